"""Orders, limits and top-k on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.aggregates import ALERTS, coming_alerts
from hazegrid.catalog.joins import PLACES, REPORTS, places, reports, steps
from hazegrid.catalog.projections import SESSIONS, messages, user_messages
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import documents as text_table
from hazegrid.catalog.tables import EV, hourly, observations, table
from hazegrid.catalog.windows import FORECAST_TAIL
from hazegrid.functions import risk
from hazegrid.operators import alerts, forecast, network, retrieval, series, sessions
from hazegrid.session import materialize


@query(
    "f1_canonical_order",
    f"""WITH {EV} SELECT event_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", event_id) - 1
      AS position FROM ev""",
)
def f1_canonical_order(spark, folder):
    ordered = series.index_rows(observations(spark, folder), ["site_id"], ["timestamp", "event_id"])
    return ordered.select("event_id", "site_id", F.col(series.ROW).alias("position"))


@query(
    "f2_history_tail",
    f"""WITH {EV} SELECT event_id, site_id, "timestamp", o3, no2 FROM ev WHERE dataset_split = 'train'
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 168""",
)
def f2_history_tail(spark, folder):
    train = observations(spark, folder).where("dataset_split = 'train'")
    return series.latest_rows(train, 168, order=("timestamp", "event_id")).drop("dataset_split")


@query(
    "f3_ordered_alerts",
    f"""{ALERTS} SELECT site_id, "timestamp", pollutant, severity, message, value, threshold,
      row_number() OVER (ORDER BY "timestamp", site_id, pollutant_rank) AS place FROM alerts""",
)
def f3_ordered_alerts(spark, folder):
    listed = alerts.ordered_alerts(coming_alerts(spark, folder))
    ordered = series.index_rows(listed.withColumn("all", F.lit(0)), ["all"], ["timestamp", "site_id", "pollutant_rank"])
    return ordered.select(
        "site_id", "timestamp", "pollutant", "severity", "message", "value", "threshold", (F.col(series.ROW) + 1).alias("place")
    )


@query(
    "f4_network_hotspots",
    f"""WITH {PLACES} SELECT key, catalog_rank, o3, no2, us_aqi, european_aqi,
        greatest(coalesce(us_aqi, 0), coalesce(european_aqi, 0)) AS pressure
      FROM places ORDER BY pressure DESC, catalog_rank LIMIT 8""",
)
def f4_network_hotspots(spark, folder):
    return network.hotspots(places(spark, folder)).drop("name", "country", "timestamp")


DEPTH = "CASE item_id % 3 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' ELSE 'deep' END"


def evidence_queries(spark, folder):
    depth = F.element_at(F.array(F.lit("quick"), F.lit("standard"), F.lit("deep")), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text", depth.alias("depth"))


def evidence_corpus(spark, folder):
    """Documents; those labelled good are more credible."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return (
        text_table(spark, folder)
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("source_id"),
            "text",
            F.col("source").alias("source_type"),
            F.when(F.col("quality") == 1, 0.9).otherwise(0.7).alias("credibility"),
        )
    )


SPACES = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower(text), '{SPACES}'), lambda t: t <> ''))"
CORPUS = """corpus AS (SELECT doc_id AS source_id, text, source AS source_type,
    CASE WHEN quality = 1 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS credibility
  FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS quality FROM labels GROUP BY 1) ON d = doc_id)"""
RANKED = f"""{CORPUS}, q AS (SELECT item_id AS query_id, {DEPTH} AS depth, {TOKENS} AS a FROM benchmark),
  s AS (SELECT source_id, credibility, {TOKENS} AS b FROM corpus),
  pairs AS (SELECT query_id, depth, source_id, credibility, CASE WHEN len(a) > 0 AND len(b) > 0
      THEN len(list_intersect(a, b)) / (sqrt(len(a)) * sqrt(len(b))) ELSE 0 END AS similarity FROM q, s),
  ranked AS (SELECT query_id, depth, source_id, similarity, similarity + credibility * 0.25::DOUBLE AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY similarity + credibility * 0.25::DOUBLE DESC, source_id) AS rank
    FROM pairs QUALIFY rank <= CASE depth WHEN 'quick' THEN 6 WHEN 'standard' THEN 10 ELSE 14 END)"""


@query(
    "f5_evidence_ranking",
    f"""WITH {RANKED} SELECT query_id, source_id, round(similarity, 9) AS similarity, round(score, 9) AS score, rank FROM ranked""",
)
def f5_evidence_ranking(spark, folder):
    ranked = retrieval.rank_evidence(evidence_queries(spark, folder), evidence_corpus(spark, folder))
    return ranked.withColumns({"similarity": F.round("similarity", 9), "score": F.round("score", 9)})


@query(
    "f6_pinned_shortlist",
    f"""WITH {RANKED}, cut AS (SELECT query_id, source_id, rank,
        CASE depth WHEN 'quick' THEN 4 WHEN 'standard' THEN 6 ELSE 9 END AS keep,
        rank = query_id % 14 + 1 AS pinned FROM ranked)
      SELECT query_id, source_id, place FROM (SELECT query_id, source_id, keep,
        row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pinned AND rank > keep THEN 0 ELSE rank END) AS place FROM cut)
      WHERE place <= keep""",
)
def f6_pinned_shortlist(spark, folder):
    asked = evidence_queries(spark, folder)
    ranked = materialize(retrieval.rank_evidence(asked, evidence_corpus(spark, folder)), "ranked")
    pins = ranked.where(F.col("rank") == F.col("query_id") % 14 + 1).select("query_id", "source_id")
    return retrieval.shortlist(ranked, asked, pins).select("query_id", "source_id", "place")


@query(
    "f7_session_list",
    f"""WITH {SESSIONS} SELECT 'u' || session_id % 7 AS user_id, session_id, title, mode, pinned, updated_at,
      row_number() OVER (PARTITION BY session_id % 7 ORDER BY pinned DESC, updated_at DESC, session_id) AS place FROM sessions""",
)
def f7_session_list(spark, folder):
    listed = sessions.sessions_from_messages(user_messages(spark, folder)).withColumns(
        {"_unpinned": ~F.col("pinned"), "_age": -F.col("updated_at")}
    )
    ordered = series.index_rows(listed, ["user_id"], ["_unpinned", "_age", "session_id"])
    return sessions.session_list(ordered).select(
        "user_id", "session_id", "title", "mode", "pinned", "updated_at", (F.col(series.ROW) + 1).alias("place")
    )


@query(
    "f8_forecast_pulse",
    f"""{FORECAST_TAIL}, scored AS (SELECT *, o3 * 0.65::DOUBLE + no2 * 0.35::DOUBLE AS score FROM forecast)
      SELECT site_id, "timestamp", lead_hour, round(score, 6) AS score,
        CASE WHEN o3 >= 140 OR no2 >= 110 THEN 'High risk' WHEN o3 >= 95 OR no2 >= 70 THEN 'Elevated' ELSE 'Stable' END AS severity,
        row_number() OVER (PARTITION BY site_id ORDER BY score DESC, lead_hour) AS pulse_rank
      FROM scored QUALIFY pulse_rank <= 4""",
)
def f8_forecast_pulse(spark, folder):
    points = forecast.lead_hours(series.latest_rows(hourly(spark, folder), 24))
    strongest = forecast.pulse(points)
    return strongest.select("site_id", "timestamp", "lead_hour", F.round("score", 6).alias("score"), "severity", "pulse_rank")


@query(
    "f9_lead_alert",
    f"""{ALERTS} SELECT site_id, "timestamp", pollutant, severity, value FROM alerts
      QUALIFY row_number() OVER (PARTITION BY site_id
        ORDER BY CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, "timestamp", pollutant_rank) = 1""",
)
def f9_lead_alert(spark, folder):
    lead = alerts.lead_alert(coming_alerts(spark, folder))
    return lead.select("site_id", "timestamp", "pollutant", "severity", "value")


@query(
    "f9_first_alerts",
    f"""{ALERTS} SELECT site_id, "timestamp", pollutant, value,
        row_number() OVER (PARTITION BY site_id ORDER BY "timestamp", pollutant_rank) AS place FROM alerts QUALIFY place <= 8""",
)
def f9_first_alerts(spark, folder):
    return alerts.first_alerts(coming_alerts(spark, folder), 8).select("site_id", "timestamp", "pollutant", "value", "place")


@query(
    "f10_highest_alert",
    f"""{ALERTS} SELECT site_id, pollutant, value, threshold, severity FROM alerts
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY value DESC, "timestamp", pollutant_rank) = 1""",
)
def f10_highest_alert(spark, folder):
    highest = alerts.highest_alert(coming_alerts(spark, folder))
    return highest.select("site_id", "pollutant", "value", "threshold", "severity")


ANOMALIES = f"""WITH {EV},
  seen AS (
    (SELECT *, 0 AS phase_rank FROM ev WHERE dataset_split = 'train'
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 24)
    UNION ALL
    (SELECT *, 1 FROM ev WHERE dataset_split = 'unseen'
      QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 24)),
  limited AS (SELECT *, greatest(95.0::DOUBLE, avg(o3) OVER w * 1.35::DOUBLE) AS lo, greatest(70.0::DOUBLE, avg(no2) OVER w * 1.35::DOUBLE) AS ln
    FROM seen WINDOW w AS (PARTITION BY site_id)),
  found AS (
    SELECT site_id, event_id, "timestamp", phase_rank, 'O3' AS pollutant, 0 AS pollutant_rank, o3 AS value FROM limited WHERE o3 > lo
    UNION ALL SELECT site_id, event_id, "timestamp", phase_rank, 'NO2', 1, no2 FROM limited WHERE no2 > ln)"""


def anomalies(spark, folder):
    df = observations(spark, folder)
    return forecast.anomalies(
        df.where("dataset_split = 'train'"), df.where("dataset_split = 'unseen'"), order=("timestamp", "event_id")
    )


@query(
    "f11_last_anomalies",
    f"""{ANOMALIES} SELECT site_id, event_id, "timestamp", pollutant, value FROM found
      QUALIFY row_number() OVER (PARTITION BY site_id
        ORDER BY phase_rank DESC, "timestamp" DESC, event_id DESC, pollutant_rank DESC) <= 8""",
)
def f11_last_anomalies(spark, folder):
    last = forecast.last_anomalies(anomalies(spark, folder), order=("timestamp", "event_id"))
    return last.select("site_id", "event_id", "timestamp", "pollutant", "value")


@query(
    "f12_latest_per_key",
    """SELECT event_id, user_id, ts AS "timestamp", value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def f12_latest_per_key(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").alias("timestamp"), "value")
    return series.latest_per_key(events, ["user_id"], ["timestamp", "event_id"])


@query(
    "f13_recent_messages",
    """SELECT conv_id AS session_id, turn AS created_at, role, text AS content FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""",
)
def f13_recent_messages(spark, folder):
    return sessions.recent_messages(messages(spark, folder))


@query(
    "f13_newest_steps",
    f"""WITH {REPORTS} SELECT r.session_id, s.step_id, s.created_at FROM steps s JOIN reports r ON s.report_id = r.report_id
      QUALIFY row_number() OVER (PARTITION BY r.session_id ORDER BY s.created_at DESC) <= 8""",
)
def f13_newest_steps(spark, folder):
    joined = sessions.session_steps(steps(spark, folder), reports(spark, folder))
    return sessions.newest_steps(joined).select("session_id", "step_id", "created_at")


@query(
    "f13_latest_query",
    """SELECT conv_id AS session_id, text AS latest_query FROM conversations WHERE role = 'assistant'
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def f13_latest_query(spark, folder):
    return sessions.latest_report_query(reports(spark, folder).withColumnRenamed("payload", "query"))


@query(
    "entry_site_alerts",
    f"""{ALERTS} SELECT a.site_id, a."timestamp", pollutant, severity, value, threshold,
        CASE WHEN o3 >= 140 OR no2 >= 110 THEN 'High risk' WHEN o3 >= 95 OR no2 >= 70 THEN 'Elevated' ELSE 'Stable' END AS risk
      FROM alerts a JOIN tail t ON a.site_id = t.site_id AND a."timestamp" = t."timestamp"
      """,
)
def entry_site_alerts(spark, folder):
    """Hourly means, last 12 hours per site, thresholds, risk, canonical order."""
    points = series.latest_rows(hourly(spark, folder), 12)
    labelled = points.withColumn("risk", risk.risk_label(F.col("o3"), F.col("no2")))
    ordered = alerts.ordered_alerts(alerts.threshold_alerts(labelled, 60.0, 50.0, keep=["risk"]))
    return ordered.select("site_id", "timestamp", "pollutant", "severity", "value", "threshold", "risk")
