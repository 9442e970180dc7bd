"""Projections, filters and predicates on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import EV, observations, table
from hazegrid.functions import calendar
from hazegrid.operators import alerts, features, forecast, sessions
from hazegrid.sources import tables as stored


@query(
    "b1_build_timestamp",
    f"""WITH {EV} SELECT event_id, make_timestamp(year("timestamp"), month("timestamp"), day("timestamp"),
      hour("timestamp"), 0, 0) AS "timestamp" FROM ev""",
)
def b1_build_timestamp(spark, folder):
    df = observations(spark, folder)
    parts = df.select(
        "event_id",
        F.year("timestamp").cast("double").alias("year"),
        F.month("timestamp").cast("double").alias("month"),
        F.dayofmonth("timestamp").cast("double").alias("day"),
        (F.hour("timestamp") + 0.5).alias("hour"),
    )
    return parts.select("event_id", calendar.hourly_timestamp("year", "month", "day", "hour").alias("timestamp"))


@query(
    "b2_cyclic_time",
    f"""WITH {EV} SELECT event_id,
      round(sin(hour("timestamp") * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour("timestamp") * 2 * pi() / 24), 9) AS hour_cos,
      round(sin(dayofyear("timestamp") * 2 * pi() / 366), 9) AS doy_sin,
      round(cos(dayofyear("timestamp") * 2 * pi() / 366), 9) AS doy_cos FROM ev""",
)
def b2_cyclic_time(spark, folder):
    columns = calendar.calendar_columns("timestamp")
    names = ["hour_sin", "hour_cos", "doy_sin", "doy_cos"]
    return observations(spark, folder).select("event_id", *[F.round(columns[n], 9).alias(n) for n in names])


@query(
    "b3_weekend",
    f"""WITH {EV} SELECT event_id, CASE WHEN isodow("timestamp") IN (6, 7) THEN 1 ELSE 0 END AS is_weekend FROM ev""",
)
def b3_weekend(spark, folder):
    return observations(spark, folder).select("event_id", calendar.is_weekend(F.col("timestamp")).alias("is_weekend"))


def _sparse(df):
    """Readings below 20 count as missing in one column, readings of zero in the other."""
    return df.withColumns({"sparse_o3": F.when(F.col("o3") >= 20, F.col("o3")), "sparse_no2": F.nullif("no2", F.lit(0.0))})


SPARSE = f"""{EV}, sparse AS (SELECT *, CASE WHEN o3 >= 20 THEN o3 END AS sparse_o3,
    nullif(no2, 0) AS sparse_no2 FROM ev)"""


@query(
    "b4_missing_flags",
    f"""WITH {SPARSE} SELECT event_id, CASE WHEN sparse_o3 IS NULL THEN 1 ELSE 0 END AS sparse_o3_missing,
      CASE WHEN sparse_no2 IS NULL THEN 1 ELSE 0 END AS sparse_no2_missing FROM sparse""",
)
def b4_missing_flags(spark, folder):
    flagged = features.missing_flags(_sparse(observations(spark, folder)), ["sparse_o3", "sparse_no2", "not_there"])
    return flagged.select("event_id", "sparse_o3_missing", "sparse_no2_missing")


@query(
    "b5_keep_complete",
    f"""WITH {SPARSE} SELECT event_id, sparse_o3, sparse_no2, dataset_split FROM sparse
      WHERE sparse_no2 IS NOT NULL AND (sparse_o3 IS NOT NULL OR dataset_split = 'unseen')""",
)
def b5_keep_complete(spark, folder):
    kept = features.keep_complete(_sparse(observations(spark, folder)), targets=["sparse_o3"])
    return kept.select("event_id", "sparse_o3", "sparse_no2", "dataset_split")


@query(
    "b6_split_filter",
    f"""WITH {EV} SELECT event_id, site_id, "timestamp", o3, no2 FROM ev WHERE dataset_split = 'unseen'""",
)
def b6_split_filter(spark, folder):
    return features.split_rows(observations(spark, folder), "unseen").select("event_id", "site_id", "timestamp", "o3", "no2")


@query(
    "b7_feature_columns",
    f"""WITH {EV}, means AS (SELECT site_id, avg(no2) AS no2, avg(hour("timestamp")) AS hour_mean FROM ev GROUP BY 1)
      SELECT site_id, round(no2, 6) AS no2, round(hour_mean, 6) AS hour_mean FROM means""",
)
def b7_feature_columns(spark, folder):
    df = observations(spark, folder).withColumn("hour_mean", F.hour("timestamp"))
    names = features.feature_columns(df, targets=["o3"], excluded=["event_id"])
    return df.groupBy("site_id").agg(*[F.round(F.avg(name), 6).alias(name) for name in names])


@query(
    "b8_align_to_model",
    f"""WITH {EV} SELECT event_id, o3, no2, CAST(0 AS DOUBLE) AS wind_u, CAST(0 AS DOUBLE) AS wind_v FROM ev""",
)
def b8_align_to_model(spark, folder):
    metadata = {"feature_columns": ["o3"], "model_feature_columns": {"forest": ["o3", "no2", "wind_u", "wind_v"]}}
    columns = forecast.model_columns(metadata, "forest")
    return forecast.align_to_model(observations(spark, folder), columns).select("event_id", *columns)


@query(
    "b9_observation_projection",
    f"""WITH {EV} SELECT "timestamp", site_id, o3 AS "O3_target", no2 AS "NO2_target" FROM ev
      WHERE site_id = 'click' AND dataset_split = 'train'""",
)
def b9_observation_projection(spark, folder):
    df = observations(spark, folder).withColumnsRenamed({"o3": "O3_target", "no2": "NO2_target"})
    return stored.observation_frame(df, "click", order=None)


@query(
    "b10_threshold_predicate",
    f"WITH {EV} SELECT event_id, site_id, o3, no2 FROM ev WHERE o3 >= 100 OR no2 >= 80",
)
def b10_threshold_predicate(spark, folder):
    return alerts.exceedances(observations(spark, folder)).select("event_id", "site_id", "o3", "no2")


def messages(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), "role", F.col("text").alias("content")
    )


def user_messages(spark, folder):
    """Conversations are dealt to seven users."""
    return messages(spark, folder).withColumn("user_id", F.concat(F.lit("u"), F.col("session_id") % 7))


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
INTENT = """CASE
  WHEN regexp_matches(lower({0}), 'alert|threshold|warning|critical|risk') THEN 'alert'
  WHEN regexp_matches(lower({0}), 'dataset|training|trained|features|columns|data') THEN 'dataset'
  WHEN regexp_matches(lower({0}), 'compare|city|global|india|network|hotspot') THEN 'comparison'
  WHEN regexp_matches(lower({0}), 'forecast|future|next|24|peak|spike') THEN 'forecast'
  WHEN regexp_matches(lower({0}), 'why|anomaly|rise|rising|drop|high|low') THEN 'diagnostic'
  ELSE 'brief' END"""
CLEAN = f"regexp_replace(split_part({{0}}, E'\\n\\nContext:', 1), '^{SPACE}+|{SPACE}+$', '', 'g')"
TITLE = (
    f"CASE WHEN trim(regexp_replace({{0}}, '{SPACE}+', ' ', 'g')) = '' THEN 'New research session' "
    f"ELSE substring(trim(regexp_replace({{0}}, '{SPACE}+', ' ', 'g')), 1, 72) END"
)


def _with(template: str, expression: str) -> str:
    return template.replace("{0}", expression)


SESSIONS = f"""sessions AS (SELECT session_id, {_with(TITLE, 'q')} AS title, {_with(INTENT, 'q')} AS mode, pinned,
    updated_at, tags FROM (
  SELECT conv_id AS session_id,
    {_with(CLEAN, "coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '')")} AS q,
    bool_or(role = 'system') AS pinned, max(turn) AS updated_at, list_sort(list(DISTINCT role)) AS tags
  FROM conversations GROUP BY conv_id))"""


@query(
    "b11_session_search",
    f"""WITH {SESSIONS} SELECT session_id, title, mode FROM sessions
      WHERE contains(lower(title), 'sys') OR contains(lower(mode), 'sys') OR
        len(list_filter(tags, lambda t: contains(lower(t), 'sys'))) > 0""",
)
def b11_session_search(spark, folder):
    found = sessions.search_sessions(sessions.sessions_from_messages(messages(spark, folder)), "  SyS ")
    return found.select("session_id", "title", "mode")


@query(
    "a5_scan_site",
    f"""WITH {EV} SELECT "timestamp", site_id, o3 FROM ev WHERE site_id = 'view' AND dataset_split = 'unseen'""",
)
def a5_scan_site(spark, folder):
    return stored.scan_site(observations(spark, folder), "view", "unseen", ["o3", "site_id"])
