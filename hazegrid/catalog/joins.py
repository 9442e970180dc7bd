"""Joins on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.projections import SESSIONS, messages, user_messages
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import COORDINATES, EV, HOURLY, coordinates, hourly, observations, stored_hours, table
from hazegrid.catalog.windows import FORECAST_TAIL
from hazegrid.operators import alerts, brief, forecast, joins, network, quality, resample, series, sessions


@query(
    "c1_site_coordinates",
    f"""WITH {EV}, {COORDINATES} SELECT e.event_id, e.site_id, c.latitude, c.longitude
      FROM ev e LEFT JOIN coords c ON e.site_id = c.site_id""",
)
def c1_site_coordinates(spark, folder):
    joined = joins.with_coordinates(observations(spark, folder), coordinates(spark))
    return joined.select("event_id", "site_id", "latitude", "longitude")


@query(
    "c2_external_context",
    f"""WITH {HOURLY}, external AS (SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp",
        round(avg(o3), 6) AS external_ozone, round(avg(no2), 6) AS external_nitrogen_dioxide, 'unseen' AS data_source
        FROM ev WHERE dataset_split = 'unseen' GROUP BY 1, 2)
      SELECT h.site_id, h."timestamp", h.o3, x.external_ozone, x.external_nitrogen_dioxide, x.data_source
      FROM hourly h LEFT JOIN external x ON h.site_id = x.site_id AND x."timestamp" = h."timestamp"
      """,
)
def c2_external_context(spark, folder):
    unseen = observations(spark, folder).where("dataset_split = 'unseen'")
    external = resample.hourly_mean(unseen, ["o3", "no2"]).select(
        "site_id",
        "timestamp",
        F.round("o3", 6).alias("external_ozone"),
        F.round("no2", 6).alias("external_nitrogen_dioxide"),
        F.lit("unseen").alias("data_source"),
    )
    return joins.with_external(hourly(spark, folder), external).drop("no2")


@query(
    "c3_site_counts",
    """WITH t AS (SELECT c_custkey AS site_id, count(*) AS train_rows FROM customer GROUP BY 1),
      u AS (SELECT o_custkey AS site_id, count(*) AS unseen_rows FROM orders GROUP BY 1)
      SELECT t.site_id, t.train_rows, coalesce(u.unseen_rows, 0) AS unseen_rows FROM t LEFT JOIN u ON t.site_id = u.site_id""",
)
def c3_site_counts(spark, folder):
    """Customers stand for sites, their orders for unseen rows; customers without orders have none."""
    known = table(spark, folder, "customer").select(F.col("c_custkey").alias("site_id"))
    return quality.site_counts(known, table(spark, folder, "orders").select(F.col("o_custkey").alias("site_id")))


@query(
    "c4_truth_with_prediction",
    f"""WITH {EV}, h AS (SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp", dataset_split,
        round(avg(o3), 6) AS o3 FROM ev GROUP BY 1, 2, 3)
      SELECT a.site_id, a."timestamp", a.o3 AS truth, b.o3 AS prediction
      FROM h a JOIN h b ON a.site_id = b.site_id AND a."timestamp" = b."timestamp"
      WHERE a.dataset_split = 'train' AND b.dataset_split = 'unseen'""",
)
def c4_truth_with_prediction(spark, folder):
    df = observations(spark, folder)
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")

    def side(split, name):
        part = df.where(F.col("dataset_split") == split)
        return part.groupBy("site_id", hour).agg(F.round(F.avg("o3"), 6).alias(name))

    return joins.truth_with_prediction(side("train", "truth"), side("unseen", "prediction"))


MODEL_ERRORS = f"""errors AS (
    SELECT CASE WHEN dataset_split = 'train' THEN 'baseline_random_forest' ELSE 'lstm' END AS model, 'O3_target' AS target,
      round(stddev_pop(o3), 6) AS sigma FROM ev GROUP BY 1, 2
    UNION ALL
    SELECT CASE WHEN dataset_split = 'train' THEN 'baseline_random_forest' ELSE 'lstm' END, 'NO2_target',
      round(stddev_pop(no2), 6) FROM ev GROUP BY 1, 2)"""


def model_errors(spark, folder):
    """A (model, target, sigma) table derived from the spread of both splits."""
    model = F.when(F.col("dataset_split") == "train", "baseline_random_forest").otherwise("lstm").alias("model")
    spread = observations(spark, folder).groupBy(model).agg(
        F.round(F.stddev_pop("o3"), 6).alias("O3_target"), F.round(F.stddev_pop("no2"), 6).alias("NO2_target")
    )
    return spread.unpivot("model", ["O3_target", "NO2_target"], "target", "sigma")


@query(
    "c5_forecast_with_errors",
    f"""{FORECAST_TAIL}, {MODEL_ERRORS},
      known AS (SELECT DISTINCT model FROM errors WHERE model = 'new_model'),
      chosen AS (SELECT target, sigma FROM errors
        WHERE model = coalesce((SELECT model FROM known), 'baseline_random_forest'))
      SELECT f.site_id, f."timestamp", f.o3, f.no2,
        (SELECT sigma FROM chosen WHERE target = 'O3_target') AS o3_sigma,
        (SELECT sigma FROM chosen WHERE target = 'NO2_target') AS no2_sigma
      FROM forecast f""",
)
def c5_forecast_with_errors(spark, folder):
    sigmas = forecast.model_errors(model_errors(spark, folder), "new_model")
    points = series.latest_rows(hourly(spark, folder), 24)
    banded = forecast.with_bands(points, sigmas)
    return banded.select(
        "site_id",
        "timestamp",
        "o3",
        "no2",
        F.round((F.col("o3_upper") - F.col("o3")) / 1.96, 6).alias("o3_sigma"),
        F.round((F.col("no2_upper") - F.col("no2")) / 1.96, 6).alias("no2_sigma"),
    )


def reports(spark, folder):
    """Each assistant message stands for a report on the user message before it."""
    rows = messages(spark, folder).where("role = 'assistant'")
    return rows.select(
        F.concat_ws("-", "session_id", "created_at").alias("report_id"), "session_id", "created_at", F.col("content").alias("payload")
    )


def steps(spark, folder):
    """Two steps per report."""
    rows = reports(spark, folder)
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    return rows.withColumn("step", step).select(
        F.concat_ws("-", "report_id", "step").alias("step_id"),
        "report_id",
        (F.col("created_at") * 2 + F.col("step")).alias("created_at"),
        F.md5(F.concat_ws("|", F.lit("step"), "payload")).alias("payload"),
    )


REPORTS = """reports AS (SELECT conv_id || '-' || turn AS report_id, conv_id AS session_id, turn AS created_at,
    text AS payload FROM conversations WHERE role = 'assistant'),
  steps AS (SELECT report_id || '-' || step AS step_id, report_id, created_at * 2 + step AS created_at,
    md5('step|' || payload) AS payload FROM reports, (VALUES (0), (1)) s(step))"""


@query(
    "c6_session_steps",
    f"""WITH {REPORTS} SELECT s.step_id, r.session_id, s.created_at, s.payload
      FROM steps s JOIN reports r ON s.report_id = r.report_id""",
)
def c6_session_steps(spark, folder):
    joined = sessions.session_steps(steps(spark, folder), reports(spark, folder))
    return sessions.newest_first(joined).select("step_id", "session_id", "created_at", "payload")


@query(
    "c7_session_detail",
    f"""WITH {REPORTS}, {SESSIONS},
      m AS (SELECT conv_id AS session_id, turn // 500 AS page, string_agg(role || ':' || text, '|' ORDER BY turn) AS t FROM conversations GROUP BY 1, 2),
      r AS (SELECT session_id, created_at // 500 AS page, string_agg(payload, '|' ORDER BY created_at DESC) AS t FROM reports GROUP BY 1, 2),
      s AS (SELECT r.session_id, s.created_at // 500 AS page, string_agg(s.payload, '|' ORDER BY s.created_at DESC) AS t
        FROM steps s JOIN reports r ON s.report_id = r.report_id GROUP BY 1, 2),
      p AS (SELECT session_id, page FROM m UNION SELECT session_id, page FROM r UNION SELECT session_id, page FROM s)
      SELECT x.session_id, CAST(p.page AS BIGINT) AS page, x.title, md5(coalesce(m.t, '')) AS messages, md5(coalesce(r.t, '')) AS reports, md5(coalesce(s.t, '')) AS steps
      FROM sessions x LEFT JOIN p ON x.session_id = p.session_id
        LEFT JOIN m ON m.session_id = p.session_id AND m.page = p.page LEFT JOIN r ON r.session_id = p.session_id AND r.page = p.page
        LEFT JOIN s ON s.session_id = p.session_id AND s.page = p.page""",
)
def c7_session_detail(spark, folder):
    said, told = messages(spark, folder), reports(spark, folder)
    taken = sessions.session_steps(steps(spark, folder), told)
    detail = sessions.session_detail(sessions.sessions_from_messages(said), said, told, taken)
    line = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    empty = F.lit("")
    return detail.select(
        "session_id",
        "page",
        "title",
        F.md5(F.coalesce(F.array_join(line, "|"), empty)).alias("messages"),
        F.md5(F.coalesce(F.array_join("reports.payload", "|"), empty)).alias("reports"),
        F.md5(F.coalesce(F.array_join("steps.payload", "|"), empty)).alias("steps"),
    )


@query(
    "c8_cascade_removal",
    f"""WITH {REPORTS}, {SESSIONS}, gone AS (SELECT session_id FROM sessions WHERE pinned AND session_id % 7 = session_id % 2),
      gone_reports AS (SELECT report_id FROM reports WHERE session_id IN (SELECT session_id FROM gone))
      SELECT 'sessions' AS kept, count(*) AS n FROM sessions WHERE session_id NOT IN (SELECT session_id FROM gone)
      UNION ALL SELECT 'messages', count(*) FROM conversations WHERE conv_id NOT IN (SELECT session_id FROM gone)
      UNION ALL SELECT 'reports', count(*) FROM reports WHERE session_id NOT IN (SELECT session_id FROM gone)
      UNION ALL SELECT 'steps', count(*) FROM steps WHERE report_id NOT IN (SELECT report_id FROM gone_reports)
      UNION ALL SELECT 'feedback', count(*) FROM reports WHERE report_id NOT IN (SELECT report_id FROM gone_reports)""",
)
def c8_cascade_removal(spark, folder):
    said, told = messages(spark, folder), reports(spark, folder)
    listed = sessions.sessions_from_messages(user_messages(spark, folder))
    # Users 0 and 1 ask to remove all pinned sessions with even and odd numbers; only their own go.
    asked = listed.where("pinned").select("session_id", F.concat(F.lit("u"), F.col("session_id") % 2).alias("user_id"))
    feedback = told.select("report_id", F.lit("useful").alias("value"))
    kept = sessions.remove_sessions(asked, listed, said, told, steps(spark, folder), feedback)
    result = None
    for name, df in kept.items():
        counted = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n")
        result = counted if result is None else result.unionByName(counted)
    return result


def places(spark, folder):
    """Users as places: their newest reading, with the two index values taken from the two measures."""
    events = table(spark, folder, "events").select(
        F.concat_ws("_", F.lit("user"), "user_id").alias("key"),
        F.col("user_id").alias("catalog_rank"),
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("value").alias("o3"),
        F.get_json_object("props", "$.k").cast("double").alias("no2"),
    )
    newest = series.latest_per_key(events, ["key"], ["timestamp", "event_id"])
    return newest.select(
        "key",
        F.col("key").alias("name"),
        F.lit("Nowhere").alias("country"),
        "catalog_rank",
        "timestamp",
        "o3",
        "no2",
        F.when(F.col("o3") >= 5, F.col("o3")).alias("us_aqi"),
        F.nullif("no2", F.lit(0.0)).alias("european_aqi"),
    )


PLACES = """places AS (SELECT 'user_' || user_id AS key, 'user_' || user_id AS name, 'Nowhere' AS country,
    user_id AS catalog_rank, ts AS "timestamp", value AS o3, no2, CASE WHEN value >= 5 THEN value END AS us_aqi,
    nullif(no2, 0) AS european_aqi
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS no2,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back = 1)),
  hot AS (SELECT * FROM places ORDER BY greatest(coalesce(us_aqi, 0), coalesce(european_aqi, 0)) DESC, catalog_rank LIMIT 1)"""


def stations(spark, folder):
    """Newest hour per site, with an index value."""
    return series.latest_rows(hourly(spark, folder), 1).withColumn("us_aqi", F.when(F.col("o3") >= 45, F.col("o3")))


STATIONS = """stations AS (SELECT site_id, "timestamp", o3, no2, CASE WHEN o3 >= 45 THEN o3 END AS us_aqi FROM hourly
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) = 1)"""


@query(
    "c9_station_city_comparison",
    f"""WITH {HOURLY}, {PLACES}, {STATIONS}
      SELECT s.site_id, h.key AS city_key, round(h.o3 - s.o3, 6) AS o3_delta, round(h.no2 - s.no2, 6) AS no2_delta,
        round(coalesce(h.us_aqi, 0) - coalesce(s.us_aqi, 0), 6) AS aqi_delta,
        CASE WHEN abs(h.o3 - s.o3) > abs(h.no2 - s.no2) THEN 'O3' ELSE 'NO2' END AS separator
      FROM stations s, hot h""",
)
def c9_station_city_comparison(spark, folder):
    compared = network.station_city_comparison(stations(spark, folder), places(spark, folder))
    rounded = {name: F.round(name, 6) for name in ("o3_delta", "no2_delta", "aqi_delta")}
    return compared.withColumns(rounded)


@query(
    "c10_hotspot_comparison",
    f"""WITH {PLACES} SELECT p.key, h.name AS hotspot, p.name = h.name AS is_hotspot,
        CASE WHEN p.name <> h.name THEN round(h.o3 - p.o3, 6) END AS o3_delta,
        CASE WHEN p.name <> h.name THEN round(h.no2 - p.no2, 6) END AS no2_delta,
        CASE WHEN p.name <> h.name THEN CASE WHEN h.o3 > p.o3 THEN h.name ELSE p.name END END AS stronger_o3,
        CASE WHEN p.name <> h.name THEN CASE WHEN h.no2 > p.no2 THEN h.name ELSE p.name END END AS stronger_no2
      FROM places p, hot h""",
)
def c10_hotspot_comparison(spark, folder):
    known = places(spark, folder)
    compared = network.hotspot_comparison(known, known)
    return compared.select(
        "key",
        "hotspot",
        "is_hotspot",
        F.round("o3_delta", 6).alias("o3_delta"),
        F.round("no2_delta", 6).alias("no2_delta"),
        "stronger_o3",
        "stronger_no2",
    )


def site_brief(spark, folder):
    hours = stored_hours(spark, folder)
    df = joins.with_coordinates(observations(spark, folder), coordinates(spark))
    summary = quality.site_summary(df).select("site_id", "latitude", "longitude", "train_rows")
    points = forecast.lead_hours(series.latest_rows(hours, 24))
    coming = series.latest_rows(hours, 12)
    current = series.latest_rows(hours, 1)
    visible = current.select(
        "site_id",
        F.when(F.col("site_id") == "click", 0.0).alias("visible_o3"),
        F.when(F.col("site_id") == "view", 88.0).alias("visible_no2"),
    )
    return brief.site_brief(
        summary,
        current,
        forecast.baseline_averages(hours),
        forecast.peaks(points),
        alerts.threshold_alerts(coming),
        places(spark, folder),
        visible,
    )


BRIEF = f"""WITH {HOURLY}, {PLACES}, {COORDINATES},
  summary AS (SELECT e.site_id, min(latitude) AS latitude, min(longitude) AS longitude, count(*) AS train_rows
    FROM ev e JOIN coords c ON e.site_id = c.site_id WHERE dataset_split = 'train' GROUP BY 1),
  back AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) AS b FROM hourly),
  base AS (SELECT site_id, avg(o3) AS o3_avg, avg(no2) AS no2_avg, max(CASE WHEN b = 1 THEN o3 END) AS live_o3,
      max(CASE WHEN b = 1 THEN no2 END) AS live_no2,
      max(CASE WHEN b <= 24 THEN o3 END) AS o3_peak, max(CASE WHEN b <= 24 THEN no2 END) AS no2_peak
    FROM back WHERE b <= 72 GROUP BY 1),
  hours AS (SELECT b.site_id, min(CASE WHEN back.o3 = b.o3_peak THEN 25 - back.b END) AS peak_o3_hour,
      min(CASE WHEN back.no2 = b.no2_peak THEN 25 - back.b END) AS peak_no2_hour
    FROM base b JOIN back ON back.site_id = b.site_id AND back.b <= 24 GROUP BY 1),
  cells AS (SELECT site_id, "timestamp", 'O3' AS pollutant, 0 AS r, o3 AS value FROM back WHERE b <= 12 AND o3 >= 100
    UNION ALL SELECT site_id, "timestamp", 'NO2', 1, no2 FROM back WHERE b <= 12 AND no2 >= 80),
  counted AS (SELECT site_id, count(*) AS alert_count FROM cells GROUP BY 1),
  top AS (SELECT site_id, pollutant FROM cells
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY value DESC, "timestamp", r) = 1),
  wide AS (SELECT s.*, o3_avg, no2_avg, o3_peak, no2_peak, peak_o3_hour, peak_no2_hour,
      coalesce(alert_count, 0) AS alert_count, pollutant,
      live_o3 AS o3_now, CASE WHEN s.site_id = 'view' THEN 88.0 ELSE live_no2 END AS no2_now
    FROM summary s LEFT JOIN base b ON s.site_id = b.site_id LEFT JOIN hours h ON s.site_id = h.site_id
      LEFT JOIN counted c ON s.site_id = c.site_id LEFT JOIN top t ON s.site_id = t.site_id)"""


@query(
    "c11_site_brief",
    f"""{BRIEF} SELECT w.site_id, w.latitude, w.longitude, train_rows, o3_now, no2_now, round(o3_avg, 6) AS o3_avg,
      round(no2_avg, 6) AS no2_avg, o3_peak, no2_peak, peak_o3_hour, peak_no2_hour,
      round(o3_now - o3_avg, 6) AS o3_delta, round(no2_now - no2_avg, 6) AS no2_delta, alert_count,
      CASE WHEN alert_count > 0 THEN pollutant WHEN abs(no2_now - no2_avg) > abs(o3_now - o3_avg) THEN 'NO2'
        WHEN greatest(o3_peak, o3_now) >= greatest(no2_peak, no2_now) THEN 'O3' ELSE 'NO2' END AS driver,
      CASE WHEN o3_peak >= 140 OR no2_peak >= 110 THEN 'High risk' WHEN o3_peak >= 95 OR no2_peak >= 70 THEN 'Elevated'
        ELSE 'Stable' END AS risk,
      h.name AS hotspot, round(h.o3 - o3_now, 6) AS hotspot_o3_delta, round(h.no2 - no2_now, 6) AS hotspot_no2_delta,
      h.us_aqi AS hotspot_aqi FROM wide w, hot h""",
)
def c11_site_brief(spark, folder):
    made = site_brief(spark, folder)
    names = ["o3_avg", "no2_avg", "o3_delta", "no2_delta", "hotspot_o3_delta", "hotspot_no2_delta"]
    return made.withColumns({name: F.round(name, 6) for name in names})
