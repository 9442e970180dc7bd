"""Aggregations on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import COORDINATES, EV, HOURLY, coordinates, hourly, observations, table
from hazegrid.catalog.windows import FORECAST_TAIL
from hazegrid.operators import alerts, forecast, joins, metrics, quality, resample, series


@query(
    "d1_dataset_summary",
    f"""WITH {EV}, {COORDINATES} SELECT e.site_id, min(latitude) AS latitude, min(longitude) AS longitude,
        count(*) FILTER (WHERE dataset_split = 'train') AS train_rows,
        count(*) FILTER (WHERE dataset_split = 'unseen') AS unseen_rows,
        min("timestamp") FILTER (WHERE dataset_split = 'train') AS train_start,
        max("timestamp") FILTER (WHERE dataset_split = 'train') AS train_end
      FROM ev e LEFT JOIN coords c ON e.site_id = c.site_id GROUP BY 1""",
)
def d1_dataset_summary(spark, folder):
    return quality.site_summary(joins.with_coordinates(observations(spark, folder), coordinates(spark)))


@query(
    "d2_dataset_totals",
    f"""WITH {EV} SELECT count(DISTINCT site_id) FILTER (WHERE dataset_split = 'train') AS total_sites,
        count(*) FILTER (WHERE dataset_split = 'train') AS total_train_rows,
        count(*) FILTER (WHERE dataset_split = 'unseen') AS total_unseen_rows,
        'no2' AS features, 'o3' AS targets FROM ev""",
)
def d2_dataset_totals(spark, folder):
    totals = quality.dataset_totals(observations(spark, folder), ["no2"], ["o3"])
    return totals.withColumns({name: F.array_join(name, ",") for name in ("features", "targets")})


@query(
    "d3_validation_report",
    f"""WITH {EV}, k AS (SELECT site_id, date_trunc('hour', "timestamp") AS h, count(*) AS n FROM ev GROUP BY 1, 2)
      SELECT bool_or(h IS NULL) AS null_timestamps, bool_or(n > 1) AS duplicates,
        'Missing columns: [''O3_target'']' || CASE WHEN bool_or(n > 1)
          THEN '|Duplicate site_id/timestamp combinations found.' ELSE '' END AS issues, false AS passed FROM k""",
)
def d3_validation_report(spark, folder):
    df = observations(spark, folder).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    report = quality.validation_report(df, required=["site_id", "timestamp", "o3", "O3_target"])
    return report.withColumn("issues", F.array_join("issues", "|"))


@query(
    "d4_hourly_mean",
    f"""WITH {EV} SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp", round(avg(o3), 6) AS o3,
      round(avg(no2), 6) AS no2 FROM ev GROUP BY 1, 2""",
)
def d4_hourly_mean(spark, folder):
    means = resample.hourly_mean(observations(spark, folder), ["o3", "no2"])
    return means.withColumns({"o3": F.round("o3", 6), "no2": F.round("no2", 6)})


def pairs(spark, folder):
    """Price against a line in the quantity and a line in quantity and discount, as two models."""
    lines = table(spark, folder, "lineitem")
    cells = F.array(
        F.struct(F.lit("line").alias("model"), (F.col("l_quantity") * 1500.0).alias("prediction")),
        F.struct(
            F.lit("discounted").alias("model"),
            (F.col("l_quantity") * 1500.0 * (1.0 - F.col("l_discount"))).alias("prediction"),
        ),
    )
    cell = F.explode(cells).alias("cell")
    return lines.select(
        F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("truth"), cell
    ).select("target", "truth", "cell.model", "cell.prediction")


PAIRS = """pairs AS (
    SELECT 'line' AS model, l_returnflag AS target, l_extendedprice AS truth, l_quantity * 1500.0::DOUBLE AS prediction FROM lineitem
    UNION ALL SELECT 'discounted', l_returnflag, l_extendedprice, l_quantity * 1500.0::DOUBLE * (1.0::DOUBLE - l_discount) FROM lineitem),
  means AS (SELECT model, target, avg(truth) AS m FROM pairs GROUP BY 1, 2),
  sums AS (SELECT p.model, p.target, count(*) AS n, sum((prediction - truth) ** 2) AS sse, sum(abs(prediction - truth)) AS sae,
      sum((truth - m) ** 2) AS sst, sum(abs(truth - m)) AS spread
    FROM pairs p JOIN means USING (model, target) GROUP BY 1, 2)"""


@query(
    "d5_regression_metrics",
    f"""WITH {PAIRS} SELECT model, target, round(sqrt(sse / n), 4) AS rmse, round(sae / n, 4) AS mae,
      round(1 - sse / sst, 6) AS r2 FROM sums""",
)
def d5_regression_metrics(spark, folder):
    scored = metrics.regression_metrics(pairs(spark, folder))
    return scored.select(
        "model", "target", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2")
    )


@query(
    "d6_index_of_agreement",
    f"""WITH {PAIRS} SELECT model, target, round(CASE WHEN spread = 0 THEN 1.0
        WHEN sae / (2 * spread) <= 1 THEN 1 - sae / (2 * spread) ELSE 1 / (sae / (2 * spread)) - 1 END, 6) AS ria FROM sums""",
)
def d6_index_of_agreement(spark, folder):
    return metrics.regression_metrics(pairs(spark, folder)).select("model", "target", F.round("ria", 6).alias("ria"))


@query(
    "d7_residual_spread",
    f"""WITH {PAIRS} SELECT model, target, round(stddev_pop(truth - prediction), 4) AS sigma FROM pairs GROUP BY 1, 2""",
)
def d7_residual_spread(spark, folder):
    spread = metrics.residual_spread(pairs(spark, folder), ["model", "target"])
    return spread.withColumn("sigma", F.round("sigma", 4))


@query(
    "d8_active_model",
    f"""WITH {PAIRS} SELECT model, round(avg(sqrt(sse / n)), 4) AS rmse FROM sums GROUP BY 1
      ORDER BY rmse, CASE WHEN model = 'line' THEN 0 ELSE 1 END LIMIT 1""",
)
def d8_active_model(spark, folder):
    scored = metrics.regression_metrics(pairs(spark, folder))
    listed = scored.withColumn("listing", F.when(F.col("model") == "line", 0).otherwise(1))
    return metrics.active_model(listed).withColumn("rmse", F.round("rmse", 4))


@query(
    "d9_recent_history",
    f"""WITH {EV}, {COORDINATES}, tail AS (SELECT * FROM ev WHERE dataset_split = 'train'
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 168)
      SELECT c.site_id, count(t.event_id) AS count, round(avg(o3), 6) AS avg_o3, round(avg(no2), 6) AS avg_no2,
        max(o3) AS max_o3, max(no2) AS max_no2, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp
      FROM coords c LEFT JOIN tail t ON c.site_id = t.site_id GROUP BY 1""",
)
def d9_recent_history(spark, folder):
    train = observations(spark, folder).where("dataset_split = 'train'")
    stats = forecast.history_stats(train, 168, order=("timestamp", "event_id"), sites=coordinates(spark))
    return stats.withColumns({"avg_o3": F.round("avg_o3", 6), "avg_no2": F.round("avg_no2", 6)})


@query(
    "d10_forecast_peaks",
    f"""{FORECAST_TAIL} SELECT site_id, max(o3) AS peak_o3,
        arg_max(lead_hour, o3 * 1000000 - lead_hour) AS peak_o3_hour, max(no2) AS peak_no2,
        (SELECT min(f.lead_hour) FROM forecast f WHERE f.site_id = g.site_id AND f.no2 =
          (SELECT max(no2) FROM forecast h WHERE h.site_id = g.site_id)) AS peak_no2_hour
      FROM forecast g GROUP BY site_id""",
)
def d10_forecast_peaks(spark, folder):
    return forecast.peaks(forecast.lead_hours(series.latest_rows(hourly(spark, folder), 24)))


ALERTS = f"""WITH {HOURLY}, tail AS (SELECT * FROM hourly
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) <= 12),
  alerts AS (
    SELECT site_id, "timestamp", 'O3' AS pollutant, 0 AS pollutant_rank, 'Projected O3 spike exceeds configured threshold.' AS message,
      o3 AS value, 60.0::DOUBLE AS threshold, CASE WHEN o3 >= 60.0::DOUBLE * 1.2::DOUBLE THEN 'critical' ELSE 'warning' END AS severity
    FROM tail WHERE o3 >= 60
    UNION ALL
    SELECT site_id, "timestamp", 'NO2', 1, 'Projected NO2 spike exceeds configured threshold.', no2, 50.0::DOUBLE,
      CASE WHEN no2 >= 50.0::DOUBLE * 1.2::DOUBLE THEN 'critical' ELSE 'warning' END FROM tail WHERE no2 >= 50)"""


def coming_alerts(spark, folder):
    """Alerts of the last 12 hours per site, with thresholds that hourly means reach."""
    return alerts.threshold_alerts(series.latest_rows(hourly(spark, folder), 12), 60.0, 50.0)


@query(
    "d11_alert_counts",
    f"""{ALERTS}, {COORDINATES} SELECT c.site_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
        count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info
      FROM coords c LEFT JOIN alerts a ON c.site_id = a.site_id GROUP BY 1""",
)
def d11_alert_counts(spark, folder):
    return alerts.severity_counts(coming_alerts(spark, folder), coordinates(spark))


@query(
    "d12_baseline_averages",
    f"""WITH {EV} SELECT site_id, round(avg(o3), 6) AS o3_avg, round(avg(no2), 6) AS no2_avg FROM (
        SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC) <= 72)
      GROUP BY 1""",
)
def d12_baseline_averages(spark, folder):
    means = forecast.baseline_averages(observations(spark, folder), order=("timestamp", "event_id"))
    return means.withColumns({name: F.round(name, 6) for name in ("o3_avg", "no2_avg")})


@query(
    "d13_point_series",
    f"""{FORECAST_TAIL} SELECT site_id, string_agg(strftime("timestamp", '%Y-%m-%d %H:%M') || '=' ||
        CAST(CAST(round(o3 * 100) AS BIGINT) AS VARCHAR), ';' ORDER BY "timestamp") AS points FROM forecast GROUP BY 1""",
)
def d13_point_series(spark, folder):
    nested = series.nest_points(series.latest_rows(hourly(spark, folder), 24), ["o3", "no2"])
    text = F.transform(
        "points",
        lambda p: F.concat_ws(
            "=", F.date_format(p["timestamp"], "yyyy-MM-dd HH:mm"), F.round(p["o3"] * 100).cast("bigint").cast("string")
        ),
    )
    return nested.select("site_id", F.array_join(text, ";").alias("points"))


@query(
    "d14_exact_medians",
    """SELECT l_returnflag, 'l_extendedprice' AS "column", round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 'l_quantity', round(median(l_quantity), 6) FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, 'l_discount', round(median(l_discount), 6) FROM lineitem GROUP BY 1""",
)
def d14_exact_medians(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = metrics.exact_medians(lines, ["l_extendedprice", "l_quantity", "l_discount"], ["l_returnflag"])
    return found.withColumn("median", F.round("median", 6))
