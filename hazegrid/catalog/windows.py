"""Window operators on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import EV, HOURLY, hourly, observations, stored_hours
from hazegrid.operators import features, forecast, quality, resample, series
from hazegrid.operators.features import FeatureSpec

SPEC = FeatureSpec(
    tie_break=("event_id",), lag_columns=("o3", "no2"), sparse_columns=(), targets=(), excluded=("event_id",)
)
ROW_ORDER = '(PARTITION BY site_id ORDER BY "timestamp", event_id)'
LAGS = [1, 3, 6, 12, 24, 48, 72, 168]


def _sql_over(expression: str, frame: str = "") -> str:
    return f'{expression} OVER (PARTITION BY site_id ORDER BY "timestamp", event_id {frame})'


@query(
    "e1_lags",
    f"WITH {EV} SELECT event_id, site_id, "
    + ", ".join(f"{_sql_over(f'lag({c}, {n})')} AS {c}_lag_{n}" for c in ("o3", "no2") for n in LAGS)
    + " FROM ev",
)
def e1_lags(spark, folder):
    df = observations(spark, folder).select("event_id", "site_id", "timestamp", "o3", "no2")
    return features.add_window_features(df, SPEC, means=False, deviations=False).drop("timestamp", "o3", "no2")


@query(
    "e2_rolling_means",
    f"WITH {EV} SELECT event_id, site_id, "
    + ", ".join(
        f"round({_sql_over(f'avg({c})', f'ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING')}, 8) AS {c}_roll_mean_{w}"
        for c in ("o3", "no2")
        for w in (6, 24, 72)
    )
    + " FROM ev",
)
def e2_rolling_means(spark, folder):
    df = observations(spark, folder).select("event_id", "site_id", "timestamp", "o3", "no2")
    wide = features.add_window_features(df, SPEC, lags=False, deviations=False)
    names = [f"{c}_roll_mean_{w}" for c in ("o3", "no2") for w in (6, 24, 72)]
    return wide.select("event_id", "site_id", *[F.round(name, 8).alias(name) for name in names])


@query(
    "e3_rolling_deviations",
    f"WITH {EV} SELECT event_id, site_id, "
    + ", ".join(
        f"round(coalesce({_sql_over(f'stddev_samp({c})', f'ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING')}, 0), 6)"
        f" AS {c}_roll_std_{w}"
        for c in ("o3", "no2")
        for w in (6, 24, 72)
    )
    + " FROM ev",
)
def e3_rolling_deviations(spark, folder):
    df = observations(spark, folder).select("event_id", "site_id", "timestamp", "o3", "no2")
    wide = features.add_window_features(df, SPEC, lags=False, means=False)
    names = [f"{c}_roll_std_{w}" for c in ("o3", "no2") for w in (6, 24, 72)]
    return wide.select("event_id", "site_id", *[F.round(name, 6).alias(name) for name in names])


MASKED = "CASE WHEN event_id % 7 = 0 THEN o3 END"


@query(
    "e4_sparse_fill",
    f"""WITH {EV}, masked AS (SELECT event_id, site_id, "timestamp", {MASKED} AS sparse FROM ev)
    SELECT event_id, site_id, coalesce(
      last_value(sparse IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY "timestamp", event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(sparse IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY "timestamp", event_id
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS sparse
    FROM masked""",
)
def e4_sparse_fill(spark, folder):
    df = observations(spark, folder).select(
        "event_id", "site_id", "timestamp", F.when(F.col("event_id") % 7 == 0, F.col("o3")).alias("sparse")
    )
    spec = FeatureSpec(tie_break=("event_id",), lag_columns=(), sparse_columns=("sparse",), targets=())
    return features.fill_sparse(df, spec).drop("timestamp")


@query(
    "e5_interpolated_hours",
    f"""WITH {EV}, means AS (
      SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp", avg(o3) AS o3, avg(no2) AS no2
      FROM ev GROUP BY 1, 2),
    grid AS (SELECT site_id, unnest(generate_series(min("timestamp"), max("timestamp"), INTERVAL 1 HOUR)) AS "timestamp"
      FROM means GROUP BY 1),
    joined AS (SELECT g.site_id, g."timestamp", m.o3, m.no2, epoch(g."timestamp") AS secs,
        CASE WHEN m.o3 IS NOT NULL THEN epoch(g."timestamp") END AS known
      FROM grid g LEFT JOIN means m ON g.site_id = m.site_id AND g."timestamp" = m."timestamp"),
    near AS (SELECT *,
        last_value(known IGNORE NULLS) OVER b AS ta, last_value(o3 IGNORE NULLS) OVER b AS oa,
        last_value(no2 IGNORE NULLS) OVER b AS na,
        first_value(known IGNORE NULLS) OVER f AS tb, first_value(o3 IGNORE NULLS) OVER f AS ob,
        first_value(no2 IGNORE NULLS) OVER f AS nb
      FROM joined WINDOW
        b AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY site_id ORDER BY "timestamp" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT site_id, "timestamp",
      round(coalesce(o3, oa + (ob - oa) * (secs - ta) / (tb - ta), oa, ob), 6) AS o3,
      round(coalesce(no2, na + (nb - na) * (secs - ta) / (tb - ta), na, nb), 6) AS no2
    FROM near""",
)
def e5_interpolated_hours(spark, folder):
    filled = resample.interpolate_hourly(observations(spark, folder), ["o3", "no2"])
    return filled.select("site_id", "timestamp", F.round("o3", 6).alias("o3"), F.round("no2", 6).alias("no2"))


@query(
    "e6_chronological_split",
    f"""WITH {EV}, numbered AS (SELECT event_id, site_id,
        row_number() OVER {ROW_ORDER} - 1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM ev)
    SELECT event_id, site_id, CASE
      WHEN i < floor(CAST(n AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE) - CAST(0.15 AS DOUBLE))) THEN 'train'
      WHEN i < floor(CAST(n AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(0.15 AS DOUBLE))) THEN 'validation'
      ELSE 'test' END AS part FROM numbered""",
)
def e6_chronological_split(spark, folder):
    df = observations(spark, folder).select("event_id", "site_id", "timestamp")
    labelled = features.chronological_split(df, 0.15, 0.15, order=("timestamp", "event_id"))
    return labelled.select("event_id", "site_id", "part")


@query(
    "e8_order_check",
    f"""WITH {EV}, steps AS (SELECT site_id,
        "timestamp" < lag("timestamp") OVER (PARTITION BY site_id ORDER BY event_id) AS back FROM ev)
    SELECT site_id, coalesce(bool_or(back), false) AS out_of_order FROM steps GROUP BY site_id""",
)
def e8_order_check(spark, folder):
    return quality.order_check(observations(spark, folder), sequence="event_id")


@query(
    "e9_sequences",
    f"""WITH {EV}, lagged AS (SELECT event_id, site_id, o3 AS target, """
    + ", ".join(f"{_sql_over(f'lag({c}, {n})')} AS {c}{n}" for c in ("o3", "no2") for n in range(1, 7))
    + """ FROM ev)
    SELECT event_id, site_id, target, """
    + f"round({' + '.join(f'{7 - n} * o3{n}' for n in range(6, 0, -1))}, 6) AS o3_digest, "
    + f"round({' + '.join(f'{7 - n} * no2{n}' for n in range(6, 0, -1))}, 6) AS no2_digest"
    + " FROM lagged WHERE o36 IS NOT NULL",
)
def e9_sequences(spark, folder):
    df = observations(spark, folder).select("event_id", "site_id", "timestamp", "o3", "no2")
    built = features.sequences(df, ["o3", "no2"], 6, SPEC)

    def digest(slot):
        total = F.lit(0.0)
        for i in range(6):
            total = total + (i + 1) * F.get(F.get("sequence", F.lit(i)), F.lit(slot))
        return F.round(total, 6)

    return built.select(
        "event_id", "site_id", F.col("o3").alias("target"), digest(0).alias("o3_digest"), digest(1).alias("no2_digest")
    )


@query(
    "e10_latest_context",
    f"""WITH {EV}, tail AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC, event_id DESC)
        AS back FROM ev QUALIFY back <= 6)
    SELECT site_id, count(*) AS steps, round(sum((7 - back) * o3), 6) AS o3_digest,
      round(sum((7 - back) * no2), 6) AS no2_digest FROM tail GROUP BY site_id""",
)
def e10_latest_context(spark, folder):
    df = observations(spark, folder)
    context = features.latest_context(df, ["o3", "no2"], 6, order=("timestamp", "event_id"))
    steps = context.select("site_id", F.posexplode("sequence").alias("at", "vector"))
    return steps.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("steps"),
        F.round(F.sum((F.col("at") + 1) * F.get("vector", F.lit(0))), 6).alias("o3_digest"),
        F.round(F.sum((F.col("at") + 1) * F.get("vector", F.lit(1))), 6).alias("no2_digest"),
    )


FORECAST_TAIL = f"""WITH {HOURLY}, tail AS (SELECT site_id, "timestamp", o3, no2,
    row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) AS back FROM hourly QUALIFY back <= 24),
  forecast AS (SELECT site_id, "timestamp", o3, no2,
    row_number() OVER (PARTITION BY site_id ORDER BY "timestamp") AS lead_hour FROM tail)"""


@query("e7_lead_hours", f'{FORECAST_TAIL} SELECT site_id, "timestamp", o3, no2, lead_hour FROM forecast')
def e7_lead_hours(spark, folder):
    points = series.latest_rows(hourly(spark, folder), 24)
    return forecast.lead_hours(points)


@query(
    "e11_reanchored_forecast",
    f"""{FORECAST_TAIL}, anchor AS (SELECT site_id, max("timestamp") AS anchor FROM ev GROUP BY 1)
    SELECT f.site_id, lead_hour, o3, no2, anchor + lead_hour * INTERVAL 1 HOUR AS "timestamp"
    FROM forecast f JOIN anchor a ON f.site_id = a.site_id""",
)
def e11_reanchored_forecast(spark, folder):
    points = forecast.lead_hours(series.latest_rows(hourly(spark, folder), 24))
    live = observations(spark, folder)
    return forecast.reanchor(points, live)


@query(
    "e12_baseline_deltas",
    f"""WITH {HOURLY}, ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) AS back
        FROM hourly QUALIFY back <= 72)
    SELECT site_id, round(max(CASE WHEN back = 1 THEN o3 END) - avg(o3), 6) AS o3_delta,
      round(max(CASE WHEN back = 1 THEN no2 END) - avg(no2), 6) AS no2_delta FROM ranked GROUP BY site_id""",
)
def e12_baseline_deltas(spark, folder):
    hours = stored_hours(spark, folder)
    deltas = forecast.baseline_deltas(series.latest_rows(hours, 1), forecast.baseline_averages(hours))
    return deltas.select(
        "site_id", F.round("o3_delta", 6).alias("o3_delta"), F.round("no2_delta", 6).alias("no2_delta")
    )
