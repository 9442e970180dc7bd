"""Column names and schemas of the site-hour tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

SITE = "site_id"
TIMESTAMP = "timestamp"
SPLIT = "dataset_split"
TRAIN = "train"
UNSEEN = "unseen"

TEMPORAL_COLUMNS = ["year", "month", "day", "hour"]
FORECAST_COLUMNS = [
    "O3_forecast",
    "NO2_forecast",
    "T_forecast",
    "q_forecast",
    "u_forecast",
    "v_forecast",
    "w_forecast",
]
SATELLITE_COLUMNS = ["NO2_satellite", "HCHO_satellite", "ratio_satellite"]
TARGET_COLUMNS = ["O3_target", "NO2_target"]
EXTERNAL_COLUMNS = [
    "external_ozone",
    "external_nitrogen_dioxide",
    "external_us_aqi",
    "external_european_aqi",
]
CYCLIC_COLUMNS = ["hour_sin", "hour_cos", "doy_sin", "doy_cos", "is_weekend"]

# Columns that never become model features, whatever their type.
NON_FEATURE_COLUMNS = [SPLIT, TIMESTAMP, *TEMPORAL_COLUMNS, "data_source"]

# Hourly lag steps and rolling window lengths, counted in rows.
LAG_STEPS = [1, 3, 6, 12, 24, 48, 72]
MAX_LOOKBACK = 168
ROLLING_WINDOWS = [6, 24, 72]


def site_csv_schema(with_targets: bool) -> T.StructType:
    names = [*TEMPORAL_COLUMNS, *FORECAST_COLUMNS, *SATELLITE_COLUMNS]
    if with_targets:
        names += TARGET_COLUMNS
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


COORDINATES_SCHEMA = T.StructType(
    [
        T.StructField("Site", T.IntegerType()),
        T.StructField("Latitude N", T.DoubleType()),
        T.StructField("Longitude E", T.DoubleType()),
    ]
)

EXTERNAL_MEASURES = ["ozone", "nitrogen_dioxide", "us_aqi", "european_aqi"]

EXTERNAL_PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField(SITE, T.StringType()),
        T.StructField(
            "hourly",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(name, T.ArrayType(T.DoubleType())) for name in EXTERNAL_MEASURES]
            ),
        ),
        T.StructField(
            "current",
            T.StructType(
                [T.StructField("time", T.StringType())]
                + [T.StructField(name, T.DoubleType()) for name in EXTERNAL_MEASURES]
            ),
        ),
    ]
)
