"""Sources and sinks: tables derived from the given ones are written, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import documents as text_table
from hazegrid.catalog.tables import COORDINATES, EV, HOURLY, SITE_COORDINATES, coordinates, hourly, observations, table
from hazegrid.operators import quality
from hazegrid.session import shared_path
from hazegrid.sources import documents, external, sites, tables

SITE_NUMBER = "CASE site_id " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, (s, _, _) in enumerate(SITE_COORDINATES)) + " END"


@query(
    "a1_site_csv",
    f"""WITH {HOURLY} SELECT {SITE_NUMBER} AS site_id, "timestamp", year("timestamp") AS "year", hour("timestamp") AS "hour",
      o3 AS "O3_forecast", no2 AS "NO2_target", CAST(NULL AS DOUBLE) AS "NO2_satellite", 'train' AS dataset_split FROM hourly""",
)
def a1_site_csv(spark, folder):
    path = shared_path(spark, "site-csv")
    hours = hourly(spark, folder).withColumn("number", F.expr(SITE_NUMBER))
    moment = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}
    values = {"O3_forecast": F.col("o3"), "NO2_target": F.col("no2"), "O3_target": F.col("o3")}
    columns = [
        moment[f.name]("timestamp").cast("double").alias(f.name)
        if f.name in moment
        else values.get(f.name, F.lit(None).cast("double")).alias(f.name)
        for f in S.site_csv_schema(True).fields
    ]
    named = hours.select(*columns, F.concat(F.lit("site_"), "number", F.lit("_train_data.csv")).alias("file"))
    named.write.partitionBy("file").option("header", "true").csv(path)
    read = sites.read_site_csv(spark, path, "train", pattern="file=site_*_{ending}.csv")
    return read.select("site_id", "timestamp", "year", "hour", "O3_forecast", "NO2_target", "NO2_satellite", "dataset_split")


@query(
    "a2_site_coordinates",
    """SELECT n_nationkey AS site_id, 20 + n_nationkey * 0.5::DOUBLE AS latitude, 70 + n_regionkey * 0.25::DOUBLE AS longitude FROM nation""",
)
def a2_site_coordinates(spark, folder):
    path = shared_path(spark, "coordinates")
    written = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias(" Site"),
        (20 + F.col("n_nationkey") * 0.5).alias("Latitude N "),
        (70 + F.col("n_regionkey") * 0.25).alias(" Longitude E"),
    )
    written.write.option("sep", "\t").option("header", "true").csv(path)
    return sites.read_site_coordinates(spark, path)


def payloads(spark, folder):
    """One landed payload per site and day out of the hourly table, some days without any hours."""
    hours = hourly(spark, folder).withColumns(
        {"day": F.to_date("timestamp"), "time": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm")}
    )
    point = F.struct("time", F.col("o3").alias("ozone"), F.col("no2").alias("nitrogen_dioxide"))
    daily = hours.groupBy("site_id", "day").agg(F.sort_array(F.collect_list(point)).alias("p"))
    measured = {name: F.col(f"p.{name}") for name in ("time", "ozone", "nitrogen_dioxide")}
    nothing = F.transform("p", lambda _: F.lit(None).cast("double"))
    hourly_part = F.struct(
        *[column.alias(name) for name, column in measured.items()],
        F.col("p.ozone").alias("us_aqi"),
        nothing.alias("european_aqi"),
    )
    last = F.element_at("p", -1)
    current = F.struct(last["time"].alias("time"), last["ozone"].alias("ozone"), last["nitrogen_dioxide"].alias("us_aqi"))
    return daily.select("site_id", "day", hourly_part.alias("hourly"), current.alias("current"))


@query(
    "a3_external_payload",
    f"""WITH {HOURLY} SELECT site_id, "timestamp", o3 AS external_ozone, no2 AS external_nitrogen_dioxide, o3 AS external_us_aqi,
      CAST(NULL AS DOUBLE) AS external_european_aqi FROM hourly""",
)
def a3_external_payload(spark, folder):
    path = shared_path(spark, "payloads")
    payloads(spark, folder).drop("day").write.json(path)
    return external.payload_hours(external.read_external_payload(spark, path))


@query(
    "a4_external_current",
    f"""WITH {HOURLY} SELECT site_id, "timestamp", o3, 0.0::DOUBLE AS no2, no2 AS us_aqi, 0.0::DOUBLE AS european_aqi FROM hourly
      QUALIFY row_number() OVER (PARTITION BY site_id, date_trunc('day', "timestamp") ORDER BY "timestamp" DESC) = 1""",
)
def a4_external_current(spark, folder):
    path = shared_path(spark, "payloads")
    payloads(spark, folder).drop("day").write.json(path)
    return external.payload_current(external.read_external_payload(spark, path))


@query(
    "a6_feature_tables",
    f"""WITH {EV} SELECT event_id, site_id, "timestamp", o3, dataset_split FROM ev WHERE dataset_split = 'unseen'""",
)
def a6_feature_tables(spark, folder):
    path = shared_path(spark, "features")
    tables.write_features(observations(spark, folder).drop("no2"), path)
    return tables.read_features(spark, path, "unseen")


@query(
    "a7_external_history",
    f"""WITH {HOURLY}, d AS (SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp", round(avg(o3), 6) AS external_ozone
        FROM ev WHERE dataset_split = 'train' GROUP BY 1, 2)
      SELECT site_id, "timestamp", external_ozone, 'first' AS data_source FROM d WHERE site_id IN ('click', 'error')
      UNION ALL SELECT site_id, "timestamp", o3, 'later' FROM hourly WHERE site_id NOT IN ('click', 'error')""",
)
def a7_external_history(spark, folder):
    """Two sites are stored first; the later load of all sites must leave them alone."""
    path = shared_path(spark, "external")
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")
    train = observations(spark, folder).where("dataset_split = 'train'").groupBy("site_id", hour)
    first = train.agg(F.round(F.avg("o3"), 6).alias("external_ozone")).withColumn("data_source", F.lit("first"))
    external.upsert_external(first.where("site_id IN ('click', 'error')"), path)
    later = hourly(spark, folder).select(
        "site_id", "timestamp", F.col("o3").alias("external_ozone"), F.lit("later").alias("data_source")
    )
    external.upsert_external(later, path)
    return external.read_external(spark, path)


@query(
    "a8_json_documents",
    f"""WITH {EV}, {COORDINATES} SELECT e.site_id, count(*) FILTER (WHERE dataset_split = 'train') AS train_rows,
        count(*) FILTER (WHERE dataset_split = 'unseen') AS unseen_rows, min(latitude) AS latitude
      FROM ev e JOIN coords c ON e.site_id = c.site_id GROUP BY 1""",
)
def a8_json_documents(spark, folder):
    path = shared_path(spark, "summary")
    df = observations(spark, folder).join(coordinates(spark), "site_id", "left")
    tables.write_documents(quality.site_summary(df), path)
    read = spark.read.schema("site_id STRING, train_rows BIGINT, unseen_rows BIGINT, latitude DOUBLE").json(path)
    return read


@query(
    "a9_document_chunks",
    r"""SELECT doc_id, length(t) AS n, md5(t) AS text FROM (
      SELECT doc_id, substring(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+', ' ', 'g')), 1, 3500) AS t FROM documents) WHERE t <> ''""",
)
def a9_document_chunks(spark, folder):
    chunks = documents.document_chunks(text_table(spark, folder).select("doc_id", "text"))
    return chunks.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("text"))


@query(
    "a10_publish_profile",
    f"""WITH {EV} SELECT site_id, round(avg(o3), 6) AS o3 FROM ev WHERE dataset_split = 'unseen' GROUP BY 1""",
)
def a10_publish_profile(spark, folder):
    book = tables.ProfileBook(spark, shared_path(spark, "profiles"))
    df = observations(spark, folder)
    for profile, split in (("zip_only", "train"), ("external_augmented", "unseen")):
        means = df.where(F.col("dataset_split") == split).groupBy("site_id").agg(F.round(F.avg("o3"), 6).alias("o3"))
        book.write(profile, "features", means)
    book.publish("zip_only", ["features"])
    book.publish("external_augmented", ["features"])
    # Another session reads what was published.
    return tables.ProfileBook(spark.newSession(), book.root).active("features")


@query(
    "a11_external_fetch_plan",
    f"""WITH {EV} SELECT site_id, CAST(greatest(CAST(min("timestamp") AS DATE), DATE '2022-08-01') AS VARCHAR) AS start_date,
      CAST(CAST(max("timestamp") AS DATE) AS VARCHAR) AS end_date FROM ev GROUP BY 1""",
)
def a11_external_fetch_plan(spark, folder):
    plan = external.external_fetch_plan(observations(spark, folder))
    return plan.withColumns({name: F.col(name).cast("string") for name in ("start_date", "end_date")})


@query(
    "g2_union_of_files",
    f"WITH {EV} SELECT site_id, count(*) AS n, round(sum(o3), 4) AS o3 FROM ev GROUP BY 1",
)
def g2_union_of_files(spark, folder):
    """Per-site folders are one table again when read together."""
    path = shared_path(spark, "per-site")
    observations(spark, folder).select("site_id", "o3").write.partitionBy("site_id").parquet(path)
    return spark.read.parquet(path).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o3"), 4).alias("o3"))
