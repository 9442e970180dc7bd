"""Set operations on the registered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazegrid.catalog.projections import SESSIONS, user_messages
from hazegrid.catalog.registry import query
from hazegrid.catalog.tables import EV, hourly, observations, table
from hazegrid.catalog.windows import FORECAST_TAIL
from hazegrid.operators import forecast, joins, network, series, sessions


@query(
    "g1_combine_splits",
    f"""WITH {EV} SELECT event_id, site_id, no2, CASE WHEN dataset_split = 'train' THEN o3 END AS o3, dataset_split FROM ev""",
)
def g1_combine_splits(spark, folder):
    df = observations(spark, folder).drop("timestamp")
    return joins.combine_splits(df.where("dataset_split = 'train'"), df.where("dataset_split = 'unseen'").drop("o3"))


@query(
    "g3_timeline",
    f"""{FORECAST_TAIL}, live AS (SELECT site_id, date_trunc('hour', "timestamp") AS "timestamp", round(avg(o3), 6) AS o3,
        round(avg(no2), 6) AS no2 FROM ev WHERE dataset_split = 'unseen' GROUP BY 1, 2)
      (SELECT site_id, "timestamp", o3, no2, 'live' AS phase FROM live
        QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY "timestamp" DESC) <= 24)
      UNION ALL SELECT site_id, "timestamp", o3, no2, 'forecast' FROM forecast""",
)
def g3_timeline(spark, folder):
    unseen = observations(spark, folder).where("dataset_split = 'unseen'")
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp")
    live = unseen.groupBy("site_id", hour).agg(
        F.round(F.avg("o3"), 6).alias("o3"), F.round(F.avg("no2"), 6).alias("no2")
    )
    return forecast.timeline(live, series.latest_rows(hourly(spark, folder), 24))


def nation_catalog(spark, folder):
    """Nations of region 0 as the home catalog, all others as the global one."""
    nation = table(spark, folder, "nation")
    return nation.select(
        F.when(F.col("n_regionkey") == 0, "india").otherwise("global").alias("catalog"),
        F.col("n_nationkey").alias("key"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 0, F.floor(F.col("n_nationkey") / 5)).otherwise(F.col("n_nationkey")).alias("catalog_rank"),
    )


@query(
    "g4_network_scope",
    """SELECT n_nationkey AS key, n_name AS name, CASE WHEN n_regionkey = 0 THEN n_nationkey // 5 ELSE n_nationkey + 3 END AS scope_rank
      FROM nation WHERE n_regionkey <> 0 OR n_nationkey // 5 < 3""",
)
def g4_network_scope(spark, folder):
    return network.network_scope(nation_catalog(spark, folder), "global").select("key", "name", "scope_rank")


TIER = """CASE WHEN site_id = 'view' THEN 'fallback' WHEN site_id = 'error' AND no2 < 80 THEN 'cached'
    WHEN no2 < 50 THEN 'external' WHEN no2 < 80 THEN 'cached' ELSE 'fallback' END"""


def _tiers(df):
    """Rows dealt to three tiers; one site has no external feed, another only the fallback."""
    tier = (
        F.when(F.col("site_id") == "view", "fallback")
        .when((F.col("site_id") == "error") & (F.col("no2") < 80), "cached")
        .when(F.col("no2") < 50, "external")
        .when(F.col("no2") < 80, "cached")
        .otherwise("fallback")
    )
    dealt = df.withColumn("tier", tier)
    return {name: dealt.where(F.col("tier") == name).drop("tier") for name in ("external", "cached", "fallback")}


FALLBACK = f"""WITH {EV}, dealt AS (SELECT *, {TIER} AS tier FROM ev),
  best AS (SELECT site_id, min(CASE tier WHEN 'external' THEN 0 WHEN 'cached' THEN 1 ELSE 2 END) AS priority FROM dealt
    WHERE site_id <> 'error' OR tier <> 'external' GROUP BY 1),
  rows AS (SELECT d.site_id, d.event_id, d."timestamp", d.o3, d.no2, b.priority,
      row_number() OVER (PARTITION BY d.site_id ORDER BY d."timestamp" DESC, d.event_id DESC) AS back
    FROM dealt d JOIN best b ON d.site_id = b.site_id
      AND b.priority = CASE d.tier WHEN 'external' THEN 0 WHEN 'cached' THEN 1 ELSE 2 END QUALIFY back <= 24),
  labelled AS (SELECT *, CASE priority WHEN 0 THEN 'openmeteo' WHEN 1 THEN 'openmeteo_cache' ELSE 'simulation' END AS provider,
      CASE priority WHEN 0 THEN 'Open-Meteo real-time air-quality feed' WHEN 1 THEN 'Cached Open-Meteo air-quality feed'
        ELSE 'Replay simulator fallback after external provider failure' END AS source_label, priority > 0 AS fallback_used FROM rows)"""


@query(
    "g5_live_with_fallback",
    f"""{FALLBACK} SELECT site_id, event_id, "timestamp", o3, no2, provider, source_label, fallback_used FROM labelled""",
)
def g5_live_with_fallback(spark, folder):
    tiers = _tiers(observations(spark, folder))
    live = network.live_with_fallback(tiers, order=("timestamp", "event_id"))
    return live.drop("priority", "dataset_split")


@query(
    "g6_network_locations",
    """WITH p AS (SELECT c_custkey AS key, c_name AS name FROM customer),
      e AS (SELECT user_id AS key, event_id, ts, value AS o3, event_type FROM events),
      both_tiers AS (SELECT *, 0 AS priority FROM e WHERE event_type = 'click'
        UNION ALL SELECT *, 1 AS priority FROM e WHERE event_type = 'error'),
      best AS (SELECT * FROM both_tiers QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, ts DESC, event_id DESC) = 1)
      SELECT p.key, p.name, best.event_id, best.o3, priority > 0 AS fallback_used FROM p JOIN best ON p.key = best.key""",
)
def g6_network_locations(spark, folder):
    """Customers stand for places, clicks for the live feed and errors for the cache; some have only one or none."""
    places = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("o3"), "event_type"
    )
    live, cached = events.where("event_type = 'click'"), events.where("event_type = 'error'")
    known = network.network_locations(places, live, cached, order=("timestamp", "event_id"))
    return known.select("key", "name", "event_id", "o3", "fallback_used")


@query(
    "g7_graph_nodes",
    f"""WITH {SESSIONS}, s AS (SELECT *, 'u' || session_id % 7 AS user_id FROM sessions)
      SELECT user_id, 'session:' || session_id AS node_id, title AS label, 'session' AS "group" FROM s
      UNION ALL SELECT DISTINCT user_id, 'mode:' || mode, upper(mode[1]) || mode[2:], 'mode' FROM s
      UNION ALL SELECT DISTINCT user_id, 'tag:' || t, t, 'tag' FROM (SELECT user_id, unnest(tags) AS t FROM s)""",
)
def g7_graph_nodes(spark, folder):
    return sessions.graph_nodes(sessions.sessions_from_messages(user_messages(spark, folder)))


@query(
    "g7_graph_edges",
    f"""WITH {SESSIONS}, s AS (SELECT *, 'u' || session_id % 7 AS user_id FROM sessions)
      SELECT user_id, 'session:' || session_id AS source, 'mode:' || mode AS target, 1.0::DOUBLE AS weight FROM s
      UNION ALL SELECT user_id, 'session:' || session_id, 'tag:' || t, 1.0::DOUBLE FROM (SELECT user_id, session_id, unnest(tags) AS t FROM s)""",
)
def g7_graph_edges(spark, folder):
    return sessions.graph_edges(sessions.sessions_from_messages(user_messages(spark, folder)))
