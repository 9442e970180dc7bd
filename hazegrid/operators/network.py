"""Live network: catalog, hot spots, comparisons, fallback tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazegrid import schema as S
from hazegrid.functions import risk
from hazegrid.operators.series import latest_rows

HOTSPOTS = 8
GLOBAL_SCOPE_INDIA = 3
RECENT_LIVE_HOURS = 24

# The places of the live network, in catalog order.
INDIA_PLACES = [
    ("delhi", "Delhi", "India", "North", 28.6139, 77.2090),
    ("mumbai", "Mumbai", "India", "West", 19.0760, 72.8777),
    ("bengaluru", "Bengaluru", "India", "South", 12.9716, 77.5946),
    ("chennai", "Chennai", "India", "South", 13.0827, 80.2707),
    ("kolkata", "Kolkata", "India", "East", 22.5726, 88.3639),
    ("hyderabad", "Hyderabad", "India", "South", 17.3850, 78.4867),
    ("pune", "Pune", "India", "West", 18.5204, 73.8567),
    ("ahmedabad", "Ahmedabad", "India", "West", 23.0225, 72.5714),
    ("jaipur", "Jaipur", "India", "North", 26.9124, 75.7873),
    ("lucknow", "Lucknow", "India", "North", 26.8467, 80.9462),
]
GLOBAL_PLACES = [
    ("london", "London", "United Kingdom", "Europe", 51.5072, -0.1276),
    ("new_york", "New York", "United States", "North America", 40.7128, -74.0060),
    ("los_angeles", "Los Angeles", "United States", "North America", 34.0522, -118.2437),
    ("paris", "Paris", "France", "Europe", 48.8566, 2.3522),
    ("singapore", "Singapore", "Singapore", "Asia", 1.3521, 103.8198),
    ("tokyo", "Tokyo", "Japan", "Asia", 35.6762, 139.6503),
    ("beijing", "Beijing", "China", "Asia", 39.9042, 116.4074),
    ("sydney", "Sydney", "Australia", "Oceania", -33.8688, 151.2093),
]

# Provider name, source label and fallback flag per tier, best tier first.
SOURCE_TIERS = [
    ("external", "openmeteo", "Open-Meteo real-time air-quality feed", False),
    ("cached", "openmeteo_cache", "Cached Open-Meteo air-quality feed", True),
    ("fallback", "simulation", "Replay simulator fallback after external provider failure", True),
]


def place_catalog(spark: SparkSession) -> DataFrame:
    """The built-in places with their group and rank."""
    rows = [("india", i, *place) for i, place in enumerate(INDIA_PLACES)]
    rows += [("global", i, *place) for i, place in enumerate(GLOBAL_PLACES)]
    return spark.createDataFrame(
        rows,
        "catalog string, catalog_rank int, key string, name string, country string, region string, "
        "latitude double, longitude double",
    )


def network_scope(catalog: DataFrame, scope: str, home: str = "india", first: int = GLOBAL_SCOPE_INDIA) -> DataFrame:
    """The home catalog, or its first places followed by all others; adds ``scope_rank``."""
    at_home = F.col("catalog") == home
    if scope == home:
        return catalog.where(at_home).withColumn("scope_rank", F.col("catalog_rank"))
    chosen = catalog.where(~at_home | (F.col("catalog_rank") < first))
    return chosen.withColumn("scope_rank", F.when(at_home, F.col("catalog_rank")).otherwise(F.col("catalog_rank") + first))


def pressure() -> Column:
    return risk.aqi_pressure(F.col("us_aqi"), F.col("european_aqi"))


def hotspots(locations: DataFrame, n: int = HOTSPOTS, rank: str = "catalog_rank") -> DataFrame:
    """The ``n`` places with the highest pressure, catalog order on ties (one top-n, no global sort)."""
    return locations.withColumn("pressure", pressure()).orderBy(F.desc("pressure"), F.asc(rank)).limit(n)


def hotspot_struct(locations: DataFrame, rank: str = "catalog_rank") -> Column:
    """The first hot spot as one struct value, to be read by every row without a join."""
    top = hotspots(locations, 1, rank)
    return top.select(F.struct(*locations.columns, "pressure").alias("hotspot")).scalar()


def station_city_comparison(stations: DataFrame, locations: DataFrame, rank: str = "catalog_rank") -> DataFrame:
    """Every station against its selected city (``selected_key``), by default the first hot spot."""
    if "selected_key" in stations.columns:
        city = F.struct(*locations.columns).alias("city")
        paired = stations.join(locations.select(F.col("key").alias("selected_key"), city), "selected_key", "left")
    else:
        paired = stations.withColumn("city", hotspot_struct(locations, rank))
    zero = F.lit(0.0)
    deltas = paired.select(
        S.SITE,
        F.col("city.key").alias("city_key"),
        (F.col("city.o3") - F.col("o3")).alias("o3_delta"),
        (F.col("city.no2") - F.col("no2")).alias("no2_delta"),
        (F.coalesce(F.col("city.us_aqi"), zero) - F.coalesce(F.col("us_aqi"), zero)).alias("aqi_delta"),
    )
    separator = F.when(F.abs("o3_delta") > F.abs("no2_delta"), "O3").otherwise("NO2")
    return deltas.withColumn("separator", separator)


def hotspot_comparison(requested: DataFrame, locations: DataFrame, rank: str = "catalog_rank") -> DataFrame:
    """Every requested place against the hot spot: is it the hot spot, and who leads per pollutant?"""
    zero = F.lit(0.0)
    paired = requested.withColumn("_hot", hotspot_struct(locations, rank))
    compared = paired.withColumn("hotspot", F.col("_hot.name")).withColumn(
        "is_hotspot", F.col("name") == F.col("_hot.name")
    )

    def leader(name: str) -> Column:
        hotter = F.coalesce(F.col(f"_hot.{name}"), zero) > F.coalesce(F.col(name), zero)
        return F.when(~F.col("is_hotspot"), F.when(hotter, F.col("hotspot")).otherwise(F.col("name")))

    return compared.withColumns(
        {
            "o3_delta": F.when(~F.col("is_hotspot"), F.col("_hot.o3") - F.col("o3")),
            "no2_delta": F.when(~F.col("is_hotspot"), F.col("_hot.no2") - F.col("no2")),
            "stronger_o3": leader("o3"),
            "stronger_no2": leader("no2"),
        }
    ).drop("_hot")


def live_with_fallback(
    tiers: dict[str, DataFrame],
    recent: int = RECENT_LIVE_HOURS,
    key: str = S.SITE,
    order: Sequence[str] = (S.TIMESTAMP,),
) -> DataFrame:
    """Recent rows per key from the best tier that has any, with provider, label and fallback flag.

    ``tiers`` maps tier names (see ``SOURCE_TIERS``) to tables; a tier left out is skipped, and keys no tier
    knows are left out. Each tier is cut to its recent rows first, so what meets is small and bounded.
    """
    tagged = None
    for priority, (name, provider, label, used) in enumerate(SOURCE_TIERS):
        if name not in tiers:
            continue
        rows = latest_rows(tiers[name], recent, key, order).withColumns(
            {
                "priority": F.lit(priority),
                "provider": F.lit(provider),
                "source_label": F.lit(label),
                "fallback_used": F.lit(used),
            }
        )
        tagged = rows if tagged is None else tagged.unionByName(rows)
    best = F.min("priority").over(Window.partitionBy(key))
    return tagged.withColumn("_best", best).where(F.col("priority") == F.col("_best")).drop("_best")


def live_snapshot(recent: DataFrame, key: str = S.SITE, order: Sequence[str] = (S.TIMESTAMP,)) -> DataFrame:
    """Current row per key out of its recent rows, with how many there are."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(name) for name in order])
    counted = recent.withColumns(
        {"_place": F.row_number().over(newest), "recent_points": F.count(F.lit(1)).over(Window.partitionBy(key))}
    )
    return counted.where(F.col("_place") == 1).drop("_place")


def network_locations(
    catalog: DataFrame, live: DataFrame, cached: DataFrame, key: str = "key", order: Sequence[str] = (S.TIMESTAMP,)
) -> DataFrame:
    """Current state of each catalog place, live else cached; places with neither are left out."""
    current = live_snapshot(live_with_fallback({"external": live, "cached": cached}, RECENT_LIVE_HOURS, key, order), key, order)
    return catalog.join(current, key)
