"""Connected components of a link table by alternating star contractions; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.session import materialize


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (and of the node itself).

    ``both_ways``: larger neighbours move, seen from either end; otherwise smaller neighbours and the node
    move. Both keep the components. A node with very many neighbours is one aggregated row joined to many
    rows, which adaptive execution splits.
    """
    if both_ways:
        seen = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    else:
        seen = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = seen.join(least, "u")
    if both_ways:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Columns ``u, v`` (long ids) to rows ``node, component`` for every id in a link; component is its smallest id.

    Links to oneself and links with a null give no row. Each round is written to the shared folder, so a
    lost executor repeats one round at most.
    """
    links = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        links = materialize(_star(_star(links, True), False), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
