"""Mix sources to target weights by weighted sampling without replacement, in column expressions only.

Targets: sources in code-point order (null last) get the weights in turn and share a budget of words; a
source stops at ``most`` times its size and what is left goes to the others by weight.

Documents: a source takes every document as often as its target holds whole epochs. For the rest of the target
each document draws an exponential key divided by its quality weight (Efraimidis and Spirakis: the smallest
keys are a weighted sample without replacement); in key order, sizes are summed until the rest is used up.

A source may hold any share of the rows. Keys fall into a fixed number of ranges; sums per source and range
tell in which range the rest runs out, and only rows of that range are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.operators.series import ROW, index_rows
from hazegrid.session import materialize

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT, MOST = 150, 2
RANGES = 4096
SEED = "mix-1"

# Characters that speak against a text when they are frequent.
SYMBOLS = "0123456789!#$%&*+<=>@[]^_`{|}~\\/"


def word_count(text: Column) -> Column:
    """Maximal runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of the text that is neither digit nor symbol, squared."""
    text = F.coalesce(text, F.lit(""))
    clean = F.length(F.translate(text, SYMBOLS, ""))
    share = (clean + F.lit(1)) / (F.length(text) + F.lit(1))
    return F.lit(0.1) + F.lit(0.9) * share * share


def uniform(id_column: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id; null ids read as an empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source. All compared numbers are whole.

    A source is capped if its fair share of what capped sources leave reaches ``most`` times its size. Each
    round caps all such sources at once; the driver sees two sums per round.
    """
    ranked = index_rows(sizes.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(0).alias("_all")), ["_all"], ["_last", "source"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col(ROW) % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.cast("long").alias("w")), "ranked")
    size = F.col("source_size").cast("decimal(19,0)")
    open_ = F.lit(True)
    while True:
        sums = ranked.agg(
            F.sum(size),
            F.sum(F.when(open_, F.lit(0).cast("decimal(19,0)")).otherwise(size)),
            F.sum(F.when(open_, F.col("w")).otherwise(0)),
        ).first()
        total, capped, weight_left = (int(v or 0) for v in sums)
        # In hundredths of words: what the open sources share.
        left = budget_percent * total - 100 * most * capped
        fair = F.col("w").cast("decimal(10,0)") * F.lit(str(left)).cast("decimal(27,0)")
        below = fair < size * F.lit(str(100 * most * weight_left)).cast("decimal(18,0)")
        if not ranked.where(open_ & ~below).count():
            break
        open_ = open_ & below
    share = F.col("w").cast("double") * F.lit(float(left)) / F.lit(float(100 * max(1, weight_left)))
    target = F.when(open_ & (F.col("source_size") > 0), share).otherwise(F.col("source_size").cast("double") * most)
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: str = SEED,
    row_column: str | None = None,
) -> DataFrame:
    """``id, source, size, source_size, target, taken`` for every row.

    With ``row_column``, a column that tells rows apart, the result has it as ``row``, and it decides between rows
    that are equal otherwise.

    ``taken`` is the number of words that the mix takes of the row, whole copies only: the whole epochs of its
    source's target, and one copy more if its key lies before the point where the rest of the target is met
    (to the nearest document). Keys depend on id and seed, so runs agree.

    A null source is a source of its own, the last. Null and empty texts have size 0 and take 0. Rows of one id
    share a key and are ordered by size and text digest; equal rows are equal in every way, so it does not
    matter which of them comes first. Null ids share a key too. An empty table gives no rows.
    """
    text = F.col(text_column)
    key = -F.log(uniform(F.col(id_column), seed)) / quality_weight(text)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        word_count(text).alias("size"),
        key.alias("key"),
        F.xxhash64(text).alias("tie"),
        *([F.col(row_column).alias("row")] if row_column else []),
        # The key is about exponential, so this spreads the rows over the ranges and keeps their order.
        F.least(F.lit(RANGES - 1), F.floor(F.lit(float(RANGES)) * (F.lit(1.0) - F.exp(-key)))).cast("int").alias("range"),
    )
    rows = materialize(rows, "mix-rows")
    sums = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-sums")
    targets = materialize(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # At most RANGES rows per source meet in one window.
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("before", before)
    same_source = ranges["source"].eqNullSafe(plan["source"])
    ranges = ranges.join(plan, same_source).select(ranges["source"], "range", "words", "before", "source_size", "target", "epochs", "rest")
    ranges = materialize(ranges, "mix-ranges")

    on = rows["source"].eqNullSafe(ranges["source"]) & (rows["range"] == ranges["range"])
    joined = rows.join(ranges, on).select(
        rows["id"], rows["source"], "size", "key", "tie", *(["row"] if row_column else []), rows["range"], "words", "before", "source_size", "target", "epochs", "rest"
    )
    columns = ["id", "source", "size", "source_size", "target", *(["row"] if row_column else [])]
    crossing = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    clear = joined.where(~crossing).withColumn("extra", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "tie", *(["row"] if row_column else [])).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    partly = joined.where(crossing).withColumn("extra", start + F.col("size") / 2 <= F.col("rest"))
    taken = (F.col("size") * (F.col("epochs") + F.col("extra").cast("long"))).alias("taken")
    return clear.select(*columns, taken).union(partly.select(*columns, taken))
