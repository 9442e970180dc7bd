"""Streams that keep state per site: readings that turn stale, rows before a row for models over sequences.

State lives in the checkpoint of the query; a lost executor or a restart goes on from there. The state of a site is one
row, or as many rows as a model looks back. ``freshness`` and ``sequence_stream`` keep it in RocksDB
(``transformWithState`` asks for it). A Python processor gets and gives all rows of a site in a micro-batch in one task,
and Spark holds what it gives until the site is done: there a trigger's size has to bound a site's rows. ``score_sequences``
has no such bound. It orders each micro-batch like a batch table, in blocks, and keeps its state as a small table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from hazegrid import schema as S
from hazegrid.operators.features import FeatureSpec, sequences
from hazegrid.operators.series import ROW, ROWS, index_rows
from hazegrid.session import delete_paths, passing_tables, share_code
from hazegrid.streaming.live import FRESH_SECONDS

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; a query holds on to the setting it was started with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


MOMENT = "_micros"


class _Freshness(StatefulProcessor):
    """The newest reading of a site, its time in microseconds first; a timer says when it is too old."""

    def __init__(self, site: str, reading: T.StructType, limit_seconds: float):
        self.reading, self.limit = reading, int(limit_seconds * 1000)
        self.names = reading.fieldNames()
        self.out = Row(site, *self.names, "stale")

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.reading)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.newest.get()) if self.newest.exists() else None
        fresh = known
        for row in rows:
            values = tuple(row[name] for name in self.names)
            # Time, then tie-break.
            if values[0] is not None and (fresh is None or values[:2] > fresh[:2]):
                fresh = values
        if fresh is None or fresh == known:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.newest.update(fresh)
        end = fresh[0] // 1000 + self.limit
        # What is older than the limit when it arrives is stale at once.
        stale = end < timerValues.getCurrentWatermarkInMs()
        if not stale:
            self.handle.registerTimer(end)
        yield self.out(*key, *fresh, stale)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self.out(*key, *self.newest.get(), True)

    def close(self) -> None:
        pass


def freshness(
    stream: DataFrame,
    tie: str,
    fields: Sequence[str] = ("o3", "no2"),
    limit_seconds: float = FRESH_SECONDS,
    delay: str = "10 seconds",
    site: str = S.SITE,
) -> DataFrame:
    """``site, timestamp, tie, fields, stale``: a row for each newer reading, and one when a site falls silent.

    Time is event time: a site is stale once the readings of all sites (less ``delay``) have moved on by
    ``limit_seconds`` past its newest one. A new reading makes it fresh again. Readings without a time are
    left out; of several with the newest time that with the largest ``tie`` counts. Start the query inside
    ``state_store``.
    """
    share_code(stream.sparkSession)
    micros = F.unix_micros(S.TIMESTAMP).alias(MOMENT)
    kept = stream.withWatermark(S.TIMESTAMP, delay).select(site, S.TIMESTAMP, micros, tie, *fields)
    reading = T.StructType([T.StructField(name, kept.schema[name].dataType) for name in (MOMENT, tie, *fields)])
    out = T.StructType([T.StructField(site, kept.schema[site].dataType), *reading.fields, T.StructField("stale", T.BooleanType())])
    said = kept.groupBy(site).transformWithState(_Freshness(site, reading, limit_seconds), out, "Append", "EventTime")
    return said.select(site, F.timestamp_micros(MOMENT).alias(S.TIMESTAMP), tie, *fields, "stale")


class _Windows(StatefulProcessor):
    """Gives each row the vectors of the rows before it in its site."""

    def __init__(self, site: str, fields: Sequence[str], order: Sequence[str], vector: str, length: int, into: str):
        self.fields, self.order, self.vector, self.length = list(fields), list(order), vector, length
        self.out = Row(site, *fields, into)

    def init(self, handle) -> None:
        self.last = handle.getListState("last", "vector array<double>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        window = [list(values[0]) for values in self.last.get()] if self.last.exists() else []
        for row in sorted(rows, key=lambda row: tuple((row[name] is not None, row[name]) for name in self.order)):
            if len(window) == self.length:
                yield self.out(*key, *[row[name] for name in self.fields], list(window))
                del window[0]
            window.append(list(row[self.vector]))
        self.last.put([(vector,) for vector in window])

    def close(self) -> None:
        pass


def sequence_stream(
    stream: DataFrame, columns: Sequence[str], length: int, keep: Sequence[str], order: Sequence[str], into: str = "sequence", site: str = S.SITE
) -> DataFrame:
    """``site, keep, into``: the rows of a stream with ``length`` predecessors, and their vectors, oldest first.

    Predecessors come from earlier micro-batches too. Rows are taken in the order of ``order`` within a batch and
    of arrival between batches, so files should be landed in time order; a late row follows what came before it.
    """
    share_code(stream.sparkSession)
    names = [name for name in dict.fromkeys([*keep, *order]) if name != site]
    vector = F.array(*[F.col(name).cast("double") for name in columns]).alias("_vector")
    rows = stream.select(site, *names, vector)
    fields = [name for name in keep if name != site]
    out = T.StructType([T.StructField(name, rows.schema[name].dataType) for name in (site, *fields)])
    out = out.add(into, T.ArrayType(T.ArrayType(T.DoubleType())))
    return rows.groupBy(site).transformWithState(_Windows(site, fields, order, "_vector", length, into), out, "Append", "None")


def _with_last_rows(batch: DataFrame, last: DataFrame | None, order: Sequence[str], site: str) -> DataFrame:
    """The rows of a batch behind the last rows before it, numbered per site; ``_fresh`` tells them apart."""
    rows = batch.withColumn("_fresh", F.lit(True))
    if last is None:
        return index_rows(rows, [site], order)
    behind = last.withColumn("_fresh", F.lit(False)).unionByName(rows, allowMissingColumns=True)
    return index_rows(behind, [site], ["_fresh", "_place", *order]).drop("_place")


def score_sequences(
    stream: DataFrame, forecaster, path: str, checkpoint: str, keep: Sequence[str], order: Sequence[str], finish: Callable[[DataFrame], DataFrame] | None = None
):
    """Start a job that scores each row of a stream with a model over the rows before it.

    Predecessors come from earlier micro-batches too, in the order that ``sequence_stream`` states. The last rows of
    every site are written with each micro-batch into the checkpoint, under its number, and the next one reads them:
    a repeated batch finds the same rows before it and replaces its own folders.
    """
    site, steps, length = S.SITE, forecaster.step_columns(), forecaster.history_rows()
    names = [name for name in dict.fromkeys([*keep, *order]) if name != site]
    vectors = [F.col(name).cast("double").alias(name) for name in steps]
    rows = forecaster.model.stages[0].transform(stream).select(site, *names, *vectors)
    spec = FeatureSpec(site=site)
    state = T.StructType([rows.schema[site], T.StructField("_place", T.LongType()), *[T.StructField(name, T.DoubleType()) for name in steps]])

    def stored(batch_id: int) -> str:
        return f"{checkpoint}/last_rows/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with passing_tables(spark):
            last = spark.read.schema(state).parquet(stored(batch_id - 1)) if batch_id else None
            numbered = _with_last_rows(batch, last, order, site)
            windows = sequences(numbered, steps, length, spec, into="_steps").where("_fresh")
            predicted = forecaster.predict_steps(windows, [site, *[name for name in keep if name != site]])
            scored = finish(predicted) if finish else predicted
            scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            ending = numbered.where(F.col(ROW) >= F.col(ROWS) - length)
            ending.select(site, F.col(ROW).alias("_place"), *steps).write.mode("overwrite").parquet(stored(batch_id))
        delete_paths(spark, [stored(batch_id - 2)])  # a batch is repeated only until the next one begins

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()
