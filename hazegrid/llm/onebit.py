"""Nearest neighbours by largest inner product with randomly rotated one-bit codes.

Vectors belong to the nearest of a fixed number of centres. What is left after taking the centre off is turned
by a random rotation, and one bit per coordinate is kept (the sign), packed, with three correction numbers.
From the bits an unbiased estimate of any inner product follows, with an error that shrinks with the distance
to the centre. A vector is scored exactly only if its estimate plus error bound can still reach the best
``k`` found; the same bound, taken for a whole centre, decides which centres a query visits at all.

Centres and rotation are fitted on a bounded sample; every row is indexed. Queries and rows of a centre meet in
blocks of bounded size, never as a product of tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.session import materialize

SAMPLE_ROWS, CENTRES, ROUNDS = 10_000, 96, 12
ROW_BLOCK, QUERY_BLOCK, STEP = 8192, 2048, 128
ERROR_FACTOR = 3.0
NEIGHBOURS = 20
SLACK = 1e-6


class Codes:
    """The fitted part: centres and a rotation whose size is a whole number of bytes."""

    def __init__(self, sample: np.ndarray, dimension: int, centres: int = CENTRES, seed: int = 5):
        random = np.random.default_rng(seed)
        self.dimension, self.bits = dimension, -(-dimension // 8) * 8
        self.rotation = np.linalg.qr(random.standard_normal((self.bits, self.bits)))[0][:dimension]
        if not len(sample):
            sample = np.zeros((1, dimension))
        chosen = sample[random.choice(len(sample), min(centres, len(sample)), replace=False)]
        for _ in range(ROUNDS):
            own = self._nearest(sample, chosen)
            sums = np.zeros_like(chosen)
            np.add.at(sums, own, sample)
            counts = np.bincount(own, minlength=len(chosen))
            chosen = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], chosen)
        self.centres = chosen

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(rows @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)

    def encode(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Centre, packed signs, length of the rest, its inner product with the signs, and the one with the centre."""
        centre = self._nearest(rows, self.centres)
        rest = rows - self.centres[centre]
        length = np.sqrt((rest**2).sum(axis=1))
        turned = (rest / np.maximum(length, 1e-300)[:, None]) @ self.rotation
        fit = np.abs(turned).sum(axis=1) / np.sqrt(self.bits)
        with_centre = (rows * self.centres[centre]).sum(axis=1)
        return {"centre": centre, "code": np.packbits(turned > 0, axis=1), "length": length, "fit": fit, "with_centre": with_centre}

    def bounds(self, queries: np.ndarray, centre: int, code, length, fit, with_centre) -> tuple[np.ndarray, np.ndarray]:
        """Estimates (rows x queries) of the inner products with rows of one centre, and their error bounds."""
        middle = self.centres[centre]
        rest = queries - middle
        signs = (np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.bits))
        part = signs @ (rest @ self.rotation).T.astype(np.float32)
        scale = np.where(fit > 0, length / np.maximum(fit, 1e-300), 0.0)
        estimate = part * scale[:, None] + with_centre[:, None] + (queries @ middle - middle @ middle)[None, :]
        spread = np.sqrt(np.maximum(1 - fit**2, 0)) * scale * (ERROR_FACTOR / np.sqrt(max(1, self.bits - 1)))
        return estimate, spread[:, None] * np.sqrt((rest**2).sum(axis=1))[None, :] + SLACK


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first coordinate to the last."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """One row ``id, vector`` (doubles) per id, without vectors that take no part, and the dimension.

    No part take vectors that are null, zero, hold null or non-finite components, or have another length than
    most; rows without an id; and of several rows of one id all but the least vector.
    """
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 1
    return rows.where(F.size("vector") == dimension).groupBy("id").agg(F.min("vector").alias("vector")), dimension


def _meet(codes: Codes, k: int):
    """Cogroup function: rows of one centre block and the queries that visit it to each query's best ``k`` here."""

    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if rows.empty or queries.empty:
            return empty
        ids, x = rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy())
        code = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
        numbers = [rows[c].to_numpy() for c in ("length", "fit", "with_centre")]
        found = []
        for at in range(0, len(queries), STEP):
            part = queries.iloc[at : at + STEP]
            q, own, floor = np.stack(part["vector"].to_numpy()), part["id"].to_numpy(), part["floor"].to_numpy()
            reached = floor
            estimate, error = codes.bounds(q, int(rows["centre"].iloc[0]), code, *numbers)
            self_row = ids[:, None] == own[None, :]
            low = np.where(self_row, -np.inf, estimate - error)
            if len(ids) > k:
                floor = np.maximum(floor, np.partition(low, len(ids) - k, axis=0)[len(ids) - k])
            keep = (estimate + error >= floor[None, :]) & ~self_row
            for j in range(len(part)):
                near = np.flatnonzero(keep[:, j])
                if len(near) > k:
                    rough = x[near] @ q[j]
                    near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - SLACK * (1 + np.abs(rough).max())]
                if not len(near):
                    continue
                score = inner_products(np.broadcast_to(q[j], (len(near), len(q[j]))), x[near])
                order = np.lexsort([ids[near], -score])[:k]
                # What is below the k rows that the query already has is not among its best.
                order = order[score[order] >= reached[j]]
                found.append((np.full(len(order), own[j]), ids[near][order], score[order]))
        if not found:
            return empty
        return pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    return best


def _visit(codes: Codes, radius: dict[int, float], everywhere: bool):
    """Map function: the centres a query visits, as ``id, vector, floor, centre``."""
    numbers = np.array(sorted(radius))
    reach = np.array([radius[c] for c in numbers])

    def visit(batches):
        for batch in batches:
            q = _matrix(batch.column(1), codes.dimension)
            if not len(q) or not len(numbers):
                continue
            centres = codes.centres[numbers]
            middle = q @ centres.T
            first = middle.argmax(axis=1)
            if everywhere:
                # No row of a centre exceeds this.
                top = middle + np.sqrt((q**2).sum(axis=1))[:, None] * reach[None, :] + SLACK
                chosen = top >= batch.column(2).to_numpy()[:, None]
                chosen[np.arange(len(q)), first] = False
            else:
                chosen = np.zeros(middle.shape, dtype=bool)
                chosen[np.arange(len(q)), first] = True
            row, at = np.nonzero(chosen)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(numbers[at].astype(np.int32))], names=["id", "vector", "floor", "centre"])

    return visit


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = NEIGHBOURS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query its ``k`` rows of largest inner product, ties to smaller ids.

    ``queries`` has the columns of ``vectors``; the row with the query's own id is left out. Ids are longs. See
    ``usable`` for rows that take no part. Queries without any candidate, and empty tables, give no rows. The
    error bound holds with high probability, not always; recall is measured in the tests.
    """
    rows, dimension = usable(vectors, id_column, vector_column)
    rows = materialize(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()
    codes = Codes(np.stack(sample["vector"].to_numpy()) if len(sample) else np.zeros((0, dimension)), dimension)

    def encode(batches):
        for batch in batches:
            found = codes.encode(_matrix(batch.column(1), dimension))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(found["centre"].astype(np.int32)),
                    pa.array([c.tobytes() for c in found["code"]], type=pa.binary()),
                    *[pa.array(found[c]) for c in ("length", "fit", "with_centre")],
                ],
                names=["id", "vector", "centre", "code", "length", "fit", "with_centre"],
            )

    index = rows.mapInArrow(encode, "id long, vector array<double>, centre int, code binary, length double, fit double, with_centre double")
    index = materialize(index, "codes")
    # One line per centre, and there are at most CENTRES.
    shape = {r["centre"]: r for r in index.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("radius")).collect()}
    radius = {c: r["radius"] for c, r in shape.items()}
    asked, asked_dimension = usable(queries, id_column, vector_column)
    asked = asked if asked_dimension == dimension else asked.limit(0)
    asked = materialize(asked.withColumn("floor", F.lit(float("-inf"))), "queries")

    def searched(queries_: DataFrame, everywhere: bool) -> DataFrame:
        schema = "id long, vector array<double>, floor double, centre int"
        visits = materialize(queries_.mapInArrow(_visit(codes, radius, everywhere), schema), "visits")
        meet = {r["centre"]: r["n"] for r in visits.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
        row_blocks = {c: -(-shape[c]["n"] // ROW_BLOCK) for c in shape}
        query_blocks = {c: -(-n // QUERY_BLOCK) for c, n in meet.items()}

        def blocks(counts: dict[int, int]):
            if not counts:
                return F.lit(0)
            return F.coalesce(F.create_map(*[F.lit(int(v)) for item in counts.items() for v in item])[F.col("centre")], F.lit(0))

        def dealt(df: DataFrame, own: dict, other: dict, own_name: str, other_name: str) -> DataFrame:
            number = F.pmod(F.xxhash64("id"), F.greatest(blocks(own), F.lit(1))).cast("int")
            others = F.filter(F.sequence(F.lit(0), blocks(other)), lambda b: b < blocks(other))
            return df.withColumn(own_name, number).withColumn(other_name, F.explode(others))

        left = dealt(index, row_blocks, query_blocks, "row_block", "query_block")
        right = dealt(visits, query_blocks, row_blocks, "query_block", "row_block")
        keys = ["centre", "row_block", "query_block"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys))
        return materialize(met.applyInPandas(_meet(codes, k), "query_id long, vec_id long, score double"), "met")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = searched(asked, False)
    place = F.row_number().over(order)
    reached = first.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    floors = asked.drop("floor").join(reached, "id", "left").select("id", "vector", F.coalesce("reached", F.lit(float("-inf"))).alias("floor"))
    both = first.union(searched(materialize(floors, "floors"), True))
    return both.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
