"""Linear regression on the rows before each row, without a copy of any row per lag.

A window of L rows with K columns is a vector of L * K numbers, and the normal matrix holds the products of every
two of them, summed over all windows. Products of lags i and j depend on i - j but for the first and last rows of a
site: moving both lags by one drops the product at the site's end and adds one at its start. So three sums are
enough, each found where the rows are stored:

* per block of rows, the products of lag 1 with all lags (K times L * K numbers), and the plain sums;
* per site, the products of its first rows and of its last rows.

The driver gets these sums, (L * K)^2 numbers whatever the rows, and solves once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.series import OWN, ROW, ROWS, frames
from hazegrid.session import share_code

SUM_TASKS = 16
SITES_AT_ONCE = 256
PARTS = ("strip", "sums", "cross", "target", "square")


def _matrix(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows.column(name).to_numpy().astype(np.float64) for name in columns])


def _block_sums(columns: Sequence[str], targets: Sequence[str], lags: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ROW)
        x, y = _matrix(rows, columns), _matrix(rows, targets)
        first = max(lags, int((~rows.column(OWN).to_numpy()).sum()))
        last = len(x)
        if first >= last:
            return pa.table({"n": pa.array([], pa.int64()), **{name: pa.array([], pa.binary()) for name in PARTS}})
        at = [slice(first - lag, last - lag) for lag in range(1, lags + 1)]
        known = y[first:last]
        found = {
            "strip": np.concatenate([x[at[0]].T @ x[place] for place in at], axis=1),
            "sums": np.concatenate([x[place].sum(axis=0) for place in at]),
            "cross": np.concatenate([x[place].T @ known for place in at]),
            "target": known.sum(axis=0),
            "square": (known**2).sum(axis=0),
        }
        return pa.table({"n": [last - first], **{name: pa.array([found[name].tobytes()], pa.binary()) for name in PARTS}})

    return run


def _added(batches):
    """One row per task: the sum of its blocks."""
    total, n = None, 0
    for batch in batches:
        n += int(pc.sum(batch.column(0)).as_py() or 0)
        for row in zip(*[batch.column(1 + i) for i in range(len(PARTS))], strict=True):
            parts = [np.frombuffer(cell.as_py()) for cell in row]
            total = [a + b for a, b in zip(total, parts)] if total else [part.copy() for part in parts]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([n]), *[pa.array([part.tobytes()], pa.binary()) for part in total]], names=["n", *PARTS])


def _edge_products(columns: Sequence[str], lags: int):
    """Per lag, its products with all lags at the start of each site less those at its end, summed over a task's sites."""

    def run(batches):
        total = np.zeros(((lags - 1) * len(columns),) * 2)
        for batch in batches:
            for at in range(0, batch.num_rows, SITES_AT_ONCE):
                part = batch.slice(at, SITES_AT_ONCE)
                head, tail = (np.array(part.column(i).to_pylist(), dtype=np.float64).reshape(part.num_rows, -1) for i in (0, 1))
                total += head.T @ head - tail.T @ tail
        strips = total.reshape(lags - 1, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(lags - 1), pa.int32()), pa.array([s.tobytes() for s in strips], pa.binary())], names=["lag", "strip"])

    return run


def _sum_strips(rows: pa.Table) -> pa.Table:
    strips = sum(np.frombuffer(cell.as_py()) for chunk in rows.column("strip").chunks for cell in chunk)
    return pa.table({"lag": rows.column("lag").slice(0, 1).cast(pa.int32()), "strip": pa.array([strips.tobytes()], pa.binary())})


class WindowMoments:
    """Means and covariances of all windows, and of the windows with each target."""

    def __init__(self, n: int, products: np.ndarray, sums: np.ndarray, cross: np.ndarray, target: np.ndarray, square: np.ndarray):
        self.n = n
        self.mean, self.target_mean = sums / n, target / n
        self.covariance = products / n - np.outer(self.mean, self.mean)
        self.cross = cross / n - np.outer(self.mean, self.target_mean)
        self.target_deviation = np.sqrt(np.maximum(square / n - self.target_mean**2, 0.0))

    def ridge(self, target: int, penalty: float) -> tuple[np.ndarray, float]:
        """Slopes and intercept that minimise half the mean squared error plus half the penalty on scaled slopes.

        Columns and target count in units of their deviation, as the library's linear regression does by default.
        """
        deviation = np.sqrt(np.maximum(np.diag(self.covariance), 0.0))
        used = np.flatnonzero(deviation > 1e-12 * np.maximum(1.0, np.abs(self.mean)))
        slopes = np.zeros(len(deviation))
        spread = self.target_deviation[target]
        if spread > 0 and len(used):
            scale = deviation[used]
            matrix = self.covariance[np.ix_(used, used)] / np.outer(scale, scale)
            matrix[np.diag_indices_from(matrix)] += penalty / spread
            slopes[used] = np.linalg.solve(matrix, self.cross[used, target] / (scale * spread)) * spread / scale
        return slopes, float(self.target_mean[target] - slopes @ self.mean)


def window_moments(indexed: DataFrame, site: str, columns: Sequence[str], targets: Sequence[str], lags: int, block_rows: int) -> WindowMoments:
    """Moments over all rows with ``lags`` rows before them in their site; oldest lag first, as windows are laid out.

    ``indexed`` has row numbers (``series.index_rows``); its columns and targets are known everywhere.
    """
    share_code(indexed.sparkSession)
    width = len(columns)
    needed = indexed.select(site, ROW, ROWS, *columns, *targets).where(F.col(ROWS) > lags)
    if not needed.where(F.greatest(*[F.col(name).isNull().cast("int") for name in targets], F.lit(0)) == 1).isEmpty():
        raise ValueError("a sequence model is fitted on rows with known targets")
    schema = "n long, " + ", ".join(f"{name} binary" for name in PARTS)
    blocks = frames(needed, block_rows, lags).groupBy(site, "_block").applyInArrow(_block_sums(columns, targets, lags), schema)
    rows = blocks.repartition(SUM_TASKS).mapInArrow(_added, schema).collect()
    if not rows:
        raise ValueError(f"no row has {lags} rows before it")
    sums = {name: sum(np.frombuffer(row[name]) for row in rows) for name in PARTS}
    n = sum(row["n"] for row in rows)

    products = np.zeros((lags, width, lags, width))
    products[0] = sums["strip"].reshape(width, lags, width)
    if lags > 1:
        # What lags 1 to L - 1 leave and enter when they move by one: a site's first rows, and its last but one.
        heads = needed.where(F.col(ROW) < lags - 1).groupBy(site).agg(_nested(columns).alias("head"))
        at_end = (F.col(ROW) >= F.col(ROWS) - lags) & (F.col(ROW) < F.col(ROWS) - 1)
        tails = needed.where(at_end).groupBy(site).agg(_nested(columns).alias("tail"))
        both = heads.join(tails, site).select("head", "tail")
        strips = both.mapInArrow(_edge_products(columns, lags), "lag int, strip binary").groupBy("lag").applyInArrow(_sum_strips, "lag int, strip binary")
        moved = np.zeros((lags - 1, width, lags - 1, width))
        for row in strips.collect():
            moved[row["lag"]] = np.frombuffer(row["strip"]).reshape(width, lags - 1, width)
        for lag in range(1, lags):
            products[lag, :, 1:] = products[lag - 1, :, :-1] + moved[lag - 1]
            products[lag, :, 0] = products[0, :, lag].T
    # Windows are laid out oldest row first, so lags run backwards.
    products = products[::-1, :, ::-1].reshape(lags * width, lags * width)
    backwards = lambda values, tail: values.reshape(lags, width, *tail)[::-1].reshape(lags * width, *tail)
    return WindowMoments(
        n, (products + products.T) / 2, backwards(sums["sums"], ()), backwards(sums["cross"], (len(targets),)), sums["target"], sums["square"]
    )


def _nested(columns: Sequence[str]):
    """The rows of a group, newest first: at most as many as there are lags."""
    point = F.struct(F.col(ROW).alias("at"), F.array(*columns).alias("v"))
    return F.transform(F.reverse(F.sort_array(F.collect_list(point))), lambda p: p["v"])
