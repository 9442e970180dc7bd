"""Exact removal of long byte strings that occur more than once, by prefix-free parsing.

A rolling hash puts triggers into every text, and the text from one trigger to the next is a phrase. Here a
trigger is the smallest hash of a sliding window instead of a hash divisible by a constant, so phrases have a
bounded length and every string of ``length`` bytes holds a trigger that its own bytes determine. Start
positions that share a trigger form a stretch:

* the *core*, the bytes around the trigger that all strings of the stretch hold, is the dictionary entry;
* the *hull*, all bytes that its strings cover, is the entry with its neighbours in the parse.

Two suffixes of the corpus are neighbours in suffix order with ``length`` bytes in common exactly if they agree
on their part of the phrase and on the following parse. Only that equality is needed, never the order itself,
so suffix ranks are kept as fingerprints and groups take the place of sorted runs; the sort of all suffixes of
dictionary and parse would cost several corpus-wide sorts and give the same classes.

Stretches are refined in three steps, from about 150 start positions to 16 and then to one:

1. Cores seen once end all strings of their stretch: nothing there repeats.
2. Hulls seen twice settle whole stretches: everything there repeats.
3. Only stretches with a repeated core and differing hulls (the borders of repeats) are cut into shorter ones,
   with longer cores and shorter hulls, and of the copies of a settled hull only one goes along.

Groups are only counted, with partial sums before each shuffle, so very frequent passages and thousands of
copies cost no more than other text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb
from hazegrid.session import materialize

LENGTH = 400
TRIGGER_BYTES = 12
CORE_SHARE = 4  # a core reaches length / CORE_SHARE bytes beyond its trigger
STEPS = (16, 1)  # start positions per stretch after each cut


class Stretches:
    """Stretches of all texts of a slice: first and last start position, trigger, core, hull and row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.offsets, self.length = data, offsets, length
        self.prefix = [tb.Prefix(data, seed) for seed in (0, 1)]
        tail = length // CORE_SHARE
        zone = length - tail - TRIGGER_BYTES + 1
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        starts = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(offsets[:-1], sizes)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        if not total:
            self._set(*[np.zeros(0, np.int64)] * 4)
            return
        at = np.arange(len(data) - TRIGGER_BYTES + 1)
        hashes = tb.mixed(self.prefix[0].raw(at, at + TRIGGER_BYTES)) & np.uint64(0xFFFFFFFF00000000)
        trigger = _sliding_least(hashes | at.astype(np.uint64), zone)[starts] & np.uint64(0xFFFFFFFF)
        trigger = trigger.astype(np.int64)
        new = np.ones(total, dtype=bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], total) - 1
        self._set(starts[first], starts[last], trigger[first], rows[first])
        self.core = self.prefix[0](self.trigger, self.trigger + TRIGGER_BYTES + tail)

    def _set(self, low: np.ndarray, high: np.ndarray, trigger: np.ndarray, row: np.ndarray) -> None:
        self.low, self.high, self.trigger, self.row = low, high, trigger, row
        self.core = np.zeros(0, np.uint64)
        self.hull = [p(low, high + self.length) for p in self.prefix]

    def cut(self, chosen: np.ndarray, step: int) -> Stretches:
        """The chosen stretches in pieces of ``step`` start positions, counted back from the trigger.

        The core of a piece holds what all its possible strings share, also where a border cuts it short, so
        equal strings have equal cores in every text.
        """
        low, high, trigger, row = (x[chosen] for x in (self.low, self.high, self.trigger, self.row))
        nearest, farthest = (trigger - high) // step, (trigger - low) // step
        n = farthest - nearest + 1
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece = np.repeat(farthest, n) - number
        low, high, trigger, row = (np.repeat(x, n) for x in (low, high, trigger, row))
        begin = trigger - piece * step
        part = Stretches.__new__(Stretches)
        part.data, part.offsets, part.length, part.prefix = self.data, self.offsets, self.length, self.prefix
        part._set(np.maximum(low, begin - step + 1), np.minimum(high, begin), trigger, row)
        part.core = self.prefix[0](begin, begin - step + 1 + self.length)
        return part

    def marked(self, lists: pa.Array, first: int) -> np.ndarray:
        """Stretches whose hull is in the list of their row; the slice's rows start at ``first``."""
        found = np.zeros(len(self.low), dtype=bool)
        borders = np.searchsorted(self.row, np.arange(len(self.offsets)))
        for row in np.flatnonzero(np.diff(borders)):
            hulls = lists[first + int(row)]
            if hulls.is_valid:
                x, y = borders[row], borders[row + 1]
                found[x:y] = np.isin(tb.signed(self.hull[0][x:y]), hulls.values.to_numpy())
        return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each position on, by prefix and suffix minima of blocks."""
    n = len(values)
    size = -(-n // width) * width
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    out = behind[:n].copy()
    reach = n - width + 1
    if reach > 0:
        np.minimum(behind[:reach], ahead[width - 1 : width - 1 + reach], out=out[:reach])
    return out


def _slices(batch: pa.RecordBatch, column: int, length: int):
    data, offsets, _ = tb.batch_texts(batch.column(column))
    for a, b in tb.row_slices(offsets):
        yield a, Stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place of every distinct key and whether it comes more than once."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))) > 1


ROWS = "text long, core long, hull long, hull2 long, again boolean"


def _distinct(keys: np.ndarray, part: Stretches, again: np.ndarray) -> pa.RecordBatch:
    """One row per distinct stretch of each text; again: it is there twice, or known to repeat."""
    place, more = _counted([part.row, part.core, *part.hull, again.astype(np.int8)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[part.row[place]], type=pa.int64()),
            *[pa.array(tb.signed(x[place]), type=pa.int64()) for x in (part.core, *part.hull)],
            pa.array(more | again[place]),
        ],
        names=["text", "core", "hull", "hull2", "again"],
    )


def _stretch_rows(texts: DataFrame, length: int) -> DataFrame:
    def parse(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, part in _slices(batch, 1, length):
                yield _distinct(keys[a:], part, np.zeros(len(part.low), dtype=bool))

    return texts.mapInArrow(parse, ROWS)


def _pieces(part: Stretches, opened: list[pa.Array], first: int) -> Stretches:
    """Cut the stretches of a slice as often as there are lists of hulls to cut."""
    for lists, step in zip(opened, STEPS):
        part = part.cut(part.marked(lists, first), step)
    return part


def _piece_rows(texts: DataFrame, length: int, levels: int) -> DataFrame:
    """Rows of the pieces behind ``levels`` cuts. Columns: ``text, content``, a list of hulls to cut per level, and
    the list of those that are settled (their pieces repeat)."""

    def expand(batches):
        for batch in batches:
            keys, opened = batch.column(0).to_numpy(), [batch.column(2 + k) for k in range(levels)]
            for a, part in _slices(batch, 1, length):
                part = _pieces(part, opened[:-1], a)
                settled = part.marked(batch.column(2 + levels), a)
                both = [part.cut(part.marked(opened[-1], a) & kind, STEPS[levels - 1]) for kind in (~settled, settled)]
                for pieces, again in zip(both, (False, True), strict=True):
                    yield _distinct(keys[a:], pieces, np.full(len(pieces.low), again))

    return texts.mapInArrow(expand, ROWS)


def _cut_texts(texts: DataFrame, length: int, kind: str) -> DataFrame:
    """``id, n_bytes, starts, ends, kept`` per row, from the lists of hulls settled and cut in its text."""

    def remove(batches):
        for batch in batches:
            ids, settled, opened = batch.column(0), batch.column(2), [batch.column(3 + k) for k in range(len(STEPS))]
            for a, part in _slices(batch, 1, length):
                low, high, rows = [], [], []
                pieces = part
                for level in range(len(STEPS) + 1):
                    hit = pieces.marked(settled, a)
                    low.append(pieces.low[hit])
                    high.append(pieces.high[hit] + length)
                    rows.append(pieces.row[hit])
                    if level < len(STEPS):
                        pieces = pieces.cut(pieces.marked(opened[level], a), STEPS[level])
                low, high, rows = (np.concatenate(x) for x in (low, high, rows))
                order = np.lexsort([low, rows])
                low, high, borders = low[order], high[order], np.searchsorted(rows[order], np.arange(len(part.offsets)))
                starts, ends, kept = [], [], []
                for row, (x, y) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                    base, stop = int(part.offsets[row]), int(part.offsets[row + 1])
                    begin, end = _merged(low[x:y], high[x:y])
                    starts.append((begin - base).tolist())
                    ends.append((end - base).tolist())
                    edges = zip([base, *end.tolist()], [*begin.tolist(), stop], strict=True)
                    kept.append(b"".join(part.data[i:j].tobytes() for i, j in edges))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, len(starts)),
                        pa.array(np.diff(part.offsets)),
                        pa.array(starts, type=pa.list_(pa.int64())),
                        pa.array(ends, type=pa.list_(pa.int64())),
                        pa.array(kept, type=pa.binary()),
                    ],
                    names=["id", "n_bytes", "starts", "ends", "kept"],
                )

    return texts.mapInArrow(remove, f"id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by ranges that are sorted by their start."""
    if not len(low):
        return low, high
    reach = np.maximum.accumulate(high)
    new = np.ones(len(low), dtype=bool)
    new[1:] = low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:], len(low)) - 1]


def _judged(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a repeated core, with ``settled`` and whether they are to be cut (``open``)."""
    twice = (F.count(F.lit(1)) > 1) | F.max("again")
    cores = rows.groupBy("core").agg(twice.alias("twice"), (F.min("hull") != F.max("hull")).alias("mixed"))
    repeated = materialize(rows.join(cores.where("twice").select("core", "mixed"), "core"), f"{label}-repeated")
    # Of the copies of a settled hull the one in the first text is cut, to be met by strings of other hulls.
    hulls = repeated.groupBy("hull", "hull2").agg(twice.alias("settled"), F.min("text").alias("first"))
    judged = repeated.join(hulls, ["hull", "hull2"])
    open_ = F.col("mixed") & (~F.col("settled") | (F.col("text") == F.col("first")))
    return materialize(judged.select("text", "hull", "settled", open_.alias("open")), f"{label}-judged")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_bytes, starts, ends, kept`` per row: ranges of the UTF-8 text to remove and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it starts at any other place too, in the same row
    or another. Strings are judged on the input. Ranges are maximal; ``kept`` may end inside a character.

    A null text counts as empty; texts shorter than ``length`` lose nothing. Equal rows and rows of one id are
    separate texts that repeat each other. Null ids pass through. Other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    content = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(content, F.length(content)).alias("text"), content.alias("content"))
    long_texts = texts.where(F.octet_length("content") >= length)

    rows = materialize(_stretch_rows(long_texts.select("text", "content"), length), "stretches")
    cut: list[DataFrame] = []
    settled = None
    for level in range(len(STEPS) + 1):
        judged = _judged(rows, f"level-{level}")
        found = judged.where("settled").select("text", "hull")
        settled = found if settled is None else settled.union(found)
        if level < len(STEPS):
            sure = F.collect_set(F.when(F.col("settled"), F.col("hull"))).alias("sure")
            lists = materialize(judged.where("open").groupBy("text").agg(F.collect_set("hull").alias(f"open{level}"), sure), "open")
            texts_here = long_texts.select("text", "content").join(lists, "text")
            for k, former in enumerate(cut):
                texts_here = texts_here.join(former, "text")
            cut.append(lists.drop("sure"))
            names = [f"open{k}" for k in range(level + 1)]
            rows = materialize(_piece_rows(texts_here.select("text", "content", *names, "sure"), length, level + 1), "pieces")

    flags = settled.groupBy("text").agg(F.collect_set("hull").alias("settled"))
    for former in cut:
        flags = flags.join(former, "text", "left")
    flags = materialize(flags, "flags")
    names = [f"open{k}" for k in range(len(STEPS))]
    joined = texts.join(flags, "text", "left").select("id", "content", "settled", *names)
    return _cut_texts(joined, length, kind)
