"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of documents as Spark hands it to a task. Its words become numbers of the benchmark's
vocabulary, all others a border. Runs of vocabulary words that are long enough to hold a test phrase are put
behind one another, each ended by a border, and indexed: suffix array by prefix doubling, Burrows-Wheeler
transform, a wavelet tree for ranks, and a sample of suffix positions. All test phrases are then searched
backwards at once; every occurrence is located by walking to the next sampled position.

The benchmark is cut into blocks of bounded size, in Spark. One block after the other is read by the driver, sent
to the tasks and searched in a job of its own that writes its hits to the shared folder, so neither the driver's
memory nor a plan nor a broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb
from hazegrid.llm.columns import free_prefix
from hazegrid.session import materialize, shared_path

WINDOW_WORDS = 10
BLOCK_BYTES = 8 << 20  # of benchmark text per pass
SHARD_BYTES = 8 << 20  # of document text per index
SAMPLE_EVERY = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of an integer text by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
        rank[order] = np.cumsum(changed)
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks of symbols in a text: one bit vector with counts per bit of the symbol, zeros before ones."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = ((text >> bit) & 1).astype(np.int64)
            counts = np.concatenate([[0], np.cumsum(ones)])
            zeros = len(text) - int(counts[-1])
            self.levels.append((bit, counts, zeros))
            text = np.concatenate([text[ones == 0], text[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros(len(position), dtype=np.int64)
        high = position.astype(np.int64)
        for bit, counts, zeros in self.levels:
            one = ((symbol >> bit) & 1) == 1
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low


class FMIndex:
    """Backward search over an integer text; symbol 0 is the border and is never searched."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        self.transform = text[order - 1]
        self.tree = WaveletTree(self.transform, max(1, int(symbols).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        # The first place of a run is always sampled, so no walk crosses a border.
        self.sampled = (order % SAMPLE_EVERY == 0) | (self.transform == 0)
        self.slot = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        self.length = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of every phrase; phrases are rows of symbols of one length."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.length, dtype=np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(phrases), dtype=bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row, then add the steps."""
        place, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        waiting = np.flatnonzero(~self.sampled[place])
        while len(waiting):
            symbol = self.transform[place[waiting]]
            place[waiting] = self.before[symbol] + self.tree.rank(symbol, place[waiting])
            steps[waiting] += 1
            waiting = waiting[~self.sampled[place[waiting]]]
        return self.samples[self.slot[place]] + steps


class Phrases:
    """The test phrases of one benchmark block, grouped by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([text for _, text in items], type=pa.large_string())
        data, offsets, _ = tb.batch_texts(texts)
        data = tb.LOWER[data]
        start, end, heads = tb.words(data, offsets, tb.byte_classes(tb.NO_WORD))
        hashes = tb.word_hashes(data, start, end)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        rows: dict[int, dict[tuple, set]] = {}
        for (item, _), a, b in zip(items, heads[:-1], heads[1:], strict=True):
            length = min(window, b - a)
            for at in range(a, b - length + 1) if length else ():
                rows.setdefault(length, {}).setdefault(tuple(symbols[at : at + length].tolist()), set()).add(item)
        self.by_length = {
            length: (np.array(list(found), dtype=np.int64), [sorted(s) for s in found.values()])
            for length, found in sorted(rows.items())
        }

    def runs(self, hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard's text for the index, and the word number behind each of its places (border: -1)."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), dtype=bool)
        first = known.copy()
        first[1:] &= ~known[:-1]
        inner = heads[:-1][heads[:-1] < len(hashes)]
        first[inner] = known[inner]
        begins = np.flatnonzero(first)
        stops = np.minimum(
            np.append(begins[1:], len(hashes)),
            np.append(np.flatnonzero(~known), len(hashes))[np.searchsorted(np.flatnonzero(~known), begins)],
        )
        long = stops - begins >= min(self.by_length, default=1)
        begins, stops = begins[long], stops[long]
        sizes = stops - begins + 1
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(begins, sizes)
        places[ends - 1] = -1
        text = np.where(places >= 0, at[places] + 1, 0)
        return text, places


def shard_hits(phrases: Phrases, hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """First word, number of words and items of every occurrence in a shard."""
    text, places = phrases.runs(hashes, heads)
    firsts, lengths, items = [], [], []
    if len(text):
        index = FMIndex(text, len(phrases.vocabulary))
        for length, (rows, owners) in phrases.by_length.items():
            low, high = index.search(rows)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            sizes = high[hit] - low[hit]
            suffixes = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[hit], sizes)
            firsts.append(places[index.locate(suffixes)])
            lengths.append(np.full(len(suffixes), length, dtype=np.int64))
            items.extend(owners[i] for i in np.repeat(hit, sizes))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate(firsts), np.concatenate(lengths), items


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, sorted; touching ranges become one."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), dtype=bool)
    new[1:] = first[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return first[begin], reach[np.append(begin[1:], len(first)) - 1]


class _Blocks:
    """The benchmark in blocks of at most ``BLOCK_BYTES`` of UTF-8 text (one item at least).

    More than one block are numbered task by task and written to the shared folder, parted by block.
    """

    def __init__(self, benchmark: DataFrame, item_column: str, text_column: str):
        item = F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item")
        self.items = benchmark.where(F.col(text_column).isNotNull()).select(item, F.col(text_column).alias("text"))
        size = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.single = size <= BLOCK_BYTES
        self.numbers = []
        if not self.single:
            numbered = self.items.coalesce(-(-size // BLOCK_BYTES)).mapInArrow(_numbering(BLOCK_BYTES), "item string, text string, block long")
            path = shared_path(benchmark.sparkSession, "blocks")
            numbered.write.partitionBy("block").parquet(path)
            self.items = benchmark.sparkSession.read.schema(numbered.schema).parquet(path)
            self.numbers = sorted(r.block for r in self.items.select("block").distinct().collect())

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        """One block after the other; only one is with the driver."""
        for part in [self.items] if self.single else (self.items.where(F.col("block") == n) for n in self.numbers):
            yield [(r.item, r.text) for r in part.select("item", "text").collect()]


def _numbering(limit: int):
    def number(batches):
        block, size, empty = TaskContext.get().partitionId() << 32, 0, True
        for batch in batches:
            _, offsets, _ = tb.batch_texts(batch.column(1))
            numbers = []
            for own in np.diff(offsets).tolist():
                if size + own > limit and not empty:
                    block, size = block + 1, 0
                size, empty = size + own, False
                numbers.append(block)
            yield batch.append_column("block", pa.array(numbers, type=pa.int64()))

    return number


def _hits(table: DataFrame, blocks: _Blocks, window: int, keys: int, name: str, schema: str) -> DataFrame:
    """The rows with hits of every block's pass, each pass written before the next block is read."""
    path = shared_path(table.sparkSession, "hits")
    for block in blocks:
        found = table.mapInArrow(_searching(block, window, keys, name), schema).where("hit_words > 0")
        found.write.mode("append").parquet(path)
    return table.sparkSession.read.schema(schema).parquet(path)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """``id, n_words, hit_words, starts, ends, items`` per document row.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A test phrase is
    ``window`` consecutive words of an item, or all its words if it has fewer. ``starts`` and ``ends`` are the
    merged byte ranges of the UTF-8 text to remove, ``hit_words`` the words in them, ``items`` the items found,
    sorted as strings.

    Null and empty texts have no words; null item texts hold no phrase; a null item id reads as an empty string.
    Rows repeated in either table count each for itself. Without benchmark rows nothing is hit. Other columns
    are not read. With several blocks the passes run at once.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_words long, hit_words long, starts array<long>, ends array<long>, items array<string>"
    blocks = _Blocks(benchmark, item_column, item_text)
    table = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if blocks.single:
        return table.mapInArrow(_searching(next(iter(blocks)), window, 0), schema)
    table = table.withColumn("key", F.xxhash64("text"))
    return _united(table, _hits(table, blocks, window, 1, "id", f"{schema}, key long"), schema)


def _searching(block: list[tuple[str, str]], window: int, keys: int, name: str = "id"):
    """Map function: one index per shard, searched for the block's phrases; ``keys`` columns behind the text pass through.

    ``name`` is that of the first column, which names the row.
    """

    def search(batches):
        phrases = Phrases(block, window)
        breaks = tb.byte_classes(tb.NO_WORD)
        for batch in batches:
            data, offsets, _ = tb.batch_texts(batch.column(1))
            for a, b in tb.row_slices(offsets, SHARD_BYTES):
                ids, part = batch.column(0).slice(a, b - a), data[offsets[a] : offsets[b]]
                found = _shard_rows(phrases, breaks, ids, part, offsets[a : b + 1] - offsets[a])
                for k in range(keys):
                    found = found.append_column(batch.schema.field(2 + k), batch.column(2 + k).slice(a, b - a))
                yield found.rename_columns([name, *found.schema.names[1:]])

    return search


def _shard_rows(phrases: Phrases, breaks, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    data = tb.LOWER[data]
    start, end, heads = tb.words(data, offsets, breaks)
    first, length, items = shard_hits(phrases, tb.word_hashes(data, start, end), heads)
    rows = np.searchsorted(heads, first, side="right") - 1
    n = len(ids)
    starts, ends, names, hit = [[]] * n, [[]] * n, [[]] * n, np.zeros(n, dtype=np.int64)
    order = np.argsort(rows, kind="stable")
    borders = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0, [True]])) if len(rows) else []
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        own = order[a:b]
        row = int(rows[own[0]])
        low, high = merged(first[own], first[own] + length[own])
        hit[row] = int((high - low).sum())
        starts[row] = (start[low] - offsets[row]).tolist()
        ends[row] = (end[high - 1] - offsets[row]).tolist()
        names[row] = sorted({name for i in own for name in items[i]})
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(heads)),
            pa.array(hit),
            pa.array(starts, type=pa.list_(pa.int64())),
            pa.array(ends, type=pa.list_(pa.int64())),
            pa.array(names, type=pa.list_(pa.string())),
        ],
        names=["id", "n_words", "hit_words", "starts", "ends", "items"],
    )


def _joined_spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, starts, ends, items`` of all passes together; ranges of different passes may overlap."""
    spans = found.groupBy(*keys).agg(
        F.collect_set(F.struct("starts", "ends")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return spans.select(*keys, F.flatten("ranges.starts").alias("starts"), F.flatten("ranges.ends").alias("ends"), "items")


def _merged_rows(batch: pa.RecordBatch):
    """Per row of ``key, text, starts, ends``: number of words, words hit, and the byte ranges merged word by word."""
    data, offsets, _ = tb.batch_texts(batch.column(1))
    start, end, heads = tb.words(tb.LOWER[data], offsets, tb.byte_classes(tb.NO_WORD))
    for row, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        own = slice(heads[row], heads[row + 1])
        begins, stops = start[own] - offsets[row], end[own] - offsets[row]
        first = np.searchsorted(begins, np.array(a or [], dtype=np.int64))
        last = np.searchsorted(stops, np.array(b or [], dtype=np.int64)) + 1
        low, high = merged(first, last)
        yield len(begins), int((high - low).sum()), begins[low].tolist(), stops[high - 1].tolist()


def _united(table: DataFrame, found: DataFrame, schema: str) -> DataFrame:
    """Several passes as one row per document: ranges and items joined, then merged beside the text again.

    Rows of one id and text are one group here; each row of the input gets its result.
    """
    spans = _joined_spans(found, ["id", "key"])
    on = table["id"].eqNullSafe(spans["id"]) & table["key"].eqNullSafe(spans["key"])
    joined = table.join(spans, on, "left").select(table["id"], "text", "starts", "ends", "items")

    def merge(batches):
        for batch in batches:
            found = list(_merged_rows(batch))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            items = pa.array([x or [] for x in batch.column(4).to_pylist()], type=pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k] for f in found], type=kind) for k, kind in enumerate(kinds)), items],
                names=["id", "n_words", "hit_words", "starts", "ends", "items"],
            )

    return joined.mapInArrow(merge, schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", window: int = WINDOW_WORDS, item_text: str = "text"
) -> DataFrame:
    """The documents with every merged span cut out of the text; one space stays in its place.

    All rows stay, in the same columns; texts without a hit are unchanged, null stays null. Spans are cut until
    no phrase is left, since the words around a cut may form one. Each round of cuts takes the spans of the whole
    benchmark, so its number of blocks and their order change nothing. With several blocks the rounds run at once
    and are written to the shared folder.
    """
    blocks = _Blocks(benchmark, "item_id", item_text)
    if blocks.single:
        return docs.mapInArrow(_cutting(next(iter(blocks)), window, docs.columns.index(text_column)), docs.schema)
    return _cut_in_rounds(docs, blocks, text_column, window)


def _cut_in_rounds(docs: DataFrame, blocks: _Blocks, text_column: str, window: int) -> DataFrame:
    """Cuts for several blocks: what a text becomes depends on the text only, so equal texts are cut once.

    The first round searches all texts, each later one only those that the round before has changed.
    """
    schema = "key string, n_words long, hit_words long, starts array<long>, ends array<long>, items array<string>"
    text = F.col(f"`{text_column}`")
    now, rounds = docs.where(text.isNotNull()).select(F.md5(text).alias("key"), text.alias("text")), []
    while True:
        spans = materialize(_joined_spans(_hits(now, blocks, window, 0, "key", schema), ["key"]), "spans")
        if spans.isEmpty():
            break
        hit = now.join(spans, "key").dropDuplicates(["key"]).select("key", "text", "starts", "ends")
        now = materialize(hit.mapInArrow(_cut_rows, "key string, text string"), "cut")
        rounds.append(now.withColumn("round", F.lit(len(rounds))))
    if not rounds:
        return docs
    changed = rounds[0]
    for one in rounds[1:]:
        changed = changed.unionByName(one)
    name = free_prefix(docs.columns, "_b_")
    changed = changed.groupBy(F.col("key").alias(f"{name}key")).agg(F.max_by("text", "round").alias(f"{name}text"))
    joined = docs.withColumn(f"{name}key", F.md5(text)).join(changed, f"{name}key", "left")
    cut = F.coalesce(F.col(f"{name}text"), text).alias(text_column)
    return joined.select(*[cut if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def _without(text: bytes, starts: list[int], ends: list[int]) -> str:
    """The text with one space in the place of every range."""
    pieces, at = [], 0
    for x, y in zip(starts, ends, strict=True):
        pieces.append(text[at:x])
        at = y
    return b" ".join([*pieces, text[at:]]).decode()


def _cut_rows(batches):
    for batch in batches:
        texts = [
            _without(text.encode(), low, high)
            for text, (_, _, low, high) in zip(batch.column(1).to_pylist(), _merged_rows(batch), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["key", "text"])


def _cutting(block, window: int, column: int):
    def cut(batches):
        phrases = Phrases(block, window)
        breaks = tb.byte_classes(tb.NO_WORD)
        for batch in batches:
            texts = batch.column(column)
            data, offsets, _ = tb.batch_texts(texts)
            changed: dict[int, str] = {}
            for a, b in tb.row_slices(offsets, SHARD_BYTES):
                rows, part, borders = np.arange(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                while len(rows):
                    found = _shard_rows(phrases, breaks, pa.array(rows), part, borders)
                    left = []
                    for i, (low, high) in enumerate(zip(found.column(3).to_pylist(), found.column(4).to_pylist(), strict=True)):
                        if low:
                            changed[int(rows[i])] = _without(part[borders[i] : borders[i + 1]].tobytes(), low, high)
                            left.append(int(rows[i]))
                    rows = np.array(left, dtype=np.int64)
                    part, borders, _ = tb.batch_texts(pa.array([changed[r] for r in left], type=pa.large_string()))
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], type=texts.type)
                batch = batch.set_column(column, batch.schema.field(column), texts)
            yield batch

    return cut
