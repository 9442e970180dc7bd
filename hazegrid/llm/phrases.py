"""Phrase collocations from a weighted de Bruijn graph of words.

1. Words are counted per language. Each (language, word) is known by a 64-bit hash; hashes that a frequent word
   would share with another word lead to another seed, so counts are exact.
2. Nodes of the graph are runs of four words, edges are runs of five. Every position of a text gives one edge: the
   five words from there on, or fewer where the piece ends or where two words follow each other too rarely for any
   phrase. The shorter ones are the corrections at the ends. Equal edges of a chunk of text are added up before the
   shuffle. Which neighbours are too rare is known from counters that pairs are hashed to: a counter below the
   least count proves it, and a shared counter only lets more edges through.
3. Edges are dealt out by their first two words, or by more as long as all words so far are so frequent that one
   task might not hold the edges that begin with them. A task sorts its edges part by part; the flow through a
   shorter phrase is the sum over the edges that begin with it, ends included. Where all flow of a phrase goes on to one longer phrase, the path is unary: it is
   compacted into one row, the longest phrase with the length of its shortest beginning of equal count.
4. Paths that reach the least count are unrolled where counts of parts are looked up.

What is sent to all tasks are three bit tables of fixed size (frequent words, frequent neighbours, hot words). A
wrong hit in one of them costs work, never a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb
from hazegrid.llm.periods import word_codes
from hazegrid.operators.series import top_rows
from hazegrid.session import materialize

LONGEST = 5
UNKNOWN_LANGUAGE = "und"
CHUNK_BYTES = 4 << 20
BLOCK_WORDS = 1 << 20
PART_POSITIONS = 1 << 20  # positions of text per part of the edge table, which is sorted at once
PARTS_SENT = 4  # parts that are sent together, so that a chunk's words are sent less often
TABLE_BITS = 24
PAIR_BITS, RANGE_BITS = 32, 22  # counters of pairs, and those that a task holds at a time
# Bytes that end a piece, and those that only part words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _hashes(dictionary: pa.Array, seed: int) -> np.ndarray:
    """Hash of every distinct word."""
    data, offsets, _ = tb.batch_texts(dictionary.cast(pa.large_string()))
    return tb.mixed(tb.word_hashes(data, offsets[:-1], offsets[1:], 0) + np.uint64(seed) * np.uint64(tb.BASES[1]))


def _keys(word: np.ndarray, language: np.ndarray) -> np.ndarray:
    return tb.mixed(word ^ (language << np.uint64(1)))


class Words:
    """Words of a chunk: code, language code, whether the next word follows in the same piece."""

    def __init__(self, content: pa.Array, language: pa.Array):
        data, offsets, _ = tb.batch_texts(content)
        data = tb.LOWER[data]
        ends = tb.byte_classes(ENDS)
        start, end, heads = tb.words(data, offsets, ends | tb.byte_classes(GAPS))
        self.codes, self.words = word_codes(data, start, end)
        coded = language.dictionary_encode()
        self.languages = coded.dictionary
        row = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        self.language = coded.indices.to_numpy()[row] if len(row) else row
        piece = np.cumsum(ends[data])[start] if len(start) else start
        self.follows = np.zeros(len(start), dtype=bool)
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])

    def keys(self, seed: int) -> np.ndarray:
        """64-bit key of (language, word) at every position."""
        if not len(self.codes):
            return np.zeros(0, np.uint64)
        return _keys(_hashes(self.words, seed)[self.codes], _hashes(self.languages, seed + 1)[self.language])


def _chunks(batch: pa.RecordBatch):
    _, offsets, _ = tb.batch_texts(batch.column(1))
    for a, b in tb.row_slices(offsets, CHUNK_BYTES):
        yield Words(batch.column(1).slice(a, b - a), batch.column(0).slice(a, b - a))


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, n`` over all texts (``lang, content``)."""

    def count(batches):
        for batch in batches:
            for chunk in _chunks(batch):
                n_words = max(len(chunk.words), 1)
                both, n = np.unique(chunk.language * np.int64(n_words) + chunk.codes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.languages.take(pa.array(both // n_words)),
                        chunk.words.take(pa.array(both % n_words)).cast(pa.large_string()).cast(pa.string()),
                        pa.array(n),
                    ],
                    names=["lang", "word", "n"],
                )

    return texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def with_keys(counted: DataFrame, seed: int) -> DataFrame:
    """``lang, word, n, key``."""

    def add(batches):
        for batch in batches:
            language = batch.column(0).dictionary_encode()
            keys = _keys(_hashes(batch.column(1), seed), _hashes(language.dictionary, seed + 1)[language.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tb.signed(keys))], names=["lang", "word", "n", "key"])

    return counted.select("lang", "word", "n").mapInArrow(add, "lang string, word string, n long, key long")


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits at the hashes of ``key``, as bytes. Its size is fixed, whatever the number of keys."""
    placed = keys.select(F.pmod("key", F.lit(1 << TABLE_BITS)).alias("place"))
    bits = placed.selectExpr("cast(place div 32 as int) AS cell", "shiftleft(1L, cast(place % 32 as int)) AS bit")
    cells = bits.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    table = np.zeros(1 << (TABLE_BITS - 5), dtype=np.uint32)
    for cell in cells:
        table[cell["cell"]] = cell["bits"]
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64((1 << TABLE_BITS) - 1)
    return (table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def _depth(grams: np.ndarray, length: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Number of first words that an edge is dealt out by: up to the first that is not hot, two at least."""
    depth = np.minimum(length, LONGEST)
    for at in range(LONGEST - 1, -1, -1):
        cool = (length > at) & ~in_table(hot, grams[:, at])
        depth[cool] = max(at + 1, 2)
    return depth


def _neighbours(chunk: Words, keys: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word and next word in the same piece are frequent, and the counter that each pair has."""
    keep = in_table(frequent, keys)
    goes_on = chunk.follows.copy()
    goes_on[:-1] &= keep[:-1] & keep[1:]
    at = np.flatnonzero(goes_on)
    return at, tb.mixed(keys[at] * np.uint64(tb.BASES[1]) + keys[at + 1]) >> np.uint64(64 - PAIR_BITS)


def count_pairs(texts: DataFrame, seed: int, frequent: np.ndarray, least: int) -> DataFrame:
    """``key, n``: the counters of pairs of neighbours that reach ``least``."""
    ranges = np.arange(1 << (PAIR_BITS - RANGE_BITS), dtype=np.uint64) << np.uint64(RANGE_BITS)

    def count(batches):
        for batch in batches:
            for chunk in _chunks(batch):
                counters, n = np.unique(_neighbours(chunk, chunk.keys(seed), frequent)[1], return_counts=True)
                borders = np.append(np.searchsorted(counters, ranges), len(counters))
                filled = np.flatnonzero(np.diff(borders))
                packed = []
                for i in filled:
                    own = slice(borders[i], borders[i + 1])
                    steps = np.diff(counters[own], prepend=ranges[i]).astype(np.uint32)
                    packed.append(_squeezed(steps.tobytes() + n[own].astype(np.uint32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(packed, pa.binary())], names=["range", "pairs"])

    def add(batches):
        """Ranges come sorted, one after the other; the counters of one are held at a time."""
        number, total = -1, np.zeros(1 << RANGE_BITS, dtype=np.int64)

        def reached():
            place = np.flatnonzero(total >= least)
            keys = place + (number << RANGE_BITS)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[place])], names=["key", "n"])

        for batch in batches:
            for which, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if which != number:
                    if number >= 0:
                        yield reached()
                    number = which
                    total[:] = 0
                steps, n = np.frombuffer(_loosened(blob.as_buffer()), dtype=np.uint32).reshape(2, -1)
                total[np.cumsum(steps, dtype=np.int64)] += n
        if number >= 0:
            yield reached()

    cut = texts.mapInArrow(count, "range long, pairs binary")
    return cut.repartition("range").sortWithinPartitions("range").mapInArrow(add, "key long, n long")


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(blob) -> pa.Buffer:
    view = memoryview(blob)
    return pa.decompress(view[8:], decompressed_size=int.from_bytes(view[:8], "little"), codec="zstd")


def edges_of(chunk: Words, seed: int, frequent: np.ndarray, pairs: np.ndarray, hot: np.ndarray, parts: int):
    """The edges of a chunk as ``bundle, edges``: those of some neighbouring parts, with their counts, packed."""
    keys = chunk.keys(seed)
    at, counter = _neighbours(chunk, keys, frequent)
    goes_on = np.zeros(len(keys) + 1, dtype=bool)
    goes_on[at[in_table(pairs, counter)]] = True
    length = np.ones(len(keys), dtype=np.int64)
    for step in range(1, LONGEST):
        reach = np.flatnonzero((length == step) & np.append(goes_on[step - 1 :], np.zeros(step - 1, bool))[: len(keys)])
        length[reach] += 1
    for low in range(0, len(keys), BLOCK_WORDS):
        yield from _block_edges(keys[low : low + BLOCK_WORDS + LONGEST], length[low : low + BLOCK_WORDS], hot, parts)


def _block_edges(keys: np.ndarray, length: np.ndarray, hot: np.ndarray, parts: int):
    at = np.flatnonzero(length > 1)
    if not len(at):
        return
    length = length[at]
    distinct, code = np.unique(keys, return_inverse=True)
    code = np.concatenate([code + 1, np.zeros(LONGEST, code.dtype)]).astype(np.uint64)
    columns = [np.where(length > k, code[at + k], np.uint64(0)) for k in range(LONGEST)]
    # Three numbers of a block fit into 64 bits.
    bits = np.uint64(21)
    high = (columns[0] << (bits + bits)) | (columns[1] << bits) | columns[2]
    low = (columns[3] << bits) | columns[4]
    order = np.lexsort([low, high])
    high, low = high[order], low[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    edge = order[first]
    grams = np.stack([c[edge].astype(np.int64) for c in columns], axis=1)
    known = np.concatenate([np.zeros(1, np.uint64), distinct])
    depth = _depth(known[grams], length[edge], hot)
    total = np.zeros(len(edge), dtype=np.uint64)
    for k in range(LONGEST):
        total = np.where(depth > k, tb.mixed(total * np.uint64(tb.BASES[0]) + known[grams[:, k]]), total)
    part = (total % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    borders = np.flatnonzero(np.diff(part // PARTS_SENT, prepend=-1))
    bundles, blobs = [], []
    for a, b in zip(borders, [*borders[1:], len(order)], strict=True):
        chosen = order[a:b]
        used, local, often = np.unique(grams[chosen], return_inverse=True, return_counts=True)
        # Frequent words get small numbers, which pack better.
        order_used = np.argsort(-often, kind="stable")
        number = np.empty(len(used), dtype=np.int64)
        number[order_used] = np.arange(len(used))
        bundles.append(int(part[a]) // PARTS_SENT)
        blobs.append(_pack(known[used[order_used]], number[local].reshape(-1, LONGEST), count[chosen], part[a:b] % PARTS_SENT))
    yield pa.RecordBatch.from_arrays([pa.array(bundles, pa.int64()), pa.array(blobs, pa.binary())], names=["bundle", "edges"])


def _edge_rows(texts: DataFrame, seed: int, tables: tuple[np.ndarray, ...], parts: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for chunk in _chunks(batch):
                yield from edges_of(chunk, seed, *tables, parts)

    return texts.mapInArrow(cut, "bundle long, edges binary")


def _pack(words: np.ndarray, grams: np.ndarray, count: np.ndarray, part: np.ndarray) -> bytes:
    """Edges (numbers of words), sorted by their part within the bundle, as bytes."""
    kinds = [np.dtype(np.uint16 if top < 1 << 16 else np.uint32) for top in (len(words), int(count.max()))]
    borders = np.searchsorted(part, np.arange(PARTS_SENT + 1))
    sizes = np.array([len(words), len(count), kinds[0].itemsize, kinds[1].itemsize, *borders], dtype=np.int64)
    # High and low bytes lie apart, so that what is alike lies together.
    planes = [np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() for x, kind in zip((grams.T, count), kinds)]
    return _squeezed(b"".join([sizes.tobytes(), words.tobytes(), *planes]))


class _Edges:
    """The packed edges of a chunk."""

    def __init__(self, packed):
        blob = _loosened(packed)
        head = np.frombuffer(blob, dtype=np.int64, count=4 + PARTS_SENT + 1)
        n_words, n_edges, wide, counted = head[:4].tolist()
        self.borders, at = head[4:], head.nbytes
        self.words = np.frombuffer(blob, dtype=np.uint64, count=n_words, offset=at)
        at += self.words.nbytes
        bytes_ = np.frombuffer(blob, dtype=np.uint8, offset=at)
        split = wide * LONGEST * n_edges
        self.grams = np.ascontiguousarray(bytes_[:split].reshape(wide, -1).T).view(f"u{wide}").reshape(LONGEST, n_edges)
        self.count = np.ascontiguousarray(bytes_[split:].reshape(counted, -1).T).view(f"u{counted}").reshape(-1)

    def part(self, number: int) -> slice:
        return slice(int(self.borders[number]), int(self.borders[number + 1]))


PATHS = "phrase array<long>, shortest int, n long, whole boolean"


def _path_rows(edges: DataFrame, hot: np.ndarray, least: int) -> DataFrame:
    """Per part: compacted paths whose count is known and reaches ``least``, and parts of counts of hot phrases."""

    def flow(rows: pa.Table) -> pa.Table:
        bundle = [_Edges(blob.as_buffer()) for chunk in rows.column("edges").chunks for blob in chunk]
        known, rank = np.unique(np.concatenate([e.words for e in bundle] + [np.zeros(1, np.uint64)]), return_inverse=True)
        rank = np.split(rank.astype(np.int32), np.cumsum([len(e.words) for e in bundle]))
        found = [paths(bundle, known, rank, number) for number in range(PARTS_SENT)]
        return pa.concat_tables([table for table in found if table is not None])

    def paths(bundle: list[_Edges], known: np.ndarray, rank: list[np.ndarray], number: int) -> pa.Table | None:
        inside = [(e, r, e.part(number)) for e, r in zip(bundle, rank)]
        grams = np.concatenate([r[e.grams[:, part]] for e, r, part in inside], axis=1).T
        count = np.concatenate([e.count[part] for e, _, part in inside]).astype(np.int64)
        if not len(count):
            return None
        empty = int(np.searchsorted(known, np.uint64(0)))
        grams = np.where(grams == empty, np.int32(-1), grams)
        order = np.lexsort(grams.T[::-1])
        grams, count = grams[order], count[order]
        length = (grams >= 0).sum(axis=1)
        hot_word = in_table(hot, known)
        cool = ~hot_word[grams[:, 0]]  # the phrase so far has a word that is not hot, so all its edges are here
        changed = np.ones(len(grams), dtype=bool)
        changed[1:] = grams[1:, 0] != grams[:-1, 0]
        levels = []
        for size in range(2, LONGEST + 1):
            changed[1:] |= grams[1:, size - 1] != grams[:-1, size - 1]
            cool = cool | ((length >= size) & ~hot_word[grams[:, size - 1]])
            # Rows of one phrase are neighbours; those that end before it stand in front of it.
            has = np.flatnonzero(length >= size)
            head = np.flatnonzero(changed[has])
            first = has[head]
            total = np.add.reduceat(count[has], head) if len(has) else count[:0]
            levels.append((first, total, cool[first] | (size == LONGEST)))
        out_first, out_size, out_shortest, out_total, out_whole = [], [], [], [], []
        shortest = None
        for size, (first, total, whole) in enumerate(levels, start=2):
            low = np.full(len(first), size)
            if shortest is not None:
                before, before_total, before_whole, before_low = shortest
                place = np.searchsorted(before, first)
                same = place < len(before)
                same[same] = before[place[same]] == first[same]
                # All flow of the shorter phrase goes on here: one path.
                unary = same.copy()
                unary[same] &= (before_total[place[same]] == total[same]) & before_whole[place[same]] & whole[same]
                low[unary] = before_low[place[unary]]
                open_ = np.ones(len(before), dtype=bool)
                open_[place[unary]] = False
                emit = open_ & (~before_whole | (before_total >= least))
                out_first.append(before[emit])
                out_size.append(np.full(emit.sum(), size - 1))
                out_shortest.append(before_low[emit])
                out_total.append(before_total[emit])
                out_whole.append(before_whole[emit])
            shortest = first, total, whole, low
        first, total, whole, low = shortest
        emit = ~whole | (total >= least)
        for out, x in zip((out_first, out_size, out_shortest, out_total, out_whole), (first[emit], np.full(emit.sum(), LONGEST), low[emit], total[emit], whole[emit])):
            out.append(x)
        first, size, low, total, whole = (np.concatenate(x) for x in (out_first, out_size, out_shortest, out_total, out_whole))
        inside = np.arange(LONGEST)[None, :] < size[:, None]
        phrases = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(tb.signed(known[grams[first]][inside]))
        )
        return pa.table({"phrase": phrases, "shortest": pa.array(low.astype(np.int32)), "n": pa.array(total), "whole": pa.array(whole)})

    return edges.groupBy("bundle").applyInArrow(flow, PATHS)


def phrase_counts(docs: DataFrame, text_column: str, language_column: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): all words as ``lang, word, key, n``, and phrases of 2 to 5 words as ``phrase`` (keys), ``a``.

    Phrases are those that occur ``least`` times within pieces, overlaps included.
    """
    texts = docs.select(
        F.coalesce(F.col(language_column).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"), F.coalesce(F.col(text_column), F.lit("")).alias("content")
    )
    counted = materialize(count_words(texts), "counted")
    seed = 0
    while True:
        words = materialize(with_keys(counted, seed), "words")
        shared = words.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("words")).where(F.col("words") > 1)
        if shared.where(F.col("n") >= least).isEmpty():
            break
        seed += 2
    frequent = bit_table(words.where(F.col("n") >= least))
    hot = bit_table(words.where(F.col("n") >= PART_POSITIONS))
    pairs = materialize(count_pairs(texts, seed, frequent, least), "pairs")
    positions = pairs.agg(F.sum("n")).first()[0] or 0
    edges = _edge_rows(texts, seed, (frequent, bit_table(pairs), hot), max(1, -(-positions // PART_POSITIONS)))
    paths = materialize(_path_rows(edges, hot, least), "paths")
    split = paths.where("not whole").groupBy("phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    lengths = F.explode(F.sequence("shortest", F.size("phrase"))).alias("size")
    rolled = paths.where("whole").select("phrase", F.col("n").alias("a"), lengths)
    phrases = rolled.select(F.slice("phrase", F.lit(1), F.col("size")).alias("phrase"), "a").union(split)
    return words, materialize(phrases, "phrases")


def collocations(
    docs: DataFrame, text_column: str = "text", language_column: str = "lang", least: int = 100, top: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by their weakest cut.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces, and those at blanks and tabs
    into words. n counts a language's words, a phrase's count a its occurrences within pieces. A cut into two
    parts of counts l and r scores floor(1000 * a * n / (l * r)); the lowest cut counts, the first of equal ones.
    Phrases that lie in a longer phrase of equal count are left out. Order: score and a descending, phrase
    ascending by bytes. All sums and products are exact.

    A null text is empty, a null language is ``und``. Repeated rows count again. Empty tables, and tables without
    a phrase that occurs ``least`` times, give no rows; other columns are not read. A text of any length is read
    by one task, which works off its edges in blocks of words.
    """
    words, phrases = phrase_counts(docs, text_column, language_column, least)
    singles = words.where(F.col("n") >= least).select(F.array("key").alias("phrase"), F.col("n").alias("a"))
    known = materialize(phrases.union(singles), "known")

    # A longer phrase of equal count has one of one word more.
    longer = phrases.where(F.size("phrase") > 2)
    size = F.size("phrase")
    inner = longer.select(F.slice("phrase", F.lit(1), size - 1).alias("phrase"), F.col("a").alias("outer")).union(
        longer.select(F.slice("phrase", F.lit(2), size - 1).alias("phrase"), F.col("a").alias("outer"))
    )
    inner = inner.groupBy("phrase").agg(F.max("outer").alias("outer"))
    closed = phrases.join(inner, "phrase", "left").where(F.col("outer").isNull() | (F.col("outer") < F.col("a"))).select("phrase", "a")

    cuts = closed.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("left"), F.slice("phrase", F.col("k") + 1, size - F.col("k")).alias("right")
    )
    left = known.select(F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select(F.col("phrase").alias("right"), F.col("a").alias("r"))
    cuts = cuts.join(left, "left").join(right, "right")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    language = words.where(F.col("n") >= least).select("key", "lang").join(totals, "lang")
    cuts = cuts.join(language, F.col("phrase")[0] == F.col("key"))
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumns({"_over": wide["a"] * wide["n"] * 1000, "_under": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("_over div _under"))
    weakest = cuts.groupBy("phrase").agg(F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("c")).select("phrase", "c.*")

    spelled = weakest.select("phrase", F.posexplode("phrase").alias("at", "key")).join(words.select("key", "word"), "key")
    spelled = spelled.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    named = weakest.join(spelled, "phrase").select("lang", text.alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return top_rows(named, ["lang"], order, top, ["phrase"], rank="rank").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
