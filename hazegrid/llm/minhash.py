"""Near duplicates by banded MinHash with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit fingerprints), a MinHash signature and a
   fingerprint of the whole set. Equal sets are one node, so exact copies cost one row each from here on.
2. Bands of the signature give buckets. A bucket is never turned into all its pairs: each member is paired with
   one or two members of the bucket.
3. Candidate pairs are compared by batches of signature values. After each batch a pair is dropped when the
   posterior chance that its similarity reaches the threshold is below ``miss``. The rest is decided exactly
   on the full sets.
4. Links found give components. Pairs that the stars left open, between different components of a bucket, are
   found with a prefix filter: two sets with the needed similarity share one of their rarest shingles. So
   common passages and copies of one text do not meet again. A pair leaves that join only if parity bits of both
   sets do not show more differences than the similarity allows, which rules out sets just below it exactly.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb
from hazegrid.llm.components import connected_components
from hazegrid.session import materialize

BANDS, BAND_ROWS = 40, 6
COMPARED, BATCH = 128, 32
MISS = 1e-6
VARIED = 8
PARITY_LONGS = 16


def needed_matches(percent: int, miss: float = MISS) -> list[int]:
    """Per batch end n: the fewest matches m with P(similarity >= threshold | m of n) >= ``miss``, uniform prior.

    The posterior is a beta distribution; its tail equals a binomial sum of n + 1 trials.
    """
    t, needed = percent / 100, []
    for n in range(BATCH, COMPARED + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        needed.append(m)
    return needed


def shingle_sets(column: pa.Array, shingle_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of the rows: first row, all distinct shingles behind one another, borders per row."""
    data, offsets, _ = tb.batch_texts(column)
    breaks = tb.byte_classes(tb.SPACES)
    for first, last in tb.row_slices(offsets):
        low = offsets[first]
        part, borders = tb.LOWER[data[low : offsets[last]]], offsets[first : last + 1] - low
        start, end, heads = tb.words(part, borders, breaks)
        hashes = tb.word_hashes(part, start, end)
        runs = tb.sequence_hash(hashes, shingle_words)
        sets = []
        for a, b in zip(heads[:-1], heads[1:], strict=True):
            if b - a >= shingle_words:
                sets.append(np.unique(runs[a : b - shingle_words + 1]))
            else:
                sets.append(tb.sequence_hash(hashes[a:b], b - a) if b > a else runs[:0])
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        yield first, np.concatenate(sets) if sets else runs[:0], np.concatenate([[0], np.cumsum(sizes)])


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seeds = tb.mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
    return (seeds >> np.uint64(32)).astype(np.uint32), (seeds.astype(np.uint32) | np.uint32(1))


def _signature(values: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of every permutation over one set, in blocks, so a huge set needs little memory."""
    out = np.full(len(flips), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(values), 4096):
        block = values[at : at + 4096]
        np.minimum(out, ((block[None, :] ^ flips[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """``id, n_shingles, node, signature, bands`` per row; node fingerprints the set and is null if it is empty."""
    flips, factors = _permutations()

    def sign(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            nodes = np.zeros(batch.num_rows, dtype=np.uint64)
            signs: list = [None] * batch.num_rows
            bands: list = [None] * batch.num_rows
            for first, values, borders in shingle_sets(batch.column(1), shingle_words):
                spread = tb.mixed(values ^ np.uint64(0x5DEECE66D))
                short = (values >> np.uint64(32)).astype(np.uint32)
                for i in range(len(borders) - 1):
                    a, b = borders[i], borders[i + 1]
                    if a == b:
                        continue
                    row = first + i
                    sizes[row] = b - a
                    nodes[row] = tb.mixed(spread[a:b].sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0]
                    least = _signature(short[a:b], flips, factors)
                    signs[row] = least[:COMPARED].astype(np.uint16).tobytes()
                    keys = least.reshape(BANDS, BAND_ROWS).astype(np.uint64)
                    total = np.arange(BANDS, dtype=np.uint64)
                    for k in range(BAND_ROWS):
                        total = tb.mixed(total * np.uint64(tb.BASES[0]) + keys[:, k])
                    bands[row] = tb.signed(total).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(tb.signed(nodes), mask=sizes == 0),
                    pa.array(signs, type=pa.binary()),
                    pa.array(bands, type=pa.binary()),
                ],
                names=["id", "n_shingles", "node", "signature", "bands"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column).mapInArrow(
        sign, f"id {kind}, n_shingles long, node long, signature binary, bands binary"
    )


def _band_rows(nodes: DataFrame) -> DataFrame:
    """One row ``key, node`` per node and band."""

    def cut(batches):
        for batch in batches:
            keys = [np.frombuffer(v.as_py(), dtype=np.int64) for v in batch.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))],
                    names=["key", "node"],
                )

    return nodes.select("node", "bands").mapInArrow(cut, "key long, node long")


def _star_pairs(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each member of a bucket with its smallest member, which bands of one group share, so pairs are few.

    In one of ``VARIED`` buckets also with a member that the key chooses, so members far from the smallest one
    are held against others too.
    """
    chosen = F.when(F.col("key") % VARIED == 0, F.col("high").bitwiseXOR(F.col("key"))).otherwise(F.col("low"))
    pairs = rows.join(buckets.where("n > 1"), "key").select("node", F.explode(F.array("low", chosen)).alias("other"))
    return _ordered(pairs).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _bayes(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs that sequential comparison of their signatures does not rule out; sizes must allow the similarity."""
    needed = needed_matches(percent)
    left = signs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    right = signs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))

    def prune(batches):
        for batch in batches:
            alive = np.arange(batch.num_rows)
            sides = [
                np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), dtype=np.uint16).reshape(-1, COMPARED)
                for c in (2, 3)
            ]
            matches = np.zeros(batch.num_rows, dtype=np.int64)
            for step, least in enumerate(needed):
                span = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (sides[0][alive, span] == sides[1][alive, span]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(alive)) for c in (0, 1)], names=["a", "b"]
            )

    sized = pairs.join(left, "a").join(right, "b")
    possible = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sized.where(possible).select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """Sorted shingle fingerprints per node, read again from the texts of ``wanted`` (columns ``node, id``).

    Rows without id cannot be picked by it: where a wanted node has no id, all of them are read and picked by node.
    """

    def collect(batches):
        for batch in batches:
            nodes, sets = [], []
            for _, values, borders in shingle_sets(batch.column(0), shingle_words):
                spread = tb.mixed(values ^ np.uint64(0x5DEECE66D))
                for a, b in zip(borders[:-1], borders[1:], strict=True):
                    if b > a:
                        total = spread[a:b].sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
                        nodes.append(int(tb.signed(tb.mixed(total))[0]))
                        sets.append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, type=pa.int64()), pa.array(sets, type=pa.binary())], names=["node", "shingles"]
            )

    schema = "node long, shingles binary"
    all_texts = docs.select(F.col(id_column).alias("id"), text_column)
    texts = all_texts.join(wanted.select("id"), "id", "left_semi").select(text_column)
    nameless = all_texts.where("id is null").select(text_column).mapInArrow(collect, schema)
    nameless = nameless.join(wanted.where("id is null").select("node"), "node", "left_semi")
    return texts.mapInArrow(collect, schema).union(nameless).dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity, as ``u, v``."""

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(side.as_py(), dtype=np.uint64) for side in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(keep)) for c in (0, 1)], names=["u", "v"]
            )

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(check, "u long, v long")


def _parity(values: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of a set's shingles hash to them, as longs.

    The exclusive or of two sets' bits is that of their difference, so it has at most as many bits as shingles
    that are in one of them only.
    """
    place = (tb.mixed(values) % np.uint64(64 * PARITY_LONGS)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=64 * PARITY_LONGS) & 1).astype(bool)).view(np.int64)


def _prefix_rows(open_sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, component, size, at`` for the rarest shingles of each set, of which similar sets share one.

    Rarity is counted over the open sets; ties go by the shingle itself, so all sets use one order. Only the
    shingle and its count are regrouped per node, a node's list is as long as its own text.
    """
    tokens = open_sets.select("node", "component", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(counts, "token", "left")
    ranked = shared.groupBy("node", "component").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("by_df")
    )
    size = F.size("by_df")
    keep = size - F.ceil(size * percent / 100).cast("int") + 1
    rows = ranked.select("node", "component", size.alias("size"), F.posexplode(F.slice("by_df", F.lit(1), keep)).alias("at", "t"))
    return rows.where("t.df > 1").select(F.col("t.token").alias("token"), "node", "component", "size", "at")


def _open_pairs(rows: DataFrame, buckets: DataFrame, parts: DataFrame, load_sets, percent: int) -> DataFrame:
    """Pairs across components that share a bucket of three or more members, found by the prefix filter."""
    members = rows.join(buckets.where("n > 2").select("key"), "key").join(parts, "node", "left")
    members = members.withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_nodes = materialize(members.join(mixed.select("key"), "key", "left_semi").select("node", "component").distinct(), "open")

    names = [f"p{i}" for i in range(PARITY_LONGS)]

    def unpack(batches):
        for batch in batches:
            values = [np.frombuffer(v.as_py(), dtype=np.int64) for v in batch.column(2)]
            borders = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(borders), pa.array(flat))
            parity = np.stack([_parity(v.view(np.uint64)) for v in values]) if values else np.zeros((0, PARITY_LONGS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), tokens, *[pa.array(parity[:, i]) for i in range(PARITY_LONGS)]],
                names=["node", "component", "tokens", *names],
            )

    sets = load_sets(open_nodes).join(open_nodes, "node").select("node", "component", "shingles")
    unpacked = sets.mapInArrow(unpack, "node long, component long, tokens array<long>, " + ", ".join(f"{n} long" for n in names))
    unpacked = materialize(unpacked, "open-sets")
    prefix = materialize(_prefix_rows(unpacked.select("node", "component", "tokens"), percent), "prefix")
    # Within a token, members of the token's largest component need not meet each other.
    shares = prefix.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("token").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select("token", "main")
    crossing = prefix.join(largest, "token").join(unpacked.select("node", *names), "node")
    rest = crossing.where("component <> main").select(
        "token", F.col("node").alias("other"), F.col("component").alias("part"), F.col("size").alias("size2"), F.col("at").alias("at2"),
        *[F.col(n).alias(f"{n}_2") for n in names],
    )
    both = F.col("size") + F.col("size2")
    # If this is the first shingle that both share, they have at most this many in common.
    common = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    enough = common * (100 + percent) >= both * percent
    # Each shingle that only one of them has flips one bit, so at least this many are not shared.
    apart = functools.reduce(operator.add, [F.bit_count(F.col(n).bitwiseXOR(F.col(f"{n}_2"))) for n in names])
    near = apart * (100 + percent) <= both * (100 - percent)
    met = crossing.join(rest, "token").where((F.col("component") != F.col("part")) & enough & near)
    return _ordered(met.select("node", "other")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Rows are linked if 100 * intersection >=
    ``percent`` * union of their shingle sets; a text of fewer words than ``shingle_words`` is one shingle.
    ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the row's own.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows of one id count as one
    document: their components are joined. A row without id is linked with others but names no component. A
    component of such rows only is null and all of them are kept, as nothing tells them apart; in any other they
    are not. An empty table gives no rows; other columns are not read.
    """
    signed = materialize(signatures(docs, id_column, text_column, shingle_words), "signatures")
    with_set = signed.where("node is not null")
    signs = materialize(with_set.dropDuplicates(["node"]).select("node", "n_shingles", "signature", "bands"), "nodes")
    rows = materialize(_band_rows(signs), "bands")
    moved = F.col("node").bitwiseXOR(F.col("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max(moved).alias("high"))
    buckets = materialize(buckets.where("n > 1"), "buckets")

    def load_sets(wanted: DataFrame) -> DataFrame:
        ids = with_set.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
        return full_sets(docs, ids, id_column, text_column, shingle_words)

    def links_of(pairs: DataFrame) -> DataFrame:
        likely = materialize(_bayes(pairs, signs, percent), "likely")
        wanted = likely.select(F.explode(F.array("a", "b")).alias("node"))
        return materialize(_confirm(likely, materialize(load_sets(wanted), "sets"), percent), "confirmed")

    # Rows of one id are one document.
    by_id = with_set.groupBy("id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("id is not null and first <> last")
    same_id = with_set.join(by_id, "id").select(F.col("first").alias("u"), F.col("node").alias("v"))
    links = links_of(_star_pairs(rows, buckets)).union(materialize(same_id, "same-id"))
    parts = materialize(connected_components(links), "components")
    more = links_of(_open_pairs(rows, buckets, parts, load_sets, percent))
    parts = materialize(connected_components(links.union(more)), "components")

    placed = with_set.select("id", "n_shingles", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    with_head = placed.join(heads, "component").select("id", "n_shingles", "component_id")
    alone = signed.where("node is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return with_head.union(alone).select(
        F.col("id").alias(id_column),
        "n_shingles",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
