"""SimHash near duplicates, compared on vertical bit planes.

1. Every text becomes a 64-bit fingerprint: the majority of the bits of its shingles' hashes. Equal fingerprints
   are one node from here on.
2. The 64 bits are cut into seven blocks. Two fingerprints that differ in at most four bits agree in three blocks
   at least, so they meet under one of 35 keys of three blocks. Keys are dealt out by range together with the
   fingerprint, so a key that holds any share of all nodes is spread over many tasks.
3. Members of a key lie in words of 64 lanes, one bit plane per bit. A fingerprint is held against a word by
   adding up its differing planes in carry-save counters, three planes a step; words of which all lanes are
   beyond the radius are abandoned. Of the pairs found only a spanning forest leaves the task.
4. Keys that were cut (too large for one tile, or at the edge of a task) are finished in a second round: members
   of the key's largest component need not meet each other, all others meet all of another component, in tiles.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm import textbytes as tb
from hazegrid.llm.components import connected_components
from hazegrid.session import materialize

SEED = 42
RADIUS = 4
TILE = 8192
ENTRIES = 1 << 15  # fingerprints times words compared at a time
BLOCKS = RADIUS + 3
ONE = np.uint64(1)


def fingerprint(words: list[bytes], shingle_words: int) -> int:
    """Majority bits of the hashes of all shingles, repeats included; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    width = min(shingle_words, len(words))
    count = len(words) - width + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 14):
        spans = zip(starts[at : min(at + (1 << 14), count)], ends[at + width - 1 :])
        hashes = np.array([digest(text[a:b], SEED) for a, b in spans], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """``id, fingerprint`` (the 64 bits as a long) per row."""

    def sign(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = [fingerprint((t.as_py() or b"").lower().split(), shingle_words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, type=pa.int64())], names=["id", "fingerprint"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column).mapInArrow(sign, f"id {kind}, fingerprint long")


def key_masks() -> list[int]:
    """For every choice of blocks that may be free of differences, a mask of their bits."""
    bounds = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(bounds)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, BLOCKS - RADIUS)]


class Planes:
    """Fingerprints of several groups, 64 to a word, as 64 bit planes. Rows of a group are neighbours."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        first_row = np.cumsum(sizes) - sizes
        words = -(-sizes // 64)
        inside = np.arange(len(prints)) - np.repeat(first_row, sizes)
        self.first_word = np.cumsum(words) - words
        self.words = words
        lane = (inside & 63).astype(np.uint64)
        self.row_word = np.repeat(self.first_word, sizes) + (inside >> 6)
        self.row_of_word = np.flatnonzero(lane == 0)
        self.filled = np.bitwise_or.reduceat(ONE << lane, self.row_of_word)
        self.planes = np.stack([np.bitwise_or.reduceat(((prints >> np.uint64(p)) & ONE) << lane, self.row_of_word) for p in range(64)])

    def near(self, prints: np.ndarray, word: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For fingerprints held against words (one word each): which are near which rows, as (number, row)."""
        alive = np.arange(len(prints))
        ones, twos, fours, over = (np.zeros(len(prints), dtype=np.uint64) for _ in range(4))
        within = self.filled[word]
        for at in range(0, 64, 3):
            x, y, z = (
                self.planes[p][word] ^ (np.uint64(0) - ((prints >> np.uint64(p)) & ONE)) if p is not None else np.zeros(len(word), np.uint64)
                for p in (*order[at : at + 3], None, None)[:3]
            )
            half = x ^ y
            carry = (x & y) | (z & half)
            total = half ^ z
            carry_1 = ones & total
            ones = ones ^ total
            half = twos ^ carry
            carry_2, carry_3 = twos & carry, half & carry_1
            twos = half ^ carry_1
            half = fours ^ carry_2
            over = over | (fours & carry_2) | (half & carry_3)
            fours = half ^ carry_3
            if at % 9 == 6 or at == 63:
                beyond, equal = over, ~np.zeros(len(word), dtype=np.uint64)
                for value, plane in ((4, fours), (2, twos), (1, ones)):
                    if RADIUS & value:
                        equal = equal & plane
                    else:
                        beyond = beyond | (equal & plane)
                        equal = equal & ~plane
                within = self.filled[word] & ~beyond
                left = np.flatnonzero(within)
                if len(left) < 0.8 * len(word):
                    alive, word, prints, within = alive[left], word[left], prints[left], within[left]
                    ones, twos, fours, over = ones[left], twos[left], fours[left], over[left]
        lanes = np.unpackbits(np.ascontiguousarray(within).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        entry, lane = np.nonzero(lanes)
        return alive[entry], self.row_of_word[word[entry]] + lane


def _rooted(label: np.ndarray) -> np.ndarray:
    while True:
        higher = label[label]
        if np.array_equal(higher, label):
            return label
        label = higher


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each the number of a root) after joining the parts of ``u`` and ``v``."""
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low != high
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, high[apart], low[apart])
        label = _rooted(label)


def plane_order(mask: int) -> list[int]:
    """Bits that members of a key may differ in first; those of the key are equal anyway."""
    return sorted(range(64), key=lambda p: (mask >> p & 1, p))


def spanning_links(prints: np.ndarray, sizes: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (at most one per row) that connect what is near within each group."""
    planes = Planes(prints, sizes)
    label = np.arange(len(prints))
    # Each row meets its own word and those behind it in its group.
    group = np.repeat(np.arange(len(sizes)), sizes)
    ahead = planes.first_word[group] + planes.words[group] - planes.row_word
    ends = np.cumsum(ahead)
    first = 0
    while first < len(prints):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ENTRIES, side="right")))
        row = np.repeat(np.arange(first, last), ahead[first:last])
        word = planes.row_word[row] + np.arange(len(row)) - np.repeat(ends[first:last] - ahead[first:last] - (ends[first] - ahead[first]), ahead[first:last])
        entry, other = planes.near(prints[row], word, order)
        label = _merge(label, row[entry], other)
        first = last
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


LINKS = "t int, key long, u long, v long"


def _link_batch(t: int, key: np.ndarray, u: np.ndarray | None, v: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(key), pa.int64())
    sides = [empty if x is None else pa.array(tb.signed(x)) for x in (u, v)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, dtype=np.int32)), pa.array(key), *sides], names=["t", "key", "u", "v"])


def _tile_links(masks: list[int], tile: int):
    """Rows sorted by (t, key): links within each key, and a row without ends for each key that may go on elsewhere."""
    orders = [plane_order(mask) for mask in masks]

    def groups(t: np.ndarray, key: np.ndarray) -> np.ndarray:
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
        return np.flatnonzero(new)

    def linked(t, key, prints):
        if not len(t):
            return
        first = groups(t, key)
        sizes = np.diff(np.append(first, len(t)))
        many = np.repeat(sizes > 1, sizes)
        for table in np.unique(t[many]):
            rows = many & (t == table)
            u, v = spanning_links(prints[rows], sizes[(sizes > 1) & (t[first] == table)], orders[table])
            yield _link_batch(int(table), np.zeros(len(u), dtype=np.int64), u, v)

    def run(batches):
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        edge = None
        for batch in batches:
            fresh = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            if not len(held[0]):
                continue
            if edge is None:
                edge = held[0][0], held[1][0]
                yield _link_batch(int(edge[0]), np.array([edge[1]]), None, None)
            last = int(groups(held[0], held[1])[-1])
            yield from linked(*[x[:last] for x in held])
            held = [x[last:] for x in held]
            while len(held[0]) > tile:
                yield from linked(*[x[:tile] for x in held])
                yield _link_batch(int(held[0][0]), held[1][:1], None, None)
                held = [x[tile:] for x in held]
        if len(held[0]):
            yield from linked(*held)
            yield _link_batch(int(held[0][0]), held[1][:1], None, None)

    return run


def _cross_links(masks: list[int]):
    """One tile of a cut key: rows of ``side`` 0 against those of side 1 in other components."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        t = key[0].as_py()
        side = rows.column("side").to_numpy()
        prints, component = (rows.column(c).to_numpy() for c in ("fingerprint", "component"))
        prints = np.ascontiguousarray(prints).view(np.uint64)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        u = v = np.zeros(0, np.uint64)
        if len(left) and len(right):
            planes = Planes(prints[right], np.array([len(right)]))
            known, label = np.unique(component, return_inverse=True)
            joined, ends = np.arange(len(known)), []
            n_words = len(planes.filled)
            step = max(1, ENTRIES // n_words)
            for at in range(0, len(left), step):
                part = left[at : at + step]
                row = np.repeat(part, n_words)
                entry, other = planes.near(prints[row], np.tile(np.arange(n_words), len(part)), plane_order(masks[t]))
                a, b = row[entry], right[other]
                apart = joined[label[a]] != joined[label[b]]
                a, b = a[apart], b[apart]
                # One pair for each two components, and only if they are still apart.
                pairs = np.sort(np.stack([joined[label[a]], joined[label[b]]]), axis=0)
                _, one = np.unique(pairs[0] * len(known) + pairs[1], return_index=True)
                ends.append((prints[a[one]], prints[b[one]]))
                joined = _merge(joined, label[a], label[b])
            u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        return pa.table({"u": pa.array(tb.signed(u)), "v": pa.array(tb.signed(v))})

    return run


def near_prints(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` whose components are those of all pairs of ``fingerprint`` that differ in up to four bits.

    ``nodes`` holds distinct fingerprints and is read several times.
    """
    masks = key_masks()
    value = F.col("fingerprint")
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    keys = [F.struct(F.lit(t).alias("t"), value.bitwiseAND(F.lit(mask).cast("long")).alias("key")) for t, mask in enumerate(signed)]
    keyed = nodes.select(F.explode(F.array(*keys)).alias("k"), "fingerprint").select("k.t", "k.key", "fingerprint")
    dealt = keyed.repartitionByRange("t", "key", "fingerprint").sortWithinPartitions("t", "key", "fingerprint")
    found = materialize(dealt.mapInArrow(_tile_links(masks, tile), LINKS), "tile-links")
    links = materialize(found.where("u is not null").select("u", "v").distinct(), "links")

    parts = materialize(connected_components(links), "parts")
    cut = materialize(found.where("u is null").select("t", "key").distinct(), "cut")
    members = keyed.join(cut, ["t", "key"]).join(parts, F.col("fingerprint") == F.col("node"), "left")
    members = materialize(members.select("t", "key", "fingerprint", F.coalesce("component", "fingerprint").alias("component")), "members")
    shares = members.groupBy("t", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    tiles = shares.groupBy("t", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")
    ).where("n > most")
    tiles = materialize(
        tiles.select("t", "key", "main", F.ceil((F.col("n") - F.col("most")) / tile).alias("across"), F.ceil(F.col("n") / tile).alias("down")), "tiles"
    )
    open_rows = members.join(tiles, ["t", "key"])
    salt = F.xxhash64("fingerprint")
    rest = open_rows.where("component <> main").select(
        "t", "key", F.pmod(salt, "across").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("j"), F.lit(0).alias("side"), "fingerprint", "component"
    )
    all_rows = open_rows.select(
        "t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("i"), F.pmod(salt, "down").alias("j"), F.lit(1).alias("side"), "fingerprint", "component"
    )
    more = rest.union(all_rows).groupBy("t", "key", "i", "j").applyInArrow(_cross_links(masks), "u long, v long")
    return links.union(materialize(more.distinct(), "more-links"))


def near_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 4, tile: int = TILE) -> DataFrame:
    """``id, fingerprint, component_id`` for every row; the fingerprint as 16 hex digits.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are joined by one space and hashed
    by XXH64 with seed 42. A bit of the fingerprint is 1 if it is set in over half of the hashes. Rows are linked
    if their fingerprints differ in four bits at most; ``component_id`` is the smallest id reachable.

    A text of fewer words than ``shingle_words`` is one shingle; a null, empty or blank text has fingerprint zero
    and is linked like any other. Rows of one id count as one document: their components are joined. Null ids pass
    on links but name no component; a component of such rows only is null. An empty table gives no rows; other
    columns are not read.
    """
    signed = materialize(fingerprints(docs, id_column, text_column, shingle_words), "fingerprints")
    nodes = materialize(signed.select("fingerprint").distinct(), "nodes")
    by_id = signed.groupBy("id").agg(F.min("fingerprint").alias("first"), F.max("fingerprint").alias("last")).where("id is not null and first <> last")
    same_id = signed.join(by_id, "id").select(F.col("first").alias("u"), F.col("fingerprint").alias("v"))
    parts = materialize(connected_components(near_prints(nodes, tile).union(same_id)), "components")
    placed = signed.join(parts, F.col("fingerprint") == F.col("node"), "left")
    placed = placed.select("id", "fingerprint", F.coalesce("component", "fingerprint").alias("component"))
    # Written, so that the join with a large component can be split.
    heads = materialize(placed.groupBy("component").agg(F.min("id").alias("component_id")), "heads")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return placed.join(heads, "component").select(F.col("id").alias(id_column), digits.alias("fingerprint"), "component_id")
