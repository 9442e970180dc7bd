"""Phrases, bit-sliced fingerprints and periodic runs against plain versions written here."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as contract
from hazegrid.llm import bitslices, periods, phrases

QUERIES = contract.queries()
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACE = r"[\x20\x09-\x0D]+"


def rows(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


# --- phrases

def plain_collocations(docs, least, top=2000):
    grams, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            grams.update((lang, *w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    big = {g: f for g, f in grams.items() if f >= least and len(g) > 2}
    held = {(g[0], *part) for g, f in big.items() for m in range(2, len(g) - 1) for part in zip(*[g[1 + i :] for i in range(m)]) if f >= big.get((g[0], *part), 1 << 60)}
    found = []
    for g, a in big.items():
        if g not in held:
            cuts = [(1000 * a * n[g[0]] // (grams[g[:k]] * grams[(g[0], *g[k:])]), k, grams[g[:k]], grams[(g[0], *g[k:])]) for k in range(2, len(g))]
            score, _, l, r = min(cuts)
            found.append((g[0], -score, -a, " ".join(g[1:]).encode(), l, r, n[g[0]]))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(found):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, total, -score))
    return out


def phrase_rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def some_texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é", "Big", "BIG", "x|y", "a-b"]
    fixed = "one two three four five six seven"
    out = []
    for _ in range(n):
        parts = [r.choice(vocabulary) if r.random() < 0.9 else fixed for _ in range(r.randrange(40))]
        out.append((r.choice(["en", "de", None]), r.choice([" ", "  ", " \t"]).join(parts).replace("w3", "w3" + r.choice(".,;:!?\n\r\x0b\x0c"))))
    return out


@pytest.mark.parametrize("capacity", [1 << 20, 200, 8])
def test_phrases_against_a_plain_count(spark, monkeypatch, capacity):
    # Small parts make nearly all words hot, so edges are dealt by longer beginnings and counts come in parts.
    monkeypatch.setattr(phrases, "PART_POSITIONS", capacity)
    docs = some_texts(5, 300) + [("en", None), (None, ""), ("en", " . , "), ("en", "one"), ("en", "the " * 3000)]
    expected = plain_collocations(docs, 6)
    assert len(expected) > 100
    got = phrases.collocations(rows(spark, docs, "lang string, text string"), least=6)
    assert phrase_rows(got) == sorted(expected)


def test_long_texts_are_cut_into_blocks_of_words():
    """What a task makes of a text does not depend on the blocks that it works in."""
    text = " ".join(f"k{i * i % 97}" for i in range(400))
    table = np.full(1 << (phrases.TABLE_BITS - 5), 0xFFFFFFFF, dtype=np.uint32)
    found = []
    for block in (1 << 20, 37):
        counted = Counter()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(phrases, "BLOCK_WORDS", block)
            chunk = phrases.Words(pa.array([text, "k0 k1"]), pa.array(["en", "en"]))
            for batch in phrases.edges_of(chunk, 0, table, table, np.zeros_like(table), 3):
                for blob in batch.column(1):
                    edges = phrases._Edges(blob.as_buffer())
                    for row, n in zip(edges.words[edges.grams.T], edges.count):
                        counted[tuple(row.tolist())] += int(n)
        found.append(counted)
    assert found[0] == found[1] and sum(found[0].values()) == 400 - 1 + 1


def test_phrases_of_a_short_list(spark):
    docs = some_texts(6, 100)
    got = phrases.collocations(rows(spark, [(l, t, "k", 1) for l, t in docs], "lang string, text string, key string, n int"), least=5, top=7)
    assert phrase_rows(got) == sorted(plain_collocations(docs, 5, 7))
    assert phrases.collocations(rows(spark, [], "lang string, text string")).collect() == []


def test_shared_hashes_of_a_frequent_word_lead_to_another_seed(spark, monkeypatch):
    docs = some_texts(7, 60)
    keyed, seeds = phrases.with_keys, []

    def with_keys(counted, seed):
        seeds.append(seed)
        words = keyed(counted, seed)
        return words if seed else words.withColumn("key", F.lit(7).cast("long"))

    monkeypatch.setattr(phrases, "with_keys", with_keys)
    got = phrases.collocations(rows(spark, docs, "lang string, text string"), least=5)
    assert phrase_rows(got) == sorted(plain_collocations(docs, 5)) and seeds == [0, 2]


def test_counters_of_pairs_are_never_too_low(spark):
    docs = [("en", t) for _, t in some_texts(8, 80)]
    table = np.full(1 << (phrases.TABLE_BITS - 5), 0xFFFFFFFF, dtype=np.uint32)
    texts = rows(spark, docs, "lang string, content string").repartition(3)
    got = {r.key: r.n for r in phrases.count_pairs(texts, 0, table, 1).collect()}
    expected = Counter()
    chunk = phrases.Words(pa.array([t for _, t in docs]), pa.array(["en"] * len(docs)))
    at, counter = phrases._neighbours(chunk, chunk.keys(0), table)
    expected.update(counter.tolist())
    assert got == dict(expected) and len(at) == sum(expected.values())


def test_edges_are_packed_and_unpacked():
    words = np.arange(6, dtype=np.uint64)
    grams = np.array([[1, 2, 3, 4, 5], [2, 3, 4, 5, 0], [3, 4, 0, 0, 0], [3, 4, 5, 0, 0]])
    edges = phrases._Edges(phrases._pack(words, grams, np.array([150, 70_000, 70, 80]), np.array([0, 2, 2, 3])))
    assert edges.words.tolist() == [0, 1, 2, 3, 4, 5]
    assert [edges.count[edges.part(i)].tolist() for i in (0, 1, 2, 3)] == [[150], [], [70_000, 70], [80]]
    assert edges.grams[:, edges.part(2)].T.tolist() == [[2, 3, 4, 5, 0], [3, 4, 0, 0, 0]]


# --- fingerprints

def plain_fingerprint(text, n=4):
    words = words_of((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return [root(i) for i in range(len(prints))]


def test_bitslice_query_against_all_pairs(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    prints = [plain_fingerprint(text) for _, text in docs]
    roots = plain_components(prints)
    expected = [(docs[i][0], f"{prints[i]:016x}", docs[roots[i]][0]) for i in range(len(docs))]
    got = QUERIES["op12_bitslices"](spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert any(r.doc_id != r.component_id for r in got)


def crowded_prints():
    """A dense cluster, chains, pairs at distances 4 and 5, and many strangers that share three blocks with it."""
    r = random.Random(11)
    centre = r.getrandbits(64)
    prints = [centre]
    for _ in range(400):
        prints.append(centre ^ sum(1 << b for b in r.sample(range(64), 2)))
    for _ in range(150):  # far from the cluster, under one key with it
        prints.append(centre ^ (r.getrandbits(36) << 28))
    for base in (r.getrandbits(64) for _ in range(60)):
        prints += [base, base ^ 0b1111, base ^ 0b1111 ^ (0b1111 << 40), base ^ (0b11111 << 20)]
    return sorted({p for p in prints})


@pytest.mark.parametrize("tile", [16, 8192])
def test_links_of_crowded_keys_against_all_pairs(spark, tile):
    prints = crowded_prints()
    longs = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = rows(spark, [(p,) for p in longs], "fingerprint long").repartition(5)
    links = [(r.u, r.v) for r in bitslices.near_prints(nodes, tile).collect()]
    index = {p: i for i, p in enumerate(longs)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in links:
        low, high = sorted((root(index[u]), root(index[v])))
        parent[high] = low
    assert [root(i) for i in range(len(prints))] == plain_components(prints)
    # A spanning forest per tile, not all pairs: the dense cluster alone has 80,000 pairs.
    assert len(links) < 35 * len(prints)


def test_fingerprints_of_odd_rows(spark):
    long = " ".join(f"v{i % 5000}" for i in range(40_000))
    docs = [(1, long, "n", "i"), (2, long.upper(), None, None), (3, None, "n", "i"), (4, "  \t", "n", "i"), (5, "", "n", "i"),
            (6, "one two", "n", "i"), (6, "other words stand here alone", "n", "i"), (7, "ONE  two", "n", "i"), (None, "one\ntwo", "n", "i"), (None, "nothing like it at all", "n", "i")]
    got = bitslices.near_fingerprints(rows(spark, docs, "doc_id long, text string, node string, fingerprint string")).collect()
    found = {(r.doc_id, r.component_id) for r in got}
    assert found == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (None, 6), (None, None)} and len(got) == 10
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert bitslices.near_fingerprints(rows(spark, [])).collect() == []


# --- periods

def plain_runs(words):
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(words[k] == words[k + p] for k in range(s, s + length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                runs.append((s, length, q))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [f"t{r.randrange(r.choice([2, 3, 50]))}" for _ in range(r.randrange(60))]
        for _ in range(r.randrange(4)):
            unit = [f"t{r.randrange(r.choice([2, 50]))}" for _ in range(r.randrange(1, 30))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: int(len(unit) * r.uniform(3, 7))]
        out.append((k, r.choice([" ", "\n", " \t "]).join(words)))
    return out


def test_runs_against_a_plain_search(spark):
    docs = periodic_texts(1, 250) + [(900, "a " * 500), (901, "a b " * 300 + "c"), (902, "a"), (903, "A a " * 3), (904, "é é é é é é")]
    got = {r.id: r for r in periods.periodic_runs(rows(spark, docs)).collect()}
    total = 0
    for doc_id, text in docs:
        words = words_of(text)
        expected = plain_runs(words)
        total += len(expected)
        assert [tuple(run) for run in got[doc_id].runs] == expected, doc_id
        assert got[doc_id].collapsed == collapsed(words, expected) and got[doc_id].n_words == len(words)
    assert total > 200


def test_every_short_string_of_two_letters():
    for n in range(1, 13):
        for bits in range(1 << n):
            symbols = np.array([bits >> k & 1 for k in range(n)] + [-1], dtype=np.int64)
            found = sorted((s, e - s, q) for s, e, q in periods.find_runs(symbols, n))
            assert found == plain_runs(symbols[:n].tolist())


def test_long_periods_and_fibonacci_words():
    r = random.Random(4)
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b[:1500], [r.randrange(9) for _ in range(333)] * 5, [0, 1, 0, 0, 1] * 60 + [1] * 90 + [0, 1] * 77, [r.randrange(2) for _ in range(40)] * 4):
        symbols = np.array([*words, -1], dtype=np.int64)
        assert sorted((s, e - s, q) for s, e, q in periods.find_runs(symbols, len(words))) == plain_runs(words)


def test_runs_of_odd_rows(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (None, "b b b b b b b", "x"), (4, "b b b b b b b", "x"), (4, "b b b b b b b", "x")]
    got = sorted((str(r.id), [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(rows(spark, docs, "doc_id long, text string, runs string")).collect())
    run = [(0, 7, 1)]
    assert got == [("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", run, "b"), ("4", run, "b"), ("None", run, "b")]
    assert periods.periodic_runs(rows(spark, [])).collect() == []


def test_period_query_against_a_plain_version(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_periods"](spark, folder).collect()
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    for r in got:
        words = words_of(docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words) if n < 1500 else [(s, e - s, q) for s, e, q in periods.find_runs(np.array([*[hash(w) >> 2 for w in words], -(1 << 62)]), n)]
        runs.sort(key=lambda run: (run[0], run[2]))
        best = max(runs, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{l},{q}\n" for s, l, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_word_codes_are_exact():
    data = np.frombuffer(b"aa b aa c", dtype=np.uint8)
    codes, known = periods.word_codes(data, np.array([0, 3, 5, 8]), np.array([2, 4, 7, 9]))
    assert codes.tolist() == [0, 1, 0, 2] and known.to_pylist() == [b"aa", b"b", b"c"]
    codes, known = periods.word_codes(data[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(codes) == 0 and len(known) == 0 and isinstance(known, pa.Array)
