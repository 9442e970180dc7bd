from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazegrid.llm import fmindex, minhash, repeats, textbytes
from hazegrid.llm.components import connected_components

DOCS = "doc_id long, text string, node string, id string"


def rows(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(texts, schema)


def words_text(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(words, seed, edits):
    r, words = random.Random(seed), list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
    return words


# --- shared byte helpers

def test_words_and_hashes_do_not_depend_on_the_place():
    texts = pa.array(["a bb  c", None, "", "bb", "é bb"])
    data, offsets, valid = textbytes.batch_texts(texts)
    start, end, heads = textbytes.words(data, offsets, textbytes.byte_classes(textbytes.SPACES))
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["a", "bb", "c", "bb", "é", "bb"]
    assert heads.tolist() == [0, 3, 3, 3, 4, 6] and valid.tolist() == [True, False, True, True, True]
    hashes = textbytes.word_hashes(data, start, end)
    assert hashes[1] == hashes[3] == hashes[5] and len(set(hashes.tolist())) == 4


# --- components

def test_components_of_a_long_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(rows(spark, links, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 1000 for i in range(1000, 1200))
    assert connected_components(rows(spark, [], "u long, v long")).count() == 0


# --- near duplicates

def shingles(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain_near_duplicates(docs, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return sorted((i, len(s), root(i)) for i, s in sets if i is not None)


def test_near_duplicates_against_all_pairs(spark):
    texts = []
    for group in range(12):
        base = words_text(group, 60)
        texts.append(" ".join(base))
        for copy in range(8):
            texts.append(" ".join(edited(base, 100 * group + copy, copy)))
    shared = " ".join(words_text(999, 60))
    texts += [shared + " " + " ".join(words_text(2000 + i, 60)) for i in range(60)]
    texts += ["", "   ", None, "one", "ONE", "two words", "Two  Words", texts[0], texts[0].upper()]
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    for n in (2, 5):
        got = minhash.near_duplicates(rows(spark, docs), shingle_words=n).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near_duplicates(docs, n)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(words_text(5, 30_000, 5000))
    docs = [(1, long, "n", "i"), (2, long + " end", None, None), (3, None, "n", "i"), (3, "a b c", "n", "i"), (3, "q r s", "n", "i"),
            (4, "a b c", "n", "i"), (5, "q r s", "n", "i"), (None, "a b c", "n", "i"), (None, "alone here", "n", "i"), (6, "", "n", "i")]
    got = minhash.near_duplicates(rows(spark, docs, DOCS), shingle_words=2).collect()
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str)
    # Rows of id 3 are one document, so they join what they resemble; a row without id names no component.
    assert found == sorted([(1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False),
                            (None, 3, False), (None, None, True), (6, 6, True)], key=str)
    assert minhash.near_duplicates(rows(spark, [])).collect() == []


def test_near_copies_without_id_are_linked(spark):
    base = [f"u{i}" for i in range(120)]
    changed = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(base))
    other, third = words_text(71, 80, 10**6), words_text(72, 80, 10**6)
    docs = [(10, changed(0, 1, 2, 3, 4, 5, 6, 7, 8)), (None, changed()), (20, changed(119, 118, 117, 116, 115, 114, 113, 112, 111)),
            (30, " ".join(other)), (None, " ".join([*other, "end"])), (None, " ".join(third)), (None, " ".join([*third, "end"])), (40, "clean words of another text")]
    got = minhash.near_duplicates(rows(spark, docs)).collect()
    # 10 and 20 meet over a row without id only.
    assert len(shingles(docs[0][1], 5) & shingles(docs[2][1], 5)) < 0.8 * len(shingles(docs[0][1], 5) | shingles(docs[2][1], 5))
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str)
    assert found == sorted([(10, 10, True), (None, 10, False), (20, 10, False), (30, 30, True), (None, 30, False), (None, None, True), (None, None, True), (40, 40, True)], key=str)


def test_pairs_of_sets_just_below_the_similarity_stay_few(spark, monkeypatch):
    """Copies with three or four changed words each are alike by about 0.65 to 0.78; few are linked."""
    base = words_text(31, 150, 10**6)
    counted, bayes = [], minhash._bayes
    monkeypatch.setattr(minhash, "_bayes", lambda pairs, *rest: counted.append(pairs.count()) or bayes(pairs, *rest))
    open_pairs = {}
    for n in (150, 400):
        docs = [(i, " ".join(edited(base, 500 + i, 3 + i % 2))) for i in range(n)]
        got = minhash.near_duplicates(rows(spark, docs)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_near_duplicates(docs, 5)
        open_pairs[n] = counted[-1]
    # There are 80,000 pairs of 400 texts; those that leave the join stay below one per text.
    assert all(pairs <= n for n, pairs in open_pairs.items()), open_pairs


def test_parity_bits_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for size in (1, 10, 146, 1000, 20_000):
        x = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: size // 2], r.integers(0, 1 << 63, size // 3, dtype=np.uint64)]))
        z = minhash._parity(x) ^ minhash._parity(y)
        assert sum(int(v).bit_count() for v in z.view(np.uint64)) <= len(np.setxor1d(x, y))


def test_needed_matches_follow_the_posterior():
    for n, m in zip(range(minhash.BATCH, minhash.COMPARED + 1, minhash.BATCH), minhash.needed_matches(80, 1e-6), strict=True):
        grid = np.linspace(0, 1, 20001)
        for matches, reached in ((m, True), (m - 1, False)):
            density = grid**matches * (1 - grid) ** (n - matches)
            assert (density[grid >= 0.8].sum() / density.sum() >= 1e-6) == reached
    assert math.isclose(1 - (1 - 0.8**minhash.BAND_ROWS) ** minhash.BANDS, 1, abs_tol=1e-5)


# --- benchmark passages

def test_fm_index_counts_and_locates():
    r = np.random.default_rng(2)
    text = np.concatenate([np.append(r.integers(1, 5, size=k), 0) for k in (30, 1, 7, 50)] + [np.append(np.tile([1, 2], 40), 0)])
    index = fmindex.FMIndex(text, 4)
    for length in (1, 2, 3, 5):
        phrases = np.array(list(itertools.product(range(1, 5), repeat=length)))[:200]
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            expected = [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


ITEMS = "item_id long, text string"


def test_contamination_of_odd_rows(spark, monkeypatch):
    phrase = " ".join(f"t{i}" for i in range(12))
    docs = [(1, f"lead {phrase} tail"), (2, None), (3, ""), (4, phrase.upper() + "!" + phrase), (4, phrase), (5, "short Item"), (6, "t0 t1 short"),
            (None, phrase), (7, " ".join(f"t{i}" for i in range(9))), (8, "x " * 40_000 + phrase), (9, "é" + phrase)]
    items = [(10, phrase), (9, "short item"), (10, phrase), (11, None), (12, ""), (None, "t0 t1 short x")]

    def found():
        got = fmindex.contamination(rows(spark, docs), rows(spark, items, ITEMS))
        return sorted((str(r.id), r.n_words, r.hit_words, tuple(r.items)) for r in got.collect())

    expected = sorted([("1", 14, 12, ("10",)), ("2", 0, 0, ()), ("3", 0, 0, ()), ("4", 24, 24, ("10",)), ("4", 12, 12, ("10",)), ("5", 2, 2, ("9",)),
                       ("6", 3, 0, ()), ("None", 12, 12, ("10",)), ("7", 9, 0, ()), ("8", 40012, 12, ("10",)), ("9", 12, 11, ("10",))])
    assert found() == expected
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 10)  # several passes
    assert found() == expected
    clean = fmindex.contamination(rows(spark, docs), rows(spark, [], ITEMS)).collect()
    assert all(r.hit_words == 0 for r in clean) and len(clean) == len(docs)
    assert fmindex.contamination(rows(spark, []), rows(spark, items, ITEMS)).count() == 0


def test_cut_texts_hold_no_phrase(spark):
    phrase = " ".join(f"t{i}" for i in range(12))
    split = " ".join(f"t{i}" for i in range(6)) + f" {phrase} " + " ".join(f"t{i}" for i in range(6, 12))
    docs = [(1, f"lead, {phrase} tail", "x"), (2, None, "y"), (3, split, None), (4, "clean text", "z")]
    got = fmindex.decontaminate(rows(spark, docs, "doc_id long, text string, starts string"), rows(spark, [(1, phrase)], ITEMS))
    assert got.columns == ["doc_id", "text", "starts"]
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1].split() == ["lead,", "tail"] and texts[2] is None and texts[4] == "clean text"
    assert texts[3].split() == []  # what closed up around the first cut is cut as well


def test_cuts_do_not_depend_on_the_blocks(spark, monkeypatch):
    run = lambda a, b: " ".join(f"t{i}" for i in range(a, b))
    first, second, third = run(5, 15), run(10, 20), run(20, 30)
    closing = f"{run(40, 45)} {first} {run(45, 50)}"  # the cut closes a phrase up that another block holds
    docs = [(1, f"lead {run(0, 25)} tail", "x"), (1, f"lead {run(0, 25)} tail", "x"), (2, None, "y"), (3, f"{closing}, end", None), (4, "clean text", "z"),
            (5, f"{second}, {third}.", "z"), (6, f"é {first} {run(5, 9)}", "z"), (None, "", "z")]
    items = [(1, first), (2, second), (3, run(40, 50)), (4, third), (5, None)]

    def cut(order):
        got = fmindex.decontaminate(rows(spark, docs, "doc_id long, text string, _b_key string"), rows(spark, order, ITEMS).coalesce(1))
        assert got.columns == ["doc_id", "text", "_b_key"]
        return sorted(map(tuple, got.collect()), key=str)

    whole = cut(items)
    expected = [(1, f"lead {run(0, 5)}   {run(20, 25)} tail", "x")] * 2 + [(2, None, "y"), (3, " , end", None), (4, "clean text", "z"), (5, " .", "z"), (6, f"é   {run(5, 9)}", "z"), (None, "", "z")]
    assert [(i, t, x) for i, t, x in whole] == sorted(expected, key=str)
    spans = lambda: sorted((str(tuple(r)) for r in fmindex.contamination(rows(spark, docs, "doc_id long, text string, x string"), rows(spark, items, ITEMS)).collect()))
    ranges = spans()
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 10)  # every item is a block
    assert cut(items) == whole and cut(items[::-1]) == whole
    assert spans() == ranges


def test_blocks_are_bounded_and_hold_every_item(spark, monkeypatch):
    texts = ["é" * 30, "x" * 59, "", "y" * 200] * 20
    items = rows(spark, [*enumerate(texts), (None, "z"), (7, None)], ITEMS).repartition(3)
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", 100)
    blocks = list(fmindex._Blocks(items, "item_id", "text"))
    assert sorted(x for block in blocks for x in block) == sorted([*((str(i), t) for i, t in enumerate(texts)), ("", "z")])
    assert all(sum(len(t.encode()) for _, t in block) <= 100 or len([t for _, t in block if t]) == 1 for block in blocks)
    found = fmindex.contamination(rows(spark, [(1, "z"), (2, "q")]), items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(blocks) > 20 and plan.count("MapInArrow") == 1  # one pass after the other, none left in the plan
    assert sorted((r.id, r.hit_words) for r in found.collect()) == [(1, 1), (2, 0)]


# --- repeated strings

def plain_repeats(docs, length):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen: dict = {}
    for _, b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        out.append((i, len(b), edges[::2].tolist(), edges[1::2].tolist(), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [40, 60])
def test_repeats_against_all_strings(spark, length):
    r = random.Random(length)
    base = ["".join(r.choices("abcdefgh é", k=r.choice([30, 90, 200, 400]))) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        a, b = r.choice(base), r.choice(base)
        docs.append((100 + i, a[r.randrange(20) :] + b[: r.randrange(len(b))]))
    passage = "".join(r.choices("xyz ", k=length + 5))
    docs += [(300 + i, f"{r.random()}{passage}{r.random()}") for i in range(40)]
    docs += [(400, "ab" * 300), (401, "abc" * 100), (402, None), (403, ""), (404, base[0]), (404, base[0]), (None, base[1]), (405, "q" * 5000)]
    got = repeats.remove_repeats(rows(spark, docs), length=length).collect()
    assert sorted(((g.id, g.n_bytes, g.starts, g.ends, bytes(g.kept)) for g in got), key=str) == plain_repeats(docs, length)


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(rows(spark, [], DOCS)).collect() == []
    one = repeats.remove_repeats(rows(spark, [(1, "x" * 399, "a", "b")], DOCS)).collect()
    assert one[0].starts == [] and bytes(one[0].kept) == b"x" * 399


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 1000, size=57).astype(np.uint64)
    for width in (1, 5, 57, 80):
        got = repeats._sliding_least(values, width)
        assert all(got[i] == values[i : i + width].min() for i in range(max(1, 57 - width + 1)))
