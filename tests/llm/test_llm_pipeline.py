"""Every stage of the pipeline, and the classifier's query, against plain versions: whole outputs are compared."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from test_llm_dedup import edited, plain_near_duplicates, words_text

import __spark_entry__ as contract
import corpus_pipeline
from hazegrid.llm import mixing, pseudonyms, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[\x20\x09-\x0D]+"


def plain_statistics(text):
    text = text or ""
    words, lines = [w for w in re.split(SPACE, text) if w], [x for x in text.split("\n") if x]
    share = lambda group: sum(c in group for c in text) / max(len(text), 1)
    count, n_lines = max(len(words), 1), max(len(lines), 1)
    return {
        "chars": math.log1p(len(text)),
        "words": math.log1p(len(words)),
        "word_length": len(text) / count,
        "distinct_words": len(set(words)) / count,
        "distinct_lines": len(set(lines)) / n_lines,
        "line_length": math.log1p(len(text) / n_lines),
        "upper": share(quality.UPPER),
        "digits": share(quality.DIGITS),
        "stops": share(quality.STOPS),
        "symbols": share(quality.SYMBOLS),
    }


def plain_score(model, text):
    found = plain_statistics(text)
    total = model.intercept
    for rule, weight in model.rules:
        if all(found[name] <= t if below else found[name] > t for name, below, t in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels, quality.fit_rules(docs, labels)


def test_quality_query_against_plain_rules(spark, folder, tables):
    docs, labels, model = tables
    assert model.rules
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = contract.queries()["op5_quality"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        score = plain_score(model, texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-12) and r.predicted == int(score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # Accuracy on labels that were not learnt.
    known = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [(known[r.doc_id], r.predicted) for r in got if r.held_out and known.get(r.doc_id) in (0, 1)]
    assert unseen and sum(a == b for a, b in unseen) >= 0.85 * len(unseen)


def test_quality_stage_keeps_what_plain_rules_keep(spark, folder, tables):
    docs, _, model = tables
    expected = sorted(tuple(r) for r in docs.collect() if plain_score(model, r.text) >= 0.3)
    got = corpus_pipeline.quality_stage(spark, docs, folder)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == expected and 0 < len(expected) < docs.count()


def corpus():
    docs = []
    for group in range(6):
        base = words_text(group, 70)
        docs += [" ".join(edited(base, 10 * group + i, i)) for i in range(5)]
    docs += [" ".join(words_text(900 + i, 60)) for i in range(20)] + ["", None, docs[0], docs[0].upper()]
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(docs)]


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark, folder):
    docs = corpus()
    kept = {i for i, _, component in plain_near_duplicates([(d[0], d[1]) for d in docs], 5) if i == component}
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, SCHEMA), folder)
    assert sorted(map(tuple, got.collect())) == [d for d in docs if d[0] in kept] and len(kept) < len(docs)


def plain_cut(text, items, window=10):
    """Cut merged hits of all items, one space in their place, until nothing is left to cut."""
    phrases = set()
    for item in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(ASCII_LOWER))
        n = min(window, len(words))
        phrases |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    while True:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(ASCII_LOWER)))
        words = [m[0] for m in found]
        hit = set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
        if not hit:
            return text
        pieces, at, i = [], 0, 0
        while i < len(words):
            if i not in hit:
                i += 1
                continue
            j = i
            while j + 1 in hit:
                j += 1
            pieces.append(text[at : found[i].start()])
            at, i = found[j].end(), j + 1
        text = " ".join([*pieces, text[at:]])


ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_benchmark_stage_cuts_what_a_plain_search_cuts(spark, folder):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = corpus_pipeline.benchmark_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in got.collect()}
    changed = 0
    for doc_id, text, *_ in docs:
        expected = text if text is None else plain_cut(text, items)
        assert texts[doc_id] == (expected, None if expected is None else len(expected)), doc_id
        changed += expected != text
    assert len(texts) == len(docs) and 0 < changed < len(docs)


CARD, IBAN = r"(?<![\w-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\w-])", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonym_stage_changes_values_and_nothing_else(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    out = corpus_pipeline.pseudonym_stage(spark, docs, folder)
    after = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and after.keys() == before.keys()
    linked, cards = {}, 0
    for doc_id, row in before.items():
        new = after[doc_id].text
        assert (new, row.text) == (None, None) or len(new) == after[doc_id].n_chars
        if row.text is None:
            continue
        # Text without a digit or an at sign holds no value; what changes keeps its shape.
        if not re.search(r"[0-9@]", row.text):
            assert new == row.text
        shape = lambda t: re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
        assert re.sub("[aA0]+", "w", shape(new)) == re.sub("[aA0]+", "w", shape(row.text)), doc_id
        for old in re.finditer(CARD, row.text):
            if luhn(old[0]) and len(new) == len(row.text):
                made = new[old.start() : old.end()]
                assert made != old[0] and luhn(made) and linked.setdefault(re.sub(r"\D", "", old[0]), re.sub(r"\D", "", made)) == re.sub(r"\D", "", made)
                cards += 1
    assert cards > 0
    back = pseudonyms.pseudonymise(out, corpus_pipeline.PSEUDONYM_KEY, back=True)
    assert {r.doc_id: r.text for r in back.collect()} == {i: r.text for i, r in before.items()}


def plain_mix(docs):
    """``(row, copies, target)`` of rows ``(key text for the draw, source, text)``."""
    sizes = [len([w for w in re.split(SPACE, d[1] or "") if w]) for d in docs]
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    total, weight = sum(sizes), {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    held = {s: sum(n for n, d in zip(sizes, docs) if d[3] == s) for s in sources}
    open_, budget = set(sources), mixing.BUDGET_PERCENT * total / 100
    while True:
        left = budget - sum(mixing.MOST * held[s] for s in sources if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= mixing.MOST * held[s]}
        if not full:
            break
        open_ -= full
    target = {s: share[s] if s in open_ else mixing.MOST * held[s] for s in sources}
    out = {}
    for s in sources:
        rows, epochs = [], int(target[s] // held[s]) if held[s] else 0
        for i, d in enumerate(docs):
            if d[3] == s:
                draw = (int(hashlib.md5(f"{mixing.SEED}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                text = d[1] or ""
                clean = (sum(c not in mixing.SYMBOLS for c in text) + 1) / (len(text) + 1)
                rows.append((-math.log(draw) / (0.1 + 0.9 * clean * clean), i))
        rest, at = target[s] - epochs * held[s], 0
        for _, i in sorted(rows):
            out[i] = epochs + int(at + sizes[i] / 2 <= rest and rest > 0)
            at += sizes[i]
    return {i: (n, target[docs[i][3]]) for i, n in out.items() if n and sizes[i]}


def test_mixing_stage_against_a_plain_mix(spark, folder):
    r = random.Random(4)
    docs = [(i, " ".join(words_text(i, r.randrange(1, 90))) + " 77" * r.randrange(9), "en", r.choice(["a", "b", "c", None]), i) for i in range(150)]
    docs += [(500, "", "en", "a", 0), (501, None, "en", "b", 0)]
    expected = plain_mix(docs)
    got = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(docs, SCHEMA), folder).collect()
    found = {x.doc_id: x for x in got}
    assert len(got) == len(expected) and found.keys() == {docs[i][0] for i in expected}
    for i, (copies, target) in expected.items():
        assert tuple(found[docs[i][0]])[:5] == docs[i] and found[docs[i][0]].copies == copies
        assert found[docs[i][0]].target == pytest.approx(target)


def test_mixing_of_rows_without_id_does_not_depend_on_their_order(spark, folder):
    r = random.Random(9)
    docs = [(None, " ".join(words_text(i, r.randrange(5, 60))), "en", "ab"[i % 2], i) for i in range(60)] + [(7, "one two three", "en", "a", 1), (7, "four five", "en", "a", 2)]
    docs += [(None, "same row", "en", "b", 9)] * 3
    outs = []
    for seed in (1, 2):
        shuffled = list(docs)
        random.Random(seed).shuffle(shuffled)
        outs.append(sorted((str(tuple(x)) for x in corpus_pipeline.mixing_stage(spark, spark.createDataFrame(shuffled, SCHEMA).repartition(3), folder).collect())))
    assert outs[0] == outs[1] and len(outs[0]) == len(set(outs[0]))
    assert sum("same row" in x for x in outs[0]) <= 1
