"""The registered training-data queries against their SQL twins or a plain version written here."""

from __future__ import annotations

import html
import re

import pytest
from compare import compare

import __spark_entry__ as contract
from hazegrid.llm import catalog
from hazegrid.llm.web_queries import URL_RULES

QUERIES = {name: f for name, f in contract.queries().items() if name in catalog.queries()}
ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", [name for name in QUERIES if name in ORACLES])
def test_against_sql(spark, folder, duck, name):
    problem, rows = compare(spark, duck, folder, QUERIES[name], ORACLES[name])
    assert problem is None, problem
    assert rows > 0


def test_one_query_per_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert "pipeline" in contract.queries()


def test_articles_come_out_whole(spark, folder):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op1_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    for row in got:
        inside = re.search(r"<article>(.*?)</article>", pages[row.page_id] or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inside[1]))) if inside else []
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


def plain_rule(url):
    """Host, path and rule by the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(str(r)), default=None)


def test_urls_follow_the_rules(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op3_urls"](spark, folder).collect()
    assert len(got) == len(urls)
    for row in got:
        host, path, rule = plain_rule(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, None if rule is None else str(rule))
        shady = any(word in host for word in ("casino", "bets", "pills", "spam", "adult", "ads-"))
        assert row.verdict == (rule.verdict if rule else "block" if shady else "allow")


def test_url_plan_has_no_python(spark, folder):
    plan = QUERIES["op3_urls"](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    scored = QUERIES["op5_quality"](spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert len(held) > 50 and right >= 0.95 * len(held)


def test_no_raw_number_is_left(spark, folder):
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pattern = re.compile(r"[a-z]+\.\d+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b4\d{15}\b|\b\d+\.\d+\.\d+\.\d+\b|AKIA\w{16}")
    found = 0
    for row in QUERIES["op2_pseudonyms"](spark, folder).collect():
        for value in pattern.findall(raw[row.doc_id] or ""):
            found += 1
            assert value.split("@")[0] not in row.text
        assert len(row.text or "") - len(raw[row.doc_id] or "") in range(-12, 13)
    assert found > 0
