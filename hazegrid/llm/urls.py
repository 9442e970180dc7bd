"""URL filter: explicit rules first, then a logistic regression on hashed character n-grams of host and path.

Everything runs as column expressions. The model is fitted by Spark ML on a small labelled table and compiled
into one array of weights, so a URL costs one pass over its n-grams.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
GRAMS = (3, 4, 5)
THRESHOLD = 0.5

# Parts of host and path names of the labelled table.
SHADY = (
    "casino poker bets slots jackpot pills pharma viagra cheap loans payday spam farm ads track adult xxx porn "
    "escort dating free win click promo warez torrent cracks hacks bonus gamble"
).split()
PLAIN = (
    "news garden school library museum travel music sport weather kitchen science history market health city "
    "river forest letter paper bridge water summer winter green north south learn data code wiki theatre "
    "harbour teacher valley painter orchard station village doctor mountain"
).split()
SYLLABLES = "th ti on er an st re in ed sh ha ble tion nd he or es en le ou".split()
FRONTS = ["", "www.", "m.", "blog."]
ENDS = ["example.com", "example.org", "example.net"]
PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/{n}", "/{w}/{n}", "", "/{w}.html"]

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_urls() -> list[tuple[str, str, int]]:
    """``host, path, blocked`` made by rule: names of shady words are blocked, plain and invented ones are not."""
    shady = [*SHADY, *(f"{a}-{b}" for a, b in zip(SHADY, SHADY[7:] + SHADY[:7], strict=True))]
    shady += [f"{a}{b}" for a, b in zip(SHADY, SHADY[11:] + SHADY[:11], strict=True)]
    plain = [*PLAIN, *(f"{a}-{b}" for a, b in zip(PLAIN, PLAIN[7:] + PLAIN[:7], strict=True))]
    plain += ["th" + a + b for i, a in enumerate(SYLLABLES) for b in SYLLABLES[i % 3 :: 3]]
    plain += [a + b for i, a in enumerate(SYLLABLES) for b in SYLLABLES[i % 5 :: 5]]
    rows = []
    for blocked, names in ((1, shady), (0, plain)):
        words = SHADY if blocked else PLAIN
        for i, name in enumerate(names):
            for j in range(2 if blocked else 1):
                path = PATHS[(3 * i + j) % len(PATHS)].format(n=(37 * i + 11 * j) % 1000, w=words[i % len(words)])
                rows.append((f"{FRONTS[(i + j) % 4]}{name}.{ENDS[(i + 2 * j) % 3]}", path, blocked))
    return rows


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*", 0), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _bucket(mark: str, text: Column, n: int, start: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(mark), F.substring(text, start, F.lit(n))), F.lit(BUCKETS)).cast("int")


def buckets(host: Column, path: Column) -> Column:
    """Distinct hash buckets of the n-grams of both parts; the parts have n-grams of their own."""
    found = []
    for mark, text in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        for n in GRAMS:
            starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1)))
            found.append(F.transform(starts, functools.partial(_bucket, mark, framed, n)))
    return F.array_distinct(F.concat(*found))


@dataclass(frozen=True)
class UrlModel:
    intercept: float
    weights: tuple[float, ...]

    def score(self, host: Column, path: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(list(self.weights))), "array<double>")
        total = F.aggregate(buckets(host, path), F.lit(self.intercept), lambda s, b: s + F.get(table, b))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_urls(spark: SparkSession, rows: Sequence[tuple[str, str, int]] | None = None) -> UrlModel:
    """Fit on a small labelled list of ``host, path, blocked`` (``labelled_urls`` by default)."""
    rows = labelled_urls() if rows is None else list(rows)
    quoted = ", ".join("('{}', '{}', {}D)".format(*(v.replace("\\", "\\\\").replace("'", "\\'") for v in (h, p)), b) for h, p, b in rows)
    table = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, label)")
    found = buckets(F.col("host"), F.col("path"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains(F.col("found"), i).cast("double"))
    table = table.select("label", found.alias("found")).coalesce(1).select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.01, maxIter=60, standardization=False).fit(table)
    return UrlModel(float(model.intercept), tuple(float(w) for w in model.coefficients.toArray()))


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and the start of the path."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct ``rule, verdict``; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judge_urls(pages: DataFrame, rules: Sequence[Rule], model: UrlModel, url_column: str = "url") -> DataFrame:
    """Every row with ``host, path, rule, verdict, url_score`` behind its own columns (which they replace by name).

    A rule's verdict counts before the model's, which blocks from ``THRESHOLD`` on. The rule list is part of the
    plan and meant to be short. Null and empty URLs and those without ``://`` have empty parts, fit no rule and
    are judged by the model like any other.
    """
    url = F.col(f"`{url_column}`")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "url_score")]
    parts = pages.select(*[F.col(f"`{c}`") for c in own], F.struct(host_of(url).alias("host"), path_of(url).alias("path")).alias("_url"))
    host, path = F.col("_url.host"), F.col("_url.path")
    judged = parts.select("*", first_rule(host, path, rules).alias("_rule"), model.score(host, path).alias("url_score"))
    by_model = F.when(F.col("url_score") >= THRESHOLD, "block").otherwise("allow")
    return judged.select(
        *[F.col(f"`{c}`") for c in own],
        host.alias("host"),
        path.alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"),
        "url_score",
    )
