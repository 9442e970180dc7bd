"""Queries of the operators on phrases, fingerprints and periods of the whole corpus."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.bitslices import near_fingerprints
from hazegrid.llm.catalog import query, table
from hazegrid.llm.dedup_queries import LOWER_SQL
from hazegrid.llm.periods import periodic_runs
from hazegrid.llm.phrases import collocations


@query(
    "op11_phrases",
    rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex({LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, unnest(range(1, 6)) AS t(m))
  GROUP BY 1, 2, 3
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY 1
), big AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE f >= 100
), longer AS (
  SELECT lang, m - 1 AS m, unnest([array_to_string(w[1:m - 1], ' '), array_to_string(w[2:m], ' ')]) AS phrase, f
  FROM big WHERE m > 2
), outer_ AS (SELECT lang, m, phrase, max(f) AS f FROM longer GROUP BY 1, 2, 3
), c AS (
  SELECT b.* FROM big b LEFT JOIN outer_ o ON o.lang = b.lang AND o.m = b.m AND o.phrase = b.phrase
  WHERE b.m > 1 AND (o.f IS NULL OR 100 * o.f < 100 * b.f)
), cut AS (
  SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y, k AS mx, m - k AS my
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, l.f AS l, r.f AS r, n.n, k,
         (1000::HUGEINT * cut.f::HUGEINT * n.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cut JOIN g l ON l.lang = cut.lang AND l.m = mx AND l.phrase = x
           JOIN g r ON r.lang = cut.lang AND r.m = my AND r.phrase = y JOIN n ON n.lang = cut.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
)
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op12_bitslices")
def op12_bitslices(spark: SparkSession, folder: str) -> DataFrame:
    return near_fingerprints(table(spark, folder, "documents"))


def repeated_tail(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's change to a tenth of the documents: from some word on, a stretch repeats to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


@query("op13_periods")
def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(table(spark, folder, "documents"), sources=repeated_tail)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def greater(best, run):
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.reduce("runs", none, greater)
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.array_join(F.transform(line, lambda text: F.concat(text, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
