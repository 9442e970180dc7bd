"""Queries of the operators that judge, change or mix documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.catalog import query, table
from hazegrid.llm.mixing import SEED, SYMBOLS, mix
from hazegrid.llm.pseudonyms import pseudonymise
from hazegrid.llm.quality import fit_rules, held_out, score_quality

PSEUDONYM_KEY = b"replace in production"


@query("op2_pseudonyms")
def op2_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pseudonymise(docs, PSEUDONYM_KEY, kinds_column="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), F.array_join(F.array_distinct("kinds"), ",").alias("kinds"))


@query(
    "op4_mixing",
    rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (length(translate(coalesce(text, ''), '{SYMBOLS}', '')) + 1)::DOUBLE / (length(coalesce(text, '')) + 1)::DOUBLE AS share,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents
), k AS (SELECT *, -ln(u) / (0.1::DOUBLE + 0.9::DOUBLE * share * share) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY source_size::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s
), c AS (SELECT *, w * (150 * total - 200 * before) >= 200 * source_size * w_left AS capped FROM r
), o AS (
  SELECT max(total) * 150 - 200 * coalesce(sum(source_size) FILTER (capped), 0) AS rest_all,
         coalesce(sum(w) FILTER (NOT capped), 1) AS w_open FROM c
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN source_size::DOUBLE * 2
    ELSE (w * rest_all)::DOUBLE / (100 * w_open)::DOUBLE END AS target FROM c, o
), e AS (
  SELECT k.doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND start + size / 2::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e""",
)
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_rules(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
