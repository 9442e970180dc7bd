"""Queries of the operators that find repeated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.catalog import query, table
from hazegrid.llm.fmindex import contamination
from hazegrid.llm.minhash import near_duplicates
from hazegrid.llm.repeats import remove_repeats

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_minhash",
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM both_ JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v
  WHERE 100 * c >= 80 * (nu.n + nv.n - c)
), e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, e.v FROM reach JOIN e ON e.u = reach.r
), comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle_words=2, percent=80)


@query(
    "op9_fmindex",
    rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({LOWER_SQL.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
  FROM iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), hit AS (
  SELECT DISTINCT doc_id, i, s.n, item_id
  FROM (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) l) s
  JOIN win ON win.n = s.n AND win.phrase = array_to_string(s.w[i:i + s.n - 1], ' ')
), hw AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY 1
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
)
def op9_fmindex(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.col("hit_words").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )


@query(
    "op7_repeats",
    """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, CAST(length(h) / 2 AS BIGINT) AS n, i, md5(substr(h, 2 * i + 1, 800)) AS s
  FROM b, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 399)) AS t(i)
), twice AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1
), hit AS (SELECT doc_id, i FROM p WHERE s IN (SELECT s FROM twice)
), edge AS (
  SELECT doc_id, i, CASE WHEN i - 400 > lag(i) OVER w OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS new
  FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge
), span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY 1, 2
), gap AS (
  SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(z) AS tail,
         sum(z - a) AS removed, count(*) AS n_spans
  FROM (SELECT s.doc_id, a, z, h, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS prev
        FROM span s JOIN b ON b.doc_id = s.doc_id) GROUP BY 1
)
SELECT b.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN gap ON gap.doc_id = b.doc_id""",
)
def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
