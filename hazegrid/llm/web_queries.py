"""Queries of the operators on web pages, chats and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.catalog import query, table
from hazegrid.llm.crf import extract_main_text
from hazegrid.llm.onebit import nearest
from hazegrid.llm.toolcalls import link_tool_calls
from hazegrid.llm.urls import Rule, fit_urls, judge_urls

URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

# How turns stand in for tool calls: a user's turn asks, the assistant's next turn is the result.
TOOLS = {
    "search": {
        "type": "object",
        "required": ["query", "words"],
        "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 1, "maxLength": 300},
            "words": {"type": "integer", "minimum": 1, "maximum": 40},
        },
    },
    "refine": {
        "type": "object",
        "required": ["after", "query"],
        "properties": {"after": {"type": "string"}, "query": {"type": "string", "maxLength": 400}},
    },
}


@query("op1_extraction")
def op1_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


@query("op3_urls")
def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES, fit_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


_ID = "'c' || conv_id || '-' || "


@query(
    "op6_tool_calls",
    rf"""
WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'
), a AS (SELECT conv_id, turn, min(text) AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2
), c AS (
  SELECT conv_id, turn, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         (conv_id, turn - 2) IN (SELECT (conv_id, turn) FROM u) AS second, (conv_id, turn + 2) IN (SELECT (conv_id, turn) FROM u) AS more FROM u
), d AS (
  SELECT *, CASE WHEN words % 3 = 0 AND more THEN turn + 2 WHEN words % 3 = 1 AND second THEN turn - 2 END AS needs FROM c
), lv AS (
  SELECT conv_id, turn, turn AS place, 0 AS level FROM d WHERE needs IS NULL
  UNION ALL
  SELECT d.conv_id, d.turn, greatest(lv.place, d.turn), CASE WHEN lv.place >= d.turn THEN lv.level + 1 ELSE 0 END
  FROM d JOIN lv ON lv.conv_id = d.conv_id AND lv.turn = d.needs
), j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv, {_ID.replace("conv_id", "coalesce(c.conv_id, a.conv_id)")} coalesce(c.turn, a.turn - 1) AS call_id,
         coalesce(lv.place, c.turn, a.turn) AS place, coalesce(lv.level, 0) AS level, c.turn IS NOT NULL AND lv.turn IS NULL AS cyclic,
         c.turn IS NOT NULL AS asked, a.turn IS NOT NULL AS answered, c.conv_id, c.turn, text, words, second, needs, content,
         CASE WHEN c.turn IS NULL THEN CAST([] AS VARCHAR[]) WHEN second THEN
           (CASE WHEN length(text) > 400 THEN ['/query: too long'] ELSE [] END)
         ELSE list_concat(CASE WHEN length(text) > 300 THEN ['/query: too long'] WHEN text = '' THEN ['/query: too short'] ELSE [] END,
           CASE WHEN words > 40 THEN ['/words: too large'] WHEN words < 1 THEN ['/words: too small'] ELSE [] END) END AS errors
  FROM d c FULL JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn
), st AS (SELECT *, CASE WHEN NOT asked THEN 'orphan' WHEN cyclic THEN 'cyclic' WHEN len(errors) > 0 THEN 'invalid' WHEN answered THEN 'ok' ELSE 'pending' END AS status FROM j)
SELECT conv AS conv_id, call_id, CAST(place AS BIGINT) AS place, CAST(level AS BIGINT) AS level, status, array_to_string(errors, ';') AS errors,
  CASE WHEN NOT asked THEN '{{"id":"' || call_id || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"orphan"}}'
  ELSE '{{"arguments":{{' || CASE WHEN second THEN '"after":"' || {_ID} (turn - 2) || '","query":' || to_json(text)::VARCHAR
         ELSE '"query":' || to_json(text)::VARCHAR || ',"words":' || words END
    || '}},"depends":[' || CASE WHEN needs IS NOT NULL THEN '"' || {_ID} needs || '"' ELSE '' END || '],"id":"' || call_id
    || '","name":"' || CASE WHEN second THEN 'refine' ELSE 'search' END || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
    || ',"status":"' || status || '"}}' END AS line
FROM st""",
)
def op6_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Users' turns as calls, the next assistant turns as results; turns of other roles give no row.

    The given chats name no dependencies, so they are taken from the texts: with a number of words divisible by
    three a call needs the user's next turn, which stands behind it; with one word more it needs the turn before.
    So some calls move behind later ones, over several turns, and some wait for each other.
    """
    turns = table(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    identifier = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), identifier.alias("call_id"))
    former = asked.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("call_id").alias("after")).distinct()
    later = asked.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("call_id").alias("before")).distinct()
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    second = F.col("after").isNotNull()
    needs = F.when(words % 3 == 0, F.array("before")).when(words % 3 == 1, F.array("after")).otherwise(F.array().cast("array<string>"))
    calls = asked.join(former, ["conv_id", "turn"], "left").join(later, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("conv"),
        "call_id",
        F.col("turn").alias("position"),
        F.when(second, "refine").otherwise("search").alias("name"),
        F.when(second, F.to_json(F.struct("after", F.col("text").alias("query"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"))))
        .alias("arguments"),
        F.array_compact(needs).alias("depends"),
    )
    answer_to = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), answer_to.alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    linked = link_tool_calls(calls, results, TOOLS)
    return linked.select(F.col("conv").alias("conv_id"), "call_id", "place", "level", "status", F.array_join("errors", ";").alias("errors"), "line")


@query(
    "op8_onebit",
    """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score
  FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
)
def op8_onebit(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
