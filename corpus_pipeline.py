"""From raw documents to a training mix: quality, near duplicates, benchmark passages, personal data, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of
``docs``. Each result is written to the shared folder and read again as the next stage's input.

``ORACLE_SQL`` is None: the first stage is a fitted model and SQL cannot state it. ``tests/llm/test_llm_pipeline.py``
holds the whole output of every stage against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.columns import free_prefix
from hazegrid.llm.fmindex import decontaminate
from hazegrid.llm.minhash import near_duplicates
from hazegrid.llm.mixing import mix
from hazegrid.llm.pseudonyms import pseudonymise
from hazegrid.llm.quality import fit_rules, score_quality
from hazegrid.session import materialize, share_code

PSEUDONYM_KEY = b"replace in production"
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_prefix(docs.columns, "_q_")
    scored = score_quality(docs, model, score=f"{name}score", predicted=f"{name}predicted")
    return scored.where(F.col(f"{name}predicted") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Of several rows with that id one stays, the least by all its columns.
    """
    share_code(spark)
    groups = near_duplicates(docs)
    name = free_prefix(docs.columns, "_k_")
    keep = groups.where("kept").groupBy(F.col("doc_id").alias(f"{name}id")).agg(F.count(F.lit(1)).alias(f"{name}n"))
    joined = docs.join(keep, docs["doc_id"].eqNullSafe(keep[f"{name}id"]))
    alone = (F.col(f"{name}n") == 1) | F.col(f"{name}id").isNull()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    least = joined.where(~alone).groupBy(f"{name}id").agg(F.min(F.struct(*columns)).alias(f"{name}row"))
    return joined.where(alone).select(*columns).union(least.select(f"{name}row.*"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark out of the texts; all documents stay."""
    share_code(spark)
    return _counted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses by pseudonyms of the same format."""
    share_code(spark)
    return _counted(pseudonymise(docs, PSEUDONYM_KEY))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with ``copies``, how often each is taken, and their source's target.

    Rows are told apart by a digest of all their columns, so rows of one id or without an id have copies of their
    own. Rows that are equal in every column become one, with the copies of all of them.
    """
    name = free_prefix(docs.columns, "_m_")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(f"{name}row", F.sha2(F.to_json(F.struct(*columns)), 256))
    plan = mix(keyed, row_column=f"{name}row").where("taken > 0")
    plan = plan.groupBy("row").agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias("copies"), F.first("target").alias("target"))
    joined = keyed.dropDuplicates([f"{name}row"]).join(plan, F.col(f"{name}row") == F.col("row"))
    kept = [keyed[f"`{c}`"] for c in docs.columns if c not in ("copies", "target")]
    return joined.select(*kept, plan["copies"], plan["target"])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
