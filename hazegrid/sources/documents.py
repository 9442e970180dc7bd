"""Text documents as evidence chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.functions.text import squeeze

CHUNK_CHARS = 3500
DOCUMENT_CREDIBILITY = 0.82


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("source_id"), F.col("value").alias("text"))


def document_chunks(documents: DataFrame, text: str = "text", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """White space made single over the whole text, empty texts dropped, then cut to the chunk length."""
    squeezed = documents.withColumn(text, squeeze(F.col(text))).where(F.length(text) > 0)
    return squeezed.withColumn(text, F.substring(text, 1, max_chars))
