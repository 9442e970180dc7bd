"""The evidence of every site as one table, ready to be ranked together with document chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid import schema as S

# Parts of the evidence, their titles, source types and credibilities.
PARTS = {
    "dashboard_visible_state": ("Visible dashboard state", "dashboard", 0.99),
    "dataset_summary": ("Dataset summary", "dataset", 0.95),
    "live_station": ("Current station conditions", "live", 0.95),
    "forecast_station": ("Forecast outlook", "forecast", 0.92),
    "alerts": ("Alert state", "alerts", 0.9),
    "historical_recent": ("Recent historical behavior", "historical", 0.88),
    "live_network": ("Live network", "network", 0.86),
}


def evidence_table(texts: dict[str, DataFrame], site: str = S.SITE) -> DataFrame:
    """``site, chunk_id, title, source_type, text, credibility, metadata`` for all sites and parts given.

    ``texts`` has, per name of ``PARTS``, a table of the site, a column ``text`` and any further columns: those
    become the metadata, a map from column name to its value as text. Rows without a text are left out.
    """
    unknown = set(texts) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown evidence parts: {sorted(unknown)}")
    table = None
    for name, (title, source_type, credibility) in PARTS.items():
        if name not in texts:
            continue
        df = texts[name].where(F.col("text").isNotNull())
        facts = [c for c in df.columns if c not in (site, "text")]
        pairs = [part for c in facts for part in (F.lit(c), F.col(c).cast("string"))]
        rows = df.select(
            site,
            F.lit(name).alias("chunk_id"),
            F.lit(title).alias("title"),
            F.lit(source_type).alias("source_type"),
            "text",
            F.lit(credibility).alias("credibility"),
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
        )
        table = rows if table is None else table.unionByName(rows)
    return table


def as_sources(evidence: DataFrame, documents: DataFrame, site: str = S.SITE) -> DataFrame:
    """Evidence and document chunks as one corpus: ``source_id, text, source_type, credibility``.

    ``documents`` has ``doc_id, text, source_type, credibility``.
    """
    own = F.concat_ws(":", F.col(site).cast("string"), "chunk_id").alias("source_id")
    listed = F.concat(F.lit("document:"), F.col("doc_id").cast("string")).alias("source_id")
    columns = ["text", "source_type", "credibility"]
    return evidence.select(own, *columns).unionByName(documents.select(listed, *columns))
