"""Quality classifier as a sparse rule ensemble, scored by plain column expressions.

Shallow trees are fitted on statistics of a bounded sample of labelled texts. Every path from a root to a
node becomes a rule, a conjunction of comparisons. A lasso logistic regression keeps few rules, and these are
compiled into one Spark expression, so scoring needs neither the trees nor Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.columns import free_prefix
from hazegrid.session import materialize

SAMPLE_ROWS = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002
THRESHOLD = 0.3
FOLDS = 5

# Character groups that the statistics count.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
STOPS = ".,;:?"
SYMBOLS = "!#$%&*+<=>@[]^_`{|}~\\/"

STATISTICS = [
    "chars",
    "words",
    "word_length",
    "distinct_words",
    "distinct_lines",
    "line_length",
    "upper",
    "digits",
    "stops",
    "symbols",
]


def _share(text: Column, length: Column, group: str) -> Column:
    return (length - F.length(F.translate(text, group, ""))) / F.greatest(length, F.lit(1))


def with_statistics(df: DataFrame, text_column: str, prefix: str = "_s_") -> DataFrame:
    """Add the statistics of the whole text as doubles; a null text counts as an empty one."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    parts = f"{prefix}parts"
    split = F.struct(
        text.alias("text"),
        F.length(text).alias("length"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line != "").alias("lines"),
    )
    whole, length, words, lines = (F.col(f"{parts}.{c}") for c in ("text", "length", "words", "lines"))
    count, line_count = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    values = {
        "chars": F.log1p(length),
        "words": F.log1p(F.size(words)),
        "word_length": length / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / line_count,
        "line_length": F.log1p(length / line_count),
        "upper": _share(whole, length, UPPER),
        "digits": _share(whole, length, DIGITS),
        "stops": _share(whole, length, STOPS),
        "symbols": _share(whole, length, SYMBOLS),
    }
    values = {f"{prefix}{name}": values[name].cast("double") for name in STATISTICS}
    return df.withColumn(parts, split).withColumns(values).drop(parts)


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; a rule is a tuple of (statistic, below or equal, threshold)."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self, prefix: str = "_s_") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule, prefix: str = "_s_") -> Column:
    parts = [
        F.col(f"{prefix}{name}") <= threshold if below else F.col(f"{prefix}{name}") > threshold
        for name, below, threshold in rule
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result & part
    return result


def _paths(node, path: tuple, found: set) -> None:
    if path:
        found.add(tuple(sorted(path)))
    if node.getClass().getSimpleName() == "InternalNode":
        name, threshold = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        _paths(node.leftChild(), (*path, (name, True, threshold)), found)
        _paths(node.rightChild(), (*path, (name, False, threshold)), found)


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divides by ``FOLDS``. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleEnsemble:
    """Learn from at most ``sample_rows`` labelled rows outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1 and rows without a document are left out. With one class only (or no rows) the
    ensemble has no rules and returns that class's share, 0.5 without any row.
    """
    usable = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    chosen = usable.select(F.col(id_column).alias("_id"), F.col(label_column).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample_rows)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    # The chosen ids are at most sample_rows, so every task can hold them and no text is moved.
    sample = with_statistics(texts.join(F.broadcast(chosen), "_id"), "_text").drop("_text")
    # The statistics of the sample are bounded too: one sorted partition, so fits do not depend on the layout.
    names = [f"_s_{name}" for name in STATISTICS]
    sample = materialize(sample.repartition(1).sortWithinPartitions("_id", "_label", *names), "quality-sample")
    shares = sample.agg(F.avg("_label"), F.count(F.lit(1))).first()
    if not shares[1] or shares[0] in (0.0, 1.0):
        share = shares[0] if shares[1] else 0.5
        return RuleEnsemble({0.0: -20.0, 1.0: 20.0}.get(share, 0.0), ())
    table = VectorAssembler(inputCols=names, outputCol="_x").transform(sample)
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=7
    ).fit(table)
    found: set = set()
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), (), found)
    rules = sorted(found)
    flags = {f"_r_{i}": condition(rule).cast("double") for i, rule in enumerate(rules)}
    table = VectorAssembler(inputCols=list(flags), outputCol="_f").transform(sample.select("_label", "_id", *[c.alias(n) for n, c in flags.items()]))
    fitted = LogisticRegression(
        featuresCol="_f", labelCol="_label", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=200
    ).fit(table)
    weights = fitted.coefficients.toArray()
    return RuleEnsemble(
        float(fitted.intercept), tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if w != 0.0)
    )


def score_quality(
    docs: DataFrame, model: RuleEnsemble, text_column: str = "text", score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) to every row, empty and null texts too.

    They replace columns of their names; all other columns stay.
    """
    prefix = free_prefix(docs.columns, "_s_")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (score, predicted)]
    scored = with_statistics(docs, text_column, prefix).select(*kept, model.score(prefix).alias(score))
    return scored.withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int"))
