"""Operator 8 - quality classifier as a sparse rule ensemble.

Statistics of the whole text are Spark columns.  A forest of shallow trees is
grown on a bounded sample of labelled rows (``SAMPLE``, the lowest hashes of the
ids); every path from a root to a node is a conjunctive rule over the
statistics.  A lasso logistic regression weighs the rules, most of them with
zero, and the rest are compiled into one Spark column: the score of any text is
a sum of CASE terms, without Python and without the training library.

Special rows: null or empty text is scored like any other (all statistics are
zero); labels without a row or with a null are not learnt from; with labels of
one kind only (or none) the score is their smoothed share; repeated rows get
equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.7
TREES, DEPTH, LASSO, SEED = 30, 4, 0.0005, 17


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, as columns; shares are of its characters, words or lines."""
    text = F.coalesce(text, F.lit(""))
    words, lines = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.split(text, "\n")
    n_chars, n_words, n_lines = F.length(text), F.size(words), F.size(lines)

    def share(pattern: str) -> Column:
        return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), n_chars), F.lit(0.0))

    return {
        "n_chars": n_chars.cast("double"), "n_words": n_words.cast("double"), "n_lines": n_lines.cast("double"),
        "word_length": F.coalesce(F.try_divide(n_chars.cast("double"), n_words), F.lit(0.0)),
        "line_words": F.coalesce(F.try_divide(n_words.cast("double"), n_lines), F.lit(0.0)),
        "distinct_words": F.coalesce(F.try_divide(F.size(F.array_distinct(words)).cast("double"), n_words), F.lit(0.0)),
        "distinct_lines": F.coalesce(F.try_divide(F.size(F.array_distinct(lines)).cast("double"), n_lines), F.lit(0.0)),
        "capitals": share(r"\p{Lu}"), "digits": share(r"\p{Nd}"), "ends": share(r"[.?]"), "commas": share(r"[,;:]"),
        "shouts": share("!"), "bars": share(r"\|"), "signs": share(r"[^\p{L}\p{N}\s.,;:!?|'\"()-]"),
    }


NAMES = (
    "n_chars", "n_words", "n_lines", "word_length", "line_words", "distinct_words", "distinct_lines", "capitals",
    "digits", "ends", "commas", "shouts", "bars", "signs")


def measured(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` and the statistics of each row, stored (a few numbers for each text)."""
    return C.stored(docs.select(*keys, *[c.alias(n) for n, c in statistics(F.col("text")).items()]), "statistics")


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions: ((statistic, is_above, threshold), ...) -> weight, and the intercept."""
    weights: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule) -> Column:
    terms = [F.col(name) > F.lit(at) if above else F.col(name) <= F.lit(at) for name, above, at in rule]
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def tree_rules(node, path=()) -> list[tuple]:
    """The conjunction that leads to each node of a fitted tree, with one bound a side for each statistic."""
    out = []
    if path:
        bounds: dict[tuple[str, bool], float] = {}
        for name, above, at in path:
            key = (name, above)
            bounds[key] = at if key not in bounds else (max if above else min)(bounds[key], at)
        out.append(tuple(sorted((n, a, t) for (n, a), t in bounds.items())))
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, at = NAMES[split.featureIndex()], float(split.threshold())
        out += tree_rules(node.leftChild(), (*path, (name, False, at)))
        out += tree_rules(node.rightChild(), (*path, (name, True, at)))
    return out


def fit(training: DataFrame) -> Rules:
    """Rules from ``training(label double, statistics...)``, a bounded table."""
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    n, good = sum(counts.values()), counts.get(1.0, 0)
    if not 0 < good < n:
        share = (good + 1) / (n + 2)
        return Rules((), math.log(share / (1 - share)))
    data = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(training)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))})
    fired = F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules])
    matrix = training.select("label", array_to_vector(fired).alias("features")).persist()
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(matrix)
    matrix.unpersist()
    weights = tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w)
    return Rules(weights, float(model.intercept))


def held_out_rows() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; ``stats`` has ``doc_id``, ``held_out``."""
    marked = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = (stats.where("NOT held_out").join(marked, "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label", *NAMES).limit(sample))
    rows = C.stored(rows.select("label", *NAMES).repartition(4, *NAMES).sortWithinPartitions(*NAMES, "label"), "training")
    rows = rows.persist()
    rules = fit(rows)
    rows.unpersist()
    return rules


def quality_scores(docs: DataFrame, labels: DataFrame, *keys: Column, sample: int = SAMPLE) -> DataFrame:
    """A row per document: ``keys``, doc_id, held_out, score, predicted."""
    stats = measured(docs, F.col("doc_id"), held_out_rows().alias("held_out"), *keys)
    score = learn(stats, labels, sample).score()
    return (stats.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop(*NAMES))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
