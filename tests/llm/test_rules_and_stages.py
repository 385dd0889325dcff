"""Rule scores against plain evaluation, and what every pipeline stage does to whole rows."""

import math
import unicodedata
from collections import Counter

import brute
import pytest
from corpus_rows import edge_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import common as C
from tillroll.llm import lines, mix, rules


def statistics(text):
    """The statistics of a text by their definitions."""
    text = text or ""
    words, rows, n = brute.WORD.findall(text), text.split("\n"), len(text)
    kind = [unicodedata.category(c) for c in text]

    def per(x, y):
        return x / y if y else 0.0

    other = sum(k[0] not in "LN" and c not in " \t\n\v\f\r.,;:!?|'\"()-" for c, k in zip(text, kind))
    return {"n_chars": n, "n_words": len(words), "n_lines": len(rows), "word_length": per(n, len(words)), "line_words": per(len(words), len(rows)),
            "distinct_words": per(len(set(words)), len(words)), "distinct_lines": per(len(set(rows)), len(rows)),
            "capitals": per(kind.count("Lu"), n), "digits": per(kind.count("Nd"), n), "ends": per(sum(c in ".?" for c in text), n),
            "commas": per(sum(c in ",;:" for c in text), n), "shouts": per(text.count("!"), n), "bars": per(text.count("|"), n), "signs": per(other, n)}


def plain_score(fitted, text):
    x = statistics(text)
    total = fitted.intercept + sum(w for rule, w in fitted.weights if all(x[n] > at if above else x[n] <= at for n, above, at in rule))
    return 1 / (1 + math.exp(-total))


def test_statistics(spark, edges):
    names = list(rules.NAMES)
    got = edges.select("text", *[c.alias(f"stat_{n}") for n, c in rules.statistics(F.col("text")).items()]).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        want = statistics(r["text"])
        assert [r[f"stat_{n}"] for n in names] == pytest.approx([want[n] for n in names])


def test_scores_are_those_of_the_rules(spark, edges):
    sf = "/root/testdata/sf0.01"
    docs, labels = C.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    stats = rules.measured(docs, F.col("doc_id"), rules.held_out_rows().alias("held_out"))
    fitted = rules.learn(stats, labels)
    assert 0 < len(fitted.weights) and all(w for _, w in fitted.weights)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["score"] for r in rules.op8_quality_classifier(spark, sf).collect()}
    assert got == pytest.approx({d: plain_score(fitted, t) for d, t in texts.items()})
    other = rules.measured(edges, F.col("text").alias("whole")).select("whole", fitted.score().alias("s")).collect()
    assert [r["s"] for r in other] == pytest.approx([plain_score(fitted, r["whole"]) for r in other])


class Node:
    """A node of a fitted tree as the training library shows it."""

    def __init__(self, feature=None, at=None, left=None, right=None):
        self.feature, self.at, self.left, self.right = feature, at, left, right

    def getClass(self):
        return self

    def getSimpleName(self):
        return "LeafNode" if self.feature is None else "InternalNode"

    def split(self):
        return self

    def featureIndex(self):
        return rules.NAMES.index(self.feature)

    def threshold(self):
        return self.at

    def leftChild(self):
        return self.left

    def rightChild(self):
        return self.right


def test_rules_of_a_tree():
    """Every path is a conjunction with the tightest bound a side of each statistic."""
    inner = Node("n_chars", 5, Node(), Node("n_chars", 7, Node(), Node()))
    tree = Node("n_chars", 10, inner, Node("n_words", 2, Node(), Node()))
    assert rules.tree_rules(tree) == [
        (("n_chars", False, 10.0),),
        (("n_chars", False, 5.0),),
        (("n_chars", False, 10.0), ("n_chars", True, 5.0)),
        (("n_chars", False, 7.0), ("n_chars", True, 5.0)),
        (("n_chars", False, 10.0), ("n_chars", True, 7.0)),
        (("n_chars", True, 10.0),),
        (("n_chars", True, 10.0), ("n_words", False, 2.0)),
        (("n_chars", True, 10.0), ("n_words", True, 2.0))]
    assert rules.tree_rules(Node()) == []


def test_what_the_stages_keep(spark):
    """quality, line_dedup and mixing row by row (near_duplicates and decontamination: test_pipeline)."""
    sf = "/root/testdata/sf0.001"
    docs = C.documents(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def rows(df):
        return Counter(tuple(r[c] for c in columns) for r in df.collect())

    good = C.stored(stages["quality"](spark, docs, sf), "quality")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = rules.measured(docs, F.col("doc_id"), rules.held_out_rows().alias("held_out"))
    fitted, at = rules.learn(stats, labels), columns.index("text")
    assert rows(good) == Counter({r: n for r, n in rows(docs).items() if plain_score(fitted, r[at]) >= rules.THRESHOLD})

    fewer = C.stored(stages["line_dedup"](spark, good, sf), "line_dedup")
    kept = Counter((r["doc_id"], r["kept"]) for r in lines.line_dedup(good).select("doc_id", "kept").collect())
    assert Counter((r["doc_id"], r["text"]) for r in fewer.collect()) == kept
    assert all(r["n_chars"] == len(r["text"]) for r in fewer.collect())
    same = [c for c in columns if c not in ("text", "n_chars")]
    assert Counter(fewer.select(same).collect()) == Counter(good.select(same).collect())

    mixed = stages["mixing"](spark, fewer, sf)
    times = {r["doc_id"]: r["n"] for r in mix.mix(fewer).select("doc_id", F.col("_mix.copies").alias("n")).collect()}
    got = Counter()
    for r in mixed.collect():
        got[tuple(r[c] for c in columns)] += 1
    assert got == Counter({r: n * times[r[columns.index("doc_id")]] for r, n in rows(fewer).items() if times[r[columns.index("doc_id")]]})
    numbers = mixed.groupBy("doc_id").agg(F.sort_array(F.collect_list("copy")).alias("copies")).collect()
    assert all(r["copies"] == list(range(1, times[r["doc_id"]] + 1)) for r in numbers)
