"""Operators 2, 5, 8, 9 and the pipeline."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from corpus_rows import edge_rows, passage, table
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import brown, lengths, mix, rules, stages
from tillroll.llm import common as C


def test_language_model(spark, small):
    rows, sf = small
    import zlib
    got = {r["doc_id"]: r for r in brown.op2_brown_lm_scoring(spark, sf).collect()}
    words = {d: brute.WORD.findall(brute.low(t)) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    count = Counter(w for d in words if not held[d] for w in words[d])
    n, v = sum(count.values()), len(count)
    for d, w in words.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    assert sum(r["score"] - r["base_score"] for r in got.values() if r["held_out"]) > 0


def test_model_is_a_distribution():
    """P(known words) and P(unknown) sum to one after every context."""
    rng = np.random.default_rng(2)
    types, tokens = np.zeros(brown.STATES), np.zeros(brown.STATES)
    types[:5] = [3, 1, 4, 2, 6]
    tokens[:5] = types[:5] * 4
    types[brown.END], tokens[brown.END] = 1, 9
    logs = brown.transition_logs(rng.integers(0, 9, (brown.STATES, brown.STATES)).astype(float), types, tokens)
    known = np.zeros(brown.STATES)
    known[:5] = (tokens[:5] - brown.DISCOUNT * types[:5]) / tokens[:5]
    known[brown.END] = known[brown.UNKNOWN] = 1
    with np.errstate(invalid="ignore"):
        total = (10.0 ** logs * known)[:, [*range(5), brown.END, brown.UNKNOWN]].sum(1)
    assert total == pytest.approx(np.ones(brown.STATES))


def test_exchange_finds_groups():
    """Two vocabularies that never meet, interleaved by frequency: exchange separates them."""
    rng = np.random.default_rng(4)
    side = np.arange(24) % 3 == 0
    a = rng.poisson(200.0 / (1 + np.arange(24)[:, None] + np.arange(24)))
    a[side[:, None] != side] = 0
    cls = brown.exchange(a.astype(float), 2, 20)
    assert len(set(cls[side])) == 1 and len(set(cls[~side])) == 1 and cls[0] != cls[1]


def test_language_model_edges(edges, nothing):
    out = brown.score_texts(edges, F.col("doc_id") == 5).select(C.doc_id_of(), "n_tokens", "score", "held_out").collect()
    assert len(out) == len(edge_rows()) and all(np.isfinite(r["score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert brown.score_texts(nothing, F.lit(False)).count() == 0
    assert {r["score"] for r in brown.score_texts(edges, F.lit(True)).collect()} == {0.0}


def test_lengths(spark, small, edges, nothing):
    rows, sf = small
    encode = lengths.encoding(lengths.RANKS, lengths.PATTERN).encode_ordinary
    n = [len(encode(t or "")) for _, t in rows]
    want = Counter((x, c, sum(y > x for y in n), sum(n), sum(min(x, y) for y in n)) for x, c in Counter(n).items())
    out = lengths.op5_token_length_histogram(spark, sf).cache()
    assert Counter(tuple(r)[:5] for r in out.collect()) == want
    assert all(r["quantile"] == pytest.approx(sum(y <= r["length"] for y in n) / len(n)) for r in out.collect())
    for limit in (0, 1, 77, 1000, 10**6):
        assert tuple(lengths.at_limit(out, limit).first()) == (sum(y > limit for y in n), sum(min(limit, y) for y in n))
    histogram = lengths.length_histogram(lengths.token_lengths(edges))
    assert histogram.agg(F.sum("n_docs")).first()[0] == len(edge_rows())
    assert lengths.length_histogram(lengths.token_lengths(nothing)).count() == 0


def test_classifier(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rules.op8_quality_classifier(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels)
    assert len(labels) > 50 and right >= 0.95 * len(labels)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (99, 0)], "doc_id long, quality int")
    out = rules.quality_scores(edges, labels).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {round(r["score"], 6) for r in rules.quality_scores(edges, labels.limit(0)).collect()} == {0.5}
    assert rules.quality_scores(nothing, labels).count() == 0


def test_tree_rules_keep_one_bound_a_side():
    assert rules.Rules((), 0.0).score() is not None


def check_mix(out, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in out:
        m, s = r["_mix"], r["source"]
        assert m["target"] == pytest.approx(want[s]) and m["source_size"] == sizes[s] and m["taken"] == m["copies"] * m["size"] <= 2 * m["size"]
        taken[s] += m["taken"]
        largest[s] = max(largest[s], m["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 * want[s]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["_mix"]["size"], r["_mix"]["copies"]) for r in out)


def test_mix(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = check_mix(mix.mix(docs).collect(), rows)
    assert len(first) == len(rows) and check_mix(mix.mix(docs.repartition(5)).collect(), rows) == first
    check_mix(mix.mix(edges).collect(), edge_rows())
    assert mix.mix(nothing).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs, columns = C.documents(spark, sf), None
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = C.stored(stage(spark, docs, sf), name)
        rows = [(r.doc_id, r.text) for r in before.collect()]
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "near_duplicates":
            assert got == Counter(r for r, (d, n, c) in zip(rows, brute.jaccard_components(rows)) if not n or d == c)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert got == Counter(r for r, x in zip(rows, brute.contamination(rows, items)) if not x[-1])
        if name == "line_dedup":
            assert len(got) == len({d for d, _ in rows}) and {d for d, _ in got} == {d for d, _ in rows}
        if name != "mixing":
            assert docs.columns == columns
    assert docs.columns == [*columns, "copy"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "copy").collect())) == Counter((r.doc_id, r.copy) for r in docs.collect())


def test_stages_on_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "la la la")], "item_id long, text string")
    for docs in (edges, nothing):
        out = [stages.drop_low_quality(docs, labels), stages.drop_repeated_lines(docs), stages.keep_one_of_each_group(docs), stages.drop_contaminated(docs, bench)]
        assert all(x.columns == docs.columns and x.count() <= docs.count() for x in out)
        stages.mixed(docs).count()
    kept = stages.keep_one_of_each_group(edges).select("doc_id", "text").collect()
    assert sum(r.doc_id == 4 for r in kept) == 1 and sum((r.text or "").strip() == "" for r in kept) == 3


def test_unrelated_texts_of_one_id_stay(spark):
    """Groups are not their smallest id: null and repeated ids stand on texts that have nothing in common."""
    texts = [" ".join(passage(i, 60)) for i in range(20, 28)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(8, texts[0]), (9, texts[5])]
    kept = stages.keep_one_of_each_group(table(spark, [(d, t, "s") for d, t in rows])).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter(rows[:8])


def test_blocks_of_equal_rows(spark):
    """A table united with itself and a row in each partition: blocks with the same rows are scored each for itself."""
    texts = [" ".join(passage(i, 30)) for i in range(40, 46)]
    base = table(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1)
    same = table(spark, [(1, texts[1], "s")] * 4).repartition(4)
    for docs, times in ((base.unionByName(base), 2), (base.unionByName(same), 1)):
        out = brown.score_texts(docs, F.col("doc_id") == 5).collect()
        rows = [(i, t) for i, t in enumerate(texts)] * times + [(1, texts[1])] * (0 if times == 2 else 4)
        count = Counter(w for i, t in rows if i != 5 for w in [*t.split(), None])
        n, v = sum(count.values()), len(count)
        want = Counter()
        for i, t in rows:
            words = [*t.split(), None]
            want[i, len(words), sum(count[w] > 0 for w in words), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)] += 1
        assert Counter((r["_d"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
        assert len({(r["_d"], round(r["score"], 6)) for r in out}) == len(texts)


def test_mixing_ties_do_not_depend_on_partitions(spark):
    """Texts of one size under null or equal ids: the same texts are taken, however the rows are dealt."""
    rows = [(None if i % 2 else 5, " ".join(passage(i, 12)), "s%d" % (i % 3 // 2)) for i in range(300)]
    docs = table(spark, rows)

    def copies(df):
        return Counter({r.text: r.n for r in mix.mix(df).select("text", F.col("_mix.copies").alias("n")).collect()})

    one = copies(docs.coalesce(1))
    assert one == copies(docs.repartition(7)) == copies(docs.orderBy("text").repartition(3, "text")) and len(set(one.values())) > 1
