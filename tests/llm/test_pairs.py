"""Operators 1, 3, 6 and 7 against brute force."""

from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from corpus_rows import edge_rows, passage, table
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.llm import decontam, iblt, jaccard, lines


def test_jaccard_table(spark, small):
    rows, sf = small
    assert Counter(map(tuple, jaccard.op6_ngram_jaccard_join(spark, sf).collect())) == Counter(brute.jaccard_components(rows))


def jaccard_rows(df, **more):
    out = jaccard.similarity_components(df, **more).select(C.doc_id_of(), "n_shingles", C.doc_id_of("component").alias("c"))
    return Counter(map(tuple, out.collect()))


def test_jaccard_edges(edges, nothing):
    assert jaccard_rows(edges, flush=1) == Counter(brute.jaccard_components([(d, t) for d, t, _ in edge_rows()]))
    assert jaccard.similarity_components(nothing).count() == 0


def test_jaccard_at_the_threshold(spark):
    """Families around 0.75 in all sizes, chains, and sets so small that neighbourhoods and empty subsets decide."""
    rng, rows = np.random.default_rng(5), []
    for family in range(60):
        base = passage(family + 10, int(rng.integers(1, 140)))
        for _ in range(int(rng.integers(1, 6))):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(text) // 25 + 1)))):
                at = int(rng.integers(0, len(text)))
                text[at:at + 1] = [["z%d" % rng.integers(99)], [], ["y", "q"]][int(rng.integers(3))]
                text = text or ["z"]
            rows.append((len(rows), " ".join(text)))
    want = Counter(brute.jaccard_components(rows))
    assert sum(1 for d, _, c in want if d != c) > 40
    assert jaccard_rows(table(spark, [(d, t, "s") for d, t in rows])) == want


def test_allocation():
    chosen, deleted, empty = jaccard.choose(np.array([5, 1, 3]), 2, np.ones(3, bool), 4)
    assert chosen.tolist() == [True, False, True] and not deleted.any() and empty == 0
    chosen, deleted, empty = jaccard.choose(np.array([5, 1, 3]), 5, np.array([True, False, True]), 4)
    assert chosen.all() and deleted.tolist() == [True, False, True] and empty == 0
    assert jaccard.choose(np.array([5]), 4, np.array([True]), 4)[2] == 2
    with pytest.raises(ValueError):
        jaccard.choose(np.array([5]), 4, np.array([True]), 1)


def test_decontamination(spark, small, edges, nothing):
    rows, sf = small
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, decontam.op7_benchmark_decontamination(spark, sf).collect())) == Counter(brute.contamination(rows, items))
    items = [(1, " ".join(passage(1, 30))), (1, "one"), (None, "la la"), (2, None), (3, ""), (3, " ".join(passage(2, 13)))]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found(docs, bench):
        out = decontam.contamination(docs, bench)
        return Counter(map(tuple, out.select(C.doc_id_of(), "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()))

    assert found(edges, bench) == Counter(brute.contamination([(d, t) for d, t, _ in edge_rows()], items))
    assert decontam.contamination(nothing, bench).count() == 0
    assert decontam.contamination(edges, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    # a benchmark in several blocks finds the same
    index = decontam.build_index(edges)
    one, many = (decontam.search(index, bench, block_bytes=n).orderBy("_d", "_t").collect() for n in (1 << 20, 1))
    assert one == many


def test_query_blocks(spark):
    """A long item in many blocks, one window in two items, windows that repeat in an item."""
    words = passage(31, 60)
    texts = [(i, " ".join(passage(50 + i, 30) + words[a:b] + passage(80 + i, 9))) for i, (a, b) in enumerate([(0, 60), (0, 13), (5, 17), (40, 60), (20, 46)])]
    items = [("a", " ".join(words * 2)), ("b", " ".join(words[:20])), ("c", " ".join(words[41:44])), ("d", ""), (None, " ".join(words[20:33]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = Counter(brute.contamination(texts, [(i or "", t) for i, t in items]))
    docs = table(spark, [(d, t, "s") for d, t in texts])
    for bench_, size in ((bench, decontam.QUERY_BYTES), (bench, 120), (bench.repartition(4), 80)):
        blocks = decontam.query_blocks(bench_, block_bytes=size)
        assert size > 120 or blocks.count() > 4
        index = decontam.build_index(docs)
        hits = {r["_d"]: r for r in decontam.search(index, bench_, block_bytes=size).collect()}
        assert {d: ",".join(r["items"]) for d, r in hits.items()} == decontaminated_items(texts, items)
    out = decontam.contamination(docs, bench)
    assert Counter(map(tuple, out.select(C.doc_id_of(), "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect())) == want


def decontaminated_items(texts, items):
    """Ids of the items with a window in each document, by plain search."""
    out = {}
    for d, t in texts:
        own = [i or "" for i, x in items for n in [min(13, len(x.split()))] if n
               and any(" " + " ".join(x.split()[k:k + n]) + " " in f" {t} " for k in range(len(x.split()) - n + 1))]
        if own:
            out[d] = ",".join(sorted(own))
    return out


def test_proximity(spark):
    docs = table(spark, [(1, "alpha x beta y gamma", "s"), (2, "alpha x x x x x beta gamma", "s"), (3, "gamma beta alpha", "s")])
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    index = decontam.build_index(docs)
    assert {r["_d"] for r in decontam.search(index, bench, slop=2).collect()} == {1, 3}
    assert decontam.search(index, bench).count() == 0


def paragraphs(text):
    import re
    return set(re.findall(iblt.PARAGRAPH, text or ""))


def test_fingerprints(spark, small, nothing, edges):
    rows, sf = small
    rows = sorted(rows)
    got = {r["doc_id"]: r for r in iblt.op3_iblt_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[:len(t) - h] + after[:h]
        r, a = got[d], paragraphs(t)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), brute.sha(edited))
        for b, near in ((paragraphs(edited), r["near_edited"]), (paragraphs(after), r["near_next"])):
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert iblt.compare_edits(nothing).count() == 0
    rows = sorted(((d is not None, d or 0, t or "") for d, t, _ in edge_rows()))
    want = Counter(brute.sha(t[:len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][2][:len(t) // 2]) for i, (_, _, t) in enumerate(rows))
    assert Counter(r[0] for r in iblt.compare_edits(edges).select("edited_sha256").collect()) == want


def pieces(text):
    """Lines cut after [.!?] and spaces, and after 24 words: written without the pattern of the operator."""
    out = set()
    for line in text.split("\n"):
        held = []
        for word in filter(None, line.split(" ")):
            held.append(word)
            if word[-1] in ".!?" or len(held) == 24:
                out.add(" ".join(held))
                held = []
        out |= {" ".join(held)} - {""}
    return out


def test_half_a_text_is_seen(spark):
    """Short texts of one line whose second half is replaced share their first sentences, with or without sentence ends."""
    rows = [(i, " ".join(w + "." * (k % 9 == 8 and i % 2) for k, w in enumerate(passage(60 + i, 60 + i)))) for i in range(8)]
    rows.append((8, "Short one. Is it? Yes! " + "x" * 30))
    got = {r["doc_id"]: r for r in iblt.compare_edits(table(spark, [(d, t, "s") for d, t in rows])).collect()}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        a, b = pieces(t), pieces(t[:len(t) - len(t) // 2] + after[:len(t) // 2])
        assert got[d]["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and got[d]["near_edited"] > 0
        assert got[d]["near_next"] == pytest.approx(len(a & pieces(after)) / len(a | pieces(after)))


def test_ranges_do_not_matter(spark, monkeypatch):
    docs = table(spark, [(i * i, f"text {i}. of {i}", "s") for i in range(60)])
    want = sorted(map(tuple, iblt.with_successor(docs).collect()))
    monkeypatch.setattr(iblt, "RANGE_BYTES", 200)
    assert sorted(map(tuple, iblt.with_successor(docs).collect())) == want
    assert len(want) == 60 and want[-1][3] == "text 0. of 0"


def test_peeling_recovers_digests(spark):
    df = spark.range(40).select(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: F.xxhash64(x, F.col("id"))).alias("a"))
    df = df.withColumn("b", F.concat(F.slice("a", 4, 300), F.transform(F.sequence(F.lit(1), F.lit(2)), lambda x: F.xxhash64(x, F.lit("new"), F.size("a")))))
    out = df.select("a", "b", iblt.peel(iblt.subtract(iblt.sketch(F.col("a"), 8), iblt.sketch(F.col("b"), 8)), 8).alias("d")).collect()
    solved = [r for r in out if r["d"] is not None]
    assert len(solved) > 30
    for r in solved:
        assert set(r["d"]["plus"]) == set(r["a"]) - set(r["b"]) and set(r["d"]["minus"]) == set(r["b"]) - set(r["a"])


def normal(line):
    plain = bytes(np.where(lines.NORMAL == 0x0A, 0x20, lines.NORMAL).astype(np.uint8))
    return b" ".join(line.encode().translate(plain).split()).decode() or line.strip()


def line_dedup(rows):
    """Brute force: all pairs of different lines whose edit similarity is high."""
    at = {}
    order = sorted(range(len(rows)), key=lambda i: (brute.LOWEST if rows[i][0] is None else rows[i][0]))
    for i in order:
        for k, line in enumerate((rows[i][1] or "").split("\n")):
            if line.strip(" \t\n\r\v\f"):
                at.setdefault(normal(line), []).append((i, k))
    up = {x: x for x in at}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(at)
    for i, x in enumerate(names):
        for y in names[:i]:
            if brute.levenshtein(x, y) <= int(max(len(x), len(y)) * (1 - lines.SIMILARITY) + 1e-9):
                up[top(x)] = top(y)
    groups = {}
    for x, places in at.items():
        groups.setdefault(top(x), []).extend(places)
    rank = {i: n for n, i in enumerate(order)}
    gone = set()
    for places in groups.values():
        keep = min(places, key=lambda p: (rank[p[0]], p[1]))
        gone |= {p for p in places if p != keep and (rows[p[0]], p[1]) != (rows[keep[0]], keep[1])}
    return Counter((d, len((t or "").split("\n")), sum((i, k) in gone for k in range(len((t or "").split("\n")))),
                    brute.sha("\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone))) for i, (d, t) in enumerate(rows))


def test_line_dedup(spark, nothing):
    rng = np.random.default_rng(3)
    texts = [" ".join(passage(i, 40)) for i in range(12)] + ["", "  ", "%%% 123", "%%% 123", "Of.", "of 7"]
    rows = []
    for d in range(40):
        doc = []
        for _ in range(int(rng.integers(1, 8))):
            words = texts[int(rng.integers(len(texts)))].split(" ")
            if len(words) > 5 and rng.random() < 0.6:
                words[int(rng.integers(len(words)))] = "changed"
            doc.append(" ".join(words))
        rows.append((d, "\n".join(doc)))
    rows += [(None, "A first line of null"), (50, "a FIRST line of null!"), (51, None), (51, "x y z"), (51, "x y z")]
    got = lines.line_dedup(table(spark, [(d, t, "s") for d, t in rows])).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == line_dedup(rows)
    assert lines.line_dedup(nothing).count() == 0


def test_near_blocks():
    """Hashes within three bits, of lengths that allow similarity, meet in a pair of blocks; others do not."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    words = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ (np.uint64(1) << np.uint64(40))]))
    sig = np.arange(len(words), dtype=np.uint64) << np.uint64(8) | np.uint64(100)
    back, found = dict(zip(sig.tolist(), words.tolist())), set()
    batch = pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(words.view(np.int64)), pa.array([bytes(4 * lines.BANDS)] * len(sig))],
                                       names=["sig", "words", "bands"])
    keys = pa.Table.from_batches(list(lines._block_keys(1)([batch])))
    blocks = keys.filter(pc.less(keys["pair"], len(lines.PAIRS)))
    out = lines._near_groups(lines.DISTANCE, lines.reach(0.9))(blocks)
    for x, y in zip(out["sig"].to_pylist(), out["near"].to_pylist()):
        assert (back[x] ^ back[y]).bit_count() <= lines.NEAR
        found.add(frozenset((back[x], back[y])))
    assert all(any((a ^ b).bit_count() <= 3 for a in back.values() if a != b and frozenset((a, b)) in found) for b in back.values())
    near, _ = lines.nearest(np.zeros(2, np.uint64), np.array([10, 40], np.uint64), 25, lines.reach(0.9))
    assert not near.any()


def test_groups_beyond_wide(monkeypatch):
    """Groups of more than WIDE rows stay whole, in smaller ones only rows with a near partner."""
    rng = np.random.default_rng(2)
    sig = np.sort(rng.integers(0, 1 << 55, 200, np.uint64) << np.uint64(8))
    sig[50] = sig[49] ^ np.uint64(1 << 9)
    group = np.zeros(200, np.uint64)
    near, best = lines.nearest(group, sig, 3, 4)
    assert near.sum() == 2 and near[[49, 50]].all() and best[50] == 49
    monkeypatch.setattr(lines, "WIDE", 100)
    near, best = lines.nearest(group, sig, 3, 4)
    assert near.all() and best[50] == 49


def test_edit_distance():
    """The bounded check equals the distance, at, below and above the bound."""
    rng = np.random.default_rng(5)
    for _ in range(1500):
        x = "".join(rng.choice(list("abc é"), int(rng.integers(0, 70))))
        y = list(x)
        for _ in range(int(rng.integers(0, 9))):
            at, kind = int(rng.integers(len(y) + 1)), int(rng.integers(3))
            y[at:at + (kind > 0)] = rng.choice(list("abc é"), int(kind < 2)).tolist()
        y = "".join(y)
        d = brute.levenshtein(x, y)
        for most in {0, d // 2, max(d - 1, 0), d, d + 1}:
            assert lines.within(x, y, most) == (d <= most), (x, y, most)


def test_line_dedup_without_filter(spark):
    """Short lines with a changed word: every pair that is similar enough is linked, however far its SimHashes are."""
    rng, letters = np.random.default_rng(8), str.maketrans("0123456789", "abcdefghij")
    texts = []
    for i in range(40):
        words = [w.translate(letters) for w in passage(200 + i, int(rng.integers(8, 30)))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            other[int(rng.integers(len(other)))] = "z" * int(rng.integers(1, 6))
            texts.append(" ".join(other))
    texts = [texts[i] for i in rng.permutation(len(texts))]
    links = [(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts[:i])
             if abs(len(x) - len(y)) <= 6 and x != y and brute.levenshtein(x, y) <= int(max(len(x), len(y)) * (1 - lines.SIMILARITY) + 1e-9)]
    raw = np.frombuffer("\n".join(texts).encode(), np.uint8)
    sig = [int(x) for x in lines.hashed_lines(raw, np.array([0, len(raw)]))[3][:, 1]]
    assert sum((sig[i] ^ sig[j]).bit_count() > lines.NEAR for i, j in links) > 60
    up = list(range(len(texts)))
    for _ in texts:
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
    first = {}
    want = {i for i, x in enumerate(texts) if first.setdefault(x if up[i] == i else texts[up[i]], i) == i}
    got = lines.line_dedup(table(spark, [(i, x, "s") for i, x in enumerate(texts)]))
    assert {r["doc_id"] for r in got.where("n_removed = 0").collect()} == want
