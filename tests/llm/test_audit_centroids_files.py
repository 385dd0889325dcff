"""Operators 11, 12 and 13."""

import hashlib
import itertools
import zlib
from collections import Counter
from math import floor, inf, nan

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from corpus_rows import SF, edge_rows, passage, table
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import audit, binary, centroids
from tillroll.llm import common as C
from tillroll.session import shared_path


def from_sql(sql, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    r = con.execute(sql)
    return [d[0] for d in r.description], sorted(r.fetchall())


def rows_of(df, names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- 11 ---------------------------------------------------------------------------

def audited(rows, good, toxic):
    """rows: (doc_id, text, source). {(part, order, step): counts} by applying every order to every document."""
    least = {}
    for d, t, _ in rows:
        t, d = t or "", brute.LOWEST if d is None else d
        least[t] = min(least.get(t, d), d)
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = brute.WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": (brute.LOWEST if d is None else d) > least[t]}
        docs.append((s or "", {x for x, f in fails.items() if f}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for i, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                out[part, order, i + 1] = [len(left), len(gone), sum(x in d[1] for d in mine) - len(gone), sum(d[1] == {x} for d in mine),
                                           sum(d[2] for d in gone), sum(d[3] for d in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


def counts(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_audit_on_the_table(spark):
    names, want = from_sql(audit.ORACLE_SQL, "documents", "labels")
    got = audit.op11_filter_audit(spark, SF)
    assert rows_of(got, names) == want
    assert dict(got.dtypes)["step"] == "int" and len(want) % 600 == 0


def test_audit_on_edges(spark, edges, nothing):
    rows = [*edge_rows(), (40, "A B C # " * 30, "s0"), (41, "A B C # " * 30, None), (41, "A B C # " * 30, None), (None, "A B C # " * 30, "s4")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (40, 1, None), (None, 1, 1), (41, None, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    filters = audit.contract_filters()
    got = audit.order_steps(audit.mask_cells(docs, labels, filters), list("ABCDE"))
    assert counts(got) == audited(rows, {4, 40, 5}, {4, 41})
    assert audit.order_steps(audit.mask_cells(nothing, labels, filters), list("ABCDE")).count() == 0
    none = labels.where("doc_id < 0")
    assert counts(audit.order_steps(audit.mask_cells(docs, none, filters), list("ABCDE"))) == audited(rows, set(), set())


def test_audit_takes_other_filters_and_many_parts(spark):
    """Three own filters, no duplicate filter; more prefix rows than a recursive query returns by default."""
    n = 70_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id")).alias("source"),
                                 F.when(F.col("id") % 3 == 0, "x y").otherwise("y").alias("text"))
    filters = {"X": F.col("text").contains("x"), "Y": F.col("text").contains("y"), "Z": F.lit(False)}
    cells = audit.mask_cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters, None)
    steps = audit.prefix_steps(cells, ["X", "Y", "Z"])
    got = steps.agg(F.count("*").alias("n"), F.sum("removed").alias("removed")).first()
    assert got.n == 15 * n  # 3 + 6 + 6 prefixes
    # a text of both goes at X, Y, ZX and ZY; one of y alone wherever a prefix ends with Y
    third = -(-n // 3)
    assert got.removed == 4 * third + 5 * (n - third)


# ---- 12 ---------------------------------------------------------------------------

def clustered(vectors, k=16, rounds=3):
    """vectors: (vec_id, whole components). [(vec_id, cluster, distance, cluster_inertia, inertia, sha)] by plain rescans."""
    def far(x, c):
        return sum((a - b) ** 2 for a, b in zip(x, c))

    first = sorted(vectors, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centroids_ = [x for _, x in first[:k]]
    for r in range(rounds + 1):
        home = [min(range(len(centroids_)), key=lambda j: (far(x, centroids_[j]), j)) for _, x in vectors]
        if r < rounds:
            for j in range(len(centroids_)):
                mine = [x for (_, x), h in zip(vectors, home) if h == j]
                if mine:
                    centroids_[j] = [sum(c) // len(mine) for c in zip(*mine)]
    d = [far(x, centroids_[h]) for (_, x), h in zip(vectors, home)]
    own = Counter()
    for h, e in zip(home, d):
        own[h] += e

    def fits(v):
        return v if v < 1 << 63 else None

    return [(v, h, fits(e), fits(own[h]), fits(sum(d)), hashlib.sha256(",".join(map(str, centroids_[h])).encode()).hexdigest())
            for (v, _), h, e in zip(vectors, home, d)]


EMBEDDINGS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           *[T.StructField(n, T.StringType()) for n in ("x", "cluster", "n", "round", "sums")]])


def embedding_rows(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.normal(size=64) * spread + rng.integers(0, 3)).tolist()) for i in range(n)]


def some_vectors(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], EMBEDDINGS)


def shown(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_centroids_on_the_table(spark):
    names, want = from_sql(centroids.ORACLE_SQL, "embeddings")
    assert rows_of(centroids.op12_centroid_clusters(spark, SF), names) == want


def test_centroids_on_edges(spark):
    v = embedding_rows(3, 60)
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 65), (103, [None] + [1.0] * 63), (104, [nan] + [1.0] * 63), (105, [inf] + [1.0] * 63),
           (106, [1e40] + [1.0] * 63)]
    # repeated rows, an id with two vectors, a null id, ties, -0.0
    rows = [*v, *v[:5], (3, [0.5] * 64), (None, [0.25] * 64), (200, [-0.0] * 64), (201, [0.0] * 64), *[(300 + i, [0.75] * 64) for i in range(40)]]
    want = clustered([(i, [floor(64 * e) for e in x]) for i, x in rows])
    assert shown(centroids.clusters_with_inertia(some_vectors(spark, rows + bad))) == sorted(want, key=str)
    assert centroids.clusters_with_inertia(some_vectors(spark, bad)).count() == 0
    few = rows[:3]
    assert shown(centroids.clusters_with_inertia(some_vectors(spark, few))) == sorted(clustered([(i, [floor(64 * e) for e in x]) for i, x in few]), key=str)


def test_centroids_of_large_components(spark):
    """Distances beyond doubles are exact, those beyond a long null."""
    rows = [(i, [x * 2.0 ** 33 for x in v]) for i, v in embedding_rows(5, 30)] + [(99, [1e25] + [0.0] * 63), (98, [1e25] * 64), (97, [2e25] * 64)]
    want = clustered([(i, [floor(64 * e) for e in x]) for i, x in rows])
    assert shown(centroids.clusters_with_inertia(some_vectors(spark, rows))) == sorted(want, key=str)


def test_bounds_skip_rows_and_never_wrongly():
    """Loosened bounds keep only rows whose nearest centroid a rescan confirms; the norm of the sum keeps more than the sum of norms."""
    rng = np.random.default_rng(7)
    x = rng.integers(-60, 60, (3000, 64)).astype(float)
    x[:1500] = x[:3].repeat(500, 0) + rng.integers(-2, 3, (1500, 64))
    history = [[r.astype(int).tolist() for r in x[::500]]]
    cluster, upper, lower = centroids.evaluate(x, history[0])
    there, summed = np.zeros(3000, int), None
    for r in range(3):  # centroids go there and back: all in all they hardly move
        step = rng.integers(-3, 4, 64) if r != 1 else -moved_by
        moved_by = step
        history.append([[a + int(b) for a, b in zip(c, step)] for c in history[-1]])
        moved = centroids.drift(history)
        one = centroids.drift(history[-2:])[0]
        summed = one if summed is None else summed + one
        redo = centroids.failures(cluster, upper, lower, there, moved)
        again = centroids.failures(cluster, upper, lower, there, np.array([summed]))
        keep = np.setdiff1d(np.arange(3000), redo)
        assert (np.argmin(centroids.squared(x[keep], history[-1]), 1) == cluster[keep]).all()
        assert len(redo) <= len(again)
    assert len(redo) <= 1500 and len(redo) < len(again)


# ---- 13 ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(binary.vocabulary_bytes())


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (1, 2 ** 64 - 1), (5, 3), (3000, 10 ** 6), (3000, 100), (2000, 2 ** 63), (1024, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    data = binary.EliasFano.of(v).to_bytes()
    e = binary.EliasFano.from_bytes(b"xx" + data, 2)
    assert (e.decode(0, n) == v).all()
    for a, b in np.sort(rng.integers(0, n + 1, (100, 2)), 1):
        assert (e.decode(int(a), int(b)) == v[a:b]).all()
    for i in rng.integers(0, max(n, 1), 50 if n else 0):
        assert e.select(int(i)) == int(v[i]) and e.rank(int(v[i])) == int(np.searchsorted(v, v[i]))
    # two bits and the logarithm of the mean gap, samples and header besides
    assert len(data) * 8 <= n * (3 + np.log2(max(1, top / max(n, 1)))) + 32 * (n // binary.SAMPLE + 1) + 8 * 24 + 16


def test_encoder_equals_the_tokenizer(tokenizer):
    bits = ["a", "B", "word", "'s", "don't", " ", " ", "  ", "\n", "\t", " ", "　", "é", "1", "23", "!", "$%", "<|endoftext|>", "中", "́", "😀",
            "\x1c", "\x85", "​", "_", " x", " y", " z", "\r\n", "\x00"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(6000)] + ["", " ", "a", "<|endoftext|>", "x" * 50_000, "é " * 20_000]
    encoder = binary.Encoder(binary.vocabulary_bytes(), most=3000)  # forgets now and then
    for i in range(0, len(texts), 701):
        part = texts[i:i + 701]
        ids, lengths = encoder(pa.array(part), 0)
        want = [t.ids + [0] for t in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def expected_files(tokenizer, rows):
    out, at = [], 0
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_of_the_table(spark, small, tokenizer):
    rows, sf = small
    assert sorted(map(tuple, binary.op13_token_files(spark, sf).collect())) == expected_files(tokenizer, sorted(rows))


def test_token_files_on_edges(spark, edges, nothing, tokenizer):
    """Null ids first, equal ids and equal rows in any order among themselves."""
    got = sorted(map(tuple, binary.read_token_files(binary.write_token_files(edges, shared_path(spark, "edges"), file_bytes=1000)).collect()),
                 key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: C.NULL_ID if i is None else i)
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:])) and got[0][1] == 0
    want = expected_files(tokenizer, [(d, t) for d, t, _ in edge_rows()])
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in want)
    assert binary.read_token_files(binary.write_token_files(nothing, shared_path(spark, "edges"))).count() == 0


def test_repeated_rows_fill_several_files(spark):
    docs = table(spark, [(1, " ".join(passage(1, 30)), "s")] * 400).repartition(4)
    files = binary.write_token_files(docs, shared_path(spark, "hot"))
    assert files.where("n_docs > 0").count() > 1 and files.agg(F.sum("n_docs")).first()[0] == 400


def test_random_access_and_damage(spark, tokenizer):
    """A document or an id's document without reading the rest; a cut file is refused."""
    docs = table(spark, [(None, "first of all", "s"), (-5, "second text here", "s"), (7, "", "s"), (1 << 62, " ".join(passage(2, 900)), "s")])
    files = binary.write_token_files(docs.coalesce(1), shared_path(spark, "access"), file_bytes=1 << 40).orderBy("shard").collect()
    seen = []
    for f in files:
        fs, name = binary._file_system(f.path)
        with fs.open_input_file(name) as file:
            r = binary.Reader(file)
            assert (r.n_docs, r.n_ids) == (f.n_docs, f.n_ids)
            for i in range(r.n_docs):
                seen.append((int(r.doc_ids(i, i + 1)[0]), tokenizer.decode(r.document(i)[:-1].tolist())))
                a, b = r.bounds(i, i + 1)
                assert r.document_at(int(a)) == r.document_at(int(b) - 1) == i
            data = file.read_at(file.size(), 0)
        with pytest.raises(Exception):
            binary.Reader(pa.BufferReader(data[:-9]))
    assert seen == [(C.NULL_ID, "first of all"), (-5, "second text here"), (7, ""), (1 << 62, " ".join(passage(2, 900)))]
