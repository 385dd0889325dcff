"""Rows of documents for the tests of the corpus operators."""

from __future__ import annotations

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # names that operators use inside
                       *[T.StructField(n, T.StringType()) for n in ("_d", "_t", "spans", "bucket", "size", "bin", "removed", "score", "cls")]])


def table(spark, rows, schema=SCHEMA):
    """documents with nulls in any column and clashing extra columns."""
    extra = (None,) * (len(schema) - 5)
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *extra) for d, t, s in rows], schema)


def passage(seed, n):
    x, out = seed, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("w" + str((x >> 33) % 5000))
    return out


def edge_rows():
    a, b = passage(1, 120), passage(2, 300)
    return [(1, None, "s0"), (2, "", None), (3, "  \t ", "s1"), (4, " ".join(a), "s0"), (4, " ".join(a), "s0"), (None, " ".join(b), None),
            (5, " ".join(a[:60] + passage(3, 40) + a[60:]), "s1"), (6, "x\n" * 700, "s2"), (7, "la la la " * 200, "s2"),
            (8, " ".join(b[:150]) + "\n" + " ".join(b[150:]) + "\n\n" + " ".join(b[100:200]), "s0"), (9, "one", "s1"), (10, "ONE", None),
            (11, " ".join(passage(4, 20_000)), "s0"), (12, " ".join(b[:290] + ["changed"] + b[291:]), "s1"), (13, "é" * 500 + " " + "é" * 700, "s2"),
            (-7, " ".join(b), "s1"), (9, "another text under the same id", "s3")]
