"""Exact selection without a sort equals the plain windows."""

from __future__ import annotations

from decimal import Decimal

import pytest
from given_tables import SF_SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_edges import D, make_star

from tillroll.operators.selection import bucket_ends, locate, ntile_column
from tillroll.plans import customers, views
from tillroll.registry import model
from tillroll.sources.tables import build_star

SMALL = {"drawn": 8, "few": 5}  # several rounds


def at(*positions):
    return lambda n, total: [lambda rows, s, p=p: rows >= p for p in positions]


@pytest.fixture(scope="module")
def numbers(spark):
    """Ties, a value that holds two thirds of the rows, nulls in every part of the key."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise((F.col("id") * 7919) % 500).cast("decimal(10,2)").alias("v"),
        F.when(F.col("id") % 97 > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"), (F.col("id") % 11).alias("w"), "id").cache()


def test_places_are_exact(numbers):
    order = ["v", "k", "id"]
    want = numbers.orderBy(*order).collect()
    for options in ({}, SMALL, {"drawn": 64, "few": 100}):
        got = locate(numbers, order, at(1, 2, 777, 1500, 2999, 3000, 3001), **options)
        for p, g in zip((1, 2, 777, 1500, 2999, 3000), got):
            assert (g.row, g.position) == (tuple(want[p - 1][c] for c in order), p)
        assert got[-1] is None


def test_running_sums_reach_their_places(numbers):
    order, rows = ["v", "k", "id"], None
    rows = numbers.orderBy(*order).collect()
    total = sum(r.w for r in rows)
    marks = [Decimal(total) * x / 100 for x in (1, 33, 50, 99)] + [Decimal(total), Decimal(total + 1)]
    got = locate(numbers, order, lambda n, s: [lambda r, run, m=m: run >= m for m in marks], weight="w", **SMALL)
    for m, g in zip(marks, got):
        run, want = 0, None
        for i, r in enumerate(rows):
            run += r.w
            if run >= m:
                want = (i + 1, run)
                break
        assert (g and (g.position, g.total)) == want


def test_equal_rows_and_few_rows(spark):
    same = spark.createDataFrame([(1, "a")] * 40 + [(2, "b")] * 3, "v int, k string")
    got = locate(same, ["v", "k"], at(1, 39, 40, 41, 43), **SMALL)
    assert [(g.row, g.position) for g in got] == [((1, "a"), 1), ((1, "a"), 39), ((1, "a"), 40), ((2, "b"), 41), ((2, "b"), 43)]
    assert locate(same.where("v > 9"), ["v"], at(1)) == [None]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 23, 1000])
def test_ntile_column_equals_the_window(spark, n):
    df = spark.range(n).select(((F.col("id") * 31) % 7).alias("v"), F.col("id").alias("k"))
    for buckets in (2, 5):
        got = df.select("k", ntile_column(df, ["v", "k"], buckets, **SMALL).alias("t"))
        want = df.select("k", F.ntile(buckets).over(Window.orderBy("v", "k")).alias("t"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert bucket_ends(23, 5) == [5, 10, 15, 19]


def test_rfm_scores_without_a_sort(spark):
    star = build_star(spark, SF_SMALL)
    cm, key = views.customer_metrics(star), list(views.CUSTOMER_TIEBREAK)
    want = cm.select(*key, (6 - F.ntile(5).over(Window.orderBy("days_since_last_order", *key))).alias("r"),
                     F.ntile(5).over(Window.orderBy("total_revenue", *key)).alias("m"))
    rfm = views._customer_rfm(model(spark, SF_SMALL), None, 5, views.FREQUENCY_CUTS)
    assert sorted(map(tuple, rfm.select(*key, "r_score", "m_score").collect())) == sorted(map(tuple, want.collect()))
    plan = rfm._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort" not in plan and "Window" not in plan


def test_concentration_edges(spark):
    def shares(*revenue):
        people = [(f"C{i}", "S", "X") for i in range(len(revenue))]
        orders = [(i, *p, D(2018, 4, 1)) for i, p in enumerate(people)]
        star = make_star(spark, people, orders, [(i, "Chair", r, "0", 1) for i, r in enumerate(revenue)], [("Chair", "F")], [])
        return tuple(customers.revenue_concentration(star).first())

    assert shares("499.95", "0.04", "500.01") == (1, 2, 3, 33.3)      # 50.001 %
    assert shares("49.995", "50.005") == (1, 2, 2, 50.0)
    assert shares("4999.49", "5000.51", "0")[0] == 1
    # 49.995 % of all counts as 50, 49.994 % does not
    assert shares("49.995", "20.005", "20", "10")[:2] == (1, 3)
    assert shares("49.994", "20.006", "20", "10")[:2] == (2, 3)
    assert shares("10", "10", "10", "10", "-5")[:2] == (2, 3)          # 28.57, 57.14, 85.71 %
    assert shares("0", "0") == (None, None, 2, None)
    assert shares("5") == (1, 1, 1, 100.0)
