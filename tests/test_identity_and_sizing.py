"""Identity without a hash, zero divisors, model sizing, a hot order, kept results, skew rules, CSV headers."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_edges import make_star

from tillroll.operators import joins
from tillroll.plans import customers, geo_time, products_targets, sales, validation, views
from tillroll.sources import sinks
from tillroll.sources.staging import ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS, read_text_csv
from tillroll.sources.tables import customer_key, star_from_facts

D = dt.date


def people_star(spark):
    """Customers that differ only in null parts, each with a repeat order."""
    who = [("Ann", "N", "X"), (None, "Ann", "N"), ("Ann", None, "N"), ("Ann", "N", None)]
    orders = [(i * 10 + k, *w, D(2018, 4, 1 + k)) for i, w in enumerate(who) for k in range(2)]
    lines = [(o[0], "Chair", "10.00", "1.00", 1) for o in orders]
    return make_star(spark, who, orders, lines, [("Chair", "Furniture")], [])


def collided(star):
    """Every customer under one key, as after a hash collision."""
    same = F.lit("0").alias("customer_id")
    return replace(star, fact_orders=star.fact_orders.withColumn("customer_id", same),
                   orders_wide=star.orders_wide.withColumn("customer_id", same))


@pytest.mark.parametrize("change", [lambda s: s, collided])
def test_customers_are_told_apart_by_identity(spark, change):
    star = change(people_star(spark))
    assert sales.kpi_summary(star).first()["total_customers"] == 4
    assert sum(r["customers"] for r in geo_time._line_side(star, ["state"]).join(
        views.state_performance(star).select("state", "customers"), "state").collect()) == 3  # null state joins nothing
    assert sum(r["customers"] for r in views.state_performance(star).collect()) == 4
    rows = {r["order_sequence"]: r["orders_at_this_sequence"] for r in customers.order_sequence(star).collect()}
    assert rows == {1: 4, 2: 4}
    assert sum(r["customers"] for r in customers.first_vs_latest(star).collect()) == 4


def test_customer_key_is_null_safe(spark):
    rows = [("a", "b", None), (None, "a", "b"), ("a", None, "b"), ("a", "b", ""), ("ab", "", ""), ("a", "b", "c")]
    df = spark.createDataFrame(rows, "n string, s string, c string").select(customer_key("n", "s", "c").alias("k"))
    assert df.distinct().count() == len(rows)


def test_zero_divisors_yield_null(spark):
    orders = [(1, "Ann", "North", "N1", D(2018, 4, 2)), (2, "Bob", "South", "S1", D(2018, 5, 2))]
    lines = [(1, "Chair", "10.00", "2.00", 0), (1, "Chair", "10.00", "2.00", 4), (2, "Shirt", "0.00", "1.00", 0)]
    star = make_star(spark, [o[1:4] for o in orders], orders, lines, [("Chair", "Furniture"), ("Shirt", "Clothing")],
                     [(D(2018, 4, 1), "Furniture", "0.00")])
    value = {r["sub_category"]: r["avg_unit_price"] for r in sales.subcat_line_value(star).collect()}
    assert value == {"Chair": 2.5, "Shirt": None}  # the mean of the prices there are
    assert {r["sub_category"]: r["margin_pct"] for r in sales.subcat_quadrant(star).collect()}["Shirt"] is None
    assert {r["state"]: r["margin_pct"] for r in geo_time.state_market_class(star).collect()}["South"] is None
    assert products_targets.target_half_trend(star).first()["h1_achievement_pct"] is None
    assert validation.val_margin_ratio(star).first()["result"] in ("PASS", "FAIL")


def test_buckets_follow_the_scan(spark):
    spark.conf.unset("spark.tillroll.model.buckets")
    scan = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey", "l_quantity")
    size = sinks.scan_bytes(scan)
    floor = 2 * spark.sparkContext.defaultParallelism
    assert 0 < size < 10_000_000 and sinks.bucket_count(scan) == floor
    assert sinks.bucket_count(scan, 1) == int(size * sinks.STORED_PER_SCANNED) > 65_536  # no cap
    with pytest.raises(ValueError):
        sinks.bucket_count(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a long"))


def stored(spark, n=4000, hot=0.5):
    orders = [(i, f"C{i % 50}", "S", "X", D(2018, 4, 1) + dt.timedelta(days=i % 300)) for i in range(100)]
    lines = [(0 if i < n * hot else i % 100, "big chair", str(i % 90 + 1), "1", 1) for i in range(n)]
    star = make_star(spark, [("C", "S", "X")], orders, lines, [("big chair", "chair")], [])
    star = replace(star_from_facts(star.orders_wide, star.fact_order_lines))
    return star, sinks.materialize_star(star, sinks.shared_dir(spark, "hot-order"), 4, "t_hot_order")


def test_hot_order(spark):
    """Half of all lines in one order: per-order jobs read one stored row for it."""
    plain, star = stored(spark)
    assert star.order_values.count() == 100
    one, two = (sorted(map(tuple, views.order_summary(s).collect())) for s in (plain, star))
    assert one == two
    assert "fact_order_lines" not in views.order_summary(star)._jdf.queryExecution().executedPlan().toString()


def test_results_are_kept_once(spark, tmp_path):
    _, star = stored(spark, 500)
    first = sorted(map(tuple, views.customer_rfm(star).collect()))
    names = set(star.kept.names)
    customers.revenue_concentration(star).collect(), customers.order_sequence(star).collect()
    base = spark._jvm.org.apache.hadoop.fs.Path(star.kept.path).getParent()
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    count = lambda: len(files.listStatus(base))
    before = count()
    for _ in range(2):
        assert sorted(map(tuple, views.customer_rfm(star).collect())) == first
        customers.revenue_concentration(star).collect(), customers.order_sequence(star).collect()
    assert count() == before and {"customer_metrics", "customer_rfm"} <= names


def test_top_customers_rank_of_ties(spark):
    orders = [(i, f"C{i}", "S", "X", D(2018, 4, 1)) for i in range(30)]
    lines = [(i, "big chair", str(100 + i), str(i // 4), 1) for i in range(30)]
    star = make_star(spark, [o[1:4] for o in orders], orders, lines, [("big chair", "chair")], [])
    got = [(r["customer_name"], r["profit_rank"]) for r in customers.top_customers(star).collect()]
    assert got == [(f"C{i}", 1 + sum(j // 4 > i // 4 for j in range(30))) for i in range(29, 14, -1)]


def test_heavy_keys_follow_the_partitions(spark):
    """A key just under a hundredth of the rows is heavy where a partition holds less than that."""
    big = spark.range(40_000).select(F.when(F.col("id") < 360, 0).otherwise(F.col("id")).alias("k"))
    assert joins.heavy_keys(big, ["k"], 0.01 * 2, 0.9).count() == 0
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert joins.heavy_fraction(spark) == 0.005
        assert [r.k for r in joins.heavy_keys(big, ["k"], joins.heavy_fraction(spark), 0.9).collect()] == [0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repeated_dimension_keys(spark):
    big = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 1)], "k long, v long")
    dim = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "dk long, name string")
    got = joins.skew_split_join(big, dim, ["k"], ["dk"], fraction=0.1, sample=0.99)
    assert got.count() == 201 and "Broadcast" not in got._jdf.queryExecution().logical().toString().split("Join")[0]


def test_csv_header_is_checked(spark):
    path = sinks.shared_dir(spark, "header")
    swapped = ("Order ID", "CustomerName", "Order Date", "State", "City")
    spark.createDataFrame([("1", "Ann", "01-02-2018", "S", "C")], list(swapped)).write.option("header", True).csv(path)
    with pytest.raises(Exception, match="header"):
        read_text_csv(spark, path, ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS).collect()


