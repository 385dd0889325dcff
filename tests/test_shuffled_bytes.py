"""Steps that the model build, the load and the checks share: what they shuffle and store, with the same rows."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from given_tables import SF_SMALL
from tillroll.operators import joins
from tillroll.plans import audit, quality
from tillroll.sources import sinks
from tillroll.sources.staging import Staging
from tillroll.sources.tables import IDENTITY, build_star, customer_key


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("repeated", [False, True])
def test_a_bounded_dimension_is_broadcast_whole(spark, repeated):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 71).alias("k"), F.col("id").alias("v"))
    dim = spark.range(60).select(F.col("id").alias("dk"), (F.col("id") * 10).cast("string").alias("w"))
    dim = dim.union(dim.where("dk = 5")) if repeated else dim
    whole = joins.skew_split_join(big, dim, ["k"], ["dk"], fraction=0.01, sample=0.5)
    split = joins.skew_split_join(big, dim, ["k"], ["dk"], fraction=0.01, sample=0.5, broadcast_bytes=0)
    assert "Union" not in logical(whole).split("Join")[0] and "strategy=broadcast" in logical(whole)
    assert rows(whole) == rows(split) == rows(big.join(dim, big.k == dim.dk))


def test_the_bound_counts_rows_and_widths(spark):
    df = spark.range(10).select("id", F.col("id").cast("string").alias("t"))  # 28 bytes of values and 16 of fields a row
    assert joins.fits_broadcast(df, 440) and not joins.fits_broadcast(df, 439) and not joins.fits_broadcast(df, 0)


def test_totals_do_not_depend_on_the_size_of_parts(spark, monkeypatch):
    want = audit.source_totals(spark, SF_SMALL)
    assert "l_partkey], [" not in logical(want)
    monkeypatch.setattr(audit, "fits_broadcast", lambda df: False)
    by_part = audit.source_totals(spark, SF_SMALL)
    assert "Aggregate [l_partkey" in logical(by_part)
    assert [str(v) for v in want.first()] == [str(v) for v in by_part.first()]


def test_stored_model_is_keyed_after_its_shuffles(spark):
    lazy = build_star(spark, SF_SMALL)
    assert "customer_id" not in lazy.order_inputs.columns
    path = sinks.shared_dir(spark, "keyed")
    stored = sinks.materialize_star(lazy, path, 4, "t_keyed")
    for df in (stored.orders_wide, stored.dated_orders, stored.dim_customer):
        assert df.where(F.col("customer_id") != customer_key(*IDENTITY)).count() == 0 < df.count()
    assert rows(stored.dim_customer) == rows(lazy.dim_customer.select(*stored.dim_customer.columns))
    assert rows(stored.fact_sales_target) == rows(lazy.fact_sales_target) != []
    for table in (*sinks.BUCKETED, sinks.DATED, "dim_customer", "fact_sales_target"):
        parts = [f for f in glob.glob(f"{path.removeprefix('file:')}/{table}/**/*.parquet", recursive=True)]
        assert parts and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in parts
                          if pq.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}


def staged(spark, orders, lines):
    o = spark.createDataFrame([(i, "01-02-2018", "A", "S", "C") for i in orders],
                              "order_id string, order_date string, customer_name string, state string, city string")
    d = spark.createDataFrame([(i, "1", "1", "1", "c", "s c") for i in lines],
                              "order_id string, amount string, profit string, quantity string, category string, sub_category string")
    return Staging(o, d, spark.createDataFrame([("Feb-18", "c", "1")], "month_of_order_date string, category string, target string"))


@pytest.mark.parametrize("orders, lines, orphans, empty", [
    (["1", "1", "2", None, "4"], ["1"] * 50 + ["3", "3", None, None], 4, 3), ([], ["1", None], 2, 0), (["1", None], [], 0, 2), ([], [], 0, 0)])
def test_both_sides_of_the_reference_meet_once(spark, orders, lines, orphans, empty):
    got = quality.dq_referential(staged(spark, orders, lines))
    assert rows(got) == [(orphans, empty)]
    assert logical(got).count("Join FullOuter") <= 1 and "scalar-subquery" not in logical(got)


@pytest.mark.parametrize("orders, lines, verdict", [
    (["1", "2"], ["1"] * 50 + ["2"], "PASS"), (["1", "1", "2"], ["1"] * 50 + ["2"], "FAIL"), (["1"], ["1", "3"], "FAIL"),
    (["1", None], ["1", None], "FAIL"), ([], [], "PASS")])
def test_fan_out_is_counted_by_order(spark, orders, lines, verdict):
    stg = staged(spark, orders, lines)
    joined = joins.joined_rows(stg.raw_order_details, stg.raw_orders)
    plain = stg.raw_order_details.join(stg.raw_orders, "order_id").count()
    assert spark.range(1).select(joined.alias("n")).first().n == plain
    assert quality.assert_no_fanout(stg).first().result == verdict
