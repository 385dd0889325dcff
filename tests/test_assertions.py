"""Every load assertion is green on the loaded model and red on a model with the fault that it looks for."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.plans import cleaning, quality
from tillroll.sources import sinks
from tillroll.sources.staging import Staging, text_schema, RAW_DETAILS_COLUMNS, RAW_ORDERS_COLUMNS, RAW_TARGET_COLUMNS

PERIOD = ("2018-04-01", "2019-03-31")


@pytest.fixture(scope="module")
def loaded(spark):
    def text(rows, names):
        return spark.createDataFrame(rows, text_schema(names))
    stg = Staging(text([("1", "01-04-2018", "Ann", "North ", "N1"), ("2", "05-06-2018", "Bob", "South", "S1")], RAW_ORDERS_COLUMNS),
                  text([("1", "10.50", "1.00", "2", "Furniture", "Chair"), ("2", "20", "-1", "1", "Clothing", "Shirt")], RAW_DETAILS_COLUMNS),
                  text([("Apr-18", "Furniture", "9.00")], RAW_TARGET_COLUMNS))
    path = sinks.shared_dir(spark, "assertions")
    sinks.write_model(cleaning.star_from_staging(stg), path)
    return stg, sinks.read_model(spark, path)


def more(col, value):
    return lambda star: replace(star, fact_order_lines=star.fact_order_lines.withColumn(col, (F.col(col) + value).cast(star.fact_order_lines.schema[col].dataType)))


def twice(table):
    return lambda star: replace(star, **{table: getattr(star, table).unionByName(getattr(star, table))})


FAULTS = {
    "assert_row_counts": lambda s: replace(s, fact_orders=s.fact_orders.limit(1)),
    "assert_revenue_preserved": more("amount", Decimal("0.01")),
    "assert_profit_preserved": more("profit", Decimal("0.01")),
    "assert_quantity_preserved": more("quantity", 1),
    "assert_no_fanout": twice("fact_orders"),
    "assert_dates_in_range": lambda s: replace(s, fact_orders=s.fact_orders.withColumn("order_date", F.lit(dt.date(2030, 1, 1)))),
    "assert_target_categories": lambda s: replace(s, fact_sales_target=s.fact_sales_target.withColumn("category", F.lit("Toys"))),
    "assert_identity_unique": twice("dim_customer"),
    "assert_no_untrimmed": lambda s: replace(s, dim_customer=s.dim_customer.withColumn("city", F.concat(F.lit(" "), "city"))),
}


@pytest.mark.parametrize("name", FAULTS)
def test_assertion_can_fail(loaded, name):
    stg, model = loaded
    args = PERIOD if name == "assert_dates_in_range" else ()
    judge = getattr(quality, name)
    assert judge(stg, *args, model=model).first()["result"] == "PASS"
    assert judge(stg, *args, model=FAULTS[name](model)).first()["result"] == "FAIL"


def test_unparsed_text_fails_the_sums(spark, loaded):
    """Text that is no number becomes NULL on loading; the staged sum of what does parse differs from a sum with it."""
    stg, model = loaded
    bad = replace(stg, raw_order_details=stg.raw_order_details.unionByName(
        spark.createDataFrame([("2", "12.x", "1", "1", "Clothing", "Shirt")], text_schema(RAW_DETAILS_COLUMNS))))
    assert quality.dq_numeric_validity(bad).first()["non_numeric_amount"] == 1
    assert quality.assert_row_counts(bad, model=model).first()["result"] == "FAIL"
