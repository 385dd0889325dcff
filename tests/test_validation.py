"""Every validation check is green on good sides and red on the fault that it looks for; the suite is one query."""

from __future__ import annotations

from dataclasses import replace
from decimal import Decimal

import pytest
from given_tables import SF_SMALL
from pyspark.sql import functions as F
from test_edges import D, make_star

from tillroll.plans import validation
from tillroll.plans.validation import CHECKS, run_checks, sides_of
from tillroll.registry import model, staging
from tillroll.plans import quality
from tillroll.sources.tables import geography_reference

PEOPLE = [(n, s, f"{s}1") for n, s in (("Ann", "North"), ("Bob", "North"), ("Cid", "South"), ("Dee", "South"), ("Eve", "West"))]
ORDERS = [(i, *PEOPLE[i % 5], D(2018 + i // 12, i % 12 + 1, 3)) for i in range(15)]
LINES = [(i, ("Chair", "Shirt")[(i + k) % 2], f"{10 + i}.50", f"{k - i}.25", 1 + k) for i in range(15) for k in range(1 + i % 3)]
SUBCATS = [("Chair", "Furniture"), ("Shirt", "Clothing")]
TARGETS = [(D(2018 + i // 12, i % 12 + 1, 1), c, "10.00") for i in range(15) for c in ("Furniture", "Clothing")]


@pytest.fixture(scope="module")
def good(spark):
    star = make_star(spark, PEOPLE, ORDERS, LINES, SUBCATS, TARGETS)
    stg_rows = [(str(i), "01-04-2018", "Ann", "North ", "N1") for i in range(3)]
    from tillroll.sources.literal import staging_from_rows
    stg = staging_from_rows(spark, stg_rows, [("1", "1.00", "-2.00", "1", "Furniture", "Chair")], [])
    rules = spark.createDataFrame([("N1", "South"), ("S1", "South")], "city string, state string")
    return sides_of(star, stg, rules)


def more(df, c, by, where="true"):
    return df.withColumn(c, F.when(F.expr(where), F.col(c) + F.lit(by)).otherwise(F.col(c)))


def lines(sides, change):
    return replace(sides, star=replace(sides.star, fact_order_lines=change(sides.star.fact_order_lines)))


CENT = Decimal("0.01")
FAULTS = {
    "V1": lambda s: replace(s, products=more(s.products, "revenue", CENT, "sub_category = 'Chair'")),
    "V2": lambda s: replace(s, states=more(s.states, "profit", CENT)),
    "V3": lambda s: replace(s, orders=s.orders.unionByName(s.orders.where("order_id = 3"))),
    "V4": lambda s: replace(s, months=more(s.months, "orders", 1, "month_start = date'2018-03-01'")),
    "V5": lambda s: replace(s, orders=more(s.orders, "order_profit", 5, "order_id = 3")),
    "V6": lambda s: replace(s, months=s.months.where("month_start <> date'2018-05-01'")),
    # the hand's two months are not neighbours in the view: a month stands there twice
    "V7": lambda s: replace(s, months=s.months.withColumn("revenue", F.when(F.expr("month_start = date'2018-08-01'"), F.lit(None)).otherwise(F.col("revenue")))),
    "V8": None,
    "V9": lambda s: replace(s, segments=s.segments.where("customer_name <> 'Ann'")),
    "V10": lambda s: replace(s, segments=more(s.segments, "m_score", 1, "m_score = 5")),
    "V11": lambda s: replace(s, segments=s.segments.withColumn("r_score", 6 - F.col("r_score"))),
    "V12": lambda s: replace(s, targets=s.targets.where("target_month <> date'2018-05-01'")),
    "V13": lambda s: replace(s, targets=more(s.targets, "variance", CENT, "category = 'Furniture' and target_month = date'2018-05-01'")),
    "V14": None,
    "V15": lambda s: replace(s, top=s.top.unionByName(s.top.where("state = 'North'"))),
    "V16": lambda s: lines(s, lambda df: df.where("order_id <> 4")),
    "V17": lambda s: replace(s, exceptions=(s.exceptions[0].limit(3), *s.exceptions[1:])),
}


def results(sides, ids=tuple(CHECKS)):
    return {r.check_id: r.result for r in run_checks(sides, ids).collect()}


def test_all_green(good):
    assert results(good) == dict.fromkeys(CHECKS, "PASS")


@pytest.mark.parametrize("check", [c for c in FAULTS if FAULTS[c]])
def test_check_can_fail(good, check):
    assert results(FAULTS[check](good), (check,)) == {check: "FAIL"}


def test_growth_of_the_first_month_and_shares_can_fail(good, monkeypatch):
    """V8 and V14 judge the checks' own growth and shares: green becomes red where these are computed wrongly."""
    def zero_first(months):
        return real_months(months).withColumn("first_growth", F.coalesce("first_growth", F.lit(0)))

    def of_the_largest(products):
        return real_products(products).withColumn("shares", F.col("shares") - 0.5)

    real_months, real_products = validation.month_side, validation.product_side
    monkeypatch.setattr(validation, "month_side", zero_first)
    monkeypatch.setattr(validation, "product_side", of_the_largest)
    assert results(good, ("V8", "V14")) == {"V8": "FAIL", "V14": "FAIL"}


def test_duplicate_header_and_orphans(good):
    dup = replace(good, star=replace(good.star, fact_orders=good.star.fact_orders.unionByName(good.star.fact_orders.where("order_id = 2"))))
    row = validation.line_side(dup.star).first()
    assert (row.headers, row.orphan_lines, row.empty_orders, row.orders) == (16, 0, 0, 15)
    none = lines(good, lambda df: df.where("false"))
    row = validation.line_side(none.star).first()
    assert row.revenue is None and row.empty_orders == 15 and row.orders == 0
    orphans = replace(good, star=replace(good.star, fact_orders=good.star.fact_orders.where("order_id > 1")))
    assert validation.line_side(orphans.star).first().orphan_lines == 3


def scans(df):
    """Columns of each scan of the initial plan, subqueries included."""
    import re
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    physical = text[text.index("== Physical Plan =="):]
    return re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", physical)


def test_suite_scans_each_side_once(spark):
    star, stg = model(spark, SF_SMALL), staging(spark, SF_SMALL)
    from tillroll.plans import views
    views.customer_rfm(star)  # kept results
    rules = quality.city_state_rules(geography_reference(spark, SF_SMALL))
    found = scans(validation.validation_results(star, stg, rules))
    of_lines = [s for s in found if "amount#" in s and "order_id#" in s]
    assert 1 <= len(of_lines) <= 10, of_lines
    assert len(found) <= 40
