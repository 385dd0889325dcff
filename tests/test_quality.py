"""Detection, exception log, cleaning and load assertions on a hand-made
dirty staging fixture (every defect the original data profile describes)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.plans import cleaning, quality
from tillroll.sources import sinks
from tillroll.sources.literal import staging_from_rows
from tillroll.sources.staging import (ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS, read_text_csv)

ORDERS = [
    ("B-1", "01-04-2018", "Ana", "Alba ", "Port Alba"),
    ("B-2", "15-05-2018", "Ana", "Alba ", "Port Alba"),
    ("B-3", "31-02-2018", "Ben", "Corvin", "Corvin"),
    ("B-4", "13-06-2018", "Ben", "Dunmore", "Corvin"),
    ("B-5", "02-07-2018", "Cleo", "Elster", "Twinford"),
    ("B-6", "03-07-2018", "Cleo", "Fennick", "Twinford"),
    ("B-7", "04-07-2018", "Dev", "corvin", "Corvin"),
    ("B-8", "05-07-2018", "Dev", "Corvin", "Corvin"),
    ("B-8", "05-07-2018", "Dev", "Corvin", "Corvin"),
]
DETAILS = [
    ("B-1", "100.00", "-150.00", "2", "Furnishings", "Desks"),
    ("B-1", "50.00", "5.00", "1", "Apparel", "Scarves"),
    ("B-1", "50.00", "5.00", "1", "Apparel", "Scarves"),
    ("B-2", "abc", "0.00", "1", "Gadgets", "Radios"),
    ("B-3", "20.00", "2.00", "x", "Gadgets", "Radios"),
    ("B-9", "10.00", "1.00", "1", "Apparel ", "Scarves"),
    ("B-4", "-5.00", "1.00", "0", "Apparel", "Scarves"),
]
TARGETS = [
    ("Apr-18", "Furnishings", "1000"),
    ("May-18", "Apparel", "500"),
    ("Jan-75", "Apparel", "10"),
    ("Feb-19", "Toys", "30"),
]


@pytest.fixture(scope="module")
def stg(spark):
    return staging_from_rows(spark, ORDERS, DETAILS, TARGETS)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(
        [("Corvin", "Corvin"), ("Twinford", "Elster"), ("Twinford", "Fennick"),
         ("Port Alba", "Alba")], "city string, state string")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_counts_keys_and_duplicates(stg):
    counts = {r.table_name: r.row_count for r in quality.dq_row_counts(stg).collect()}
    assert counts == {"raw_orders": 9, "raw_order_details": 7, "raw_sales_target": 4}
    assert one(quality.dq_pk_unique(stg)) == {
        "total_rows": 9, "distinct_order_ids": 8, "duplicate_order_ids": 1}
    assert one(quality.dq_full_duplicates(stg))["duplicate_line_groups"] == 1
    assert one(quality.dq_candidate_key(stg))["repeated_order_subcategory_pairs"] == 1
    assert one(quality.dq_referential(stg)) == {
        "detail_lines_without_header": 1, "headers_without_detail_lines": 5}


def test_missing_scan_counts_null_and_empty(spark):
    s = staging_from_rows(spark, [("B-1", "", None, "X", "Y")],
                          [("B-1", "1.00", "", "1", "C", "S")], [])
    got = {(r.table_name, r.column_name): r.missing_rows
           for r in quality.dq_missing_scan(s).collect()}
    assert got[("raw_orders", "order_date")] == 1
    assert got[("raw_orders", "customer_name")] == 1
    assert got[("raw_orders", "state")] == 0
    assert got[("raw_order_details", "profit")] == 1
    assert len(got) == 11


def test_text_hygiene(stg):
    ws = {(r.column_name, r.raw_value): r.rows_affected for r in quality.dq_whitespace(stg).collect()}
    assert ws == {("state", "Alba "): 2, ("category", "Apparel "): 1}
    cv = quality.dq_case_variants(stg).collect()
    assert sorted((r.normalised, r.variant_count, r.variant) for r in cv) == [("corvin", 2, "Corvin"), ("corvin", 2, "corvin")]


def test_dates_and_numbers(stg):
    d = one(quality.dq_date_format_proof(stg))
    assert d["total_rows"] == 9 and d["unparseable_as_dd_mm_yyyy"] == 1
    assert d["rows_proving_day_first"] == 3
    assert d["earliest_order"] == dt.date(2018, 4, 1) and d["latest_order"] == dt.date(2018, 7, 5)
    n = one(quality.dq_numeric_validity(stg))
    assert n == {"non_numeric_amount": 1, "non_numeric_profit": 0, "non_numeric_quantity": 1,
                 "non_positive_amount": 1, "non_positive_quantity": 1,
                 "negative_profit_lines": 1, "zero_profit_lines": 1}
    # |profit| > amount also catches the negative-amount line (1.00 > -5.00)
    assert one(quality.dq_loss_exceeds_revenue(stg))["loss_exceeds_revenue_lines"] == 2


def test_geography_identity_targets(stg):
    cities = sorted((r.city, r.state_count, r.state) for r in quality.dq_city_multi_state(stg).collect())
    assert cities == [("Corvin", 3, "Corvin"), ("Corvin", 3, "Dunmore"), ("Corvin", 3, "corvin"),
                      ("Twinford", 2, "Elster"), ("Twinford", 2, "Fennick")]
    assert one(quality.dq_identity_ambiguity(stg))["names_spanning_multiple_locations"] == 3
    assert one(quality.dq_target_coverage(stg)) == {
        "target_rows": 4, "distinct_months": 4, "distinct_categories": 3}
    assert one(quality.dq_functional_dependency(stg)) == {
        "sub_categories": 3, "violating_sub_categories": 0}


def test_exception_log(stg, rules):
    log = quality.exception_log(stg, rules)
    by = {(r.check_name, r.severity): r.rows_logged for r in quality.exc_breakdown(log).collect()}
    assert by == {("impossible_city_state", "ERROR"): 2, ("loss_exceeds_revenue", "WARN"): 2,
                  ("shared_capital_city", "INFO"): 2, ("untrimmed_state", "INFO"): 2}
    order = [r.severity for r in quality.exc_breakdown(log).collect()]
    assert order == ["ERROR", "WARN", "INFO", "INFO"]
    e1 = one(quality.exc_loss_exceeds_revenue(stg).filter(F.col("entity_key") == "B-1"))
    assert e1["detail"] == "Desks: amount 100.00, profit -150.00"
    e4 = quality.exc_untrimmed(stg).collect()[0]
    assert e4.detail == 'state stored as "Alba " - trimmed on load'


def test_cleaning_casts_and_parses(stg):
    lines = cleaning.build_fact_lines(stg)
    assert lines.count() == 7                               # never de-duplicated
    assert lines.filter(F.col("amount").isNull()).count() == 1  # 'abc' -> NULL, not an error
    assert lines.filter(F.col("category").isNotNull() if "category" in lines.columns
                        else F.lit(False)).count() == 0
    t = {r.category: r.target_month for r in cleaning.build_fact_target(stg).collect()}
    assert t["Furnishings"] == dt.date(2018, 4, 1)
    assert t["Toys"] == dt.date(2019, 2, 1)
    months = [r.target_month for r in cleaning.build_fact_target(stg).collect()]
    assert dt.date(1975, 1, 1) in months                    # 70-99 -> 19xx
    dim = cleaning.build_dim_customer(stg)
    assert dim.filter(F.col("state") == "Alba").count() == 1
    orders = cleaning.build_fact_orders(stg)
    assert orders.filter(F.col("order_date").isNull()).count() == 1


def test_constraints(stg):
    v = {(r.table_name, r.rule): r.violations for r in quality.dq_constraints(stg).collect()}
    assert v[("fact_order_lines", "amount not null")] == 1
    assert v[("fact_order_lines", "amount > 0")] == 1
    assert v[("fact_order_lines", "quantity > 0")] == 1
    assert v[("fact_orders", "order_date not null")] == 1


def test_assertions(stg):
    res = {}
    for fn in (quality.assert_row_counts, quality.assert_revenue_preserved,
               quality.assert_quantity_preserved, quality.assert_no_fanout,
               quality.assert_target_categories, quality.assert_identity_unique,
               quality.assert_no_untrimmed):
        r = one(fn(stg))
        res[r["assertion"]] = r["result"]
    assert res["row counts preserved"] == "PASS"
    assert res["revenue preserved"] == "PASS"
    assert res["quantity preserved"] == "PASS"
    assert res["no join fan-out on orders"] == "FAIL"       # orphan line + duplicate header
    assert res["target categories match order categories"] == "FAIL"   # 'Toys'
    assert res["customer identity is unique per location"] == "PASS"
    assert res["no untrimmed text remains"] == "PASS"
    r = one(quality.assert_dates_in_range(stg, "2018-04-01", "2019-03-31"))
    assert r["result"] == "FAIL"                              # one date did not parse


def test_csv_reader_drops_blank_rows(spark, tmp_path):
    path = tmp_path / "orders.csv"
    lines = [",".join(ORDERS_CSV_HEADER)]
    lines += [",".join(r) for r in ORDERS[:3]]
    lines += [",,,,"] * 4
    path.write_text("\r\n".join(lines) + "\r\n")
    df = read_text_csv(spark, str(path), ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS)
    rows = df.collect()
    assert len(rows) == 3
    assert rows[0].state == "Alba "                         # padding preserved, raw stays raw
    assert all(isinstance(v, str) for v in rows[0])


def test_every_variant_is_listed(spark):
    """A key with many spellings or states lists all of them beside their count."""
    from types import SimpleNamespace
    states = ["".join(c.upper() if i >> k & 1 else c for k, c in enumerate("longname")) for i in range(250)]
    stg = SimpleNamespace(raw_orders=spark.createDataFrame([(" Twinford", s) for s in states], "city string, state string"))
    assert sorted(map(tuple, quality.dq_case_variants(stg).select("normalised", "variant_count", "variant").collect())) == [
        ("longname", 250, v) for v in sorted(states)]
    assert sorted(map(tuple, quality.dq_city_multi_state(stg).select("city", "state_count", "state").collect())) == [
        ("Twinford", 250, v) for v in sorted(states)]


def test_comparison_by_bytes_or_by_collation(spark):
    """Case and accents count or not, by parameter; padding never does."""
    orders = [("1", "01-04-2018", "Ana", "Goa", "X"), ("2", "02-04-2018", "ANA ", "Góa", "X"), ("3", "03-04-2018", "Ana", "goa", "x"),
              ("4", "04-04-2018", "Ben", "Goa", "X"), ("5", "05-04-2018", None, "Goa", "X"), ("6", "06-04-2018", "", "GOA", "X")]
    s = staging_from_rows(spark, orders, [], [])
    assert cleaning.build_dim_customer(s).count() == 6
    dim = cleaning.build_dim_customer(s, cleaning.ANY_CASE)
    assert sorted(map(tuple, dim.select("customer_name", "state", "city").collect()), key=str) == sorted(
        [("ANA", "Góa", "X"), ("Ben", "Goa", "X"), (None, "Goa", "X"), ("", "GOA", "X")], key=str)
    linked = cleaning.build_fact_orders(s, cleaning.ANY_CASE).join(dim, "customer_id", "left")
    assert {r.order_id: r.customer_name for r in linked.collect()} == {"1": "ANA", "2": "ANA", "3": "ANA", "4": "Ben", "5": None, "6": ""}
    assert linked.count() == 6
    for collation in (None, cleaning.ANY_CASE):
        assert one(quality.assert_identity_unique(s, collation=collation))["result"] == "PASS"
    # a dimension that tells spellings apart fails the rule that does not
    model = cleaning.star_from_staging(s)
    assert one(quality.assert_identity_unique(s, model))["result"] == "PASS"
    assert one(quality.assert_identity_unique(s, model, cleaning.ANY_CASE))["result"] == "FAIL"
    assert sorted(map(tuple, quality.dq_case_variants(s, "state").select("normalised", "variant_count", "variant").collect())) == [
        ("goa", 3, "GOA"), ("goa", 3, "Goa"), ("goa", 3, "goa")]
    assert sorted(map(tuple, quality.dq_case_variants(s, "state", cleaning.ANY_CASE).select("normalised", "variant_count", "variant").collect())) == [
        ("GOA", 4, "GOA"), ("GOA", 4, "Goa"), ("GOA", 4, "Góa"), ("GOA", 4, "goa")]


def test_a_log_keeps_its_runs_apart(spark, stg, rules):
    """A repeated run replaces its own rows, even by none; other runs stay."""
    log = quality.exception_log(stg, rules)
    path = sinks.shared_dir(spark, "runs")

    def runs():
        return {r.run_id: r["count"] for r in sinks.read_log(spark, path, log.schema).groupBy("run_id").count().collect()}

    n = log.count()
    assert sinks.write_log(log.limit(3), path, "1").count() == 3 and runs() == {"1": 3}
    assert sinks.write_log(log, path, "02").count() == n and runs() == {"1": 3, "02": n}
    assert sinks.write_log(log.limit(1), path, "1").count() == 1 and runs() == {"1": 1, "02": n}
    assert sinks.write_log(log.limit(0), path, "1").count() == 0 and runs() == {"02": n}
    back = sinks.read_log(spark, path, log.schema).drop("run_id")
    assert back.exceptAll(log).count() == 0 and back.columns == log.columns
