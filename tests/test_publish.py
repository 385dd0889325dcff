"""Write, audit, publish; rejects and quarantine; malformed lines; reuse of a published model."""

from __future__ import annotations

import datetime as dt
import os
import threading
from dataclasses import replace
from decimal import Decimal

import pytest
from given_tables import SF_SMALL
from pyspark.sql import functions as F

from tillroll.plans import audit, cleaning, geo_time, sales
from tillroll.registry import PERIOD_END, PERIOD_START, present
from tillroll.sources import files, publish, sinks
from tillroll.sources.literal import staging_from_rows
from tillroll.sources.staging import ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS, read_csv_lines
from tillroll.sources.tables import build_star

PERIOD = ("2018-04-01", "2019-03-31")
ORDERS = [("1", "01-04-2018", "Ann", "North ", "N1"), ("2", "05-06-2018", "Bob", "South", "S1"), ("3", "07-06-2018", "Bob", "South", "S1")]
LINES = [("1", "10.50", "1.00", "2", "Furniture", "Chair"), ("2", "20", "-1", "1", "Clothing", "Shirt"), ("3", "5", "0", "1", "Clothing", "Shirt")]
TARGETS = [("Apr-18", "Furniture", "9.00"), ("May-18", "Clothing", "3")]


def store_of(spark, name="store"):
    return publish.ModelStore(spark, sinks.shared_dir(spark, name))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def everything(spark, store):
    return rows(sinks.model_rows(sinks.read_loaded(spark, store.current()).star))


def versions(spark, store):
    return set(files.children(spark, f"{store.path}/versions"))


def test_load_publishes_and_replaces(spark):
    store = store_of(spark)
    assert store.current() is None
    first = sinks.load_staged(store, staging_from_rows(spark, ORDERS[:2], LINES[:2], TARGETS[:1]), *PERIOD)
    assert first.number == 1 and first.tables["fact_orders"]["rows"] == 2 and {v["result"] for v in first.verdicts} == {"PASS"}
    before = everything(spark, store)
    second = sinks.load_staged(store, staging_from_rows(spark, ORDERS, LINES, TARGETS), *PERIOD)
    assert second.number == 2 and second.version != first.version
    assert len(everything(spark, store)) > len(before)
    # the version before can still be read, until two more are published
    assert rows(sinks.model_rows(sinks.read_loaded(spark, store.manifest(1)).star)) == before
    for _ in range(2):
        sinks.load_staged(store, staging_from_rows(spark, ORDERS, LINES, TARGETS), *PERIOD)
    assert store.published() == [3, 4] and versions(spark, store) == {store.manifest(n).version for n in (3, 4)}


def test_a_failing_table_leaves_the_old_model_whole(spark, monkeypatch):
    store = store_of(spark)
    sinks.load_staged(store, staging_from_rows(spark, ORDERS[:2], LINES[:2], TARGETS[:1]), *PERIOD)
    before, kept = everything(spark, store), versions(spark, store)
    real = cleaning.build_fact_orders

    def broken(stg):
        # the third table's tasks die while two tables of the new version are already written
        return real(stg).withColumn("order_date", F.when(F.col("order_id") == "3", F.raise_error(F.lit("disk is gone")).cast("date"))
                                    .otherwise(F.col("order_date")))

    monkeypatch.setattr(cleaning, "build_fact_orders", broken)
    with pytest.raises(Exception, match="disk is gone"):
        sinks.load_staged(store, staging_from_rows(spark, ORDERS, LINES, TARGETS), *PERIOD)
    assert everything(spark, store) == before and store.published() == [1] and versions(spark, store) == kept


@pytest.mark.parametrize(("orders", "lines", "targets", "assertion"), [
    ([*ORDERS, ORDERS[0]], LINES, TARGETS, audit.FANOUT),
    ([("1", "01-04-2031", "Ann", "North", "N1"), *ORDERS[1:]], LINES, TARGETS, audit.DATES),
    (ORDERS, LINES, [*TARGETS, ("Apr-18", "Toys", "1")], audit.CATEGORIES),
    (ORDERS, [*LINES, ("9", "1", "1", "1", "Clothing", "Shirt")], TARGETS, audit.FANOUT),
])
def test_a_failed_assertion_is_not_published(spark, orders, lines, targets, assertion):
    store = store_of(spark)
    sinks.load_staged(store, staging_from_rows(spark, ORDERS, LINES, TARGETS), *PERIOD)
    before = everything(spark, store)
    with pytest.raises(publish.LoadRejected) as e:
        sinks.load_staged(store, staging_from_rows(spark, orders, lines, targets), *PERIOD)
    assert [v["assertion"] for v in e.value.verdicts if v["result"] == "FAIL"] == [assertion]
    assert everything(spark, store) == before and store.published() == [1]


def test_two_loads_at_a_time_conflict(spark):
    store = store_of(spark)
    tables = {"t": {"path": f"{store.folder('a')}/t"}}
    store.commit("a", tables, [], {}, 0)
    with pytest.raises(files.Conflict):
        store.commit("b", tables, [], {}, 0)
    assert store.current().version == "a"
    # many at once: one gets each number, and a manifest is never seen in part
    won, lock = [], threading.Lock()

    def publish_one(i):
        try:
            m = store.commit(f"v{i}", tables, [{"assertion": "x" * 2000, "result": "PASS"}], {}, 1)
            with lock:
                won.append(m.version)
        except files.Conflict:
            pass

    threads = [threading.Thread(target=publish_one, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.current().version in won and store.published() == [1, 2]
    assert not [n for n in os.listdir(store.path.removeprefix("file:") + "/manifests") if n.startswith(".") and not n.endswith(".crc")]


# ---- the analysis model

def test_published_model_is_reused_until_its_inputs_change(spark, monkeypatch):
    path = sinks.shared_dir(spark, "models")
    star, first = sinks.published_model(spark, SF_SMALL, PERIOD_START, PERIOD_END, path)
    want = rows(present(sales.category_scorecard(star)))
    assert {v["result"] for v in first.verdicts} == {"PASS"} and len(first.verdicts) == 9
    growth = rows(present(geo_time.monthly_growth(star)))

    def never(*a):
        raise AssertionError("built again")

    # a later application knows the folder alone, not the tables of this one's catalog
    for t in spark.catalog.listTables():
        if first.version.replace("-", "_") in t.name:
            spark.sql(f"DROP TABLE {t.name}")
    with monkeypatch.context() as m:
        m.setattr(sinks, "build_star", never)
        again, second = sinks.published_model(spark, SF_SMALL, PERIOD_START, PERIOD_END, path)
        assert second == first
        assert rows(present(sales.category_scorecard(again))) == want and rows(present(geo_time.monthly_growth(again))) == growth
        plan = again.fact_order_lines.groupBy("order_id").agg(F.sum("amount"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan  # still bucketed
    # other inputs, another period or other code: a new load
    with monkeypatch.context() as m:
        m.setattr(publish, "code_state", lambda: "other")
        assert publish.ModelStore(spark, path).current_for(first.inputs) is None
    assert publish.ModelStore(spark, path).current_for(first.inputs | {"x": "y"}) is None
    _, third = sinks.published_model(spark, SF_SMALL, PERIOD_START, "2003-03-31", path)
    assert third.number == 2


def test_applications_that_build_at_a_time_agree(spark, monkeypatch):
    """The slower one takes the faster one's model; a manifest whose tables are gone counts for nothing."""
    path = sinks.shared_dir(spark, "models")
    real, tries = publish.ModelStore.commit, []

    def late(self, version, tables, verdicts, inputs, after):
        tries.append(version)
        if len(tries) == 1:  # someone else has published the same number meanwhile, and removed it again
            real(self, "rival", tables, verdicts, inputs, after)
        elif len(tries) == 2:  # and now for good
            sinks.published_model(spark, SF_SMALL, PERIOD_START, PERIOD_END, path)
        return real(self, version, tables, verdicts, inputs, after)

    monkeypatch.setattr(publish.ModelStore, "commit", late)
    star, m = sinks.published_model(spark, SF_SMALL, PERIOD_START, PERIOD_END, path)
    assert len(tries) == 3 and m.version == tries[2] and m.number == 2
    assert star.fact_orders.count() == m.tables["fact_orders"]["rows"]
    assert set(files.children(spark, f"{path}/versions")) == {tries[2]}


def test_state_of_inputs_changes_with_the_files(spark):
    path = sinks.shared_dir(spark, "inputs")
    spark.range(5).write.parquet(path)
    one = files.state_of(spark, [path])
    assert files.state_of(spark, [path]) == one
    spark.range(1).write.mode("append").parquet(path)
    assert files.state_of(spark, [path]) != one


MODEL_FAULTS = {
    audit.ROW_COUNTS: lambda s: replace(s, fact_orders=s.fact_orders.where("order_id <> 1")),
    audit.REVENUE: lambda s: replace(s, fact_order_lines=s.fact_order_lines.withColumn("amount", F.col("amount") + F.lit(Decimal("0.0001")))),
    audit.PROFIT: lambda s: replace(s, fact_order_lines=s.fact_order_lines.withColumn("profit", -F.col("profit"))),
    audit.QUANTITY: lambda s: replace(s, fact_order_lines=s.fact_order_lines.withColumn("quantity", F.col("quantity") + 1)),
    audit.FANOUT: lambda s: replace(s, fact_orders=s.fact_orders.unionByName(s.fact_orders.where("order_id = 1"))),
    audit.DATES: lambda s: replace(s, fact_orders=s.fact_orders.withColumn("order_date", F.when(F.col("order_id") != 1, F.col("order_date")))),
    audit.CATEGORIES: lambda s: replace(s, fact_sales_target=s.fact_sales_target.withColumn("category", F.lit("toys"))),
    audit.IDENTITY: lambda s: replace(s, dim_customer=s.dim_customer.withColumn("customer_id", F.lit("one"))),
    audit.UNTRIMMED: lambda s: replace(s, dim_customer=s.dim_customer.withColumn("state", F.concat("state", F.lit(" ")))),
}


@pytest.fixture(scope="module")
def lazy_star(spark):
    return build_star(spark, SF_SMALL)


@pytest.mark.parametrize("name", [None, *MODEL_FAULTS])
def test_every_assertion_on_the_analysis_model_can_fail(spark, lazy_star, name):
    model = MODEL_FAULTS[name](lazy_star) if name else lazy_star
    got = {r.assertion: r.result for r in audit.audit_model(audit.source_totals(spark, SF_SMALL), model, PERIOD_START, PERIOD_END).collect()}
    failed = {a for a, r in got.items() if r == "FAIL"}
    assert len(got) == 9 and (name in failed if name else not failed), got
    if name in (audit.REVENUE, audit.PROFIT, audit.QUANTITY, audit.DATES, audit.CATEGORIES, audit.IDENTITY, audit.UNTRIMMED):
        assert failed == {name}


def test_audit_of_nothing(spark):
    empty = staging_from_rows(spark, [], [], [])
    got = audit.audit_model(audit.staged_totals(empty), cleaning.star_from_staging(empty), *PERIOD).collect()
    assert {r.result for r in got} == {"PASS"}


# ---- rejects

def test_rejected_rows_are_counted_and_listed(spark):
    orders = [*ORDERS, ("4", "31-02-2018", "Cid", "West", "W1"), (None, "01-05-2018", "Cid", "West", "W1"), ("5", None, "", None, "W1")]
    lines = [*LINES, ("4", "1", "1", "1", "Clothing", "Shirt"), ("1", "abc", "1", "x", "Clothing", "Shirt"), ("2", "1", None, "1", "Clothing", "Shirt"),
             ("5", "", "1", "1", "Clothing", " "), (" ", "1", "1", "1.5", "Clothing", "Shirt")]
    targets = [*TARGETS, ("Foo-18", "Furniture", "1"), ("Apr-18", None, "n/a")]
    store = store_of(spark)
    m = sinks.load_staged(store, staging_from_rows(spark, orders, lines, targets), *PERIOD)
    load = sinks.read_loaded(spark, m)
    assert rows(load.quarantine) == sorted([
        ("raw_orders", "4", "order_date is no date", "4|31-02-2018|Cid|West|W1"),
        ("raw_orders", None, "order_id is missing", "\\N|01-05-2018|Cid|West|W1"),
        ("raw_orders", "5", "order_date is no date", "5|\\N||\\N|W1"),
        ("raw_order_details", "4", "its order is rejected", "4|1|1|1|Clothing|Shirt"),
        ("raw_order_details", "1", "amount is no number; quantity is no whole number", "1|abc|1|x|Clothing|Shirt"),
        ("raw_order_details", "2", "profit is no number", "2|1|\\N|1|Clothing|Shirt"),
        ("raw_order_details", "5", "sub_category is missing; amount is no number; its order is rejected", "5||1|1|Clothing| "),
        ("raw_order_details", " ", "order_id is missing; quantity is no whole number", " |1|1|1.5|Clothing|Shirt"),
        ("raw_sales_target", "Foo-18 Furniture", "month_of_order_date is no month", "Foo-18|Furniture|1"),
        ("raw_sales_target", "Apr-18", "category is missing; target is no number", "Apr-18|\\N|n/a")], key=str)
    assert dict(((r.table_name, r.reason), r.rejected_rows) for r in cleaning.reject_counts(load.quarantine).collect())[
        "raw_order_details", "quantity is no whole number"] == 2
    # the load's own writes counted the same
    seen = {f: m.tables[f]["observed"] for f in ("fact_orders", "fact_order_lines", "fact_sales_target")}
    assert seen == {"fact_orders": {"rows": 6, "rejected": 3}, "fact_order_lines": {"rows": 8, "rejected": 5}, "fact_sales_target": {"rows": 4, "rejected": 2}}
    assert m.tables["load_quarantine"]["rows"] == 10 and m.tables["fact_order_lines"]["rows"] == 3
    assert {v["assertion"]: v["result"] for v in m.verdicts}[sinks.EVERY_ROW] == "PASS"


def test_clean_load_has_an_empty_quarantine(spark):
    m = sinks.load_staged(store_of(spark), staging_from_rows(spark, ORDERS, LINES, TARGETS), *PERIOD)
    assert m.tables["load_quarantine"]["rows"] == 0
    star = sinks.read_loaded(spark, m).star
    assert [r.order_date for r in star.fact_orders.orderBy("order_id").collect()] == [dt.date(2018, 4, 1), dt.date(2018, 6, 5), dt.date(2018, 6, 7)]


# ---- malformed lines

def test_malformed_lines_are_listed(spark):
    path = sinks.shared_dir(spark, "broken")
    head = ",".join(ORDERS_CSV_HEADER)
    lines = [head, "1,01-04-2018,Ann,North ,N1", "2,05-06-2018,Bob", "3,07-06-2018,Bob,South,S1,extra,more", ",,,,", '4,07-06-2018,"",South,', "5"]
    spark.createDataFrame([("\r\n".join(lines),)], "value string").coalesce(1).write.text(path)
    good, bad = read_csv_lines(spark, path, ORDERS_CSV_HEADER, RAW_ORDERS_COLUMNS)
    assert rows(good) == [("1", "01-04-2018", "Ann", "North ", "N1"), ("4", "07-06-2018", "", "South", None)]
    assert [r.line for r in bad.collect()] == [lines[2], lines[3], lines[6]]
    # any selection of columns sees the same rows
    assert good.select("state").count() == good.count() == 2 and bad.count() == 3
    with pytest.raises(Exception):
        read_csv_lines(spark, path, ORDERS_CSV_HEADER[::-1], RAW_ORDERS_COLUMNS)[0].collect()
