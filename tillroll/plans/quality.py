"""Data-quality jobs: detection (C1-C16), exception log (E1-E5), load
assertions (A1-A9).

Detection jobs profile the text staging layer: each is one pass of
aggregates (``count_if`` per condition), with two-level aggregation instead
of COUNT(DISTINCT) where a group key and a distinct key combine.  Lists of
values of one key (variants, states) are rows, not one text.

Text to number / date conversions are ``try_*``: a value that does not parse
is counted (or NULL), never an aborted job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import broadcast_checked, joined_rows
from tillroll.plans.cleaning import (build_dim_customer, build_fact_lines, build_fact_orders,
                                     build_fact_target, collated, star_from_staging)
from tillroll.sources.staging import (RAW_DETAILS_COLUMNS, RAW_ORDERS_COLUMNS, Staging)
from tillroll.sources.tables import MONEY, Star
from tillroll.functions.dates import parse_day_first

# Patterns of a well-formed number in the text files (fixed values).
DECIMAL_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"
INTEGER_TEXT = r"^-?[0-9]+$"


def _n(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def _missing(c: str) -> Column:
    return F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(c)


# ---------------------------------------------------------------- detection

def dq_row_counts(stg: Staging) -> DataFrame:
    """C1 - rows per staging table."""
    return _union([
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in (("raw_orders", stg.raw_orders),
                         ("raw_order_details", stg.raw_order_details),
                         ("raw_sales_target", stg.raw_sales_target))])


def dq_missing_scan(stg: Staging) -> DataFrame:
    """C2 - NULL-or-empty count per column of the two order files (one pass each)."""
    def scan(name, df, cols):
        wide = df.agg(*[_missing(c) for c in cols])
        return (wide.unpivot([], list(cols), "column_name", "missing_rows")
                .select(F.lit(name).alias("table_name"), "column_name", "missing_rows"))
    return scan("raw_orders", stg.raw_orders, RAW_ORDERS_COLUMNS).unionByName(
        scan("raw_order_details", stg.raw_order_details, RAW_DETAILS_COLUMNS))


def dq_pk_unique(stg: Staging) -> DataFrame:
    """C3 - is order_id a key of the order file?"""
    o = stg.raw_orders
    distinct_ids = _n(o.select("order_id").distinct())
    return o.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", distinct_ids.alias("distinct_order_ids"),
        (F.col("total_rows") - distinct_ids).alias("duplicate_order_ids"))


def dq_full_duplicates(stg: Staging) -> DataFrame:
    """C4 - groups of detail rows identical on every column."""
    d = stg.raw_order_details
    dup = d.groupBy(*RAW_DETAILS_COLUMNS).count().filter(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_line_groups"))


def dq_candidate_key(stg: Staging) -> DataFrame:
    """C5 - (order_id, sub_category) pairs that repeat: no natural line key."""
    d = stg.raw_order_details
    dup = d.groupBy("order_id", "sub_category").count().filter(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("repeated_order_subcategory_pairs"))


def dq_referential(stg: Staging) -> DataFrame:
    """C6 - detail lines without a header, headers without lines."""
    # both are counted per order before they meet, once: a hot order is one row a task, and each side is shuffled one time
    o = stg.raw_orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("headers"))
    d = stg.raw_order_details.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    unmatched = lambda n, other: F.coalesce(F.sum(F.when(F.col(other).isNull(), F.col(n))), F.lit(0))
    return o.join(d, "order_id", "full_outer").agg(
        unmatched("lines", "headers").alias("detail_lines_without_header"),
        unmatched("headers", "lines").alias("headers_without_detail_lines"))


def dq_whitespace(stg: Staging) -> DataFrame:
    """C7 - (column, raw value, rows) for values with leading/trailing blanks."""
    def scan(df, cols):
        padded = reduce(lambda a, b: a | b, [F.col(c) != F.trim(F.col(c)) for c in cols])
        long = df.filter(padded).unpivot([], list(cols), "column_name", "raw_value")
        return (long.filter(F.col("raw_value") != F.trim("raw_value"))
                .groupBy("column_name", "raw_value").agg(F.count(F.lit(1)).alias("rows_affected")))
    return scan(stg.raw_orders, ["state", "city", "customer_name"]).unionByName(
        scan(stg.raw_order_details, ["category", "sub_category"]))


def _variants(pairs: DataFrame, key: str, count: str) -> DataFrame:
    """Of distinct (key, value) pairs those whose key has several values: a row a value, with their number.

    A key of any number of values is never gathered into one row; only its number meets its values.
    """
    counts = pairs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)
    return pairs.join(counts, pairs[key].eqNullSafe(counts["_key"])).drop("_key")


def dq_case_variants(stg: Staging, column: str = "state", collation: str | None = None) -> DataFrame:
    """C8 - values that count as equal but are stored in several spellings: a row a spelling.

    Equal after trim and lower, or as a collation has it (accents as well as case).
    """
    if collation is None:
        return _variants(stg.raw_orders.select(F.lower(F.trim(column)).alias("normalised"), F.trim(column).alias("variant")).distinct(),
                         "normalised", "variant_count")
    spelt = stg.raw_orders.select(F.trim(column).alias("variant")).distinct()
    # the first spelling in byte order stands for all
    groups = spelt.groupBy(F.collate("variant", collation).alias("_key")).agg(
        F.min("variant").alias("normalised"), F.count("variant").alias("variant_count")).filter("variant_count > 1")
    return spelt.join(groups, F.collate(spelt.variant, collation) == F.col("_key")).select("normalised", "variant_count", "variant")


def dq_date_format_proof(stg: Staging) -> DataFrame:
    """C9 - unparseable dates and the rows proving the day comes first."""
    o = stg.raw_orders
    d = parse_day_first("order_date")
    first = F.substring_index(F.col("order_date"), "-", 1).try_cast("int")
    return o.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(d.isNull()).alias("unparseable_as_dd_mm_yyyy"),
        F.count_if(first > 12).alias("rows_proving_day_first"),
        F.min(d).alias("earliest_order"), F.max(d).alias("latest_order"))


def dq_numeric_validity(stg: Staging, money: str = MONEY) -> DataFrame:
    """C10 - malformed numbers, non-positive amounts/quantities, losses, zeros."""
    d = stg.raw_order_details
    amount, profit = F.col("amount").try_cast(money), F.col("profit").try_cast(money)
    qty = F.col("quantity").try_cast("bigint")
    return d.agg(
        F.count_if(~F.col("amount").rlike(DECIMAL_TEXT)).alias("non_numeric_amount"),
        F.count_if(~F.col("profit").rlike(DECIMAL_TEXT)).alias("non_numeric_profit"),
        F.count_if(~F.col("quantity").rlike(INTEGER_TEXT)).alias("non_numeric_quantity"),
        F.count_if(amount <= 0).alias("non_positive_amount"),
        F.count_if(qty <= 0).alias("non_positive_quantity"),
        F.count_if(profit < 0).alias("negative_profit_lines"),
        F.count_if(profit == 0).alias("zero_profit_lines"))


def _loss_exceeds_revenue(money: str = MONEY) -> Column:
    return F.abs(F.col("profit").try_cast(money)) > F.col("amount").try_cast(money)


def dq_loss_exceeds_revenue(stg: Staging, money: str = MONEY) -> DataFrame:
    """C11 - lines whose |profit| exceeds the amount."""
    return stg.raw_order_details.agg(
        F.count_if(_loss_exceeds_revenue(money)).alias("loss_exceeds_revenue_lines"))


def dq_city_multi_state(stg: Staging) -> DataFrame:
    """C12 - cities recorded under more than one state: a row a state."""
    pairs = stg.raw_orders.select(F.trim("city").alias("city"), F.trim("state").alias("state")).distinct()
    return _variants(pairs, "city", "state_count")


def dq_identity_ambiguity(stg: Staging) -> DataFrame:
    """C13 - names used at more than one (state, city)."""
    places = stg.raw_orders.select(F.trim("customer_name").alias("nm"),
                                   F.trim("state").alias("s"), F.trim("city").alias("c")).distinct()
    multi = places.groupBy("nm").count().filter(F.col("count") > 1)
    return multi.agg(F.count(F.lit(1)).alias("names_spanning_multiple_locations"))


def dq_target_coverage(stg: Staging) -> DataFrame:
    """C14 - target rows, distinct months, distinct categories."""
    t = stg.raw_sales_target
    months = _n(t.select("month_of_order_date").distinct())
    cats = _n(t.select("category").distinct())
    return t.agg(F.count(F.lit(1)).alias("target_rows")).select(
        "target_rows", months.alias("distinct_months"), cats.alias("distinct_categories"))


def dq_functional_dependency(stg: Staging) -> DataFrame:
    """C15 - does sub_category determine category?"""
    pairs = stg.raw_order_details.select(F.trim("sub_category").alias("s"),
                                         F.trim("category").alias("c")).distinct()
    per_sub = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return per_sub.agg(F.count(F.lit(1)).alias("sub_categories"),
                       F.count_if(F.col("n") > 1).alias("violating_sub_categories"))


def dq_constraints(stg: Staging) -> DataFrame:
    """C16 - NOT NULL and CHECK rules of the model, counted in one pass per table."""
    lines, orders, targets = build_fact_lines(stg), build_fact_orders(stg), build_fact_target(stg)

    def rules(name, df, checks):
        wide = df.agg(*[F.count_if(cond).alias(rule) for rule, cond in checks])
        return (wide.unpivot([], [r for r, _ in checks], "rule", "violations")
                .select(F.lit(name).alias("table_name"), "rule", "violations"))
    c = F.col
    return _union([
        rules("fact_order_lines", lines, [
            ("order_id not null", c("order_id").isNull()),
            ("sub_category not null", c("sub_category").isNull()),
            ("amount not null", c("amount").isNull()),
            ("profit not null", c("profit").isNull()),
            ("quantity not null", c("quantity").isNull()),
            ("amount > 0", c("amount") <= 0),
            ("quantity > 0", c("quantity") <= 0)]),
        rules("fact_orders", orders, [
            ("order_id not null", c("order_id").isNull()),
            ("order_date not null", c("order_date").isNull())]),
        rules("fact_sales_target", targets, [
            ("target_month not null", c("target_month").isNull()),
            ("target_amount not null", c("target_amount").isNull()),
            ("target_amount > 0", c("target_amount") <= 0)]),
    ])


# ------------------------------------------------------------ exception log

def exc_loss_exceeds_revenue(stg: Staging, money: str = MONEY) -> DataFrame:
    """E1 - WARN per line whose loss exceeds its revenue (raw text in detail)."""
    d = stg.raw_order_details.filter(_loss_exceeds_revenue(money))
    return d.select(F.lit("loss_exceeds_revenue").alias("check_name"),
                    F.lit("WARN").alias("severity"), F.lit("order_line").alias("entity_type"),
                    F.col("order_id").alias("entity_key"),
                    F.concat("sub_category", F.lit(": amount "), "amount",
                             F.lit(", profit "), "profit").alias("detail"))


def city_state_rules(stg_or_pairs: DataFrame) -> DataFrame:
    """(city, state) pairs that exist geographically: the reference list."""
    return stg_or_pairs.select(F.trim("city").alias("city"), F.trim("state").alias("state")).distinct()


def impossible_places(orders: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (city, state) of orders, of a known city that is not in that state: judged once a
    pair, so the orders themselves are not shuffled by city."""
    pairs = orders.select("city", "state").distinct()
    return pairs.join(rules.select("city").distinct(), "city", "left_semi").join(rules, ["city", "state"], "left_anti")


def exc_impossible_geo(stg: Staging, rules: DataFrame) -> DataFrame:
    """E2 - ERROR per order whose city is known but recorded in a state the
    city does not belong to.  ``rules`` = (city, state) pairs that exist."""
    o = stg.raw_orders.select("order_id", F.trim("city").alias("city"), F.trim("state").alias("state"))
    bad = o.join(broadcast_checked(impossible_places(o, rules)), ["city", "state"], "left_semi")
    return bad.select(F.lit("impossible_city_state").alias("check_name"),
                      F.lit("ERROR").alias("severity"), F.lit("order").alias("entity_type"),
                      F.col("order_id").alias("entity_key"),
                      F.concat(F.lit("city "), "city", F.lit(" recorded in state "), "state")
                      .alias("detail"))


def exc_shared_geo(stg: Staging, rules: DataFrame) -> DataFrame:
    """E3 - INFO per order placed in a city that legitimately spans states."""
    shared = rules.groupBy("city").count().filter(F.col("count") > 1).select("city")
    o = stg.raw_orders.select("order_id", F.trim("city").alias("city"), F.trim("state").alias("state"))
    return o.join(broadcast_checked(shared), "city", "left_semi").select(
        F.lit("shared_capital_city").alias("check_name"), F.lit("INFO").alias("severity"),
        F.lit("order").alias("entity_type"), F.col("order_id").alias("entity_key"),
        F.concat("city", F.lit(" recorded under "), "state", F.lit(" - both are valid"))
        .alias("detail"))


def exc_untrimmed(stg: Staging) -> DataFrame:
    """E4 - INFO per order whose state carries padding (trimmed on load)."""
    o = stg.raw_orders.filter(F.col("state") != F.trim("state"))
    return o.select(F.lit("untrimmed_state").alias("check_name"), F.lit("INFO").alias("severity"),
                    F.lit("order").alias("entity_type"), F.col("order_id").alias("entity_key"),
                    F.concat(F.lit('state stored as "'), "state", F.lit('" - trimmed on load'))
                    .alias("detail"))


def exception_log(stg: Staging, rules: DataFrame) -> DataFrame:
    """The four feeds, appended into one log."""
    return _union([exc_loss_exceeds_revenue(stg), exc_impossible_geo(stg, rules),
                   exc_shared_geo(stg, rules), exc_untrimmed(stg)])


SEVERITY_ORDER = ("ERROR", "WARN", "INFO")


def exc_breakdown(log: DataFrame) -> DataFrame:
    """E5 - rows per (check, severity), ERROR first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return (log.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("rows_logged"))
            .orderBy(rank, "check_name"))


# ------------------------------------------------------------ assertions

def _verdict(name: str, ok: Column, anchor: DataFrame) -> DataFrame:
    """One (assertion, result) row; ``anchor`` is any table, used for its one-row aggregate."""
    return anchor.agg(F.lit(name).alias("assertion"),
                      F.when(ok, "PASS").otherwise("FAIL").alias("result"))


# Each assertion judges ``model`` - the written model, read back - against staging;
# without one, the projections that the load would write.

def assert_row_counts(stg: Staging, model: Star | None = None) -> DataFrame:
    """A1 - modelled row counts equal staged row counts."""
    model = model or star_from_staging(stg)
    ok = ((_n(model.fact_orders) == _n(stg.raw_orders))
          & (_n(model.fact_order_lines) == _n(stg.raw_order_details))
          & (_n(model.fact_sales_target) == _n(stg.raw_sales_target)))
    return _verdict("row counts preserved", ok, stg.raw_sales_target)


def _preserved(stg: Staging, model: Star | None, name: str, col: str, typ: str) -> DataFrame:
    modelled = (model or star_from_staging(stg)).fact_order_lines.agg(F.sum(col)).scalar()
    staged = stg.raw_order_details.agg(F.sum(F.col(col).try_cast(typ))).scalar()
    return _verdict(name, modelled == staged, stg.raw_sales_target)


def assert_revenue_preserved(stg: Staging, model: Star | None = None) -> DataFrame:
    """A2"""
    return _preserved(stg, model, "revenue preserved", "amount", MONEY)


def assert_profit_preserved(stg: Staging, model: Star | None = None) -> DataFrame:
    """A3"""
    return _preserved(stg, model, "profit preserved", "profit", MONEY)


def assert_quantity_preserved(stg: Staging, model: Star | None = None) -> DataFrame:
    """A4"""
    return _preserved(stg, model, "quantity preserved", "quantity", "int")


def assert_no_fanout(stg: Staging, model: Star | None = None) -> DataFrame:
    """A5 - joining headers to lines neither adds nor loses line rows."""
    model = model or star_from_staging(stg)
    lines = model.fact_order_lines
    return _verdict("no join fan-out on orders", joined_rows(lines, model.fact_orders) == _n(lines), stg.raw_sales_target)


def assert_dates_in_range(stg: Staging, start: str, end: str, model: Star | None = None) -> DataFrame:
    """A6 - every date parsed and inside [start, end]."""
    o = (model or star_from_staging(stg)).fact_orders
    inside = _n(o.filter(F.col("order_date").between(F.lit(start).cast("date"),
                                                     F.lit(end).cast("date"))))
    return _verdict("dates parsed and in range", inside == _n(o), stg.raw_sales_target)


def assert_target_categories(stg: Staging, model: Star | None = None) -> DataFrame:
    """A7 - no target category outside the product dimension (NOT IN, NULL-aware)."""
    model = model or star_from_staging(stg)
    t, d = model.fact_sales_target, model.dim_sub_category.select("category")
    outside = _n(t.filter(F.col("category").isNotNull())
                 .join(d.filter(F.col("category").isNotNull()).distinct(), "category", "left_anti"))
    dim_has_null = _n(d.filter(F.col("category").isNull())) > 0
    return _verdict("target categories match order categories", dim_has_null | (outside == 0),
                    stg.raw_sales_target)


def assert_identity_unique(stg: Staging, model: Star | None = None, collation: str | None = None) -> DataFrame:
    """A8 - one dimension row (and one key) per distinct raw identity, told apart by bytes or by a collation."""
    dim = model.dim_customer if model else build_dim_customer(stg, collation)
    triples = _n(stg.raw_orders.select(*[collated(c, collation) for c in ("customer_name", "state", "city")]).distinct())
    keys = _n(dim.select("customer_id").distinct())
    return _verdict("customer identity is unique per location",
                    (_n(dim) == triples) & (keys == triples), stg.raw_sales_target)


def assert_no_untrimmed(stg: Staging, model: Star | None = None) -> DataFrame:
    """A9 - no padded text left in the customer dimension."""
    dim = (model or star_from_staging(stg)).dim_customer
    padded = _n(dim.filter((F.col("state") != F.trim("state")) | (F.col("city") != F.trim("city"))
                           | (F.col("customer_name") != F.trim("customer_name"))))
    return _verdict("no untrimmed text remains", padded == 0, stg.raw_sales_target)
