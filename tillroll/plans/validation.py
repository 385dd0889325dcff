"""Validation suite (V1-V19): every headline figure recomputed a second way.

Where the original compares with a literal of its one dataset (500 orders, 401
customers, a 5.55 % margin, 63 exceptions, a hand-typed MoM value) the check
here compares with an independent recomputation from another grain, so it
stays meaningful on any data.

Every side of the checks is evaluated once, to a row of figures: the line side from the line
fact alone (added up by order, beside the headers: its totals, distinct orders,
orphans and empty orders come from one scan), and each view as the questions
use it.  A check is an expression over these rows (``CHECKS``), so the whole suite is one
query with one scalar subquery a side, and one check on its own evaluates only
the sides that it names.  Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.measures import avg2, per, ratio_pct
from tillroll.plans import cleaning, quality
from tillroll.plans.customers import top3_per_state
from tillroll.plans.views import (customer_metrics, customer_rfm, monthly_sales, order_summary,
                                  sales_vs_target, state_performance, sub_category_performance)
from tillroll.sources.staging import Staging
from tillroll.sources.tables import Star

#: Position of the month whose growth V7 recomputes; rows that V15 allows a state (fixed values of the original).
HAND_MONTH, TOP_K = 8, 3


# ---------------------------------------------------------------- the sides, one row each

def line_side(star: Star) -> DataFrame:
    """Line totals and both directions of the order link, from one scan of the lines."""
    ratio = F.try_divide(F.lit(100.0) * F.col("profit").cast("double"), F.col("amount").cast("double"))
    lines = star.fact_order_lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("a"), F.sum("profit").alias("p"),
        F.sum(ratio).alias("r"), F.count(ratio).alias("rn"))
    headers = star.fact_orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("h"))
    return lines.join(headers, "order_id", "full").agg(
        F.sum("a").alias("revenue"), F.sum("p").alias("profit"), F.count("n").alias("orders"),
        F.round(F.try_divide(F.sum("r"), F.sum("rn")), 2).alias("naive_margin"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("headers"),
        F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("n"))), F.lit(0)).alias("orphan_lines"),
        F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("h"))), F.lit(0)).alias("empty_orders"))


def order_side(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("n"), F.sum("order_revenue").alias("revenue"), F.sum("order_profit").alias("profit"),
                      avg2("order_revenue").alias("aov"))


def customer_side(customers: DataFrame, people: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("revenue"), F.sum("total_profit").alias("profit"),
                         people.agg(F.count(F.lit(1))).scalar().alias("people"))


def state_side(states: DataFrame) -> DataFrame:
    return states.agg(F.sum("orders").alias("orders"), F.sum("customers").alias("customers"), F.sum("revenue").alias("revenue"),
                      F.sum("profit").alias("profit"))


def month_side(months: DataFrame) -> DataFrame:
    """Totals, the running total's end, growth by LAG, and the two months that V7 computes from by hand."""
    by_month = Window.orderBy("month_start")  # one row a month
    prev = F.lag("revenue").over(by_month)
    m = months.select("month_label", "orders", "revenue", F.row_number().over(by_month).alias("rn"), (F.col("revenue") - prev).alias("growth"),
                      ratio_pct(F.col("revenue") - prev, prev).alias("mom"),
                      F.sum("revenue").over(by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"))

    def at(position: int, c: str) -> Column:
        return F.max(F.when(F.col("rn") == position, F.col(c)))

    return m.agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"), F.max("running").alias("closing"),
                 at(HAND_MONTH, "revenue").alias("hand_revenue"), at(HAND_MONTH - 1, "revenue").alias("hand_before"),
                 at(HAND_MONTH, "mom").alias("hand_mom"), at(1, "growth").alias("first_growth"), at(1, "month_label").alias("first_label"))


def product_side(products: DataFrame) -> DataFrame:
    total = F.sum(F.sum("revenue")).over(Window.partitionBy()).cast("double")
    share = products.groupBy("category", "sub_category").agg(F.sum("revenue").alias("revenue"), F.try_divide(
        F.lit(100.0) * F.sum("revenue").cast("double"), total).alias("share"))
    return share.agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.round(F.sum("share"), 2).alias("shares"))


def segment_side(rfm: DataFrame) -> DataFrame:
    outside = reduce(lambda a, b: a | b, [~F.col(c).between(1, 5) for c in ("r_score", "f_score", "m_score")])
    days = lambda score: avg2(F.when(F.col("r_score") == score, F.col("days_since_last_order")), 0)
    return rfm.agg(F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("revenue"), F.count_if(F.col("rfm_segment").isNull()).alias("none"),
                   F.size(F.collect_set("rfm_segment")).alias("segments"), F.count_if(outside).alias("outside"),
                   days(5).alias("days_best"), days(1).alias("days_worst"))


def target_side(grid: DataFrame) -> DataFrame:
    wrong = F.col("variance") != F.col("actual_revenue") - F.col("target_amount")
    return grid.agg(F.count(F.lit(1)).alias("n"), F.sum("actual_revenue").alias("revenue"), F.count_if(wrong).alias("wrong"))


def top_side(top: DataFrame) -> DataFrame:
    return top.groupBy("state").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("states"))


def exception_side(log: DataFrame, stg: Staging, rules: DataFrame) -> DataFrame:
    """The log's rows and checks, and the flagged rows counted another way than the log is built: losses by arithmetic
    on the modelled numbers, places from orders grouped by place, padding by length."""
    logged = log.groupBy("check_name").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("checks"))
    lines = cleaning.build_fact_lines(stg)
    loss = lines.agg(F.count_if((F.col("amount") + F.col("profit") < 0) | (F.col("profit") > F.col("amount")))).scalar()
    place = [F.trim(c).alias(c) for c in ("city", "state")]
    places = stg.raw_orders.select(*place, (F.length("state") > F.length(F.trim("state"))).alias("padded")).groupBy("city", "state").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("padded").alias("padded"))
    valid = rules.groupBy("city").agg(F.collect_set("state").alias("states"))
    flagged = F.col("padded") + F.when(F.col("states").isNotNull(), F.col("n") * (
        (~F.array_contains("states", F.col("state"))).cast("int") + (F.size("states") > 1).cast("int"))).otherwise(F.lit(0))
    found = places.join(valid, "city", "left").agg(F.coalesce(F.sum(flagged), F.lit(0))).scalar()
    return logged.select("n", "checks", (loss + found).alias("expected"))


@dataclass(frozen=True)
class Sides:
    """What the checks compare: the star's lines and each view, replaceable one by one."""

    star: Star
    orders: DataFrame
    customers: DataFrame
    states: DataFrame
    months: DataFrame
    products: DataFrame
    segments: DataFrame
    targets: DataFrame
    top: DataFrame
    exceptions: tuple[DataFrame, Staging, DataFrame] | None = None  # log, staging, place rules

    def rows(self) -> dict[str, Callable[[], DataFrame]]:
        return {"lines": lambda: line_side(self.star), "orders": lambda: order_side(self.orders),
                "customers": lambda: customer_side(self.customers, self.star.dim_customer), "states": lambda: state_side(self.states),
                "months": lambda: month_side(self.months), "products": lambda: product_side(self.products),
                "segments": lambda: segment_side(self.segments), "targets": lambda: target_side(self.targets), "top": lambda: top_side(self.top),
                "exceptions": lambda: exception_side(*self.exceptions)}


def sides_of(star: Star, stg: Staging | None = None, rules: DataFrame | None = None) -> Sides:
    return Sides(star, order_summary(star), customer_metrics(star), state_performance(star), monthly_sales(star), sub_category_performance(star),
                 customer_rfm(star), sales_vs_target(star), top3_per_state(star, TOP_K),
                 None if stg is None else (quality.exception_log(stg, rules), stg, rules))


# ---------------------------------------------------------------- the checks

def _txt(c: Column) -> Column:
    return c.cast("string")


def _dec2(c: Column) -> Column:
    """A rounded double as text with two decimals."""
    return c.cast("decimal(38,2)").cast("string")


def _equal(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in zip(values, values[1:])])


@dataclass(frozen=True)
class Check:
    name: str
    sides: tuple[str, ...]
    verdict: Callable[..., tuple[Column, Column]]  # (ok, detail) from the sides' rows


def _revenue(lines, orders, customers, states, months, products):
    line = lines["revenue"]
    return (_equal(line, orders["revenue"], customers["revenue"], states["revenue"], months["revenue"], products["revenue"]),
            F.concat(F.lit("all grains = "), _txt(line)))


def _profit(lines, orders, customers, states):
    line = lines["profit"]
    return _equal(line, orders["profit"], customers["profit"], states["profit"]), F.concat(F.lit("all grains = "), _txt(line))


def _aov(lines, orders):
    ratio = per(lines["revenue"], lines["orders"])
    return orders["aov"] == ratio, F.concat(F.lit("avg method = "), _txt(orders["aov"]), F.lit(", ratio method = "), _txt(ratio))


def _counts(lines, orders, customers, states, months):
    n, people = lines["headers"], customers["people"]
    return (_equal(orders["n"], n, states["orders"], months["orders"]) & _equal(customers["n"], people, states["customers"]),
            F.concat(_txt(n), F.lit(" orders / "), _txt(people), F.lit(" customers at every grain")))


def _margin(lines, orders):
    correct = ratio_pct(lines["profit"], lines["revenue"])
    return (correct == ratio_pct(orders["profit"], orders["revenue"]),
            F.concat(F.lit("correct = "), _dec2(correct), F.lit("%, naive row-average = "), _dec2(lines["naive_margin"]), F.lit("%")))


def _running(lines, months):
    return months["closing"] == lines["revenue"], F.lit("final cumulative row = total revenue")


def _hand(months):
    hand = ratio_pct(months["hand_revenue"] - months["hand_before"], months["hand_before"])
    return hand == months["hand_mom"], F.concat(F.lit("hand = "), _dec2(hand), F.lit("%, query = "), _dec2(months["hand_mom"]), F.lit("%"))


def _first(months):
    return months["first_growth"].isNull(), F.concat(months["first_label"], F.lit(" has no prior month"))


def _partition(lines, customers, segments):
    ok = (segments["n"] == customers["n"]) & (segments["revenue"] == lines["revenue"]) & (segments["none"] == 0)
    return ok, F.concat(_txt(segments["segments"]), F.lit(" segments covering "), _txt(customers["n"]), F.lit(" customers, no NULLs"))


def _recency(segments):
    best, worst = segments["days_best"], segments["days_worst"]
    return best < worst, F.concat(F.lit("avg days: score5 = "), _txt(best), F.lit(", score1 = "), _txt(worst))


def _grid(lines, targets):
    return (targets["revenue"] == lines["revenue"],
            F.concat(F.lit("grid = "), _txt(targets["revenue"]), F.lit(", total = "), _txt(lines["revenue"])))


def _links(lines):
    return ((lines["empty_orders"] == 0) & (lines["orphan_lines"] == 0),
            F.concat(_txt(lines["orphan_lines"]), F.lit(" orphan lines, "), _txt(lines["empty_orders"]), F.lit(" empty orders")))


def _exceptions(exceptions):
    return (exceptions["n"] == exceptions["expected"],
            F.concat(_txt(exceptions["n"]), F.lit(" rows across "), _txt(exceptions["checks"]), F.lit(" checks")))


CHECKS: dict[str, Check] = {
    "V1": Check("Revenue identical at all six grains", ("lines", "orders", "customers", "states", "months", "products"), _revenue),
    "V2": Check("Profit identical at all grains", ("lines", "orders", "customers", "states"), _profit),
    "V3": Check("AOV consistent across two methods", ("lines", "orders"), _aov),
    "V4": Check("Order/customer counts not inflated by join", ("lines", "orders", "customers", "states", "months"), _counts),
    "V5": Check("Margin uses ratio of totals, not mean of ratios", ("lines", "orders"), _margin),
    "V6": Check("Cumulative revenue closes on grand total", ("lines", "months"), _running),
    "V7": Check("MoM growth matches hand calculation", ("months",), _hand),
    "V8": Check("First month MoM growth is NULL, not zero", ("months",), _first),
    "V9": Check("RFM segments partition the customer base", ("lines", "customers", "segments"), _partition),
    "V10": Check("RFM scores within 1-5", ("segments",), lambda segments: (segments["outside"] == 0, F.lit("r, f and m all in [1,5]"))),
    "V11": Check("Recency inverted correctly (recent = high score)", ("segments",), _recency),
    "V12": Check("Target grid accounts for all revenue", ("lines", "targets"), _grid),
    "V13": Check("Variance = actual - target on every row", ("targets",), lambda targets: (
        targets["wrong"] == 0, F.concat(F.lit("checked across all "), _txt(targets["n"]), F.lit(" cells")))),
    "V14": Check("Revenue shares sum to 100%", ("products",), lambda products: (
        products["shares"] == 100.0, F.concat(_txt(products["n"]), F.lit(" sub-categories")))),
    "V15": Check(f"Top-{TOP_K}-per-state returns at most {TOP_K} per state", ("top",), lambda top: (
        top["most"] <= TOP_K, F.concat(F.lit("across all "), _txt(top["states"]), F.lit(" states")))),
    "V16": Check("Referential integrity holds both directions", ("lines",), _links),
    "V17": Check("Data-quality exceptions captured", ("exceptions",), _exceptions),
}


def run_checks(sides: Sides, ids=tuple(CHECKS)) -> DataFrame:
    """(check_id, check_name, result, detail) of the named checks, in run order: one query, each side once."""
    needed = dict.fromkeys(s for i in ids for s in CHECKS[i].sides)
    build = sides.rows()
    # every side is one row: a struct that the checks read fields of
    one = {name: build[name]() for name in needed}
    first, *others = needed
    facts = one[first].select(F.struct("*").alias(first), *[one[n].select(F.struct("*")).scalar().alias(n) for n in others])

    def row(check_id: str) -> Column:
        check = CHECKS[check_id]
        ok, detail = check.verdict(*[F.col(s) for s in check.sides])
        return F.struct(F.lit(check_id).alias("check_id"), F.lit(check.name).alias("check_name"),
                        F.when(ok, "PASS").otherwise("FAIL").alias("result"), detail.alias("detail"))

    return facts.select(F.inline(F.array(*[row(i) for i in ids])))


def one_check(check_id: str) -> Callable[..., DataFrame]:
    def run(star: Star, stg: Staging | None = None, rules: DataFrame | None = None) -> DataFrame:
        return run_checks(sides_of(star, stg, rules), (check_id,))
    run.__doc__ = f"{check_id} - {CHECKS[check_id].name}."
    return run


val_revenue_grains, val_profit_grains, val_aov_two_ways, val_counts = map(one_check, ("V1", "V2", "V3", "V4"))
val_margin_ratio, val_running_total, val_mom_hand, val_first_mom_null = map(one_check, ("V5", "V6", "V7", "V8"))
val_rfm_partition, val_rfm_range, val_recency_direction, val_target_grid_total = map(one_check, ("V9", "V10", "V11", "V12"))
val_variance_rows, val_shares_sum, val_topn_bound, val_referential = map(one_check, ("V13", "V14", "V15", "V16"))
val_exception_count = one_check("V17")


def validation_results(star: Star, stg: Staging, rules: DataFrame) -> DataFrame:
    """V19 - every check row, in run order."""
    return run_checks(sides_of(star, stg, rules)).orderBy(F.substring("check_id", 2, 3).cast("int"))


def validation_verdict(results: DataFrame) -> DataFrame:
    """V18 - checks run, passed, failed, overall verdict."""
    return results.agg(
        F.count(F.lit(1)).alias("checks_run"),
        F.count_if(F.col("result") == "PASS").alias("passed"),
        F.count_if(F.col("result") == "FAIL").alias("failed"),
    ).withColumn("verdict", F.when(F.col("failed") == 0, "ALL CHECKS PASSED")
                 .otherwise("VALIDATION FAILED - DO NOT TRUST DOWNSTREAM RESULTS"))
