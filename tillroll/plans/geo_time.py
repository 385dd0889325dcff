"""Geography and time series (Q9-Q16).

Revenue-side measures come from lines pre-aggregated to the order; order and
customer counts come from the order grain (``fact_orders``), so orders
without lines still count as orders where the question says so (Q9, Q11).
Windows run over per-state / per-month results only (bounded by the nation
and calendar dimensions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import (day_name, fiscal_quarter_label, month_label,
                                      month_start)
from tillroll.functions.measures import margin_pct, per, ratio_pct
from tillroll.plans.views import order_summary, order_values
from tillroll.sources.tables import IDENTITY, Star

def _whole():
    """The whole (already aggregated, dimension-bounded) result as one window."""
    return Window.partitionBy()


def _order_values(star: Star) -> DataFrame:
    """Per order with lines: revenue, profit, units (line grain -> order grain)."""
    return order_values(star).select("order_id", F.col("order_revenue").alias("revenue"),
                                     F.col("order_profit").alias("profit"),
                                     F.col("order_quantity").alias("units"))


def _line_side(star: Star, keys) -> DataFrame:
    """Revenue, profit, units by customer attributes (lines -> orders -> customer)."""
    return (_order_values(star).join(star.orders_with_customer(), "order_id")
            .groupBy(*keys).agg(F.sum("revenue").alias("revenue"),
                                F.sum("profit").alias("profit"),
                                F.sum("units").alias("units")))


def state_scorecard(star: Star) -> DataFrame:
    """Q9 - full state scorecard; orders/customers counted at order grain."""
    lines = _line_side(star, ["state"])
    per_cust = star.orders_with_customer().groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("o"))
    orders = per_cust.groupBy("state").agg(F.sum("o").alias("orders"),
                                           F.count(F.lit(1)).alias("customers"))
    j = lines.join(orders, "state")
    return j.select(
        "state", "revenue", "profit", margin_pct().alias("margin_pct"),
        "orders", "customers",
        per("revenue", "orders").alias("avg_order_value"),
        per("revenue", "customers").alias("revenue_per_customer"),
        ratio_pct("revenue", F.sum("revenue").over(_whole())).alias("pct_of_revenue"),
        F.rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"),
        F.rank().over(Window.orderBy(F.desc("profit"))).alias("profit_rank"),
    ).orderBy(F.desc("revenue"), "state")


def state_market_class(star: Star) -> DataFrame:
    """Q10 - median state revenue and business margin split states in four."""
    sp = _line_side(star, ["state"]).withColumn(
        "m", F.try_divide(F.lit(100.0) * F.col("profit").cast("double"), F.col("revenue").cast("double")))
    bench = star.fact_order_lines.agg(
        F.try_divide(F.lit(100.0) * F.sum("profit").cast("double"), F.sum("amount").cast("double"))).scalar()
    sp = sp.withColumn("med", F.median(F.col("revenue").cast("double")).over(_whole())) \
           .withColumn("bench", bench)
    high = F.col("revenue").cast("double") >= F.col("med")
    strong = F.col("m") >= F.col("bench")
    # fixed values: the market labels
    seg = (F.when(high & strong, "Strong market")
           .when(high & ~strong, "High revenue, weak profit")
           .when(~high & strong, "Growth opportunity")
           .otherwise("Underperforming"))
    return sp.select(
        "state", "revenue", "profit", F.round("m", 2).alias("margin_pct"),
        F.round("med", 2).alias("median_state_revenue"),
        F.round("bench", 2).alias("margin_benchmark_pct"),
        seg.alias("market_segment"),
    ).orderBy(F.desc("revenue"), "state")


def city_performance(star: Star, min_orders: int = 10) -> DataFrame:
    """Q11 - (city, state) with at least ``min_orders`` orders."""
    lines = _line_side(star, ["city", "state"])
    orders = star.orders_with_customer().groupBy("city", "state").agg(
        F.count(F.lit(1)).alias("orders"))
    return (lines.join(orders, ["city", "state"]).filter(F.col("orders") >= min_orders)
            .select("city", "state", "revenue", "profit", margin_pct().alias("margin_pct"),
                    "orders", per("revenue", "orders").alias("avg_order_value"))
            .orderBy(F.desc("revenue"), "city", "state"))


def loss_states(star: Star, of_mean: float = 0.0) -> DataFrame:
    """Q12 - states with profit <= ``of_mean`` times the mean state's profit (0: losses), worst first."""
    states = _line_side(star, ["state"])
    bound = F.lit(of_mean) * states.agg(F.sum("profit").cast("double") / F.count(F.lit(1))).scalar()
    return (states.filter(F.col("profit").cast("double") <= (F.lit(0.0) if of_mean == 0 else bound))
            .select("state", "revenue", "profit", margin_pct().alias("margin_pct"))
            .orderBy("profit", "state"))


def _dated_order_values(star: Star, start: str | None = None, end: str | None = None) -> DataFrame:
    return order_summary(star, start=start, end=end).select(
        "order_id", "order_date", "month_start", F.col("order_revenue").alias("revenue"), F.col("order_profit").alias("profit"),
        F.col("order_quantity").alias("units"))


def monthly_growth(star: Star, start: str | None = None, end: str | None = None) -> DataFrame:
    """Q13 - month metrics, month-over-month growth and cumulative totals, of all orders or of a period."""
    m = _dated_order_values(star, start, end).groupBy("month_start").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("units").alias("units"), F.count(F.lit(1)).alias("orders"))
    by_month = Window.orderBy("month_start")
    upto = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag("revenue").over(by_month)
    return m.select(
        "month_start", month_label("month_start").alias("month_label"),
        "revenue", "profit", margin_pct().alias("margin_pct"), "orders", "units",
        per("revenue", "orders").alias("avg_order_value"),
        prev.alias("prev_month_revenue"),
        ratio_pct(F.col("revenue") - prev, prev).alias("mom_growth_pct"),
        F.sum("revenue").over(upto).alias("cumulative_revenue"),
        F.sum("profit").over(upto).alias("cumulative_profit"),
    ).orderBy("month_start")


def fiscal_quarter(star: Star, fiscal_start_month: int = 4) -> DataFrame:
    """Q14 - fiscal quarters (fiscal year starting in ``fiscal_start_month``)."""
    d = _dated_order_values(star)
    return (d.groupBy(fiscal_quarter_label("order_date", fiscal_start_month)
                      .alias("fiscal_quarter")).agg(
        F.min("order_date").alias("quarter_start"),
        F.max("order_date").alias("quarter_end"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
        .select("fiscal_quarter", "quarter_start", "quarter_end", "orders", "revenue",
                "profit", margin_pct().alias("margin_pct"))
        .orderBy("quarter_start"))


def day_of_week(star: Star) -> DataFrame:
    """Q15 - weekday pattern; orders per *active* date of that weekday."""
    per_date = _dated_order_values(star).groupBy("order_date").agg(
        F.count(F.lit(1)).alias("o"), F.sum("revenue").alias("r"), F.sum("profit").alias("p"))
    dow = per_date.groupBy(day_name("order_date").alias("day_name"),
                           F.dayofweek("order_date").alias("day_number")).agg(
        F.sum("o").alias("orders"), F.count(F.lit(1)).alias("active_days"),
        F.sum("r").alias("revenue"), F.sum("p").alias("profit"))
    return dow.select(
        "day_name", "orders", "active_days",
        per("orders", "active_days").alias("orders_per_active_day"),
        "revenue", per("revenue", "orders").alias("avg_order_value"),
        margin_pct().alias("margin_pct"), "day_number",
    ).orderBy("day_number").drop("day_number")


def category_month_pivot(star: Star, categories, focus: str) -> DataFrame:
    """Q16 - category revenue as columns per month, plus one category's profit.

    The category list is explicit so the output schema does not depend on
    the data; an absent category is 0.
    """
    per_order_cat = star.lines_with_category().groupBy("order_id", "category").agg(
        F.sum("amount").alias("amount"), F.sum("profit").alias("profit"))
    d = (per_order_cat.join(star.fact_orders, "order_id")
         .withColumn("month_start", month_start("order_date")))
    zero = F.lit(0).cast("decimal(18,4)")
    cols = [F.sum(F.when(F.col("category") == c, F.col("amount")).otherwise(zero))
            .alias(f"{c.lower()}_revenue") for c in categories]
    return (d.groupBy("month_start").agg(
        *cols, F.sum("amount").alias("total_revenue"),
        F.round(F.sum(F.when(F.col("category") == focus, F.col("profit")).otherwise(zero)), 2)
        .alias(f"{focus.lower()}_profit"))
        .withColumn("month_label", month_label("month_start"))
        .orderBy("month_start")
        .select("month_label", *[f"{c.lower()}_revenue" for c in categories],
                "total_revenue", f"{focus.lower()}_profit"))
