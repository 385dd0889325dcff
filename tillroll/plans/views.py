"""Shared DataFrame builders (the seven views of the model).

Every builder takes the ``Star`` and returns a lazy DataFrame; money stays an
exact decimal here and is converted only when a result is presented.

Grain rules: line measures are aggregated to the order *before* joining to
order-level data, and distinct counts are computed by first aggregating to
the finer grain (e.g. (sub-category, order)) and counting rows, which avoids
the row-doubling Expand of a mixed distinct/non-distinct aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import month_label, month_start
from tillroll.functions.measures import avg2, margin_pct, per, ratio_pct
from tillroll.operators.selection import ntile_column
from tillroll.sources.tables import IDENTITY, Star, per_order_values

CUSTOMER_TIEBREAK = IDENTITY


def snapshot_date(star: Star, snapshot: str | None = None) -> Column:
    """Recency reference date: a fixed date, or the last order date in the data."""
    if snapshot is not None:
        return F.lit(snapshot).cast("date")
    return star.fact_orders.agg(F.max("order_date")).scalar()


def order_values(star: Star) -> DataFrame:
    """Line measures per order; a stored model has them as a table (bucketed like the orders)."""
    return per_order_values(star.fact_order_lines) if star.order_values is None else star.order_values


def order_summary(star: Star, with_customer: bool = False, start: str | None = None, end: str | None = None) -> DataFrame:
    """W1 - one row per order that has lines (inner join), optionally of a period (both days included).

    ``with_customer`` adds the customer's name, state and city from the (wide)
    order table, for jobs that group by them.  A stored model has the rows by month, so a period
    - given here or by a join on ``month_start`` - reads its months only.
    """
    extra = ["customer_name", "state", "city"] if with_customer else []
    if star.dated_orders is not None:
        rows = star.dated_orders
    else:
        orders = star.orders_with_customer() if with_customer else star.fact_orders
        rows = orders.join(order_values(star), "order_id").withColumn("month_start", month_start("order_date"))
    for bound, keep in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            rows = rows.where(keep(F.col("month_start"), F.trunc(day, "MM")) & keep(F.col("order_date"), day))
    return rows.select("order_id", "customer_id", *extra, "order_date", "month_start",
                       "line_count", "order_revenue", "order_profit", "order_quantity")


def customer_metrics(star: Star, snapshot: str | None = None) -> DataFrame:
    """W2 - one row per customer with at least one order with lines.

    The customer's attributes ride along from the wide order table, so the
    per-customer aggregate needs no join back to the dimension (they are
    functionally dependent on the customer key).  A stored model keeps the result.
    """
    if snapshot is None:
        return star.once("customer_metrics", lambda: _customer_metrics(star, None))
    return _customer_metrics(star, snapshot)


def _customer_metrics(star: Star, snapshot: str | None) -> DataFrame:
    snap = snapshot_date(star, snapshot)
    per_customer = order_summary(star, with_customer=True).groupBy(
        "customer_id", "customer_name", "state", "city").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("order_revenue").alias("total_revenue"),
        F.sum("order_profit").alias("total_profit"),
        F.sum("order_quantity").alias("total_quantity"),
        avg2("order_revenue").alias("avg_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    return per_customer.select(
        "customer_id", "customer_name", "state", "city",
        "order_count", "total_revenue", "total_profit", "total_quantity", "avg_order_value",
        "first_order_date", "last_order_date",
        F.datediff("last_order_date", "first_order_date").alias("customer_lifespan_days"),
        F.datediff(snap, "last_order_date").alias("days_since_last_order"),
        F.when(F.col("order_count") == 1, "One-time").otherwise("Repeat").alias("customer_type"),
    )


def monthly_sales(star: Star) -> DataFrame:
    """W3 - one row per calendar month (sorted on the DATE, never the label)."""
    return (order_summary(star).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        F.sum("order_profit").alias("profit"),
        F.sum("order_quantity").alias("units"))
        .select("month_start", month_label("month_start").alias("month_label"),
                "orders", "revenue", "profit", "units",
                per("revenue", "orders").alias("avg_order_value"),
                margin_pct().alias("margin_pct")))


def sub_category_performance(star: Star) -> DataFrame:
    """W4 - one row per sub-category."""
    pairs = star.fact_order_lines.groupBy("sub_category", "order_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amount").alias("a"), F.sum("profit").alias("p"), F.sum("quantity").alias("q"),
        F.count_if(F.col("profit") < 0).alias("loss"))
    per_sub = pairs.groupBy("sub_category").agg(
        F.sum("n").alias("line_count"),
        F.count(F.lit(1)).alias("order_count"),
        F.sum("a").alias("revenue"), F.sum("p").alias("profit"), F.sum("q").alias("units"),
        F.sum("loss").alias("loss_making_lines"))
    return per_sub.join(star.dim_sub_category, "sub_category").select(
        "category", "sub_category", "line_count", "order_count", "revenue", "profit", "units",
        margin_pct().alias("margin_pct"),
        per("revenue", "line_count").alias("avg_line_value"),
        "loss_making_lines")


def state_performance(star: Star) -> DataFrame:
    """W5 - one row per state, from W1 (line-less orders excluded)."""
    # the (wide) order table already carries the customer's state
    orders = order_summary(star, with_customer=True)
    per_customer = orders.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("o"), F.sum("order_revenue").alias("r"),
        F.sum("order_profit").alias("p"), F.sum("order_quantity").alias("u"))
    per_state = per_customer.groupBy("state").agg(
        F.sum("o").alias("orders"), F.count(F.lit(1)).alias("customers"),
        F.sum("r").alias("revenue"), F.sum("p").alias("profit"), F.sum("u").alias("units"))
    return per_state.select(
        "state", "orders", "customers", "revenue", "profit", "units",
        margin_pct().alias("margin_pct"),
        per("revenue", "orders").alias("avg_order_value"),
        per("revenue", "customers").alias("revenue_per_customer"))


RFM_DEFAULT_SEGMENT = "Low Value"


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment rules, first match wins (fixed values of the model)."""
    return (F.when((f >= 4) & (r >= 4) & (m >= 4), "Champions")
            .when((f >= 3) & (m >= 3), "Loyal Customers")
            .when(f >= 3, "Potential Loyalists")
            .when((m >= 4) & (r <= 2), "At Risk")
            .when((m >= 4) & (r >= 4), "Recent High Spenders")
            .when((r <= 2) & (m <= 2), "Hibernating")
            .when(r >= 4, "Promising")
            .when(m >= 3, "Needs Attention")
            .otherwise(RFM_DEFAULT_SEGMENT))


#: Orders from which a customer's frequency scores 3, 4 and 5.  The original extract has
#: one to four orders a customer (cut-offs 2, 3, 4), the driver tables about ten.
FREQUENCY_CUTS = (10, 12, 14)


def frequency_score(order_count: Column, cuts=FREQUENCY_CUTS) -> Column:
    """Rule-scored frequency (NTILE would split tied counts, see Q23)."""
    three, four, five = cuts
    return (F.when(order_count >= five, 5).when(order_count >= four, 4)
            .when(order_count >= three, 3).otherwise(1))


def customer_rfm(star: Star, snapshot: str | None = None, buckets: int = 5,
                 cuts=FREQUENCY_CUTS) -> DataFrame:
    """W6 - RFM scores and segment per customer.

    r = buckets+1 - NTILE over days since last order (ascending),
    m = NTILE over total revenue (ascending); ties broken by the natural
    customer key.  The rows at which buckets end are selected exactly without
    a sort (``operators.selection``); the scores are comparisons with them.
    A stored model keeps the result.
    """
    if snapshot is None and buckets == 5 and cuts == FREQUENCY_CUTS:
        return star.once("customer_rfm", lambda: _customer_rfm(star, None, buckets, cuts))
    return _customer_rfm(star, snapshot, buckets, cuts)


def _customer_rfm(star: Star, snapshot: str | None, buckets: int, cuts) -> DataFrame:
    cm = customer_metrics(star, snapshot).select(
        "customer_id", "customer_name", "state", "city", "days_since_last_order",
        "order_count", "total_revenue", "total_profit", "first_order_date", "last_order_date")
    tb = list(CUSTOMER_TIEBREAK)
    recency, money = (ntile_column(cm, [c, *tb], buckets) for c in ("days_since_last_order", "total_revenue"))
    scored = cm.withColumns({"r_score": F.lit(buckets + 1) - recency, "m_score": money})
    scored = scored.withColumn("f_score", frequency_score(F.col("order_count"), cuts).cast("int"))
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "customer_id", "customer_name", "state", "city", "days_since_last_order",
        "order_count", "total_revenue", "total_profit", "first_order_date", "last_order_date",
        "r_score", "f_score", "m_score",
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_cell"),
        rfm_segment(r, f, m).alias("rfm_segment"))


def actual_by_month_category(star: Star) -> DataFrame:
    per_order_cat = star.lines_with_category().groupBy("order_id", "category").agg(
        F.sum("amount").alias("amount"), F.sum("profit").alias("profit"))
    return (per_order_cat.join(star.fact_orders, "order_id")
            .groupBy(month_start("order_date").alias("month_start"), "category")
            .agg(F.sum("amount").alias("actual_revenue"), F.sum("profit").alias("actual_profit")))


def sales_vs_target(star: Star) -> DataFrame:
    """W7 - one row per target cell; LEFT from targets, absent sales = 0."""
    t = star.fact_sales_target
    a = actual_by_month_category(star).withColumnRenamed("month_start", "target_month")
    j = t.join(a, ["target_month", "category"], "left")
    zero = F.lit(0).cast("decimal(18,4)")
    actual = F.coalesce(F.col("actual_revenue"), zero)
    return j.select(
        "target_month", month_label("target_month").alias("month_label"), "category",
        "target_amount",
        actual.alias("actual_revenue"),
        F.coalesce(F.col("actual_profit"), zero).alias("actual_profit"),
        (actual - F.col("target_amount")).alias("variance"),
        ratio_pct(actual - F.col("target_amount"), "target_amount").alias("variance_pct"),
        ratio_pct(actual, "target_amount").alias("achievement_pct"),
        F.when(actual >= F.col("target_amount"), "Hit").otherwise("Miss").alias("status"))
