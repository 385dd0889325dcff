"""Executive KPIs, product profitability and order composition (Q1-Q8, Q36-Q38).

Q1-Q16 deliberately read the star directly rather than the views.  Line
measures are always pre-aggregated (to the order or to the sub-category)
before they meet another table, so joins run on aggregated rows and counts
are never inflated by the line fan-out.  Windows appear only over results
bounded by a dimension (categories, sub-categories).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.measures import (avg2, margin_pct, per, per_double, ratio_pct,
                                         sum_margin_pct)
from tillroll.plans.views import order_summary, order_values
from tillroll.sources.tables import IDENTITY, Star

def _whole():
    """The whole (already aggregated, dimension-bounded) result as one window."""
    return Window.partitionBy()


def _order_totals(star: Star) -> DataFrame:
    per_order = order_values(star).select(
        "order_id", F.col("order_revenue").alias("order_amount"), "order_quantity")
    return star.orders_with_customer().join(per_order, "order_id")


def kpi_summary(star: Star) -> DataFrame:
    """Q1 - the business in one row; every figure from its own grain.

    Each grain is one aggregate returning a struct (a single scalar
    subquery per grain; Spark reuses a subquery referenced twice).
    """
    ot = _order_totals(star)
    orders = ot.agg(F.struct(F.count(F.lit(1)).alias("n"),
                             avg2("order_amount").alias("aov"),
                             avg2("order_quantity").alias("aoq"))).scalar()
    total_customers = ot.select(*IDENTITY).distinct().agg(F.count(F.lit(1))).scalar()
    places = star.dim_customer.agg(F.struct(F.count_distinct("state").alias("s"),
                                            F.count_distinct("city").alias("c"))).scalar()
    products = star.dim_sub_category.agg(F.struct(F.count_distinct("category").alias("c"),
                                                  F.count(F.lit(1)).alias("s"))).scalar()
    period = star.fact_orders.agg(F.struct(F.min("order_date").alias("a"),
                                           F.max("order_date").alias("b"))).scalar()
    return star.fact_order_lines.agg(
        F.sum("amount").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        sum_margin_pct().alias("profit_margin_pct"),
        F.sum("quantity").alias("total_quantity"),
    ).select(
        "total_revenue", "total_profit", "profit_margin_pct",
        orders["n"].alias("total_orders"),
        total_customers.alias("total_customers"),
        "total_quantity",
        orders["aov"].alias("avg_order_value"),
        orders["aoq"].alias("avg_order_quantity"),
        places["s"].alias("states_served"),
        places["c"].alias("cities_served"),
        products["c"].alias("categories"),
        products["s"].alias("sub_categories"),
        period["a"].alias("period_start"),
        period["b"].alias("period_end"),
    )


def reconcile_grains(star: Star) -> DataFrame:
    """Q2 - revenue at line grain vs order grain."""
    lines = star.fact_order_lines
    at_order = (lines.groupBy("order_id").agg(F.sum("amount").alias("a"))
                .agg(F.sum("a")).scalar())
    return lines.agg(F.sum("amount").alias("revenue_at_line_grain")).select(
        "revenue_at_line_grain",
        at_order.alias("revenue_at_order_grain"),
        F.when(F.col("revenue_at_line_grain") == at_order, "RECONCILED")
        .otherwise("MISMATCH").alias("check_result"))


def _per_sub_category(star: Star) -> DataFrame:
    """Line measures per sub-category, then the (small) dimension join."""
    # one row per quantity first: amounts of one quantity add up exactly before they
    # are divided by it, whatever the order of the lines
    priced = F.when(F.col("quantity") != 0, F.col("amount"))
    per_quantity = star.fact_order_lines.groupBy("sub_category", "quantity").agg(
        F.sum("amount").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.col("profit") < 0).alias("loss_making_lines"),
        F.sum(priced).alias("priced"), F.count(priced).alias("unit_prices"))
    per_sub = per_quantity.groupBy("sub_category").agg(
        *[F.sum(c).alias(c) for c in ("revenue", "profit", "units", "line_count",
                                      "loss_making_lines", "unit_prices")],
        F.sum(F.try_divide(F.col("priced").cast("double"), F.col("quantity"))).alias("unit_price_sum"))
    return per_sub.join(star.dim_sub_category, "sub_category")


def category_scorecard(star: Star) -> DataFrame:
    """Q3 - categories side by side, revenue rank against profit rank."""
    per_cat = _per_sub_category(star).groupBy("category").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"),
        F.sum("units").alias("units_sold"))
    return per_cat.select(
        "category", "revenue", "profit", margin_pct().alias("margin_pct"), "units_sold",
        per("revenue", "units_sold").alias("revenue_per_unit"),
        ratio_pct("revenue", F.sum("revenue").over(_whole())).alias("pct_of_total_revenue"),
        F.rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"),
        F.rank().over(Window.orderBy(F.desc("profit"))).alias("profit_rank"),
    ).orderBy(F.desc("revenue"), "category")


def subcat_loss_share(star: Star) -> DataFrame:
    """Q4 - sub-categories with the share of their lines that lost money."""
    return _per_sub_category(star).select(
        "category", "sub_category", "revenue", "profit", margin_pct().alias("margin_pct"),
        "line_count", "loss_making_lines",
        ratio_pct("loss_making_lines", "line_count", 1).alias("loss_line_share_pct"),
    ).orderBy(F.desc("profit"), "sub_category")


def subcat_quadrant(star: Star) -> DataFrame:
    """Q5 - revenue against the mean sub-category revenue, margin against the
    business margin (both unrounded when compared)."""
    s = _per_sub_category(star).withColumn(
        "m", F.try_divide(F.lit(100.0) * F.col("profit").cast("double"), F.col("revenue").cast("double")))
    overall = star.fact_order_lines.agg(
        F.try_divide(F.lit(100.0) * F.sum("profit").cast("double"), F.sum("amount").cast("double"))).scalar()
    avg_rev = F.sum("revenue").over(_whole()).cast("double") / F.count(F.lit(1)).over(_whole())
    s = s.withColumn("avg_rev", avg_rev).withColumn("overall", overall)
    high = F.col("revenue").cast("double") >= F.col("avg_rev")
    strong = F.col("m") >= F.col("overall")
    # fixed values: the quadrant labels
    quadrant = (F.when(high & strong, "Core strength")
                .when(high & ~strong, "Volume trap - fix margin")
                .when(~high & strong, "Scale candidate")
                .otherwise("Review or exit"))
    return s.select(
        "category", "sub_category", "revenue", "profit",
        F.round("m", 2).alias("margin_pct"),
        F.round("overall", 2).alias("business_margin_pct"),
        F.round(F.col("m") - F.col("overall"), 2).alias("margin_gap_pts"),
        quadrant.alias("quadrant"),
    ).orderBy(F.desc("revenue"), "sub_category")


def subcat_counterfactual(star: Star) -> DataFrame:
    """Q6 - loss-making sub-categories (profit < 0) and profit without each."""
    total = star.fact_order_lines.agg(F.sum("profit")).scalar()
    return (_per_sub_category(star).filter(F.col("profit") < 0).select(
        "sub_category", "category", "profit", "revenue", margin_pct().alias("margin_pct"),
        total.alias("current_total_profit"),
        (total - F.col("profit")).alias("profit_excluding_this_subcat"))
        .orderBy("profit", "sub_category"))


def subcat_pareto(star: Star) -> DataFrame:
    """Q7 - running revenue share over sub-categories ranked by revenue."""
    s = star.fact_order_lines.groupBy("sub_category").agg(F.sum("amount").alias("revenue"))
    order = Window.orderBy(F.desc("revenue"), "sub_category")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("revenue").over(_whole())
    return s.select(
        "sub_category", "revenue",
        ratio_pct("revenue", total).alias("pct_of_revenue"),
        ratio_pct(F.sum("revenue").over(upto), total).alias("cumulative_pct"),
        F.row_number().over(order).alias("revenue_rank"),
    ).orderBy("revenue_rank")


def subcat_line_value(star: Star) -> DataFrame:
    """Q8 - value per line, units per line, mean unit price, margin."""
    return _per_sub_category(star).select(
        "sub_category", "category", "line_count",
        per("revenue", "line_count").alias("avg_line_value"),
        per("units", "line_count").alias("avg_units_per_line"),
        per_double("unit_price_sum", "unit_prices").alias("avg_unit_price"),
        margin_pct().alias("margin_pct"),
    ).orderBy(F.desc("avg_line_value"), "sub_category")


def _size_bucket(n):
    label = (F.when(n == 1, "1 line").when(n == 2, "2 lines")
             .when(n.between(3, 4), "3-4 lines").when(n.between(5, 6), "5-6 lines")
             .otherwise("7+ lines"))
    return label


def order_size_buckets(star: Star) -> DataFrame:
    """Q36 - does order size (line count) predict order margin?"""
    os = order_summary(star)
    return (os.groupBy(_size_bucket(F.col("line_count")).alias("order_size")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        F.sum("order_profit").alias("profit"),
        avg2("order_revenue").alias("avg_order_value"),
        F.count_if(F.col("order_profit") < 0).alias("loss_making_orders"),
        F.min("line_count").alias("_min_lines"))
        .select("order_size", "orders", "revenue", "profit", margin_pct().alias("margin_pct"),
                "avg_order_value", "loss_making_orders",
                ratio_pct("loss_making_orders", "orders", 1).alias("loss_order_share_pct"),
                "_min_lines")
        .orderBy("_min_lines").drop("_min_lines"))


def _orders_with_categories(star: Star, categories) -> DataFrame:
    """Per order (that has lines and a header): revenue, profit, category flags."""
    flags = [F.max(F.col("category") == c).alias(f"_has_{i}") for i, c in enumerate(categories)]
    per_order = star.lines_with_category().groupBy("order_id").agg(
        F.sum("amount").alias("order_revenue"), F.sum("profit").alias("order_profit"), *flags)
    return per_order.join(star.fact_orders, "order_id", "left_semi")


def category_mix(star: Star, categories, min_orders: int = 10) -> DataFrame:
    """Q37 - metrics per combination of categories in an order.

    ``categories`` fixes the label order; combinations with fewer than
    ``min_orders`` orders are dropped (sample-size floor).
    """
    o = _orders_with_categories(star, categories)
    label = F.concat_ws(" + ", *[F.when(F.col(f"_has_{i}"), F.lit(c))
                                 for i, c in enumerate(categories)])
    n_cats = sum(F.col(f"_has_{i}").cast("int") for i in range(len(categories)))
    return (o.groupBy(label.alias("category_mix"), n_cats.alias("categories_in_order")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        F.sum("order_profit").alias("profit"),
        avg2("order_revenue").alias("avg_order_value"))
        .filter(F.col("orders") >= min_orders)
        .select("category_mix", "categories_in_order", "orders", "revenue", "profit",
                margin_pct().alias("margin_pct"), "avg_order_value")
        .orderBy(F.desc("margin_pct"), "category_mix"))


def contains_category_effect(star: Star, category: str) -> DataFrame:
    """Q38 - orders containing ``category`` against orders without it."""
    o = _orders_with_categories(star, [category])
    return (o.groupBy(F.when(F.col("_has_0"), f"Order contains {category}")
                      .otherwise(f"No {category} in order").alias("order_type")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("revenue"),
        F.sum("order_profit").alias("profit"),
        avg2("order_revenue").alias("avg_order_value"),
        F.count_if(F.col("order_profit") < 0).alias("_loss"))
        .select("order_type", "orders", "revenue", "profit", margin_pct().alias("margin_pct"),
                "avg_order_value",
                ratio_pct("_loss", "orders", 1).alias("loss_order_share_pct")))
