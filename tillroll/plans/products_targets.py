"""Product ranking and target attainment (Q29-Q35), on the views.

The windows here run over the sub-category view (one row per sub-category,
bounded by the product dimension) and the target grid (months x
categories), never over lines or customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import fiscal_half, fiscal_year
from tillroll.functions.measures import ratio_pct
from tillroll.plans.views import actual_by_month_category, sales_vs_target, sub_category_performance
from tillroll.sources.tables import Star


def top3_subcat_ranks(star: Star, k: int = 3) -> DataFrame:
    """Q29 - ROW_NUMBER, RANK and DENSE_RANK by profit within category;
    keeps DENSE_RANK <= k so ties are all kept."""
    w = Window.partitionBy("category").orderBy(F.desc("profit"))
    w_rn = Window.partitionBy("category").orderBy(F.desc("profit"), "sub_category")
    return (sub_category_performance(star).select(
        "category", "sub_category", "revenue", "profit", "margin_pct",
        F.row_number().over(w_rn).alias("row_num"),
        F.rank().over(w).alias("rank_pos"),
        F.dense_rank().over(w).alias("dense_pos"))
        .filter(F.col("dense_pos") <= k)
        .orderBy("category", "dense_pos", "row_num"))


# The quartile labels.
QUARTILE_LABELS = {1: "Q1 - most profitable", 2: "Q2", 3: "Q3"}
QUARTILE_LAST = "Q4 - least profitable"


def margin_quartiles(star: Star) -> DataFrame:
    """Q30 - NTILE(4) over the (rounded) sub-category margin, best first."""
    q = F.ntile(4).over(Window.orderBy(F.desc("margin_pct"), "sub_category"))
    label = F.when(F.col("margin_quartile") == 1, QUARTILE_LABELS[1]) \
        .when(F.col("margin_quartile") == 2, QUARTILE_LABELS[2]) \
        .when(F.col("margin_quartile") == 3, QUARTILE_LABELS[3]).otherwise(QUARTILE_LAST)
    return (sub_category_performance(star)
            .select("sub_category", "category", "revenue", "profit", "margin_pct",
                    q.alias("margin_quartile"))
            .withColumn("quartile_label", label)
            .orderBy(F.desc("margin_pct"), "sub_category"))


def _attainment(g):
    return g.agg(
        F.sum("target_amount").alias("target"),
        F.sum("actual_revenue").alias("actual"),
        F.count_if(F.col("status") == "Hit").alias("hit"),
        F.count_if(F.col("status") == "Miss").alias("miss"))


def target_by_category(star: Star) -> DataFrame:
    """Q31 - target attainment per category over all target months."""
    g = _attainment(sales_vs_target(star).groupBy("category"))
    return g.select(
        "category", F.col("target").alias("total_target"), F.col("actual").alias("total_actual"),
        (F.col("actual") - F.col("target")).alias("variance"),
        ratio_pct(F.col("actual") - F.col("target"), "target").alias("variance_pct"),
        ratio_pct("actual", "target").alias("achievement_pct"),
        F.col("hit").alias("months_hit"), F.col("miss").alias("months_missed"),
    ).orderBy(F.desc("achievement_pct"), "category")


def target_by_month(star: Star) -> DataFrame:
    """Q32 - attainment of the business per month."""
    g = _attainment(sales_vs_target(star).groupBy("target_month", "month_label"))
    return g.select(
        "target_month", "month_label", "target", "actual",
        (F.col("actual") - F.col("target")).alias("variance"),
        ratio_pct("actual", "target").alias("achievement_pct"),
        F.col("hit").alias("categories_hit"),
    ).orderBy("target_month")


def target_grid(star: Star) -> DataFrame:
    """Q33 - the full month x category grid."""
    return (sales_vs_target(star)
            .select("target_month", "month_label", "category", "target_amount",
                    "actual_revenue", "variance", "achievement_pct", "status")
            .orderBy("target_month", "category"))


def target_half_trend(star: Star, fiscal_start_month: int = 4) -> DataFrame:
    """Q34 - first against second fiscal half-year attainment, per category
    and fiscal year; the change is computed from unrounded ratios."""
    t = sales_vs_target(star)
    halves = t.groupBy(
        "category",
        fiscal_year("target_month", fiscal_start_month).alias("fiscal_year"),
        fiscal_half("target_month", fiscal_start_month).alias("half"),
    ).agg(F.sum("target_amount").alias("target"), F.sum("actual_revenue").alias("actual"))
    pct = F.try_divide(F.lit(100.0) * F.col("actual").cast("double"), F.col("target").cast("double"))
    h1 = F.max(F.when(F.col("half") == 1, pct))
    h2 = F.max(F.when(F.col("half") == 2, pct))
    g = halves.groupBy("category", "fiscal_year").agg(h1.alias("h1"), h2.alias("h2"))
    return g.select(
        "category", "fiscal_year",
        F.round("h1", 2).alias("h1_achievement_pct"),
        F.round("h2", 2).alias("h2_achievement_pct"),
        F.round(F.col("h2") - F.col("h1"), 2).alias("change_in_pts"),
        F.when(F.col("h2") > F.col("h1"), "Improving").otherwise("Deteriorating").alias("direction"),
    ).orderBy("fiscal_year", F.desc("change_in_pts"), "category")


def target_hit_vs_profit(star: Star) -> DataFrame:
    """Q35 - do Hit cells earn more margin than Miss cells?"""
    g = sales_vs_target(star).groupBy(F.col("status").alias("target_status")).agg(
        F.count(F.lit(1)).alias("month_category_cells"),
        F.sum("actual_revenue").alias("revenue"),
        F.sum("actual_profit").alias("profit"),
        F.round(F.avg("achievement_pct"), 2).alias("avg_achievement_pct"))
    return g.select("target_status", "month_category_cells", "revenue", "profit",
                    ratio_pct("profit", "revenue").alias("margin_pct"), "avg_achievement_pct")


def target_coverage(star: Star) -> DataFrame:
    """Targets against sales in both directions: every (month, category) of either side.

    W7 keeps the targets' side alone; months and categories sold without a target drop out there.
    Both sides are grids of months and categories, so their join is small.
    """
    sold = actual_by_month_category(star).select(F.col("month_start").alias("target_month"), "category", "actual_revenue")
    planned = star.fact_sales_target.select("target_month", "category", "target_amount")
    a, b = planned.alias("a"), sold.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("target_month", "category")]
    # a side is missing where its figure is: neither is null by itself in the model
    cells = a.join(b, same[0] & same[1], "full").select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("target_month", "category")], "target_amount", "actual_revenue")
    has = [F.col(c).isNotNull() for c in ("target_amount", "actual_revenue")]
    return cells.withColumn("coverage", F.when(has[0] & has[1], "both").when(has[0], "target without sales").otherwise("sales without target"))
