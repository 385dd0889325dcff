"""Customer base, RFM and order sequences (Q17-Q28), on the views.

Q19 selects its two places without a sort; Q26 (sequences) uses the
distributed global-position operator; Q23 needs only the value
histogram; Q28 is a per-state top-k (Spark plans a partial WindowGroupLimit
before the shuffle, so a populous state costs k rows per task).  Shares of a
total use window totals over the (small) grouped result, or a scalar
subquery when the total is over customers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.measures import avg2, margin_pct, ratio_pct
from tillroll.operators.ordering import (N, RN, global_positions, group_extent, ntile,
                                        value_histogram_positions)
from tillroll.operators.selection import locate
from tillroll.plans.views import (CUSTOMER_TIEBREAK, customer_metrics, customer_rfm,
                                  order_summary)
from tillroll.sources.tables import Star

def _whole():
    """The whole (already aggregated, dimension-bounded) result as one window."""
    return Window.partitionBy()


def _shares(df: DataFrame, count_col: str = "customers", revenue_col: str = "revenue"):
    return [ratio_pct(count_col, F.sum(count_col).over(_whole()), 1).alias("pct_of_customers"),
            ratio_pct(revenue_col, F.sum(revenue_col).over(_whole()), 1).alias("pct_of_revenue")]


def one_time_vs_repeat(star: Star) -> DataFrame:
    """Q17 - one-time against repeat customers."""
    g = customer_metrics(star).groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_profit").alias("profit"),
        avg2("total_revenue").alias("avg_customer_spend"),
        F.round(F.avg("avg_order_value"), 2).alias("avg_order_value"))
    pc, pr = _shares(g)
    return g.select("customer_type", "customers", pc, "revenue", pr, "profit",
                    margin_pct().alias("margin_pct"), "avg_customer_spend", "avg_order_value")


def frequency_distribution(star: Star) -> DataFrame:
    """Q18 - customers and revenue per number of orders placed."""
    g = customer_metrics(star).groupBy(F.col("order_count").alias("orders_placed")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_revenue").alias("revenue"),
        avg2("total_revenue").alias("avg_spend"))
    pc, pr = _shares(g)
    return g.select("orders_placed", "customers", pc, "revenue", pr, "avg_spend") \
            .orderBy("orders_placed")


def revenue_concentration(star: Star, thresholds=(50, 80)) -> DataFrame:
    """Q19 - fewest customers whose cumulative share (rounded to 2 dp first)
    reaches each threshold."""
    return star.once(f"concentration_{'_'.join(map(str, thresholds))}", lambda: _concentration(star, thresholds))


def _concentration(star: Star, thresholds) -> DataFrame:
    """The places where the running revenue reaches the shares, selected without a sort.

    A share rounds to t or more, half away from zero, from t - 0.005 on.  Only customers with
    revenue can bring it there.
    """
    cm = customer_metrics(star).select((-F.col("total_revenue")).alias("_least"), "total_revenue", *CUSTOMER_TIEBREAK)
    base = cm.agg(F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("total")).first()
    total = base.total or 0

    def reached(t):
        return lambda rows, running: 100 * running >= (t - Decimal("0.005")) * total

    found = locate(cm.where("total_revenue > 0"), ["_least", *CUSTOMER_TIEBREAK], lambda n, s: [reached(t) for t in thresholds],
                   weight="total_revenue") if total > 0 else [None] * len(thresholds)
    first, second = thresholds
    places = [p and p.position for p in found]
    out = star.fact_orders.sparkSession.createDataFrame([(*places, base.n or None)], (
        f"customers_for_{first}pct_revenue long, customers_for_{second}pct_revenue long, total_customers long"))
    return out.withColumn("pct_of_base_for_half_revenue",
                          ratio_pct(f"customers_for_{first}pct_revenue", "total_customers", 1))


def _with_customer_margin(df: DataFrame) -> DataFrame:
    return df.withColumn("margin_pct", margin_pct("total_profit", "total_revenue"))


def top_customers(star: Star, k: int = 15) -> DataFrame:
    """Q20 - top ``k`` by revenue with revenue rank and (global) profit rank."""
    cm = customer_metrics(star).select("customer_name", "city", "state", "order_count",
                                       "total_revenue", "total_profit")
    top = cm.orderBy(F.desc("total_revenue"), *CUSTOMER_TIEBREAK).limit(k)
    # profit rank = 1 + customers with more profit: k counts in one pass, no sort of all customers
    profits = top.agg(F.array_sort(F.collect_set("total_profit"))).scalar()
    above = cm.agg(F.map_from_entries(F.array(*[F.struct(
        F.lit(i).alias("i"), F.count_if(F.col("total_profit") > F.get(profits, F.lit(i))).alias("n"))
        for i in range(k)]))).scalar()
    top = top.withColumn("profit_rank", 1 + F.element_at(
        above, (F.array_position(profits, F.col("total_profit")) - 1).cast("int")))
    return _with_customer_margin(top).select(
        F.rank().over(Window.orderBy(F.desc("total_revenue"))).alias("revenue_rank"),
        "customer_name", "city", "state", "order_count", "total_revenue", "total_profit",
        "margin_pct", "profit_rank").orderBy("revenue_rank", *CUSTOMER_TIEBREAK)


def _mean_spend(cm: DataFrame):
    """Mean customer revenue as double(exact sum) / count."""
    return cm.agg(F.sum("total_revenue").cast("double") / F.count(F.lit(1))).scalar()


def unprofitable_big_spenders(star: Star, k: int = 15) -> DataFrame:
    """Q21 - above-mean spenders with profit <= 0, top ``k`` by revenue."""
    cm = customer_metrics(star)
    mean = _mean_spend(cm)
    hits = cm.filter((F.col("total_revenue").cast("double") > mean) & (F.col("total_profit") <= 0))
    top = hits.orderBy(F.desc("total_revenue"), *CUSTOMER_TIEBREAK).limit(k)
    return _with_customer_margin(top).select(
        "customer_name", "city", "state", "order_count", "total_revenue", "total_profit",
        "margin_pct", F.round(mean, 2).alias("avg_customer_spend"))


def above_average_group(star: Star) -> DataFrame:
    """Q22 - customers above (strictly) and at/below the mean spend."""
    cm = customer_metrics(star)
    mean = _mean_spend(cm)
    grp = F.when(F.col("total_revenue").cast("double") > mean, "Above average") \
           .otherwise("At or below average")
    g = cm.groupBy(grp.alias("spend_group")).agg(
        F.count(F.lit(1)).alias("customers"),
        avg2("total_revenue").alias("avg_spend"),
        F.sum("total_revenue").alias("revenue"))
    return g.select("spend_group", "customers", "avg_spend", "revenue",
                    ratio_pct("revenue", F.sum("revenue").over(_whole()), 1).alias("pct_of_revenue"))


def ntile_artefact(star: Star, buckets: int = 5) -> DataFrame:
    """Q23 - NTILE over a heavily tied value hands equal values different
    scores.  Rows with one value occupy consecutive positions, so the lowest
    and highest score per value follow from the value histogram alone."""
    h = value_histogram_positions(customer_metrics(star), "order_count")
    lo, hi = ntile("first_rn", N, buckets), ntile("last_rn", N, buckets)
    return h.select(
        F.col("order_count").alias("actual_orders"),
        F.col("cnt").alias("customers"),
        lo.alias("lowest_ntile_score"), hi.alias("highest_ntile_score"),
        F.when(lo != hi, "SPLIT - identical behaviour scored differently")
        .otherwise("consistent").alias("ntile_verdict"),
    ).orderBy("actual_orders")


def rfm_scorecard(star: Star) -> DataFrame:
    """Q24 - the commercial shape of each RFM segment."""
    g = customer_rfm(star).groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_revenue").alias("revenue"),
        F.sum("total_profit").alias("profit"),
        avg2("total_revenue", 0).alias("avg_spend"),
        avg2("order_count", 2).alias("avg_orders"),
        avg2("days_since_last_order", 0).alias("avg_days_since_order"))
    pc, pr = _shares(g)
    return g.select("rfm_segment", "customers", pc, "revenue", pr, "profit",
                    margin_pct().alias("margin_pct"), "avg_spend", "avg_orders",
                    "avg_days_since_order").orderBy(F.desc("revenue"), "rfm_segment")


def at_risk_list(star: Star, k: int = 15, segment: str = "At Risk") -> DataFrame:
    """Q25 - the At Risk working list, top ``k`` by revenue."""
    return (customer_rfm(star).filter(F.col("rfm_segment") == segment)
            .orderBy(F.desc("total_revenue"), *CUSTOMER_TIEBREAK).limit(k)
            .select("customer_name", "city", "state", "total_revenue", "total_profit",
                    "order_count", "last_order_date", "days_since_last_order", "rfm_cell"))


def order_sequence(star: Star) -> DataFrame:
    """Q26 - order value by position in each repeat customer's history.

    Positions come from one global sort on (customer, date, order id) -
    a customer with a huge history is spread over many range partitions -
    instead of a per-customer window that would put that customer in one
    task.  LAG/LEAD are the global neighbours when they belong to the same
    customer; each customer's first position and order count are joined back
    block-wise (``group_extent``), so the hot customer stays spread out.
    """
    return star.once("order_sequence", lambda: _order_sequence(star)).orderBy("order_sequence")


def _order_sequence(star: Star) -> DataFrame:
    who = F.struct(*CUSTOMER_TIEBREAK)  # the identity itself: no hash, nulls are values
    os = order_summary(star, with_customer=True).select(
        who.alias("who"), "order_id", "order_date", "order_revenue")
    repeat = os.groupBy("who").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("who")
    os = os.join(repeat, "who", "left_semi")  # one-time customers have no sequence: not sorted
    pos = global_positions(os, ["who", "order_date", "order_id"],
                           neighbours=["who", "order_revenue", "order_date"])
    seq = (group_extent(pos, ["who"], prefix="_c")
           .withColumnRenamed("_c_rows", "lifetime_orders")
           .withColumn("seq", F.col(RN) - F.col("_c_first") + 1))
    same_prev = F.col("prev_who") == F.col("who")
    same_next = F.col("next_who") == F.col("who")
    seq = seq.select(
        "seq", "lifetime_orders", "order_revenue",
        (F.col("order_revenue") - F.when(same_prev, F.col("prev_order_revenue"))).alias("chg"),
        F.datediff(F.when(same_next, F.col("next_order_date")), F.col("order_date")).alias("gap"))
    return (seq.filter(F.col("lifetime_orders") > 1).groupBy(F.col("seq").alias("order_sequence"))
            .agg(F.count(F.lit(1)).alias("orders_at_this_sequence"),
                 avg2("order_revenue").alias("avg_order_value"),
                 avg2("chg").alias("avg_change_vs_previous"),
                 avg2("gap", 1).alias("avg_days_to_next_order"))
            .orderBy("order_sequence"))


def first_vs_latest(star: Star, band: float = 0.20) -> DataFrame:
    """Q27 - first against latest order value for repeat customers.

    One aggregation per customer: the lexicographic minimum of
    (date, -revenue) gives the first date and the largest order on it, the
    maximum of (date, revenue) the last date and the largest order on it.
    """
    os = order_summary(star, with_customer=True)
    b = os.groupBy(*CUSTOMER_TIEBREAK).agg(
        F.count(F.lit(1)).alias("orders"),
        F.min(F.struct(F.col("order_date").alias("d"), (-F.col("order_revenue")).alias("v"))).alias("f"),
        F.max(F.struct(F.col("order_date").alias("d"), F.col("order_revenue").alias("v"))).alias("l"),
    ).filter(F.col("orders") > 1).select(
        F.col("f.d").alias("first_date"), (-F.col("f.v")).alias("first_order_value"),
        F.col("l.d").alias("last_date"), F.col("l.v").alias("last_order_value"))
    up = F.lit(1 + band).cast("decimal(4,2)")
    down = F.lit(1 - band).cast("decimal(4,2)")
    p = round(band * 100)
    trend = (F.when(F.col("last_order_value") > F.col("first_order_value") * up,
                    f"Growing (>{p}% up)")
             .when(F.col("last_order_value") < F.col("first_order_value") * down,
                   f"Declining (>{p}% down)")
             .otherwise(f"Stable (within +/-{p}%)"))
    return (b.groupBy(trend.alias("spend_trend")).agg(
        F.count(F.lit(1)).alias("customers"),
        avg2("first_order_value").alias("avg_first_order"),
        avg2("last_order_value").alias("avg_latest_order"),
        avg2(F.datediff("last_date", "first_date"), 0).alias("avg_days_between"))
        .orderBy(F.desc("customers"), "spend_trend"))


def top3_per_state(star: Star, k: int = 3) -> DataFrame:
    """Q28 - exactly ``k`` customers per state by revenue (ROW_NUMBER)."""
    w = Window.partitionBy("state").orderBy(F.desc("total_revenue"), "customer_name", "city")
    return (customer_metrics(star).withColumn("rank_in_state", F.row_number().over(w))
            .filter(F.col("rank_in_state") <= k)
            .select("state", "rank_in_state", "customer_name", "city", "order_count",
                    "total_revenue", "total_profit")
            .orderBy("state", "rank_in_state"))
