"""A1-A9 on a stored model as it reads back, in one query: what a load must pass to be published.

For the model that the analysis jobs read, the expected side is the source tables themselves,
counted without the load's joins: lines, quantity and
revenue from the line table alone, the cost from quantities added up by part, orders from the order table,
identities from the customers that ordered.  Each stored table is read
once, the lines a second time (one column) for the fan-out check, which counts each side by
order before they meet (in a bucketed model without a shuffle).  The cost is added up by line where the parts are few
enough to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.joins import fits_broadcast, joined_rows
from tillroll.sources.staging import Staging
from tillroll.sources.tables import MONEY, PROFIT_COST_FACTOR, Star, line_amount, line_scan, read_table

# Names of the load assertions, in run order (fixed values).
ROW_COUNTS, REVENUE, PROFIT, QUANTITY, FANOUT, DATES, CATEGORIES, IDENTITY, UNTRIMMED = (
    "row counts preserved", "revenue preserved", "profit preserved", "quantity preserved", "no join fan-out on orders",
    "dates parsed and in range", "target categories match order categories", "customer identity is unique per location",
    "no untrimmed text remains")


def _n(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: what the source holds of everything that a load must preserve."""
    lines = line_scan(spark, sf_dir)
    measured = {"n": F.lit(1).cast("long"), "quantity": F.col("l_quantity").cast("int"), "units": F.col("l_quantity").cast("decimal(6,0)"),
                "amount": line_amount(F.col("l_extendedprice"), F.col("l_discount"))}
    retail = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(8,2)").alias("retail"))
    cost = F.lit(PROFIT_COST_FACTOR) * F.col("units") * F.col("retail")
    if fits_broadcast(retail):  # each line meets its price; otherwise lines are added up by part before they do
        priced = lines.select("l_partkey", *[c.alias(n) for n, c in measured.items()]).join(
            F.broadcast(retail), F.col("l_partkey") == F.col("p_partkey"), "left")
    else:
        by_part = lines.groupBy("l_partkey").agg(*[F.sum(c).alias(n) for n, c in measured.items()])
        priced = by_part.join(retail, by_part.l_partkey == retail.p_partkey, "left")
    totals = priced.agg(
        F.sum("n").alias("lines"), F.sum("amount").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum(cost).alias("cost"))
    orders, customer = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    buyers = customer.join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    identities = buyers.select("c_name", "c_nationkey", "c_mktsegment").distinct()
    return totals.select("lines", "revenue", "quantity", (F.col("revenue") - F.col("cost")).alias("profit"),
                         _n(orders).alias("orders"), _n(identities).alias("identities"))


def staged_totals(stg: Staging) -> DataFrame:
    """The same of the text staging tables."""
    number = lambda c, kind: F.sum(F.trim(c).try_cast(kind))
    who = stg.raw_orders.select(*[F.trim(c) for c in ("customer_name", "state", "city")]).distinct()
    return stg.raw_order_details.agg(
        F.count(F.lit(1)).alias("lines"), number("amount", MONEY).alias("revenue"), number("quantity", "int").alias("quantity"),
        number("profit", MONEY).alias("profit")).select("*", _n(stg.raw_orders).alias("orders"), _n(who).alias("identities"))


def padded(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c) != F.trim(F.col(c)), F.lit(False))
    return out


def audit_model(source: DataFrame, model: Star, start: str, end: str) -> DataFrame:
    """(assertion, result, expected, found): nine rows."""
    lines, orders, people = model.fact_order_lines, model.fact_orders, model.dim_customer
    stored = lines.agg(F.count(F.lit(1)).alias("m_lines"), F.sum("amount").alias("m_revenue"),
                       F.sum("profit").alias("m_profit"), F.sum("quantity").alias("m_quantity"))
    headers = orders.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("inside"))
    dimension = people.agg(F.count(F.lit(1)).alias("n"), F.count_if(padded("customer_name", "state", "city")).alias("padded"))
    keys = _n(people.select("customer_id").distinct())
    joined = joined_rows(lines, orders)
    known = model.dim_sub_category.select("category").where("category IS NOT NULL").distinct()
    strange = _n(model.fact_sales_target.where("category IS NOT NULL").join(known, "category", "left_anti"))
    def field(df: DataFrame, name: str) -> Column:
        return df.select(name).scalar()

    both = source.select("*", *[field(stored, c).alias(c) for c in stored.columns],
                         field(headers, "n").alias("m_orders"), field(headers, "inside").alias("m_inside"),
                         field(dimension, "n").alias("m_people"), field(dimension, "padded").alias("m_padded"),
                         keys.alias("m_keys"), joined.alias("m_joined"), strange.alias("m_strange"))
    text = lambda *cs: F.concat_ws(" / ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cs])
    zero = F.lit("0")
    rows = [(ROW_COUNTS, text("orders", "lines"), text("m_orders", "m_lines")), (REVENUE, text("revenue"), text("m_revenue")),
            (PROFIT, text("profit"), text("m_profit")), (QUANTITY, text("quantity"), text("m_quantity")),
            (FANOUT, text("m_lines"), text("m_joined")), (DATES, text("m_orders"), text("m_inside")), (CATEGORIES, zero, text("m_strange")),
            (IDENTITY, text("identities", "identities"), text("m_people", "m_keys")), (UNTRIMMED, zero, text("m_padded"))]
    made = F.array(*[F.struct(F.lit(a).alias("assertion"), F.when(e == f, "PASS").otherwise("FAIL").alias("result"),
                              e.alias("expected"), f.alias("found")) for a, e, f in rows])
    return both.select(F.inline(made))
