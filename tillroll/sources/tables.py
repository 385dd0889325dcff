"""Driver tables -> typed star schema.

The driver ships TPC-H-like Parquet tables.  They are mapped onto the retail
model as follows (values are exact decimals all the way):

=================  ====================================================
order line         lineitem joined to part on the part key
amount             extended price (2 dp) * (1 - discount (2 dp))
profit             amount - 2 * quantity * retail price
sub-category       part name; category = its last word
order              orders row; order date = order timestamp as DATE
customer identity  (customer name, nation name, nation/segment) - the
                   composite identity of the model: name, state, city
target             revenue of the same month and category twelve months
                   earlier, rounded to cents
=================  ====================================================

Nothing is filtered: every order, line and customer takes part.  The two
fact-to-dimension joins (lines to parts, orders to customers) broadcast a dimension of
bounded size whole and are skew-split beyond it: keys holding a large share of the fact rows take a bounded broadcast path,
the rest a shuffle join (``operators.joins``).  Otherwise no join is hinted;
Spark's planner (and AQE at runtime) broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.dates import month_start
from tillroll.operators.joins import skew_split_join

# Fixed mapping constants (the test-table <-> retail-model contract).
PROFIT_COST_FACTOR = 2          # profit = amount - 2 * quantity * retail price
TARGET_LAG_MONTHS = 12          # target = same month/category one year earlier
FISCAL_START_MONTH = 4          # fiscal year runs April..March
MONEY = "decimal(18,4)"
TARGET_MONEY = "decimal(18,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The composite customer identity. Jobs group by it; the key below only links tables.
IDENTITY = ("customer_name", "state", "city")


def customer_key(name, state, city):
    """128-bit content key of the identity; a null part differs from every text (checked by A8)."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c) if isinstance(c, str) else c), F.lit(""))
             for c in (name, state, city)]
    return F.md5(F.concat_ws("\x1f", *parts))


def keyed(orders_or_people: DataFrame) -> DataFrame:
    """Adds the customer key of the identity that the rows carry."""
    return orders_or_people.withColumn("customer_id", customer_key(*IDENTITY))


def category_of(sub_category):
    return F.substring_index(sub_category, " ", -1)


def line_amount(price, discount):
    return (price.cast("decimal(12,2)") * (F.lit(1) - discount.cast("decimal(4,2)"))).cast(MONEY)


def line_profit(price, discount, quantity, retail_price):
    gross = price.cast("decimal(12,2)") * (F.lit(1) - discount.cast("decimal(4,2)"))
    cost = F.lit(PROFIT_COST_FACTOR) * quantity.cast("decimal(6,0)") * retail_price.cast("decimal(8,2)")
    return (gross - cost).cast(MONEY)


@dataclass(frozen=True)
class Star:
    """The modelled layer: two dimensions, two facts and the target table."""

    dim_customer: DataFrame        # customer_id, customer_name, state, city
    dim_sub_category: DataFrame    # sub_category, category
    fact_orders: DataFrame         # order_id, customer_id, order_date
    fact_order_lines: DataFrame    # order_id, sub_category, amount, profit, quantity
    fact_sales_target: DataFrame   # target_month, category, target_amount
    orders_wide: DataFrame | None = None  # fact_orders + customer attributes
    line_inputs: DataFrame | None = None  # raw inputs of fact_order_lines (line_measures)
    order_inputs: DataFrame | None = None  # orders_wide before its customer key (keyed)
    line_scan: DataFrame | None = None    # the scan behind line_inputs: its size sizes the model
    order_values: DataFrame | None = None  # stored line measures per order
    dated_orders: DataFrame | None = None  # both, stored by month_start
    kept: Callable | None = None          # (name, build) -> result, written once per model

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """``build()``, from storage where the model is stored."""
        return build() if self.kept is None else self.kept(name, build)

    def orders_with_customer(self) -> DataFrame:
        """fact_orders joined to dim_customer (order grain, no fan-out)."""
        if self.orders_wide is not None:
            return self.orders_wide
        return self.fact_orders.join(self.dim_customer, "customer_id")

    def lines_with_category(self) -> DataFrame:
        return self.fact_order_lines.join(self.dim_sub_category, "sub_category")


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the line table that the model reads."""
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")


def source_line_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to their part, with the raw inputs of the line measures."""
    li = line_scan(spark, sf_dir)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    joined = skew_split_join(li, part, ["l_partkey"], ["p_partkey"])
    return joined.select(F.col("l_orderkey").alias("order_id"),
                         F.col("p_name").alias("sub_category"),
                         "l_extendedprice", "l_discount", "l_quantity", "p_retailprice")


def line_measures(inputs: DataFrame) -> DataFrame:
    """The line fact: exact amount, profit and quantity from the raw inputs."""
    return inputs.select(
        "order_id", "sub_category",
        line_amount(F.col("l_extendedprice"), F.col("l_discount")).alias("amount"),
        line_profit(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity"),
                    F.col("p_retailprice")).alias("profit"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def per_order_values(lines: DataFrame) -> DataFrame:
    """Line measures per order (order grain)."""
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("amount").alias("order_revenue"),
        F.sum("profit").alias("order_profit"),
        F.sum("quantity").alias("order_quantity"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_measures(source_line_inputs(spark, sf_dir))


def source_order_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order grain with the customer's composite identity attached."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    people = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        "c_custkey",
        F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("state"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("city"),
    )
    return skew_split_join(orders, people, ["o_custkey"], ["c_custkey"]).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        "customer_name", "state", "city",
    )


def source_orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the customer key."""
    return keyed(source_order_inputs(spark, sf_dir))


def sub_categories_sold(lines: DataFrame) -> DataFrame:
    """dim_sub_category: the sub-categories that occur on order lines.

    Derived from the line fact's (low-cardinality) sub-category column: map-side
    partial aggregation leaves at most one row per sub-category per task, so
    the shuffle is negligible whatever the line count.
    """
    return (lines.select("sub_category").distinct()
            .withColumn("category", category_of(F.col("sub_category"))))


def targets_from_history(fact_orders: DataFrame, lines_cat: DataFrame,
                         lag_months: int = TARGET_LAG_MONTHS) -> DataFrame:
    """Targets = revenue of the same month and category ``lag_months`` earlier."""
    per_order = lines_cat.groupBy("order_id", "category").agg(F.sum("amount").alias("rev"))
    monthly = (per_order.join(fact_orders, "order_id")
               .groupBy(month_start("order_date").alias("m"), "category")
               .agg(F.sum("rev").alias("rev")))
    return monthly.select(
        F.add_months("m", lag_months).alias("target_month"),
        "category",
        F.round("rev", 2).cast(TARGET_MONEY).alias("target_amount"),
    )


def star_from_facts(orders_wide: DataFrame, lines: DataFrame) -> Star:
    """The star around two facts: dimensions and targets are derived from them."""
    fact_orders = orders_wide.select("order_id", "customer_id", "order_date")
    dim_customer = orders_wide.select("customer_id", "customer_name", "state", "city").distinct()
    dim_sub = sub_categories_sold(lines)
    targets = targets_from_history(fact_orders, lines.join(dim_sub, "sub_category"))
    return Star(dim_customer, dim_sub, fact_orders, lines, targets, orders_wide)


def build_star(spark: SparkSession, sf_dir: str) -> Star:
    inputs, orders = source_line_inputs(spark, sf_dir), source_order_inputs(spark, sf_dir)
    star = star_from_facts(keyed(orders), line_measures(inputs))
    return replace(star, line_inputs=inputs, order_inputs=orders, line_scan=line_scan(spark, sf_dir))


# Cities that span two states (fixed values of the reference list): city, second state.
SHARED_CITIES = (("NATION_0/BUILDING", "NATION_1"),)


def geography_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, state) pairs that exist: every nation's segment cities.

    The rule table for the impossible-geography check (E2/E3); derived from
    the customer and nation tables, i.e. a reference list of places, and the
    cities that are known to span two states.
    """
    cust = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .select(F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("city"),
                    F.col("n_name").alias("state"))
            .union(spark.createDataFrame(SHARED_CITIES, "city string, state string")).distinct())
