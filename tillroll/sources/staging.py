"""The text staging layer.

The original pipeline loads three source files into all-text staging tables
and does every cast explicitly afterwards.  Here the staging tables are a
text rendering of the driver tables in the same shapes:

raw_orders          order_id, order_date 'dd-mm-yyyy', customer_name, state, city
raw_order_details   order_id, amount, profit, quantity, category, sub_category
raw_sales_target    month_of_order_date 'Mon-yy', category, target

Every column is a string; nothing is filtered or repaired here (raw stays
raw).  ``read_text_csv`` is the file reader of the original loads: explicit
all-string schema, header row, no inference, wholly blank rows dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.tables import category_of

RAW_ORDERS_COLUMNS = ("order_id", "order_date", "customer_name", "state", "city")
RAW_DETAILS_COLUMNS = ("order_id", "amount", "profit", "quantity", "category", "sub_category")
RAW_TARGET_COLUMNS = ("month_of_order_date", "category", "target")

# Header names of the original source files (fixed values).
ORDERS_CSV_HEADER = ("Order ID", "Order Date", "CustomerName", "State", "City")
TARGET_CSV_HEADER = ("Month of Order Date", "Category", "Target")


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


@dataclass(frozen=True)
class Staging:
    raw_orders: DataFrame
    raw_order_details: DataFrame
    raw_sales_target: DataFrame


# The defect layer: faults that the profiling checks and the load look for, put into the text
# of whole orders by their number (modulus, remainder).  The driver tables have
# none, and a check that finds nothing proves nothing.
MISPLACED, PADDED, RESPELT = (167, 8), (89, 4), (131, 6)          # state
IMPOSSIBLE_DATE, NAMELESS = (173, 5), (211, 3)                     # order_date, customer_name
WORDY_AMOUNT, NO_PROFIT, WORDY_QUANTITY, NO_QUANTITY = (179, 7), (193, 2), (197, 4), (223, 6)  # lines
REPEATED = (199, 9)                                                # every line of the order twice
UNKNOWN_STATE, BAD_DAY, BAD_AMOUNT, BAD_QUANTITY, BAD_TARGET = "ATLANTIS", "31-02", "abc", "x", "n/a"
#: Month and category of the targets that are no numbers.
WORDY_TARGET = ("Dec", "bolt")


def _hit(rule) -> Column:
    return F.pmod(F.col("order_id").cast("long"), F.lit(rule[0])) == rule[1]


def with_defects(stg: Staging) -> Staging:
    """Staging with faults; where several rules name one field, the first applies."""
    orders = stg.raw_orders.withColumns({
        "state": F.when(_hit(MISPLACED), F.lit(UNKNOWN_STATE)).when(_hit(PADDED), F.concat("state", F.lit(" ")))
        .when(_hit(RESPELT), F.lower("state")).otherwise(F.col("state")),
        "order_date": F.when(_hit(IMPOSSIBLE_DATE), F.concat(F.lit(BAD_DAY), F.substring("order_date", 6, 5))).otherwise(F.col("order_date")),
        "customer_name": F.when(_hit(NAMELESS), F.lit("")).otherwise(F.col("customer_name"))})
    lines = stg.raw_order_details.withColumns({
        "amount": F.when(_hit(WORDY_AMOUNT), F.lit(BAD_AMOUNT)).otherwise(F.col("amount")),
        "profit": F.when(~_hit(NO_PROFIT), F.col("profit")),
        "quantity": F.when(_hit(WORDY_QUANTITY), F.lit(BAD_QUANTITY)).when(_hit(NO_QUANTITY), F.lit("0")).otherwise(F.col("quantity"))})
    copies = F.when(_hit(REPEATED), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = lines.withColumn("copy", F.explode(copies)).drop("copy")
    bad = F.col("month_of_order_date").startswith(f"{WORDY_TARGET[0]}-") & (F.col("category") == WORDY_TARGET[1])
    targets = stg.raw_sales_target.withColumn("target", F.when(bad, F.lit(BAD_TARGET)).otherwise(F.col("target")))
    return Staging(orders, lines, targets)


def staging_from_star(star, defects: bool = False) -> Staging:
    """The text staging tables rendered from an (already built) star, with the defect layer if asked for."""
    o = star.orders_with_customer()
    raw_orders = o.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.date_format("order_date", "dd-MM-yyyy").alias("order_date"),
        "customer_name", "state", "city")
    ln = star.fact_order_lines
    raw_details = ln.select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("amount").cast("string").alias("amount"),
        F.col("profit").cast("string").alias("profit"),
        F.col("quantity").cast("string").alias("quantity"),
        category_of(F.col("sub_category")).alias("category"),
        F.col("sub_category").alias("sub_category"))
    t = star.fact_sales_target
    raw_target = t.select(F.date_format("target_month", "MMM-yy").alias("month_of_order_date"),
                          "category", F.col("target_amount").cast("string").alias("target"))
    stg = Staging(raw_orders, raw_details, raw_target)
    return with_defects(stg) if defects else stg


#: What a quoted empty field reads as, before it becomes an empty text; an unquoted one has no value.
_EMPTY = "\x1a"
_LINE = "_malformed"


def read_csv_lines(spark: SparkSession, path: str, header_names, names, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of a CSV file as all-text columns, from one read.

    A line with too few or too many fields is no row: it is listed whole in ``malformed`` (column ``line``).
    Rows that are wholly blank are dropped.  The header names are checked: a file with other or swapped
    columns is an error; ``header=False`` reads a file without one.
    """
    schema = text_schema(header_names).add(_LINE, T.StringType())
    df = (spark.read.schema(schema)
          .option("header", header).option("enforceSchema", not header).option("columnPruning", False)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).option("emptyValue", _EMPTY)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path)).toDF(*names, _LINE)
    rows = df.where(F.col(_LINE).isNull()).drop(_LINE).dropna(how="all")
    rows = rows.select(*[F.when(F.col(c) == _EMPTY, F.lit("")).otherwise(F.col(c)).alias(c) for c in names])
    # Spark refuses a read of the line alone: the second condition, always true, has the first field read as well
    malformed = F.col(_LINE).isNotNull() & (F.length(F.concat_ws("", F.col(names[0]))) >= 0)
    return rows, df.where(malformed).select(F.col(_LINE).alias("line"))


def read_text_csv(spark: SparkSession, path: str, header_names, names) -> DataFrame:
    """The rows of a headed CSV file (``read_csv_lines``)."""
    return read_csv_lines(spark, path, header_names, names)[0]


def write_text_csv(df: DataFrame, path: str, header_names) -> None:
    (df.toDF(*header_names).write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


# Orders whose line is cut and orders whose line has a field too many, in the file that shows malformed lines.
CUT_LINE, LONG_LINE = (227, 1), (229, 2)


def write_broken_csv(raw_orders: DataFrame, path: str) -> None:
    """The staged orders as CSV lines without a header, some of them malformed."""
    fields = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in RAW_ORDERS_COLUMNS[:-1]])
    line = F.when(_hit(CUT_LINE), fields).when(_hit(LONG_LINE), F.concat_ws(",", fields, "city", F.lit("more"))).otherwise(
        F.concat_ws(",", fields, "city"))
    raw_orders.select(line.alias("value")).write.mode("overwrite").text(path)
