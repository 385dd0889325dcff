"""Staging -> modelled layer (T1-T5).

Every cast is a ``try_*`` cast: Spark's ANSI mode would abort the whole job
on one bad value, while the load must keep going.  T1-T5 are the projections as such, with
NULL for text that does not parse; a load takes the rows of ``accepted`` and
lists all others, with their reasons, in a quarantine table (``quarantined``).  Text is trimmed on the way in;
nothing is de-duplicated except the dimensions, which are DISTINCT by
definition.  Lines carry no surrogate key: a DataFrame needs none, and the
rows are never de-duplicated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.dates import parse_day_first, parse_month_label
from tillroll.operators.joins import broadcast_checked
from tillroll.sources.staging import Staging
from tillroll.sources.tables import IDENTITY, MONEY, TARGET_MONEY, Star, customer_key


def build_dim_sub_category(stg: Staging) -> DataFrame:
    """T1 - distinct trimmed (sub_category, category)."""
    d = stg.raw_order_details
    return d.select(F.trim("sub_category").alias("sub_category"),
                    F.trim("category").alias("category")).distinct()


#: Text comparison of the original database: case and accents do not count.
ANY_CASE = "UNICODE_CI_AI"


def collated(c: str | Column, collation: str | None) -> Column:
    """Trimmed text, compared byte by byte or by a collation."""
    text = F.trim(c)
    return text if collation is None else F.collate(text, collation)


def build_dim_customer(stg: Staging, collation: str | None = None) -> DataFrame:
    """T2 - distinct trimmed (name, state, city) with a content key.

    Under a collation, identities that it holds equal are one customer, stored in the first of their
    spellings (byte order).
    """
    o = stg.raw_orders.select(*[F.trim(c).alias(c) for c in IDENTITY])
    if collation is None:
        d = o.distinct()
    else:
        d = o.distinct().groupBy(*[F.collate(c, collation).alias(f"_{c}") for c in IDENTITY]).agg(
            F.min(F.struct(*IDENTITY)).alias("who")).select("who.*")
    return d.select(customer_key(*IDENTITY).alias("customer_id"), *IDENTITY)


def build_fact_orders(stg: Staging, collation: str | None = None) -> DataFrame:
    """T3 - order headers: trimmed id, customer key, parsed date.

    The customer key is computed from the same trimmed triple the dimension
    is keyed on, so no join to the dimension is needed and none can fan out.
    Under a collation it is the key of the spelling that the dimension has stored: identities
    are few, so spellings meet their dimension row first, once each.
    """
    o = stg.raw_orders
    if collation is not None:
        dim = build_dim_customer(stg, collation).alias("d")
        spelt = o.select(*[F.trim(c).alias(c) for c in IDENTITY]).distinct().alias("s")
        same = [F.collate(F.col(f"s.{c}"), collation).eqNullSafe(F.collate(F.col(f"d.{c}"), collation)) for c in IDENTITY]
        keys = spelt.join(dim, same).select(*[F.col(f"s.{c}").alias(f"_{c}") for c in IDENTITY], "customer_id")
        return o.join(keys, [F.trim(o[c]).eqNullSafe(keys[f"_{c}"]) for c in IDENTITY]).select(
            F.trim("order_id").alias("order_id"), "customer_id", parse_day_first("order_date").alias("order_date"))
    return o.select(
        F.trim("order_id").alias("order_id"),
        customer_key(F.trim("customer_name"), F.trim("state"), F.trim("city")).alias("customer_id"),
        parse_day_first("order_date").alias("order_date"))


def build_fact_lines(stg: Staging, money: str = MONEY) -> DataFrame:
    """T4 - typed order lines; the category is dropped (it lives in T1)."""
    d = stg.raw_order_details
    return d.select(
        F.trim("order_id").alias("order_id"),
        F.trim("sub_category").alias("sub_category"),
        F.trim("amount").try_cast(money).alias("amount"),
        F.trim("profit").try_cast(money).alias("profit"),
        F.trim("quantity").try_cast("int").alias("quantity"))


def build_fact_target(stg: Staging, money: str = TARGET_MONEY) -> DataFrame:
    """T5 - 'Apr-18' -> 2018-04-01, target cast to money."""
    t = stg.raw_sales_target
    return t.select(
        parse_month_label("month_of_order_date").alias("target_month"),
        F.trim("category").alias("category"),
        F.trim("target").try_cast(money).alias("target_amount"))


def star_from_staging(stg: Staging) -> Star:
    """The modelled layer built the way the original load builds it."""
    return Star(build_dim_customer(stg), build_dim_sub_category(stg), build_fact_orders(stg),
                build_fact_lines(stg), build_fact_target(stg))


# ---- rows that a load rejects

def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def reject_rules(money: str = MONEY, target_money: str = TARGET_MONEY) -> dict[str, list[tuple[str, Column]]]:
    """Why a row of a staging table cannot become a row of the model: (reason, condition), in the order they are listed."""
    return {
        "raw_orders": [("order_id is missing", _blank("order_id")),
                       ("order_date is no date", parse_day_first("order_date").isNull())],
        "raw_order_details": [("order_id is missing", _blank("order_id")), ("sub_category is missing", _blank("sub_category")),
                              ("amount is no number", F.trim("amount").try_cast(money).isNull()),
                              ("profit is no number", F.trim("profit").try_cast(money).isNull()),
                              ("quantity is no whole number", F.trim("quantity").try_cast("int").isNull())],
        "raw_sales_target": [("month_of_order_date is no month", parse_month_label("month_of_order_date").isNull()),
                             ("category is missing", _blank("category")),
                             ("target is no number", F.trim("target").try_cast(target_money).isNull())],
    }


#: Reason of a line whose own fields are good.
ORDER_REJECTED = "its order is rejected"
REASONS = "_reasons"


def judged(stg: Staging) -> Staging:
    """The staging tables with the reasons against each row (empty: accepted).

    Orders that are rejected take their lines with them.
    """
    def with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
        return df.withColumn(REASONS, F.array_compact(F.array(*[F.when(condition, F.lit(reason)) for reason, condition in rules])))

    rules = reject_rules()
    orders = with_reasons(stg.raw_orders, rules["raw_orders"])
    lines = with_reasons(stg.raw_order_details, rules["raw_order_details"])
    gone = (orders.where(F.size(REASONS) > 0).select(F.trim("order_id").alias("_order")).where("_order <> ''").distinct()
            .withColumn("_gone", F.lit(True)))
    gone = broadcast_checked(gone)  # no shuffle of the lines while few orders are rejected
    lines = lines.join(gone, F.trim(lines.order_id) == gone["_order"], "left").withColumn(
        REASONS, F.when(F.col("_gone"), F.array_append(REASONS, F.lit(ORDER_REJECTED))).otherwise(F.col(REASONS))).drop("_order", "_gone")
    return Staging(orders, lines, with_reasons(stg.raw_sales_target, rules["raw_sales_target"]))


def accepted(marked: Staging, seen: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> Staging:
    """The rows of a judged staging that a load takes; ``seen`` may watch each table's rows before the others go."""
    def good(name: str) -> DataFrame:
        return seen(name, getattr(marked, name)).where(F.size(REASONS) == 0).drop(REASONS)
    return Staging(good("raw_orders"), good("raw_order_details"), good("raw_sales_target"))


#: What stands for a field without a value in the text of a row.
NULL_TEXT = "\\N"


def row_text(columns: list[str]) -> Column:
    """The fields as one text; a missing value is told from an empty one."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT)) for c in columns])


def quarantined(marked: Staging) -> DataFrame:
    """(table_name, entity_key, reasons, row): every rejected row of a judged staging, in full."""
    def bad(name: str, key: Column) -> DataFrame:
        df = getattr(marked, name)
        columns = [c for c in df.columns if c != REASONS]
        return df.where(F.size(REASONS) > 0).select(F.lit(name).alias("table_name"), key.alias("entity_key"),
                                                    F.array_join(REASONS, "; ").alias("reasons"), row_text(columns).alias("row"))
    return (bad("raw_orders", F.col("order_id")).unionByName(bad("raw_order_details", F.col("order_id")))
            .unionByName(bad("raw_sales_target", F.concat_ws(" ", "month_of_order_date", "category"))))


def reject_counts(quarantine: DataFrame) -> DataFrame:
    """(table_name, reason, rejected_rows); a row with several reasons counts under each."""
    return (quarantine.select("table_name", F.explode(F.split("reasons", "; ")).alias("reason"))
            .groupBy("table_name", "reason").agg(F.count(F.lit(1)).alias("rejected_rows")))
