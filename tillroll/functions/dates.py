"""Calendar expressions: months, fiscal periods, text-date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.measures import col


def month_start(d: str | Column) -> Column:
    """First day of the month as a DATE (never a text label)."""
    return F.trunc(col(d), "MM")


def month_label(d: str | Column) -> Column:
    """'Apr 2018' style display label."""
    return F.date_format(col(d), "MMM yyyy")


def fiscal_shift(d: str | Column, fiscal_start_month: int) -> Column:
    """Date moved so that the fiscal year starts in January."""
    return F.add_months(col(d), -(fiscal_start_month - 1))


def fiscal_year(d: str | Column, fiscal_start_month: int = 4) -> Column:
    """Fiscal year named after the calendar year in which it ends."""
    shifted = fiscal_shift(d, fiscal_start_month)
    return F.year(shifted) + (1 if fiscal_start_month > 1 else 0)


def fiscal_quarter(d: str | Column, fiscal_start_month: int = 4) -> Column:
    return F.quarter(fiscal_shift(d, fiscal_start_month))


def fiscal_quarter_label(d: str | Column, fiscal_start_month: int = 4) -> Column:
    """'FY19 Q1': two-digit fiscal year plus fiscal quarter."""
    fy = fiscal_year(d, fiscal_start_month)
    return F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0"),
                    F.lit(" Q"), fiscal_quarter(d, fiscal_start_month).cast("string"))


def fiscal_half(d: str | Column, fiscal_start_month: int = 4) -> Column:
    """1 for the first six months of the fiscal year, 2 for the rest."""
    return F.when(F.month(fiscal_shift(d, fiscal_start_month)) <= 6, 1).otherwise(2)


def parse_day_first(text: str | Column) -> Column:
    """'dd-mm-yyyy' text to DATE; NULL (not an error) when unparseable."""
    return F.try_to_date(F.trim(col(text)), "dd-MM-yyyy")


def parse_month_label(text: str | Column) -> Column:
    """'Apr-18' text to the first day of that month.

    Two-digit years follow the database convention of the original load:
    70-99 are 1970-1999 and 00-69 are 2000-2069 (Spark's own ``yy`` would put
    every year in 2000-2099).
    """
    t = F.trim(col(text))
    mon = F.month(F.try_to_date(F.concat(F.lit("01-"), F.substring_index(t, "-", 1),
                                         F.lit("-2000")), "dd-MMM-yyyy"))
    yy = F.substring_index(t, "-", -1).try_cast("int")
    year = F.when(yy >= 70, yy + 1900).otherwise(yy + 2000)
    ok = mon.isNotNull() & yy.isNotNull() & (F.length(F.substring_index(t, "-", -1)) == 2)
    return F.when(ok, F.make_date(year, mon, F.lit(1)))


def day_name(d: str | Column) -> Column:
    """Full weekday name ('Sunday'); Spark's dayname() gives 'Sun'."""
    return F.date_format(col(d), "EEEE")
