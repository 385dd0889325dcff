"""Shared column expressions: fiscal periods, text dates, exact rounding."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.dates import (fiscal_half, fiscal_quarter_label, fiscal_year,
                                      parse_day_first, parse_month_label)
from tillroll.functions.measures import avg2, per, ratio_pct


def test_fiscal_periods_april_start(spark):
    rows = [(dt.date(2018, 4, 1),), (dt.date(2018, 9, 30),), (dt.date(2018, 10, 1),),
            (dt.date(2018, 12, 31),), (dt.date(2019, 1, 1),), (dt.date(2019, 3, 31),),
            (dt.date(1999, 6, 1),)]
    df = spark.createDataFrame(rows, "d date").select(
        "d", fiscal_quarter_label("d").alias("q"), fiscal_year("d").alias("fy"),
        fiscal_half("d").alias("h"))
    got = {r.d: (r.q, r.fy, r.h) for r in df.collect()}
    assert got[dt.date(2018, 4, 1)] == ("FY19 Q1", 2019, 1)
    assert got[dt.date(2018, 9, 30)] == ("FY19 Q2", 2019, 1)
    assert got[dt.date(2018, 10, 1)] == ("FY19 Q3", 2019, 2)
    assert got[dt.date(2018, 12, 31)] == ("FY19 Q3", 2019, 2)
    assert got[dt.date(2019, 1, 1)] == ("FY19 Q4", 2019, 2)
    assert got[dt.date(2019, 3, 31)] == ("FY19 Q4", 2019, 2)
    assert got[dt.date(1999, 6, 1)] == ("FY00 Q1", 2000, 1)


def test_text_dates(spark):
    df = spark.createDataFrame(
        [("Apr-18", "01-04-2018"), ("Jan-75", "31-02-2018"), ("Dec-69", " 15-05-2018 "),
         ("Foo-18", "2018-04-01"), ("Apr-2018", None)], "m string, d string")
    got = df.select(parse_month_label("m").alias("m"), parse_day_first("d").alias("d")).collect()
    assert got[0].m == dt.date(2018, 4, 1) and got[0].d == dt.date(2018, 4, 1)
    assert got[1].m == dt.date(1975, 1, 1) and got[1].d is None       # 70-99 -> 19xx; no Feb 31
    assert got[2].m == dt.date(2069, 12, 1) and got[2].d == dt.date(2018, 5, 15)
    assert got[3].m is None and got[3].d is None
    assert got[4].m is None and got[4].d is None


def test_ratio_rounds_exact_half_away_from_zero(spark):
    df = spark.createDataFrame(
        [(Decimal("49995.0000"), Decimal("100000.0000")),    # 49.995 -> 50.00
         (Decimal("-125.0000"), Decimal("100000.0000")),     # -0.125 -> -0.13
         (Decimal("1.0000"), Decimal("3.0000")),             # 33.333.. -> 33.33
         (Decimal("2.0000"), Decimal("3.0000")),             # 66.666.. -> 66.67
         (Decimal("1.0000"), Decimal("0.0000"))],            # NULL, not an error
        "n decimal(18,4), d decimal(18,4)")
    got = [r.p for r in df.select(ratio_pct("n", "d").alias("p")).collect()]
    assert got == [50.0, -0.13, 33.33, 66.67, None]
    one_dp = df.limit(1).select(ratio_pct(F.lit(1), F.lit(2000), 1).alias("p")).collect()[0].p
    assert one_dp == 0.1                                     # 0.05 -> 0.1


def test_exact_averages(spark):
    # 206403.765 is an exact half-cent: a double would store 206403.76499... and round down
    df = spark.createDataFrame([(Decimal("412807.5300"), 2)], "s decimal(18,4), n long")
    assert float(df.select(per("s", "n").alias("a")).collect()[0].a) == 206403.77
    vals = spark.createDataFrame([(Decimal("0.0050"),), (Decimal("0.0100"),)], "x decimal(18,4)")
    assert float(vals.agg(avg2("x", 2).alias("a")).collect()[0].a) == 0.01   # 0.0075 -> 0.01
