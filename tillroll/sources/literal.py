"""Literal text rows -> staging DataFrame (the seed-loader format).

Used for small hand-made fixtures (tests): every value is text, exactly as
the staging layer stores it, so the detection and cleaning jobs see the same
shapes as from a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.staging import (RAW_DETAILS_COLUMNS, RAW_ORDERS_COLUMNS,
                                      RAW_TARGET_COLUMNS, Staging, text_schema)


def text_rows(spark: SparkSession, rows, names) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], text_schema(names))


def staging_from_rows(spark: SparkSession, orders, details, targets) -> Staging:
    return Staging(text_rows(spark, orders, RAW_ORDERS_COLUMNS),
                   text_rows(spark, details, RAW_DETAILS_COLUMNS),
                   text_rows(spark, targets, RAW_TARGET_COLUMNS))
