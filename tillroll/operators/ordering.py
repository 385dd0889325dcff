"""Global orderings without a single-partition window.

``Window.orderBy(x)`` with no ``partitionBy`` gathers every row into one task.
That is harmless over a few hundred aggregated rows (months, states,
sub-categories) and fatal at customer grain.  This module computes the same
answers - ROW_NUMBER, RANK, NTILE, running sums, LAG/LEAD - in a distributed
way:

1. ``orderBy`` the rows on a *total* order (the sort key must end in a unique
   key).  Spark range-partitions the rows by sampled boundaries; because the
   key is unique, a value shared by a third of all rows is still split over
   many partitions.
2. Tag each row with its partition id and its position inside the partition
   (``monotonically_increasing_id`` = partition << 33 | local index) and
   write the result once to the shared checkpoint folder, so the range
   boundaries are fixed once and the positions survive executor loss.
3. Aggregate one summary row per partition (count, sums, first and last row
   values), take prefix sums over those P rows, and broadcast them back - P is
   bounded by the number of shuffle partitions, so the broadcast is bounded.

Running sums and neighbours need the rows of one partition in order: that is
one ``Window.partitionBy(_pid)``, i.e. one balanced shuffle of the already
range-partitioned rows.

``value_histogram_positions`` handles the case where the order key takes few
distinct values (order counts): positions follow from ``groupBy(value)``
alone, no sort at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import shared_path

PID, MID, LOCAL, RN, N = "_pid", "_mid", "_local", "_rn", "_n"


_PINNED: list[str] = []


@contextmanager
def pinned_until_written(spark: SparkSession) -> Iterator[None]:
    """Remove the orderings that are pinned inside the block when it ends."""
    before = len(_PINNED)
    yield
    while len(_PINNED) > before:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PINNED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sort_and_checkpoint(df: DataFrame, order_by: Sequence) -> DataFrame:
    """Globally sort ``df`` and pin the result: adds _pid and 0-based _local.

    The sorted rows, tagged with their partition id and position, are written
    once as a Parquet table in the shared checkpoint folder and read back, so
    the sampled range boundaries are fixed, the positions survive executor
    loss, and the sort runs in a single job (an eager ``checkpoint()`` would
    run the sorted stage twice: once to count, once to write).
    """
    spark = df.sparkSession
    tagged = df.orderBy(*[_as_col(c) for c in order_by]).select(
        "*", F.spark_partition_id().alias(PID),
        F.monotonically_increasing_id().alias(MID))
    path = shared_path(spark, "sorted")
    tagged.write.mode("overwrite").parquet(path)
    _PINNED.append(path)
    pinned = spark.read.parquet(path)
    return pinned.withColumn(LOCAL, F.col(MID) - F.shiftleft(F.col(PID).cast("bigint"), 33)).drop(MID)


def global_positions(df: DataFrame, order_by: Sequence, running: dict | None = None,
                     neighbours: Sequence[str] = ()) -> DataFrame:
    """Add _rn (1-based global position), _n (row count) and optional extras.

    ``running``    {output name: column name} -> running sum over the order
                   (ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), plus
                   ``<output name>_total``, the sum over all rows.
    ``neighbours`` column names -> ``prev_<c>`` / ``next_<c>`` (LAG/LEAD by 1
                   in the global order; NULL at the ends).
    ``order_by`` must be a total order (end it with a unique key).
    """
    running = dict(running or {})
    pinned = sort_and_checkpoint(df, order_by)

    summary_aggs = [F.count(F.lit(1)).alias("_cnt")]
    summary_aggs += [F.sum(c).alias(f"_psum_{name}") for name, c in running.items()]
    summary_aggs += [F.max_by(c, LOCAL).alias(f"_plast_{c}") for c in neighbours]
    summary_aggs += [F.min_by(c, LOCAL).alias(f"_pfirst_{c}") for c in neighbours]
    summary = pinned.groupBy(PID).agg(*summary_aggs)

    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    by_pid = Window.orderBy(PID)
    cols = [PID, "_cnt",
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
            F.sum("_cnt").over(everything).alias(N)]
    cols += [F.sum(f"_psum_{name}").over(before).alias(f"_poff_{name}") for name in running]
    cols += [F.sum(f"_psum_{name}").over(everything).alias(f"{name}_total") for name in running]
    cols += [F.lag(f"_plast_{c}").over(by_pid).alias(f"_pprev_{c}") for c in neighbours]
    cols += [F.lead(f"_pfirst_{c}").over(by_pid).alias(f"_pnext_{c}") for c in neighbours]
    # P rows (one per non-empty partition of the sort): bounded, safe to broadcast.
    offsets = summary.select(*cols)

    out = pinned.join(F.broadcast(offsets), PID)
    out = out.withColumn(RN, F.col("_off") + F.col(LOCAL) + 1)
    if running or neighbours:
        in_part = Window.partitionBy(PID).orderBy(LOCAL)
        upto = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, c in running.items():
            base = F.coalesce(F.col(f"_poff_{name}"), F.lit(0).cast(out.schema[c].dataType))
            out = out.withColumn(name, base + F.sum(c).over(upto))
        for c in neighbours:
            out = out.withColumn(f"prev_{c}", F.when(F.col(LOCAL) == 0, F.col(f"_pprev_{c}"))
                                 .otherwise(F.lag(c).over(in_part)))
            out = out.withColumn(f"next_{c}", F.when(F.col(LOCAL) == F.col("_cnt") - 1,
                                                      F.col(f"_pnext_{c}"))
                                 .otherwise(F.lead(c).over(in_part)))
    drop = [c for c in out.columns if c.startswith(("_off", "_poff_", "_pprev_", "_pnext_"))]
    return out.drop(*drop, "_cnt", LOCAL, PID)


def ntile(rn: str | Column, n: str | Column, buckets: int) -> Column:
    """NTILE(buckets) from a 1-based row number and the row count.

    Same rule as the SQL window function: the first ``n % buckets`` buckets
    hold one row more than the others.
    """
    rn, n = _as_col(rn).cast("bigint"), _as_col(n).cast("bigint")
    k = F.lit(buckets).cast("bigint")
    q = F.floor(n / k).cast("bigint")
    r = n - q * k
    big = r * (q + 1)
    in_big = F.floor((rn + q) / (q + 1)).cast("bigint")             # ceil(rn / (q+1))
    in_small = r + F.floor((rn - big + q - 1) / q).cast("bigint")   # r + ceil((rn-big)/q)
    return F.when(rn <= big, in_big).otherwise(in_small).cast("bigint")


BLOCK_ROWS = 1 << 20


def group_extent(df_with_rn: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS,
                 prefix: str = "_g") -> DataFrame:
    """Attach ``<prefix>_first``, ``<prefix>_last`` (positions) and
    ``<prefix>_rows`` of each row's group, for groups that are contiguous in
    the global order (the sort key starts with the group key).

    The summary is one pre-aggregated row per group.  Joining it back on the
    key alone would send a group holding a third of all rows to one task, so
    rows are matched on (key, position // block_rows) and each summary row is
    replicated once per block its group spans: a hot group is spread over
    ``rows / block_rows`` tasks, and the replication adds at most one row per
    group plus one per block.
    """
    keys = list(keys)
    b = F.lit(block_rows).cast("bigint")
    ext = df_with_rn.groupBy(*keys).agg(F.min(RN).alias(f"{prefix}_first"),
                                        F.max(RN).alias(f"{prefix}_last"),
                                        F.count(F.lit(1)).alias(f"{prefix}_rows"))
    blk = "_blk"
    ext = ext.withColumn(blk, F.explode(F.sequence(F.floor(F.col(f"{prefix}_first") / b),
                                                   F.floor(F.col(f"{prefix}_last") / b))))
    rows = df_with_rn.withColumn(blk, F.floor(F.col(RN) / b))
    return rows.join(ext, [*keys, blk]).drop(blk)


def rank_by(df_with_rn: DataFrame, value_cols: Sequence[str], name: str = "rank") -> DataFrame:
    """RANK: the first position among rows sharing the ordering value (the
    order must start with ``value_cols``, so equal values are contiguous)."""
    out = group_extent(df_with_rn, value_cols, prefix="_v")
    return out.withColumnRenamed("_v_first", name).drop("_v_last", "_v_rows")


def value_histogram_positions(df: DataFrame, value: str) -> DataFrame:
    """(value, count, first_rn, last_rn) for an ascending order on ``value``.

    Rows sharing a value occupy the consecutive positions first_rn..last_rn
    whatever the tie-break; only the histogram (one row per distinct value)
    is ordered, so this fits keys with a small domain - e.g. per-customer
    order counts: D distinct counts need at least 1 + 2 + ... + D orders, so
    D <= sqrt(2N) for N orders.
    """
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hist.select(
        value, "cnt",
        (F.sum("cnt").over(upto) - F.col("cnt") + 1).alias("first_rn"),
        F.sum("cnt").over(upto).alias("last_rn"),
        F.sum("cnt").over(every).alias(N),
    )
