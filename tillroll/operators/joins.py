"""Equi-join that stays balanced when one key holds a large share of the rows.

A sort-merge join sends every row of a key to one task; if one customer or
one part carries a third of the fact rows, that task carries a third of the
join.  AQE's skew-join handling splits such partitions at runtime, but only
when it is enabled and the skew crosses its thresholds, so the model build
does not rely on it.  A dimension of at most ``BROADCAST_BYTES`` is broadcast whole, so
the big side isn't shuffled at all and no key can be heavy.  A larger one is split:

1. a small Bernoulli sample of the big side nominates *heavy* keys - keys
   whose sampled share reaches half of ``fraction``.  At most
   ``2 / fraction`` keys can qualify, so the list has a proven size bound;
2. rows of heavy keys are joined against only the matching rows of the other
   side, which is therefore bounded too and broadcast - no shuffle, so no
   task holds a heavy key;
3. all other rows take the ordinary shuffle join.

The sample only decides which path a row takes; every row is joined exactly
once on either path, so the result is whole and exact whatever the sample
says.  The other side should have at most one row per key (a dimension); that
bounds the broadcast part and is checked.  If it does not hold, all rows take
the shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir, shared_path

#: A dimension up to this size (rows times the width of its columns) is broadcast whole.
BROADCAST_BYTES = 96 << 20
SAMPLE_FRACTION = 0.001
SAMPLE_SEED = 17


def fits_broadcast(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows, at the default width of their columns, stay within ``most_bytes``."""
    width = 8 * len(df.columns) + sum(20 if f.dataType.typeName() == "string" else 8 for f in df.schema.fields)
    most_rows = most_bytes // width
    return most_rows > 0 and df.count() <= most_rows


def heavy_fraction(spark: SparkSession) -> float:
    """A key is heavy from half a shuffle partition's share of the rows on."""
    return 0.5 / int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(big: DataFrame, keys: Sequence[str], fraction: float,
               sample: float = SAMPLE_FRACTION) -> DataFrame:
    """Keys holding (about) ``fraction`` of the rows or more; at most 2 / fraction rows.

    The sample is written once: one pass over the key columns of ``big``.
    """
    spark = big.sparkSession
    path = shared_path(spark, "sample")
    big.select(*keys).sample(withReplacement=False, fraction=sample, seed=SAMPLE_SEED) \
       .write.mode("overwrite").parquet(path)
    s = spark.read.parquet(path)
    total = s.count()
    counts = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") * 2 >= total * fraction).select(*keys)


def joined_rows(a: DataFrame, b: DataFrame, key: str = "order_id") -> Column:
    """Rows of the inner join on ``key``: each side's rows are counted per key before they meet, so a hot key is one row."""
    left, right = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "_a"), (b, "_b")))
    return left.join(right, key).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0))).scalar()


def broadcast_checked(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """``df``, pinned, marked for broadcast if it has at most ``most_rows`` rows; else a shuffle join takes it."""
    ensure_checkpoint_dir(df.sparkSession)
    pinned = df.checkpoint(eager=True)
    return F.broadcast(pinned) if pinned.limit(most_rows + 1).count() <= most_rows else pinned


def skew_split_join(big: DataFrame, dim: DataFrame, big_keys: Sequence[str],
                    dim_keys: Sequence[str], fraction: float | None = None,
                    sample: float = SAMPLE_FRACTION, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join ``big`` to ``dim`` (unique on ``dim_keys``): a dimension of bounded size is broadcast, of a larger one the heavy keys.

    Equivalent to ``big.join(dim, big_keys == dim_keys)``; output columns are
    those of both sides.
    """
    big_keys, dim_keys = list(big_keys), list(dim_keys)
    if fits_broadcast(dim, broadcast_bytes):
        return big.join(F.broadcast(dim), [big[a] == dim[b] for a, b in zip(big_keys, dim_keys)])
    # Pinned with a reliable checkpoint: the semi and anti joins below must see
    # the very same key list, even if the sample were recomputed differently.
    ensure_checkpoint_dir(big.sparkSession)
    fraction = heavy_fraction(big.sparkSession) if fraction is None else fraction
    hot = heavy_keys(big, big_keys, fraction, sample).checkpoint(eager=True)  # <= 2/fraction rows
    hot_for_dim = hot.toDF(*dim_keys)
    # The broadcast below is bounded only if the dimension is unique on its key.
    if dim.join(F.broadcast(hot_for_dim), dim_keys, "left_semi").count() > hot.count():
        return big.join(dim, [big[a] == dim[b] for a, b in zip(big_keys, dim_keys)])
    big_hot = big.join(F.broadcast(hot), big_keys, "left_semi")
    big_cold = big.join(F.broadcast(hot), big_keys, "left_anti")
    dim_hot = dim.join(F.broadcast(hot_for_dim), dim_keys, "left_semi")  # <= 2 / fraction rows
    cond_hot = [big_hot[a] == dim_hot[b] for a, b in zip(big_keys, dim_keys)]
    cond_cold = [big_cold[a] == dim[b] for a, b in zip(big_keys, dim_keys)]
    return (big_hot.join(F.broadcast(dim_hot), cond_hot)
            .unionByName(big_cold.join(dim, cond_cold)))
