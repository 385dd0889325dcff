"""The exact rows at given places of an order, without sorting.

NTILE needs the rows at which buckets end, and "how many customers make half of the
revenue" the row at which a running sum gets there.  Both are a search for the first row, in a total
order, at which a condition on the rows and the sum so far becomes true; sorting
everything for a handful of rows is not needed:

1. count rows and sum by the gaps between the boundaries known so far (at first one gap, everything);
2. the gap where a condition becomes true holds its row.  A gap of few rows is
   read and walked through; of a larger one, some rows are drawn by their hash as new boundaries, and so on.

Each round narrows a gap by about ``drawn`` times: two passes of scan and partial
aggregation a round, three rounds for 10^10 rows.  The counts are exact, so is the result; the draw
only decides how fast it is found.  Boundaries, counts by gap and the rows of the last gaps - thousands, by parameters -
are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries drawn in a gap each round; rows of a gap that are read as they are.
DRAWN, FEW = 512, 1 << 14
_SCALE = 1 << 53

Condition = Callable[[int, Decimal], bool]


@dataclass(frozen=True)
class Place:
    """A row of the order: its ordering values, its 1-based position, the sum up to and with it."""

    row: tuple
    position: int
    total: Decimal


def _before(bounds: str, row: str, n: int) -> Column:
    """How many of the ascending ``bounds`` are smaller than ``row``: a binary search."""
    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["lo"] + state["hi"], 1)
        smaller = (state["lo"] < state["hi"]) & (F.get(bounds, middle) < F.col(row))
        return F.struct(F.when(smaller, middle + 1).otherwise(state["lo"]).alias("lo"),
                        F.when(smaller, state["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, step)["lo"]


def _celled(df: DataFrame, order: Sequence[str], bounds: list[tuple], kind: T.StructType) -> DataFrame:
    """Adds _cell: 2j for rows between boundaries j-1 and j, 2j + 1 for rows equal to boundary j."""
    df = df.withColumn("_row", F.struct(*order))
    if not bounds:
        return df.withColumn("_cell", F.lit(0))
    known = df.sparkSession.createDataFrame([(bounds,)], T.StructType([T.StructField("b", T.ArrayType(kind))]))
    df = df.withColumn("_bounds", known.select("b").scalar()).withColumn("_at", _before("_bounds", "_row", len(bounds)))
    equal = F.coalesce(F.get("_bounds", F.col("_at")) == F.col("_row"), F.lit(False))
    return df.withColumn("_cell", F.col("_at") * 2 + equal.cast("int")).drop("_bounds", "_at")


def locate(df: DataFrame, order: Sequence[str], conditions: Callable[[int, Decimal], Sequence[Condition]], weight: str | None = None,
           drawn: int = DRAWN, few: int = FEW) -> list[Place | None]:
    """For each condition the first row of the ascending order at which it holds; None if it never does.

    ``conditions(n, total)`` gives them, knowing the row count and the sum of ``weight``; each takes (rows, sum) up to and with a
    row and must stay true once it is (over rows whose weight is not negative).  ``order`` are columns that together
    identify a row; rows that agree in all of them have one place after the other.
    """
    order = list(order)
    kind = df.select(*order).schema
    kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in kind])
    df = df.select(*order, (F.lit(0) if weight is None else F.col(weight)).cast("decimal(38,4)").alias("_weight"))
    bounds: list[tuple] = []
    wanted: list[Condition] | None = None
    found: dict[int, Place | None] = {}
    for turn in range(1, 1000):
        cells = _celled(df, order, bounds, kind)
        counted = {r["_cell"]: (r.n, r.s) for r in cells.groupBy("_cell").agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("s")).collect()}
        if wanted is None:
            wanted = list(conditions(sum(n for n, _ in counted.values()), sum((s for _, s in counted.values()), Decimal(0))))
        open_gaps: dict[int, tuple[int, int, Decimal]] = {}
        reading: dict[int, list[tuple[int, int, Decimal]]] = {}
        for i, holds in enumerate(wanted):
            if i in found:
                continue
            rows, total = 0, Decimal(0)
            for cell in sorted(counted):
                n, s = counted[cell]
                if not holds(rows + n, total + s):
                    rows, total = rows + n, total + s
                elif cell % 2:  # equal rows: the first copy at which it holds
                    lo, hi = 1, n
                    while lo < hi:
                        m = (lo + hi) // 2
                        lo, hi = (lo, m) if holds(rows + m, total + s / n * m) else (m + 1, hi)
                    found[i] = Place(bounds[cell // 2], rows + lo, total + s / n * lo)
                    break
                elif n <= few:
                    reading.setdefault(cell, []).append((i, rows, total))
                    break
                else:
                    open_gaps[cell] = (n, rows, total)
                    break
            else:
                found[i] = None
        if reading:
            rows_of: dict[int, list] = {}
            for r in cells.where(F.col("_cell").isin(list(reading))).select("_cell", *order, "_weight").orderBy("_cell", *order).collect():
                rows_of.setdefault(r["_cell"], []).append(r)
            for cell, these in reading.items():
                for i, rows, total in these:
                    for r in rows_of[cell]:
                        rows, total = rows + 1, total + (r["_weight"] or 0)
                        if wanted[i](rows, total):
                            found[i] = Place(tuple(r[c] for c in order), rows, total)
                            break
        if len(found) == len(wanted):
            return [found[i] for i in range(len(wanted))]
        # the boundaries around open gaps stay; in them, about ``drawn`` rows become boundaries
        share = F.lit(0)
        for cell, (n, _, _) in open_gaps.items():
            share = F.when(F.col("_cell") == cell, F.lit(min(_SCALE, _SCALE * drawn // n))).otherwise(share)
        picked = cells.where(F.pmod(F.xxhash64(F.lit(turn), *order), F.lit(_SCALE)) < share).select(*order).limit(4 * drawn * len(open_gaps))
        edges = {j for cell in open_gaps for j in (cell // 2 - 1, cell // 2) if 0 <= j < len(bounds)}
        kept = df.sparkSession.createDataFrame([bounds[j] for j in sorted(edges)], kind)
        bounds = [tuple(r) for r in picked.unionByName(kept).distinct().orderBy(*order).collect()]
    raise RuntimeError("no progress: the order does not tell rows apart")


def bucket_ends(n: int, buckets: int) -> list[int]:
    """Last position of each NTILE bucket but the last: the first n % buckets hold one row more."""
    q, r = divmod(n, buckets)
    return [b * q + min(b, r) for b in range(1, buckets)]


def _literal(place: Place, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(place.row, kind)])


def ntile_column(df: DataFrame, order: Sequence[str], buckets: int, **options) -> Column:
    """NTILE(buckets) over ``order`` for rows of ``df``: one more than the bucket ends before the row."""
    order = list(order)
    ends = locate(df, order, lambda n, _: [lambda rows, s, p=p: rows >= p for p in dict.fromkeys(bucket_ends(n, buckets))], **options)
    kind, row = df.select(*order).schema, F.struct(*order)
    score = F.lit(1)
    for end in ends:
        if end is not None:
            score = score + (row > _literal(end, kind)).cast("int")
    return score
