"""Operator 9 - mixing sources to target weights by entropy balancing (DataFrame operations only).

Each source gets a token target (shares by weight, at most twice its size, the
excess shared again).  Document rates are the ones closest in entropy to "every
document once" that meet the targets: the rate of a document of ``size`` words
in source s is ``min(2, exp(lambda_s * size / mean size of s))``, exponentially
tilted along the constraint's own gradient.  The convex dual in lambda is solved
by Newton iterations, each one distributed aggregation over the histogram of
sizes, kept inside a bracket.  Rates are then rounded to whole copies by
sequential Poisson sampling: fractional parts are taken in the order of
u / fraction (u from a hash of the row) until the words left are reached, so a
source misses its target by at most half a document and reruns agree.

Special rows: null text has size 0 and is taken once (0 words); null sources are
one source, ordered last; repeated rows are rows of their own; an empty table
gives an empty result.  The mixing columns shadow nothing: other columns of the
input, whatever their names, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.operators.ordering import global_positions

#: Weights of the sources in order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the rounding order, over 0 to 4.
BINS = 16_384


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, _sid, source_size, n, target): shares by weight, capped, the excess shared again.

    Capped by ``most`` times the size, the shares are ``min(cap, theta * weight)``;
    theta is the largest of the shares that are left for a unit of weight as the
    sources are capped one by one, least cap per weight first.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = global_positions(sources, [F.col("source").asc_nulls_last()]).select(
        F.col("_rn").alias("_sid"), "source", "source_size", "n", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    ranked = C.stored(ranked, "sources")
    capped = global_positions(ranked.withColumn("unit", F.col("cap") / F.col("w")), ["unit", "_sid"],
                              running={"cap_to": "cap", "w_to": "w", "size_to": "source_size"})
    left = (F.lit(float(share)) * F.col("size_to_total") - (F.col("cap_to") - F.col("cap"))) / (F.col("w_to_total") - (F.col("w_to") - F.col("w")))
    theta = capped.agg(F.max(left).alias("theta"))
    return ranked.select("*", F.least("cap", theta.scalar() * F.col("w")).alias("target"))


def tilt(hist: DataFrame, sources: DataFrame, most: float, tolerance: float = 1e-7, most_rounds: int = 60) -> DataFrame:
    """(_sid, lam): tilt of each source whose target is below its cap, by safeguarded Newton steps on the dual."""
    state = C.stored(sources.where("source_size > 0 AND target < cap * (1 - 1e-12)").select(
        "_sid", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done")), "tilt")
    for _ in range(most_rounds):
        x = F.col("size") / F.col("mean")
        free = F.col("lam") * x < F.log(F.lit(float(most)))
        rate = F.when(free, F.exp(F.col("lam") * x)).otherwise(F.lit(float(most)))
        sums = (hist.join(state.where("NOT done"), "_sid").groupBy("_sid").agg(
            F.sum(F.col("count") * F.col("size") * rate).alias("words"),
            F.sum(F.when(free, F.col("count") * F.col("size") * x * rate).otherwise(0.0)).alias("slope")))
        gap = F.col("words") - F.col("target")
        step = state.join(sums, "_sid", "left").withColumns({
            "settled": F.col("done") | (F.abs(gap) <= tolerance * F.col("target")),
            "lo2": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")),
            "hi2": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo2").isNull() | (newton > F.col("lo2"))) & (F.col("hi2").isNull() | (newton < F.col("hi2")))
        wide = F.greatest(F.lit(1.0), F.abs("lam"))
        safe = F.when(F.col("lo2").isNull(), F.col("hi2") - 2 * wide).when(F.col("hi2").isNull(), F.col("lo2") + 2 * wide).otherwise(
            (F.col("lo2") + F.col("hi2")) / 2)
        state = C.stored(step.select("_sid", "target", "mean", F.when(F.col("settled"), F.col("lam")).when(inside, newton)
                                     .otherwise(safe).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                                     F.col("settled").alias("done")), "tilt")
        if state.where("NOT done").isEmpty():
            break
    return state.select("_sid", "lam", "mean")


def content_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` with struct ``_mix``: size, source_size, target, rate, copies, taken.

    Only ``doc_id``, ``text`` (or a ready ``_size`` and ``_content``) and ``source`` are read for
    it; a text is never shuffled.
    """
    size = F.col("_size") if "_size" in docs.columns else word_count(F.col("text"))
    # rows of one doc_id and size are told apart by their text, else their order were that of the partitions
    content = F.col("_content") if "_content" in docs.columns else content_hash(F.col("text"))
    own = [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    row = docs.select(*own, F.col("source").alias("source"), size.alias("size"), content.alias("content"),
                      ((F.xxhash64(F.col("doc_id"), F.lit(9), size, content).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)).alias("u"))
    hist = C.stored(row.groupBy("source", "size").count(), "sizes")
    sources = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"),
                                                 F.sum("count").alias("n")), weights, share, most)
    sources = C.stored(sources, "targets")
    here = hist["source"].eqNullSafe(sources["source"])
    lam = tilt(C.stored(hist.join(sources, here).select("_sid", "size", "count"), "sizes"), sources, most)
    plan = C.stored(sources.join(lam, "_sid", "left").select(F.col("source").alias("_source"), "_sid", "source_size", "target", "lam", "mean"), "plan")

    x = F.col("lam") * F.col("size") / F.col("mean")
    top = F.lit(float(most))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam").isNull(), top).otherwise(
        F.when(x < F.log(top), F.exp(x)).otherwise(top))
    rated = (row.join(plan, row["source"].eqNullSafe(plan["_source"])).withColumn("rate", rate)
             .withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
             .withColumn("turn", F.when(F.col("part") > 0, F.col("u") / F.col("part")))
             .withColumn("bin", F.floor(F.least(F.col("turn"), F.lit(4.0)) * (BINS / 4))))
    bins = rated.groupBy("_sid", "bin").agg(F.sum(F.col("whole") * F.col("size")).alias("words"),
                                            F.sum(F.when(F.col("bin").isNotNull(), F.col("size"))).alias("more"),
                                            F.first("target").alias("target"))
    order = Window.partitionBy("_sid").orderBy(F.col("bin").asc_nulls_first())
    bins = (bins.withColumn("upto", F.sum(F.coalesce("more", F.lit(0))).over(order))
            .withColumn("left", F.col("target") - F.sum("words").over(Window.partitionBy("_sid"))))
    #: the bin in which the words left are reached
    cut = C.stored(bins.where(F.col("bin").isNotNull() & (F.col("upto") >= F.col("left"))).groupBy("_sid").agg(
        F.min("bin").alias("cut"), F.min_by(F.col("left") - (F.col("upto") - F.col("more")), "bin").alias("room")), "cuts")
    rated = rated.join(cut, "_sid", "left")
    within = F.col("bin").eqNullSafe(F.col("cut")) & F.col("cut").isNotNull()
    far = rated.where(~within).withColumn(
        "copies", F.col("whole") + F.when(F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    line = Window.partitionBy("_sid").orderBy("turn", "u", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    near = rated.where(within).withColumn(
        "copies", F.col("whole") + F.when(F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("size") / 2 <= F.col("room"), 1).otherwise(0))
    out = F.struct("size", "source_size", "target", "rate", F.col("copies").cast("long").alias("copies"),
                   (F.col("copies") * F.col("size")).cast("long").alias("taken")).alias("_mix")
    return far.unionByName(near).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)], out)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    narrow = C.stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("_size"), content_hash(F.col("text")).alias("_content")), "sized")
    return mix(narrow).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies", "_mix.rate")
