"""Operator 3 - document fingerprints as invertible Bloom lookup sketches (DataFrame operations only).

A text's paragraphs (lines, cut at sentence ends; overlong sentences after 24
words) are hashed to 64-bit digests.
A sketch is three tables of ``width`` cells; each digest adds itself to one cell
of each table: a count, the xor of digests, the xor of their checks.  Sketches
of two versions subtract cell by cell, and what is left holds only the
paragraphs that differ.  A cell with count 1 or -1 and a matching check shows a
digest, which is taken out of its other cells (peeling) until all are empty.

The fingerprint is the small sketch (12 cells).  When its difference does not
peel, larger sketches are built from the paragraphs: digests are dealt by
their bits to groups of at most about eight, a sketch for each, and a group that fails is
tried again with four times the width, at last by plain set difference.

Special rows: null text is empty; equal texts have equal fingerprints and
likeness 1; a paragraph repeated within a text counts once; rows are ordered by
(doc_id, null first, then text), so repeated ids have a defined successor; a
single row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C

#: A paragraph: words of one line up to a sentence end, at most 24 (a word of over 200 characters ends one).
PARAGRAPH = r"[^ \n]{1,200}(?:(?<![.!?]) +[^ \n]{1,200}){0,23}"
BASE_WIDTH, WIDTHS = 4, (8, 32, 128, 512)
ROUNDS = 5
#: Text bytes in each range of the successor search.
RANGE_BYTES = 4 << 20


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda x: F.xxhash64(x)))


def _place(key: Column, table: int, width: int) -> Column:
    return F.shiftrightunsigned(key, 20 * table).bitwiseAND(F.lit(width - 1).cast("long"))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), key.alias("key"), check.alias("chk"))


def sketch(keys: Column, width: int) -> Column:
    """Cells (n, key, chk) of the three tables, one after the other; ``width`` is a power of two."""
    zero = F.lit(0).cast("long")

    def table(j: int) -> Column:
        return F.transform(F.sequence(zero, F.lit(width - 1).cast("long")), lambda c: F.aggregate(
            F.filter(keys, lambda x: _place(x, j, width) == c), _cell(zero, zero, zero),
            lambda a, x: _cell(a["n"] + 1, a["key"].bitwiseXOR(x), a["chk"].bitwiseXOR(F.xxhash64(x)))))

    return F.concat(table(0), table(1), table(2))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"])))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def peel(difference: Column, width: int, rounds: int = ROUNDS) -> Column:
    """Struct (plus, minus) of the digests that a difference of sketches holds, or null if it does not peel."""
    def taken_out(cells: Column, pure: Column) -> Column:
        def table(j: int) -> Column:
            return F.transform(F.slice(cells, j * width + 1, width), lambda c, i: F.aggregate(
                F.filter(pure, lambda q: _place(q["key"], j, width) == i), c,
                lambda a, q: _cell(a["n"] - q["n"], a["key"].bitwiseXOR(q["key"]), a["chk"].bitwiseXOR(F.xxhash64(q["key"])))))

        return F.concat(table(0), table(1), table(2))

    def side(pure: Column, sign: int) -> Column:
        return F.transform(F.filter(pure, lambda q: q["n"] == sign), lambda q: q["key"])

    def step(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (F.xxhash64(c["key"]) == c["chk"])),
                                            lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
        return _let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(F.struct(
            taken_out(state["cells"], p).alias("cells"), F.concat(state["plus"], side(p, 1)).alias("plus"),
            F.concat(state["minus"], side(p, -1)).alias("minus"))))

    none = F.array().cast("array<long>")
    start = F.struct(difference.alias("cells"), none.alias("plus"), none.alias("minus"))
    clean = lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.when(
        F.forall(s["cells"], clean), F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"))))


def _compared(a: Column, b: Column, width: int) -> Column:
    return peel(subtract(sketch(a, width), sketch(b, width)), width)


def _group_difference(a: Column, b: Column) -> Column:
    tries = [_compared(a, b, w) for w in WIDTHS]
    exact = F.struct(F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    return F.coalesce(*tries, exact)


def groups(keys: str, count: str) -> Column:
    """Digests dealt by their upper bits to ``count`` (a power of two, at most 1,024) groups."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col(count) - 1), lambda g: F.filter(
        F.col(keys), lambda x: F.shiftrightunsigned(x, 50).bitwiseAND(F.col(count) - 1) == g))


def group_count(a: str, b: str) -> Column:
    return F.expr(f"CASE WHEN greatest(size({a}), size({b})) <= 8 THEN 1L "
                  f"ELSE shiftleft(1L, least(10, length(bin((greatest(size({a}), size({b})) - 1) div 8)))) END")


def fingerprint(cells: Column) -> Column:
    """Text form of a sketch."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["chk"]))), ";")


def add_difference(df: DataFrame, a: str, b: str, base_a: str, base_b: str, out: str) -> DataFrame:
    """Column ``out``: how many digests of the arrays ``a`` and ``b`` differ, from the base sketches or larger ones."""
    n = lambda d: _let(d, lambda s: F.size(s["plus"]) + F.size(s["minus"]))
    small = n(peel(subtract(F.col(base_a), F.col(base_b)), BASE_WIDTH, 6))
    df = df.withColumn("_few", F.when(F.col(a) == F.col(b), F.lit(0)).otherwise(small)).withColumn("_of", group_count(a, b))
    large = F.aggregate(F.zip_with(groups(a, "_of"), groups(b, "_of"), lambda x, y: F.when(x == y, F.lit(0)).otherwise(n(_group_difference(x, y)))),
                        F.lit(0), lambda s, x: s + x)
    return df.withColumn(out, F.coalesce("_few", large)).drop("_few", "_of")


def likeness(a: str, b: str, differing: str) -> Column:
    """Shared digests over all digests, from the sizes and the number that differ."""
    common = (F.size(a) + F.size(b) - F.col(differing)) / 2
    return F.coalesce(F.try_divide(common, common + F.col(differing)), F.lit(1.0))


def _ranges(rows: DataFrame, n: int) -> Column:
    """Number of a row's range of ids, by two levels of approximate quantiles (any bounds give the same result)."""
    if n < 2:
        return F.lit(0).cast("long")
    step = max(1, int(n ** 0.5))
    bounds = rows.agg(F.percentile_approx("_d", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if not bounds:
        return F.lit(0).cast("long")
    chunks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(c[0]) for c in chunks])
    fine = F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks])
    at = F.size(F.filter(coarse, lambda b: b <= F.col("_d")))
    return _let(at, lambda k: F.when(k == 0, F.lit(0)).otherwise(
        (k - 1) * step + F.size(F.filter(F.element_at(fine, F.greatest(k, F.lit(1))), lambda b: b <= F.col("_d")))).cast("long"))


def with_successor(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own, next_text, following, own_sketch, following_sketch): each text, its digests and their
    base sketch with those of the next row in order of doc_id, the last with the first's.

    Rows are dealt to ranges of ids (one shuffle of the text); the first row of each range
    is also sent, as a guest, to the end of the range before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("_d"), text.alias("text"))
    rows = rows.withColumn("_range", _ranges(rows, -(-(C.scan_bytes(docs) or 0) // RANGE_BYTES)))
    rows = rows.withColumn("own", digests(F.col("text"))).withColumn("own_sketch", sketch(F.col("own"), BASE_WIDTH))
    first = rows.groupBy("_range").agg(F.min(F.struct("_d", "text", "own", "own_sketch")).alias("f"))
    line = Window.orderBy("_range")  # one row for each range
    before = F.coalesce(F.lag("_range").over(line), F.max("_range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = first.select(F.lit(None).cast("long").alias("doc_id"), "f._d", "f.text", before.alias("_range"), "f.own", "f.own_sketch",
                          F.lit(1).alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", "_d", "text")
    return (rows.withColumn("_guest", F.lit(0)).unionByName(guests)
            .withColumns({"next_text": F.lead("text").over(order), "following": F.lead("own").over(order),
                          "following_sketch": F.lead("own_sketch").over(order)})
            .where("_guest = 0").select("doc_id", "text", "own", "next_text", "following", "own_sketch", "following_sketch"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """A row per document: its and its edited text's fingerprint, and how like they and its successor's are."""
    rows = with_successor(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.expr("left(next_text, cast(n_chars div 2 as int))")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "own_sketch",
                       digests(F.col("edited")).alias("new"), "following", "following_sketch")
    rows = rows.withColumn("new_sketch", sketch(F.col("new"), BASE_WIDTH))
    rows = add_difference(rows, "own", "new", "own_sketch", "new_sketch", "edits")
    rows = add_difference(rows, "own", "following", "own_sketch", "following_sketch", "others")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own_sketch")).alias("fingerprint"),
                       fingerprint(F.col("new_sketch")).alias("edited_fingerprint"), likeness("own", "new", "edits").alias("near_edited"),
                       likeness("own", "following", "others").alias("near_next"))


def op3_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(C.documents(spark, sf_dir))
