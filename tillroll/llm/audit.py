"""Operator 11 - how filters interact: every order of applying them, by a recursive CTE.

Each document gets a mask with a bit for every filter that it fails.  All that an audit
can say depends on the counts of documents by part and mask (at most 2^k cells a part),
so the texts are read once.  A recursive CTE then extends prefixes of filters: it starts
with no filter, joins every filter that is not yet applied and the part's mask cells,
carries the applied bits, and emits at each level the metrics of the step that the
prefix ends with.  The k! orders are the longest prefixes; the metrics of their
steps are those of their own prefixes (325 prefixes a part for five filters, not 600 steps).

One of the filters is "the same text stands under a smaller doc_id".  Copies are found
by the SHA-256 of the text: the smallest id of each digest is aggregated before the
shuffle, and a row is a first one if (digest, id) is among these; no join has the digest
alone as its key, so a group of copies of any size is spread.

Special rows: null text is empty; null ``doc_id`` is smaller than all others and has no
label; repeated rows count each, and none of them is a copy of the other; several labels
of one document count as one that has each flag; null ``source`` is the part ''; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

SPACE = r"[\x20\x09-\x0D]+"
#: Letter of the duplicate filter.
DUPLICATE = "E"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def contract_filters() -> dict[str, Column]:
    """Conditions on ``text`` and its ``words``."""
    words, text = F.col("words"), F.col("text")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicate: str | None = DUPLICATE) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and failed filters; bit i is the i-th letter in alphabetical order."""
    letters = sorted([*filters, *([duplicate] if duplicate else [])])
    bit = {x: 1 << i for i, x in enumerate(letters)}
    failed = F.lit(0)
    for x, condition in filters.items():
        failed = failed.bitwiseOR(F.when(condition, F.lit(bit[x])).otherwise(F.lit(0)))
    rows = (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("id"), F.coalesce("source", F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
            .withColumn("words", word_array(F.col("text")))
            .select("id", "part", failed.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    # repeated rows are one row with a count; the texts are read once
    facts = C.stored(rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "audit-facts")
    if duplicate:
        first = facts.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        facts = facts.join(first, ["digest", "id"], "left").withColumn(
            "mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(bit[duplicate]))))
    flags = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    facts = facts.select("id", "part", "mask", "n")
    # null ids have no label; in the join they would be one key
    named = facts.where(F.col("id") != C.NULL_ID).join(flags, "id", "left").select("part", "mask", "n", "good", "toxic")
    null = facts.where(F.col("id") == C.NULL_ID).select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))

    def total(flag: str) -> Column:
        return F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(F.lit(0))).alias(flag)

    return named.unionByName(null).groupBy("part", "mask").agg(F.sum("n").alias("docs"), total("good"), total("toxic"))


_STEPS = """
WITH RECURSIVE audit(part, prefix, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, total, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT c.part, concat(a.prefix, f.letter), a.step + 1, a.applied | f.bit,
         aggregate(c.masks, 0L, (x, m) -> x + IF((m.mask & (a.applied | f.bit)) = 0, m.docs, 0L)),
         aggregate(c.masks, 0L, (x, m) -> x + IF((m.mask & f.bit) <> 0 AND (m.mask & a.applied) = 0, m.docs, 0L)),
         aggregate(c.masks, 0L, (x, m) -> x + IF((m.mask & f.bit) <> 0 AND (m.mask & a.applied) <> 0, m.docs, 0L)),
         aggregate(c.masks, 0L, (x, m) -> x + IF(m.mask = f.bit, m.docs, 0L)),
         aggregate(c.masks, 0L, (x, m) -> x + IF((m.mask & f.bit) <> 0 AND (m.mask & a.applied) = 0, m.good, 0L)),
         aggregate(c.masks, 0L, (x, m) -> x + IF((m.mask & f.bit) <> 0 AND (m.mask & a.applied) = 0, m.toxic, 0L))
  FROM audit a JOIN {filters} f ON (a.applied & f.bit) = 0 JOIN {cells} c ON c.part = a.part)
SELECT * FROM audit WHERE step > 0 LIMIT ALL
"""


def prefix_steps(cells: DataFrame, letters: list[str]) -> DataFrame:
    """A row for each part and prefix of filters: the metrics of its last step.  Bit i is the i-th letter of ``letters``."""
    spark = cells.sparkSession
    # a part's cells in one row: at most 2^k of them
    masks = C.stored(cells.groupBy("part").agg(F.sum("docs").alias("total"), F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks")),
                     "audit-cells")
    bits = spark.createDataFrame([(x, 1 << i) for i, x in enumerate(letters)], "letter string, bit int")
    return spark.sql(_STEPS, cells=masks, filters=F.broadcast(bits))


def order_steps(cells: DataFrame, letters: list[str]) -> DataFrame:
    """A row for each part, order of all filters and step; ``shapley`` sums the removals of the step's filter over all orders."""
    k = len(letters)
    steps = C.stored(prefix_steps(cells, letters).withColumn("letter", F.right("prefix", F.lit(1))), "audit-steps")
    # a prefix of j filters begins (k - j)! orders
    weight = F.element_at(F.array(*[F.lit(factorial(k - j)) for j in range(1, k + 1)]), F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = (steps.where(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
              .withColumn("prefix", F.expr("left(filter_order, step)")))
    return (orders.join(steps.drop("step", "applied"), ["part", "prefix"]).join(shapley, ["part", "letter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = contract_filters()
    cells = mask_cells(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), filters)
    return order_steps(cells, sorted([*filters, DUPLICATE]))


#: Counts every step of every order from the documents' five failure flags.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
v AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(coalesce(doc_id, -9223372036854775808)) AS least_id FROM d GROUP BY t),
flags AS (
  SELECT v.part,
         len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
         100 * length(regexp_replace(v.t, '[^A-Z]', '', 'g')) > 5 * length(v.t) AS c,
         regexp_matches(v.t, '[#$%&*|]') AS d,
         coalesce(v.doc_id, -9223372036854775808) > firsts.least_id AS e,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = v.doc_id AND l.toxic = 1) AS toxic
  FROM v JOIN firsts ON firsts.t = v.t),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE p.x NOT IN (q.x, r.x, s.x, u.x) AND q.x NOT IN (r.x, s.x, u.x) AND r.x NOT IN (s.x, u.x) AND s.x <> u.x),
steps AS (SELECT filter_order, CAST(n AS INTEGER) AS step, filter_order[n:n] AS letter, filter_order[1:n - 1] AS before
          FROM orders, range(1, 6) AS g(n)),
classes AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
               || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flags GROUP BY ALL),
met AS (SELECT *, contains(failed, letter) AS hit, translate(failed, before, '') <> failed AS gone FROM classes, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
