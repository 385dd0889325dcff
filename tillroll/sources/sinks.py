"""Sinks: the modelled layer, the exception log and validation results.

Output goes under a *shared* directory: an explicit path, or a folder in the
session's reliable checkpoint directory (``spark.checkpoint.dir``), never a
machine-local temporary folder.  A model is loaded into a store (``sources.publish``): each
load is a version of its own, which readers see when its assertions have passed.  The order
fact of S5 is partitioned by order month, so a reader prunes it by date.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.dates import month_start
from tillroll.operators.ordering import pinned_until_written
from tillroll.plans import cleaning
from tillroll.plans.audit import audit_model, source_totals, staged_totals
from tillroll.session import shared_path
from tillroll.sources import files
from tillroll.sources.publish import Manifest, ModelStore, home, write_audit_publish
from tillroll.sources.staging import Staging
from tillroll.sources.tables import IDENTITY, Star, build_star, keyed, line_measures, per_order_values, star_from_facts, targets_from_history

MODEL_TABLES = ("dim_customer", "dim_sub_category", "fact_orders", "fact_order_lines",
                "fact_sales_target")


#: Stored tables are half digits and keys: zstd leaves about two thirds of what the default does (143 to 92 MB of staging at 8 times sf0.1).
STORED = {"compression": "zstd"}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return shared_path(spark, name)


def write_model(star: Star, path: str) -> None:
    """S5/S6 - write the five modelled tables (overwrite = full reload)."""
    star.dim_customer.write.mode("overwrite").options(**STORED).parquet(f"{path}/dim_customer")
    star.dim_sub_category.write.mode("overwrite").options(**STORED).parquet(f"{path}/dim_sub_category")
    # clustered by month first, so each month is written by few tasks
    (star.fact_orders.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
     .hint("rebalance", F.col("order_month")).write.mode("overwrite").options(**STORED).partitionBy("order_month").parquet(f"{path}/fact_orders"))
    star.fact_order_lines.write.mode("overwrite").options(**STORED).parquet(f"{path}/fact_order_lines")
    star.fact_sales_target.write.mode("overwrite").options(**STORED).parquet(f"{path}/fact_sales_target")


def read_model(spark: SparkSession, path: str) -> Star:
    def rd(name):
        return spark.read.parquet(f"{path}/{name}")
    return Star(rd("dim_customer"), rd("dim_sub_category"),
                rd("fact_orders").drop("order_month"), rd("fact_order_lines"),
                rd("fact_sales_target"))


@dataclass(frozen=True)
class Loaded:
    """A model loaded from text staging, with the rows that it could not take."""

    star: Star
    quarantine: DataFrame  # table_name, entity_key, reasons, row


QUARANTINE = "load_quarantine"


def load_staged(store: ModelStore, stg: Staging, start: str, end: str) -> Manifest:
    """S5/S6 - load text staging as a new version of a store: write, audit, publish.

    The rows of each table and those rejected are counted by the load's own writes (observed metrics);
    only if there are any is the quarantine table filled by another pass.  Every staged row must be
    found again, in the model or in the quarantine.
    """
    marked = cleaning.judged(stg)
    seen = {name: Observation(name) for name in STAGED}

    def watched(name: str, df: DataFrame) -> DataFrame:
        return df.observe(seen[name], F.count(F.lit(1)).alias("rows"), F.count_if(F.size(cleaning.REASONS) > 0).alias("rejected"))

    def write(folder: str, version: str) -> dict[str, dict]:
        # the facts first: their writes carry the observations
        loads, plain = cleaning.accepted(marked, watched), cleaning.accepted(marked)
        star = Star(cleaning.build_dim_customer(plain), cleaning.build_dim_sub_category(plain), cleaning.build_fact_orders(loads),
                    cleaning.build_fact_lines(loads), cleaning.build_fact_target(loads))
        write_model(star, folder)
        metrics = {name: seen[name].get for name in STAGED}
        rejects = cleaning.quarantined(marked)
        (rejects if any(m["rejected"] for m in metrics.values()) else rejects.limit(0)).write.options(**STORED).parquet(f"{folder}/{QUARANTINE}")
        return {name: {"observed": metrics[raw]} if raw else {} for name, raw in
                (("dim_customer", None), ("dim_sub_category", None), *zip(FACTS, STAGED), (QUARANTINE, None))}

    def audit(loaded: Loaded) -> DataFrame:
        expected = staged_totals(cleaning.accepted(marked))
        found = [getattr(loaded.star, f).agg(F.count(F.lit(1))).scalar()
                 + loaded.quarantine.where(F.col("table_name") == raw).agg(F.count(F.lit(1))).scalar() for f, raw in zip(FACTS, STAGED)]
        staged = [getattr(stg, raw).agg(F.count(F.lit(1))).scalar() for raw in STAGED]
        text = lambda cs: F.concat_ws(" / ", *[c.cast("string") for c in cs])
        rows = stg.raw_sales_target.agg(F.lit(EVERY_ROW).alias("assertion"), text(staged).alias("expected"), text(found).alias("found"))
        rows = rows.select("assertion", F.when(F.col("expected") == F.col("found"), "PASS").otherwise("FAIL").alias("result"), "expected", "found")
        return audit_model(expected, loaded.star, start, end).unionByName(rows)

    def counts(loaded: Loaded) -> dict[str, int]:
        return {r.table_name: r.row_count for r in model_row_counts(loaded.star).unionByName(
            loaded.quarantine.agg(F.lit(QUARANTINE).alias("table_name"), F.count(F.lit(1)).alias("row_count"))).collect()}

    return write_audit_publish(store, write, lambda m: read_loaded(store.spark, m), audit, counts)


STAGED = ("raw_orders", "raw_order_details", "raw_sales_target")
FACTS = ("fact_orders", "fact_order_lines", "fact_sales_target")
EVERY_ROW = "every staged row is loaded or in quarantine"


def read_loaded(spark: SparkSession, manifest: Manifest) -> Loaded:
    return Loaded(read_model(spark, manifest.path), spark.read.parquet(manifest.tables[QUARANTINE]["path"]))


def model_row_counts(star: Star) -> DataFrame:
    frames = [getattr(star, t).agg(F.lit(t).alias("table_name"),
                                   F.count(F.lit(1)).alias("row_count")) for t in MODEL_TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def model_rows(star: Star) -> DataFrame:
    """Every row of the five tables as (table_name, row): what a load has written, to be compared whole.

    The order fact is shown with the customer that its key links to.
    """
    shown = {
        "dim_customer": star.dim_customer.select("customer_name", "state", "city"),
        "dim_sub_category": star.dim_sub_category.select("sub_category", "category"),
        "fact_orders": star.fact_orders.join(star.dim_customer, "customer_id", "left").select(
            "order_id", "order_date", "customer_name", "state", "city"),
        "fact_order_lines": star.fact_order_lines.select("order_id", "sub_category", "amount", "profit", "quantity"),
        "fact_sales_target": star.fact_sales_target.select("target_month", "category", "target_amount"),
    }
    frames = [df.select(F.lit(name).alias("table_name"), cleaning.row_text(df.columns).alias("row")) for name, df in shown.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


TARGET_BUCKET_BYTES = 256 * 1024 * 1024
#: Bytes of the stored line fact for each byte of the line scan: it keeps as many
#: numbers a line as the scan reads, and the sub-category's name.
STORED_PER_SCANNED = 1.5


def scan_bytes(scan: DataFrame) -> int:
    """Optimizer's size of a table scan with its column selection."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 58:  # Spark's default for a source without a size
        raise ValueError("the source has no size estimate; set spark.tillroll.model.buckets")
    return size


def bucket_count(scan: DataFrame, target_bytes: int = TARGET_BUCKET_BYTES) -> int:
    """Buckets for the facts: ~``target_bytes`` each by the size of the *line scan*
    (a join's estimate would multiply its sides), at least twice the default parallelism."""
    spark = scan.sparkSession
    configured = spark.conf.get("spark.tillroll.model.buckets", None)
    if configured:
        return int(configured)
    stored = int(scan_bytes(scan) * STORED_PER_SCANNED)
    return max(2 * spark.sparkContext.defaultParallelism, -(-stored // target_bytes))


class Kept:
    """Results derived from a stored model, each written beside it once, by whichever application needs it first.

    Orderings pinned while a result is built are removed when it is written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path, set()

    def __call__(self, name: str, build) -> DataFrame:
        path = f"{self.path}/kept_{name}"
        if name not in self.names:
            if not files.exists(self.spark, f"{path}/_SUCCESS"):
                with pinned_until_written(self.spark):
                    build().write.mode("overwrite").options(**STORED).parquet(path)
            self.names.add(name)
        return self.spark.read.parquet(path)


BUCKETED = ("fact_orders", "fact_order_lines", "order_values")
DATED, MONTH = "dated_orders", "month_start"


def materialize_star(star: Star, path: str, buckets: int | None, tag: str) -> Star:
    """Write the model once and return the star read back from storage.

    Lines and orders are bucketed on ``order_id`` into the same number of
    buckets, so every later lines->orders join and per-order aggregate runs
    without a shuffle; each fact is hash-repartitioned into ``buckets`` before
    the write so each bucket is one file.  The order table is written wide
    (customer attributes included): a column scan of it costs the same as a
    narrow table and spares the order-grain join to the customer dimension.
    Dimensions and targets are then derived from the *stored* facts (cheap,
    bucketed) and written as plain Parquet.  ``buckets=None`` sizes the
    buckets from the data (``bucket_count``).
    """
    spark = star.fact_orders.sparkSession
    if buckets is None:
        buckets = bucket_count(star.line_scan)

    def bucketed(df: DataFrame, name: str, partitioned: bool = False) -> DataFrame:
        table = f"{tag}_{name}"
        if not partitioned:
            df = df.repartition(buckets, "order_id")
        (df.write.mode("overwrite").options(**STORED)
         .bucketBy(buckets, "order_id").option("path", f"{path}/{name}")
         .format("parquet").saveAsTable(table))
        return spark.table(table)

    # The customer key follows from the identity: where the orders come without it, it is
    # computed after each shuffle, which its 32 random digits an order would double.
    plain = star.order_inputs is not None
    columns = ["order_id", "customer_id", "order_date", "customer_name", "state", "city"]
    if plain:
        wide = bucketed(keyed(star.order_inputs.repartition(buckets, "order_id")).select(*columns), "fact_orders", partitioned=True)
    else:
        wide = bucketed(star.orders_with_customer().select(*columns), "fact_orders")
    if star.line_inputs is not None:
        # the measures are computed after the bucketing shuffle, spread over
        # all buckets rather than over the scan splits of the source
        # (rebalanced: an order with a large share of the lines is several files)
        lines = bucketed(line_measures(star.line_inputs.hint("rebalance", buckets, F.col("order_id"))),
                         "fact_order_lines", partitioned=True)
    else:
        lines = bucketed(star.fact_order_lines, "fact_order_lines")
    # One row per order for the per-order jobs.  The files are read without their
    # buckets, so a hot order's lines are added up in many tasks before they meet.
    values = bucketed(per_order_values(spark.read.parquet(f"{path}/fact_order_lines")), "order_values")
    # The orders with their values once more, a folder for each month: jobs on a period read its
    # months only.  A month of many orders is several files, a small one a single file.
    dated = (wide.drop("customer_id") if plain else wide).join(values, "order_id").withColumn(MONTH, month_start("order_date"))
    dated = dated.hint("rebalance", F.col(MONTH))
    (keyed(dated) if plain else dated).write.mode("overwrite").options(**STORED).partitionBy(MONTH).parquet(f"{path}/{DATED}")
    derived = star_from_facts(wide, lines)
    if plain:
        derived = replace(derived, dim_customer=keyed(wide.select(*IDENTITY).distinct()).select("customer_id", *IDENTITY))
    for name in ("dim_customer", "dim_sub_category"):
        getattr(derived, name).write.mode("overwrite").options(**STORED).parquet(f"{path}/{name}")
    # The targets need each line's category: the stored dimension is known to be small, so the lines keep their buckets.
    sub_categories = spark.read.parquet(f"{path}/dim_sub_category")
    targets = targets_from_history(derived.fact_orders, lines.join(sub_categories, "sub_category"))
    targets.write.mode("overwrite").options(**STORED).parquet(f"{path}/fact_sales_target")
    return open_star(spark, path, buckets, tag)


def open_star(spark: SparkSession, path: str, buckets: int, tag: str) -> Star:
    """The star of a stored model; its bucketed tables are registered in this application's catalog if they aren't yet."""
    def bucketed(name: str) -> DataFrame:
        table = f"{tag}_{name}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/{name}").schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                      f"CLUSTERED BY (order_id) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
        return spark.table(table)

    def plain(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    wide, lines, values = map(bucketed, BUCKETED)
    # the months are dates, whatever a reader would take the folders' names for
    dated = spark.read.schema(T.StructType([*wide.schema.fields, *values.drop("order_id").schema.fields,
                                            T.StructField(MONTH, T.DateType())])).parquet(f"{path}/{DATED}")
    return Star(plain("dim_customer"), plain("dim_sub_category"), wide.select("order_id", "customer_id", "order_date"), lines,
                plain("fact_sales_target"), wide, order_values=values, dated_orders=dated, kept=Kept(spark, path))


#: The tables that the model is built from.
SOURCE_TABLES = ("lineitem", "part", "orders", "customer", "nation")


def published_model(spark: SparkSession, sf_dir: str, start: str, end: str, path: str | None = None) -> tuple[Star, Manifest]:
    """The analysis model of the source tables: the published one if it is still theirs, else a new load.

    ``start`` and ``end`` bound the order dates (A6).  A load that fails an assertion isn't published.
    """
    inputs = files.state_of(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in SOURCE_TABLES])
    inputs["period"] = f"{start} to {end}"
    store = ModelStore(spark, path or home(spark, f"model of {sf_dir}"))

    def opened(m: Manifest) -> Star:
        return open_star(spark, m.path, m.tables["fact_orders"]["buckets"], f"tillroll_{m.version.replace('-', '_')}")

    def write(folder: str, version: str) -> dict[str, dict]:
        star = build_star(spark, sf_dir)
        buckets = bucket_count(star.line_scan)
        materialize_star(star, folder, buckets, f"tillroll_{version.replace('-', '_')}")
        return {**{n: {"buckets": buckets} for n in BUCKETED}, DATED: {"partitioned by": MONTH}, "dim_customer": {}, "dim_sub_category": {},
                "fact_sales_target": {}}

    def counts(star: Star) -> dict[str, int]:
        frames = model_row_counts(star)
        for name, df in (("order_values", star.order_values), (DATED, star.dated_orders)):
            frames = frames.unionByName(df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count")))
        return {r.table_name: r.row_count for r in frames.collect()}

    def audited(star: Star) -> DataFrame:
        return audit_model(source_totals(spark, sf_dir), star, start, end)

    for last in (False, False, True):
        manifest = store.current_for(inputs)
        if manifest is None:
            try:
                manifest = write_audit_publish(store, write, opened, audited, counts, inputs)
            except files.Conflict:  # another application was faster: its model is as good, if it is of these inputs
                if last:
                    raise
                continue
        break
    return opened(manifest), manifest


RUN = "run_id"


def write_log(df: DataFrame, path: str, run_id: str = "run") -> DataFrame:
    """S7/S8 - append a run's rows to a log; a run that is repeated replaces its own rows and no others.

    Each run is a partition of the log, exchanged as a whole when its write is committed (dynamic partition
    overwrite); a run without rows leaves none.  Returns the run's rows as they read back.
    """
    spark, seen = df.sparkSession, Observation("log")
    (df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn(RUN, F.lit(run_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path))
    if seen.get["rows"] == 0:  # nothing was written, so nothing was exchanged either
        files.delete(spark, f"{path}/{RUN}={run_id}")
    return read_log(spark, path, df.schema).where(F.col(RUN) == run_id).drop(RUN)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All runs of a log."""
    return spark.read.schema(T.StructType(list(schema.fields)).add(RUN, T.StringType())).parquet(path)
