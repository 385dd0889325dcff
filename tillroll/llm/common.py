"""Shared helpers: row identity, sizing, array kernels used inside tasks.

Row identity.  A document row is identified by ``(_d, _t)``: its ``doc_id``
(null counts as the smallest value) and a 32-bit hash of its text.  Rows that
agree in both are the same document repeated and get the same result, so
nothing depends on row order, file splits or recomputation.
"""

from __future__ import annotations

import io
import pathlib
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tillroll
from tillroll.session import shared_path

NULL_ID = -(1 << 63)
#: Bytes of text that one step of an array kernel handles (a longer document is one step);
#: the kernels need about 150 bytes of work space for each.
STEP_BYTES = 1 << 18
#: Input bytes for each bucket of a hash exchange.
BUCKET_BYTES = 4 << 20
#: Word separators of the contracts: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


# ---- Spark side -----------------------------------------------------------------

_SHIPPED: set[str] = set()


#: Texts are large rows: batches for Python of a few MB instead of the default 64, unless the session sets another size.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as a zip in the shared folder; bound the batches."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    if sc.applicationId in _SHIPPED:
        return
    top = pathlib.Path(tillroll.__file__).parent
    if top.is_dir():  # else the package itself came as a zip
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark, 'code')}/tillroll.zip")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(_d, _t, text): row identity and text (null text is empty); other columns are not read."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
                       F.hash(text).alias("_t"), text.alias("text"))


def doc_id_of(col: str = "_d"):
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def scan_bytes(df: DataFrame) -> int | None:
    """Optimizer's size of a scan (with its filters and projections); None where the source has no size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= 1 << 58 else size  # Spark's default for an unknown size is 2^63 - 1 bytes


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, bytes_each: int = BUCKET_BYTES) -> int:
    """Buckets of a hash exchange: they follow the size of the scan (of unknown size: the shuffle partitions)."""
    return max(shuffle_partitions(df.sparkSession), -(-(scan_bytes(df) or 0) // bytes_each))


def stored(df: DataFrame, name: str, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage, survives executors)."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str | None = None) -> Iterator[DataFrame]:
    """``df`` written once to the shared folder in buckets of ``key``, until the block ends: joins on
    ``key`` move only the rows that come to it, however many joins there are."""
    spark, path, table = df.sparkSession, shared_path(df.sparkSession, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    write = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).option("path", path)
    (write.option("compression", codec) if codec else write).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")
        release(spark, path)


def file_system(path: str):
    """Arrow's file system of a file in the shared folder, and the file's name there; for tasks."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that has had its last reader."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that have had their last reader, and let Spark's cleaner drop the shuffle
    files of finished queries (it does so when the driver's JVM collects them, by default every half hour).
    Spark holds the last query until another has run."""
    for path in paths:
        remove(spark, path)
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if its files are small; else a shuffle join takes it."""
    size = scan_bytes(df)
    return F.broadcast(df) if size is not None and size <= most else df


#: Links that one task joins into components; more are contracted in distributed rounds until so many are left.
TASK_LINKS = 1 << 20


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (u, v), ascending, and the smallest node that each reaches."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(node))
    while len(x):
        parent = np.arange(len(node))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        far = parent[parent]
        while (far != parent).any():
            parent, far = far, far[far]
        root, x, y = parent[root], parent[x], parent[y]
        x, y = x[x != y], y[x != y]
    return node, node[root]


def _joined(batches) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(*(np.concatenate(x) for x in zip(*held)))], names=["node", "component"])


def _links(pairs: DataFrame, name: str) -> DataFrame:
    return stored(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-links")


def components(edges: DataFrame, name: str = "components", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component): smallest node reachable over ``edges(u, v)``; only nodes with an edge.

    While there are more than ``task_links`` links, a round contracts them: every node
    points to the neighbour with the smallest hash, if that is smaller than its own, and is
    replaced by what the node it points to points to.  Links within a group vanish, so each round leaves
    a fraction of nodes and links, however long the paths are.  One task joins the rest (bounded
    by ``task_links``); the rounds' maps are then applied backwards.  Rounds are written
    tables; only a count for each reaches the driver.
    """
    links, maps = _links(edges.select("u", "v"), name), []
    while links.count() > task_links:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        code = F.xxhash64("v")
        least = both.groupBy("u").agg(F.min_by("v", code).alias("v"), F.min(code).alias("code"))
        step = broadcast_if_small(stored(least.select(
            F.col("u").alias("node"), F.when(F.col("code") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("next")), f"{name}-step"))
        jump = stored(step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
                      .select("node", F.col("far").alias("next")), f"{name}-map")
        maps.append(jump)
        jump = broadcast_if_small(jump)
        links = _links(links.join(jump.select(F.col("node").alias("u"), F.col("next").alias("x")), "u")
                       .join(jump.select(F.col("node").alias("v"), F.col("next").alias("y")), "v")
                       .select(F.col("x").alias("u"), F.col("y").alias("v")), name)
    labels = stored(links.coalesce(1).mapInArrow(_joined, "node long, component long"), f"{name}-labels")
    for jump in reversed(maps):
        known = broadcast_if_small(labels.withColumnRenamed("node", "next"))
        labels = stored(jump.join(known, "next", "left").select("node", F.coalesce("component", "next").alias("component")), f"{name}-labels")
    if maps:  # a contracted group bears the name of one of its nodes
        least = stored(labels.groupBy("component").agg(F.min("node").alias("least")), f"{name}-least")
        labels = stored(labels.join(broadcast_if_small(least), "component").select("node", F.col("least").alias("component")), f"{name}-labels")
    return labels


# ---- task side: texts as arrays -------------------------------------------------

def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and each text's first byte (one more at the end)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs.astype(np.int64)


def steps(offs: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def word_spans(buf: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word, and the first word of each text (one more at the end)."""
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[buf]
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _splitmix(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_BYTE = _splitmix(256, 11)


class Rolling:
    """Hashes of stretches of a sequence of 64-bit codes, from one prefix sum."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word."""
    return Rolling(_BYTE[buf])(starts, ends)


# ---- task side: columns of a hash exchange packed per bucket ----------------------

def planes(a: np.ndarray) -> bytes:
    """Byte planes of an integer array: equal high bytes stand together and compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_keys(key: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences."""
    return planes(np.diff(key, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def by_bucket(key: np.ndarray, buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Rows dealt to buckets by ranges of the hash ``key``; in a bucket they ascend by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    home = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(home, prepend=home[:1] + np.uint64(1))) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        yield int(home[a]), key[a:b], [c[order[a:b]] for c in columns]


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """First row of each run of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, ... in one array."""
    size = end - start
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(start - (np.cumsum(size) - size), size)
    return first + np.arange(total)
