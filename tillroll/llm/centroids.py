"""Operator 12 - centroid clustering with bounds by the norm of the sum (ns-bounds).

A stored row keeps its vector, its cluster, and the distances to all centroids as they were when it was
last evaluated: the distance to its own centroid as an upper bound, the others as lower bounds, and the
round of that evaluation.  The centroids of all rounds are retained.  In a later round the bounds are loosened by
how far each centroid has moved *in all* since the row's evaluation - the norm of the sum of its
moves, at most the sum of their norms - and a row whose upper bound stays under every other centroid's lower
bound keeps its cluster without a distance.  All other rows are rescanned exactly.

A round is one pass: tasks read the rows that the round before wrote, write them with new bounds, and
end with one row for each cluster that holds its exact sums.  Rows carry all that they need,
so no row is shuffled or joined; only the sums (clusters x components for each task) are added up.  The
rows of older rounds are removed when the next ones are written.

Exactness: components are integers.  While none exceeds 2^22 squared distances are whole
numbers below 2^53 and products of doubles are exact; beyond that Python's integers take over.
Bounds are rounded outwards, and a tie never passes them.

Special rows: vectors of another length, null, or with a null or non-finite component are left out; a
component of 10^28 or more after scaling counts as not finite (its sums would not fit a decimal); a distance or
inertia that does not fit a long is null; a null ``vec_id`` is hashed as an empty text; repeated rows count each
and may each start a centroid; with fewer vectors than clusters there are fewer clusters; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C
from tillroll.session import shared_path

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest component for which a distance is exact in doubles: 64 * (2 * 2^22)^2 = 2^52.
EXACT = 1 << 22
LARGEST = 10.0 ** 28
LONG = (1 << 63) - 1
#: Relative error of a square root or a sum of two, with room to spare.
SLACK = 1e-12

ROW = ("vec_id long, x array<double>, cluster int, upper double, lower array<float>, round int, distance long, "
       "n long, sums array<decimal(38,0)>, inertia decimal(38,0)")
_ARROW = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()),
                    ("lower", pa.list_(pa.float32())), ("round", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()),
                    ("sums", pa.list_(pa.decimal128(38, 0))), ("inertia", pa.decimal128(38, 0))])


# ---- one batch of rows --------------------------------------------------------------

def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances (rows x centroids): doubles that are whole numbers, or Python integers."""
    top = max([max(map(abs, c), default=0) for c in centroids])
    if top <= EXACT and (not x.size or np.abs(x).max() <= EXACT):
        c = np.array(centroids, np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    whole = [[int(v) for v in row] for row in x]
    out = np.empty((len(x), len(centroids)), object)
    for i, row in enumerate(whole):
        out[i] = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
    return out


def drift(history: list[list[list[int]]]) -> np.ndarray:
    """[t, j]: norm of centroid j's whole move from round t to the last one."""
    last = history[-1]
    return np.array([[float(sum((a - b) ** 2 for a, b in zip(c, d))) ** 0.5 for c, d in zip(old, last)] for old in history])


def failures(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, evaluated: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Rows whose cluster the loosened bounds do not prove."""
    rows = np.arange(len(cluster))
    most = (upper + moved[evaluated, cluster]) * (1 + SLACK)
    least = lower - moved[evaluated] * (1 + SLACK)
    least[rows, cluster] = np.inf
    return np.flatnonzero(~(most < least.min(1, initial=np.inf)))


def evaluate(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; distance to it; lower bounds of the distances to all)."""
    d2 = squared(x, centroids)
    cluster = np.argmin(d2, 1).astype(np.int32)  # the first of equal ones
    d = np.sqrt(d2.astype(np.float64))
    return cluster, d[np.arange(len(x)), cluster], np.nextafter(d.astype(np.float32), np.float32(-np.inf), dtype=np.float32)


def own_distances(x: np.ndarray, cluster: np.ndarray, centroids: list[list[int]]) -> list[int]:
    out: list[int] = [0] * len(x)
    for j in np.unique(cluster):
        rows = np.flatnonzero(cluster == j)
        for i, v in zip(rows.tolist(), squared(x[rows], [centroids[j]])[:, 0].tolist()):
            out[i] = int(v)
    return out


def _pass(history: list, last: bool) -> Callable:
    """Assign every row by the last centroids of ``history`` and add up the clusters."""
    centroids, now = history[-1], len(history) - 1
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = drift(history)
        n, sums, inertia = [0] * k, [[0] * SIZE for _ in range(k)], [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_id, flat = batch.column(0), batch.column(1).flatten().to_numpy()
            x = flat.reshape(batch.num_rows, SIZE)
            if now:
                cluster = batch.column(2).to_numpy().copy()
                upper = batch.column(3).to_numpy().copy()
                lower = batch.column(4).flatten().to_numpy().reshape(-1, k).copy()
                evaluated = batch.column(5).to_numpy().copy()
                redo = failures(cluster, upper, lower, evaluated, moved)
            else:
                cluster, upper, evaluated = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x), np.int32)
                lower, redo = np.zeros((len(x), k), np.float32), np.arange(len(x))
            cluster[redo], upper[redo], lower[redo] = evaluate(x[redo], centroids)
            evaluated[redo] = now
            distance: list = [None] * len(x)
            for j in np.unique(cluster).tolist():
                rows = x[cluster == j]
                n[j] += len(rows)
                exact = np.abs(rows).max() * len(rows) < 1 << 53
                more = rows.sum(0).tolist() if exact else [sum(map(int, c)) for c in rows.T]
                sums[j] = [a + int(b) for a, b in zip(sums[j], more)]
            if last:
                distance = own_distances(x, cluster, centroids)
                for j, d in zip(cluster.tolist(), distance):
                    inertia[j] += d
                distance = [d if d <= LONG else None for d in distance]
            yield _batch(vec_id, batch.column(1), cluster, upper, lower, evaluated, distance)
        held = [j for j in range(k) if n[j]]
        m = len(held)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float64())), pa.array(held, pa.int32()), pa.nulls(m, pa.float64()),
            pa.nulls(m, pa.list_(pa.float32())), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array([n[j] for j in held], pa.int64()),
            pa.array([sums[j] for j in held], pa.list_(pa.decimal128(38, 0))), pa.array([inertia[j] for j in held], pa.decimal128(38, 0))],
            schema=_ARROW)
    return run


def _batch(vec_id, x, cluster, upper, lower, evaluated, distance) -> pa.RecordBatch:
    m, k = lower.shape
    bounds = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(lower.ravel()))
    return pa.RecordBatch.from_arrays([
        vec_id, x.cast(pa.list_(pa.float64())), pa.array(cluster, pa.int32()), pa.array(upper), bounds, pa.array(evaluated, pa.int32()),
        pa.array(distance, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.decimal128(38, 0))), pa.nulls(m, pa.decimal128(38, 0))],
        schema=_ARROW)


# ---- rounds -------------------------------------------------------------------------

def whole_vectors(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the kept vectors, each component floor(scale * component) as a whole double."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where((F.size("v") == size) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < LARGEST)))
    # 0.0 for -0.0; floor() itself returns a long, which large components would not fit
    return v.select("vec_id", F.transform("v", lambda e: e * scale).alias("v")).select(
        "vec_id", F.transform("v", lambda e: F.when(F.abs(e) < 1 << 52, F.floor(e).cast("double")).otherwise(e)).alias("x"))


def start(vectors: DataFrame, clusters: int, seed: Column) -> list[list[int]]:
    """The first vectors by ``seed``; equal seeds (repeated ids) by their components."""
    rows = vectors.select(seed.alias("seed"), "x").orderBy("seed", "x").limit(clusters).collect()
    return [[int(e) for e in r.x] for r in rows]


def updated(sums: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floor of the means; a centroid without vectors stays.  Clusters x components numbers reach the driver."""
    total = sums.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = [list(c) for c in centroids]
    for r in total:
        out[r.cluster][r.i] = int(r.s) // r.n
    return out


def cluster(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, list[list[list[int]]]]:
    """(rows with cluster and distance, each cluster's sums by task, centroids of all rounds)."""
    spark, history, rows, before = vectors.sparkSession, [centroids], vectors, None
    for r in range(rounds + 1):
        path = shared_path(spark, f"centroids-{r}")
        table = C.stored(rows.mapInArrow(_pass(history, r == rounds), ROW), "centroids", path)
        if before:
            C.remove(spark, before)
        before = path
        rows, sums = table.where("n IS NULL"), table.where("n IS NOT NULL")
        if r < rounds:
            history = [*history, updated(sums, history[-1])]
            rows = rows.select("vec_id", "x", "cluster", "upper", "lower", "round")
    return rows.select("vec_id", "cluster", "distance"), sums.select("cluster", "n", "inertia"), history


def clusters_with_inertia(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1:") -> DataFrame:
    spark = embeddings.sparkSession
    C.ship(spark)
    vectors = whole_vectors(embeddings)
    first = start(vectors, clusters, F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows, sums, history = cluster(vectors, first, rounds)
    names = spark.createDataFrame([(j, ",".join(map(str, c))) for j, c in enumerate(history[-1])], "cluster int, components string")
    # a row for each cluster
    totals = sums.groupBy("cluster").agg(F.sum("inertia").alias("own"))
    totals = totals.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"),
                           F.sum("own").over(Window.partitionBy()).try_cast("long").alias("inertia"))
    totals = totals.join(names, "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_with_inertia(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The rounds written out: every vector against every centroid."""
    ctes = [r"""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
            """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x AS c
  FROM v ORDER BY k LIMIT 16)"""]
    for i in range(ROUNDS + 1):
        ctes.append(f"""d{i} AS (
  SELECT r, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d FROM v, c{i})""")
        ctes.append(f"a{i} AS (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < ROUNDS:
            ctes.append(f"""m{i} AS (
  SELECT k, list(f ORDER BY i) AS c FROM (
    SELECT k, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
    FROM (SELECT a.k, unnest(range(1, 65)) AS i, unnest(x) AS e FROM a{i} a JOIN v USING (r)) GROUP BY k, i) GROUP BY k)""")
            ctes.append(f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)"""


ORACLE_SQL = _oracle()
