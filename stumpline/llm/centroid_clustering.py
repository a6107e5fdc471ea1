"""Centroid clustering of integer vectors with zone maps along a space-filling curve.

The vectors are laid out once in the order of a Hilbert curve through the coordinates of most variance (their ranges
and variances come from one aggregation), cut by range into partitions and, within a partition, into blocks of
``BLOCK`` neighbouring vectors; the table is staged, so every round reads the same blocks. A block's zone map is its
box of componentwise minima and maxima. In a round, each block bounds the squared distance from its box to every
centroid from below and above; only the centroids whose lower bound is at most the least upper bound can be nearest
to a vector of the block, and only those are compared with its vectors, exactly, as a block of integer products.
Tasks return sums and counts per centroid, so what is shuffled is ``k`` rows a task, whatever the cluster sizes; the
new centroids (``k`` times the dimension, a parameter) come to the driver and go out with the next round's function.

Defined results: rows whose vector is null, of another length than ``dim`` or holds null or non-finite components
are left out; a row without an id is clustered but never seeds a centroid; repeated rows are clustered each, and
equal vectors tie to the smaller centroid number; with fewer than ``k`` kept vectors, all of them seed; an empty table
gives an empty result; other columns are ignored. Centroids are exact integers (floor of sum over count), distances
exact 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.cluster import ship, staged
from stumpline.llm.vectors import finite, matrix, scaled
from stumpline.sources.staging import drop_table

K = 40
ROUNDS = 5
SCALE = 256
DIM = 64
SEED = "2:"
BLOCK = 256  # vectors a zone map covers
CURVE_DIMS = 4  # coordinates the curve runs through
CURVE_BITS = 10  # cells a coordinate has along the curve: 2 ** CURVE_BITS
PART_ROWS = 1 << 17  # vectors a partition of the laid-out table holds

SUMS = "cluster int, dim int, total long"
ASSIGNED = "vec_id long, cluster int, distance long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows, dims), each coordinate below 2 ** bits.

    Skilling's transposed form: undo the excess work of the reflections, Gray-code, then interleave the bits.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint64(q)) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def _curve(axes: list[int], low: list[int], high: list[int], dim: int):
    width = [max(1, h - lo + 1) for lo, h in zip(low, high, strict=True)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            picked = x[:, axes] - np.asarray(low, np.int64)
            cells = (picked * (1 << CURVE_BITS)) // np.asarray(width, np.int64)
            key = hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1), CURVE_BITS) if axes else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(key, pa.int64())],
                                             ["vec_id", "x", "curve"])

    return place


def laid_out(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors (vec_id, x) in curve order, with their block; staged."""
    spark = vectors.sparkSession
    x = F.col("x")
    stats = vectors.agg(F.count("*").alias("n"), *(F.min(x[i]).alias(f"lo{i}") for i in range(dim)),
                        *(F.max(x[i]).alias(f"hi{i}") for i in range(dim)),
                        *(F.var_pop(x[i]).alias(f"v{i}") for i in range(dim))).first()
    spread = sorted(range(dim), key=lambda i: (-(stats[f"v{i}"] or 0.0), i))
    axes = [i for i in spread[:CURVE_DIMS] if (stats[f"v{i}"] or 0.0) > 0]
    low, high = [stats[f"lo{i}"] for i in axes], [stats[f"hi{i}"] for i in axes]
    parts = max(1, -(-stats["n"] // PART_ROWS), spark.sparkContext.defaultParallelism)
    curved = vectors.mapInArrow(_curve(axes, low, high, dim), "vec_id long, x array<int>, curve long")
    ordered = curved.repartitionByRange(parts, "curve", "vec_id").sortWithinPartitions("curve", "vec_id", "x")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)
    return staged(ordered.select("vec_id", "x", block.alias("block")))


def box_bounds(box_low: np.ndarray, box_high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance from any point of the box to each centroid."""
    below = np.maximum(box_low[None, :] - centroids, 0) + np.maximum(centroids - box_high[None, :], 0)
    far = np.maximum(np.abs(centroids - box_low[None, :]), np.abs(centroids - box_high[None, :]))
    return (below * below).sum(1), (far * far).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row (ties: the smaller number) and its squared distance; exact in 64-bit integers.

    Rows are taken a zone map at a time: the box bounds leave the candidate centroids, which are compared exactly.
    """
    cluster = np.empty(len(x), np.int64)
    distance = np.empty(len(x), np.int64)
    for start in range(0, len(x), BLOCK):
        rows = x[start : start + BLOCK]
        low, high = box_bounds(rows.min(0), rows.max(0), centroids)
        candidates = np.flatnonzero(low <= high.min())
        d = (rows * rows).sum(1)[:, None] - 2 * rows @ centroids[candidates].T + norms[candidates][None, :]
        best = d.argmin(1)
        cluster[start : start + BLOCK] = candidates[best]
        distance[start : start + BLOCK] = d[np.arange(len(rows)), best]
    return cluster, distance


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one block at a time (a block that two batches share is taken as two)."""
    block = batch.column("block").to_numpy()
    if len(block) == 0:
        return
    x = matrix(batch.column("x"), dim)
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True):
        yield np.arange(a, b), x[a:b]


def _round(centroids: np.ndarray, dim: int):
    norms = (centroids * centroids).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            cluster = np.empty(batch.num_rows, np.int64)
            for at, rows in _blocks(batch, dim):
                cluster[at], _ = nearest(rows, centroids, norms)
            counts += np.bincount(cluster, minlength=k)
            part = np.zeros((k, dim), np.int64)
            np.add.at(part, cluster, matrix(batch.column("x"), dim))
            sums += part.astype(object)  # Python integers: no bound on a task's rows
        used = np.flatnonzero(counts)
        cluster = np.repeat(used, dim + 1).astype(np.int32)
        dims = np.tile(np.arange(-1, dim, dtype=np.int32), len(used))
        totals = np.column_stack([counts[used].astype(object), sums[used]]).ravel() if len(used) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(dims), pa.array([int(t) for t in totals], pa.int64())],
                                         ["cluster", "dim", "total"])

    return assign


def _final(centroids: np.ndarray, dim: int):
    norms = (centroids * centroids).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for at, rows in _blocks(batch, dim):
                cluster[at], distance[at] = nearest(rows, centroids, norms)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             ["vec_id", "cluster", "distance"])

    return assign


def seeds(vectors: DataFrame, k: int, dim: int, seed: str = SEED) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of seed and id, in that order (a top-k, never the whole table)."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).orderBy(key, "x").limit(k).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), dim)


def updated(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Each centroid that won rows becomes the exact floor of their sum over their count; others stay."""
    out = centroids.copy()
    total: dict[tuple[int, int], int] = {(r.cluster, r.dim): r.total for r in sums}
    for c in {c for c, _ in total}:
        n = total[(c, -1)]
        out[c] = [total[(c, d)] // n for d in range(centroids.shape[1])]
    return out


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM,
              seed: str = SEED) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (see the module)."""
    spark = embeddings.sparkSession
    ship(spark)
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_v"))
    kept = kept.where(finite(F.col("_v"), dim)).select("vec_id", scaled(F.col("_v"), scale).cast("array<int>").alias("x"))
    table = laid_out(kept, dim)
    centroids = seeds(table, k, dim, seed)
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if len(centroids) == 0:
        drop_table(table)
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        sums = table.mapInArrow(_round(centroids, dim), SUMS).groupBy("cluster", "dim").agg(F.sum("total").alias("total"))
        centroids = updated(centroids, sums.collect())
    assigned = staged(table.mapInArrow(_final(centroids, dim), ASSIGNED))
    drop_table(table)
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [(c, int(inertia.get(c, 0)), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
               for c in range(len(centroids))]
    per_cluster = spark.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(per_cluster), "cluster")  # k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                    "centroid_sha256"))
