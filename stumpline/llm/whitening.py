"""Whitening of integer embeddings by the eigenvectors of their covariance, refined in higher precision.

The covariance comes from one distributed pass: every task sums the Gram matrix and the sums of its rows' integer
vectors, exactly (64-bit products checked against overflow, Python integers across batches), and Spark adds the task
sums as decimals, so the matrix n^2 V = n G - S S^T reaches the driver exact; it has the size of the dimension
squared, whatever the number of rows. Its eigenvectors are first found in float32 and then corrected by Ogita and
Aishima's iteration, whose products run in extended precision: R = I - X'X, T = X'AX, eigenvalues T_ii / (1 - R_ii),
and X gains X E with E_ij = (T_ij + l_j R_ij) / (l_j - l_i), or R_ij / 2 where two eigenvalues are closer than the
iteration can part; the vectors of such a cluster are then rotated by the eigenvectors of their own small block of
X'AX (a sub-solve). Rows are projected JVM-side with the components as literals; a second pass over the staged
projections measures their covariance against the identity.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, so are rows of another
length than the most frequent one (ties: the shorter) and empty vectors; rows without an id stay (id null); repeated rows count each; a
component whose eigenvalue is at most ``FLAT`` times the trace has no whitened value (null) and is left out of the
identity check; an empty table gives an empty result; other columns are ignored. Components have a unit length and
the sign that makes their largest entry (first of equal ones) positive. ``deviation`` is exact while it fits a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.cluster import ship, staged
from stumpline.llm.vectors import finite, matrix, scaled

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
FLAT = 1e-12
ITERATIONS = 30
HIGH = np.longdouble

SUMS = "pos int, total decimal(38,0)"


def _moments(dim: int):
    """Per task: row count, sums and Gram matrix of the integer vectors y (without the offset), as exact integers."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = matrix(batch.column("y"), dim)
            top = int(np.abs(y).max(initial=0))
            if top * top * len(y) < (1 << 62):
                gram = (y.T @ y).astype(object)
            else:  # very large components: products as Python integers
                gram = y.astype(object).T @ y.astype(object)
            n += len(y)
            s += y.sum(0).astype(object) if top * len(y) < (1 << 62) else y.astype(object).sum(0)
            g += gram
        if n:
            values = [n, *s.tolist(), *g.ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(values) - 1), pa.int32()),
                                              pa.array([str(int(v)) for v in values], pa.string())], ["pos", "total"])

    return moments


def refined(a: np.ndarray, start: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a`` from approximate ones, by Ogita-Aishima steps in ``HIGH``.

    Eigenvalues that the step can't part (closer than its own error bound) form clusters; each cluster's vectors are
    rotated by the eigenvectors of their block of X'AX, after which the next step goes on.
    """
    a = a.astype(HIGH)
    x = start.astype(HIGH)
    size = len(a)
    eye = np.eye(size, dtype=HIGH)
    norm_a = np.sqrt((a * a).sum())
    for _ in range(iterations):
        r = eye - x.T @ x
        t = x.T @ a @ x
        lam = np.diag(t) / (1 - np.diag(r))
        off = t - np.diag(lam)
        delta = 2 * (np.sqrt((off * off).sum()) + norm_a * np.sqrt((r * r).sum()))
        gap = lam[None, :] - lam[:, None]
        close = np.abs(gap) <= delta
        e = np.where(close, r / 2, (t + lam[None, :] * r) / np.where(close, 1, gap))
        x = x + x @ e
        for cluster in _clusters(close):
            if len(cluster) > 1:
                block = (x[:, cluster].T @ a @ x[:, cluster]).astype(np.float64)
                _, w = np.linalg.eigh((block + block.T) / 2)
                x[:, cluster] = x[:, cluster] @ w.astype(HIGH)
        if np.abs(e).max() < 1e-17:
            break
    lam = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    x = x / np.sqrt((x * x).sum(0))[None, :]
    return lam, x


def _clusters(close: np.ndarray) -> list[list[int]]:
    """Groups of indices joined by ``close`` (connected components of a small matrix)."""
    seen: set[int] = set()
    out = []
    for i in range(len(close)):
        if i in seen:
            continue
        group, todo = [], [i]
        seen.add(i)
        while todo:
            j = todo.pop()
            group.append(j)
            for m in np.flatnonzero(close[j]):
                if int(m) not in seen:
                    seen.add(int(m))
                    todo.append(int(m))
        out.append(sorted(group))
    return out


def eigen(scaled_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of an exact integer matrix."""
    a = np.array(scaled_cov, dtype=HIGH)
    top = np.abs(a).max(initial=0) or 1
    _, start = np.linalg.eigh((a / top).astype(np.float32))
    lam, x = refined(a / top, start.astype(np.float64))
    order = np.argsort(-lam.astype(np.float64), kind="stable")
    lam, x = lam[order] * top, x[:, order]
    signs = np.sign(x[np.argmax(np.abs(x.astype(np.float64)), 0), np.arange(x.shape[1])])
    return lam, x * np.where(signs == 0, 1, signs)[None, :]


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per kept row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries are x = floor(scale * c) + OFFSET; the offset cancels in n x - S, so the work is done on y = x - OFFSET.
    """
    spark = embeddings.sparkSession
    ship(spark)
    empty = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("_v"))
    rows = rows.where(finite(F.col("_v")) & (F.size("_v") > 0)).select("vec_id", scaled(F.col("_v"), scale).alias("y"))
    lengths = rows.groupBy(F.size("y").alias("d")).count().collect()  # one row a length
    if not lengths:
        return spark.createDataFrame([], empty)
    dim = min(lengths, key=lambda r: (-r["count"], r.d)).d
    rows = staged(rows.where(F.size("y") == dim))
    totals = {r.pos: int(r.total) for r in rows.mapInArrow(_moments(dim), "pos int, total string")
              .groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = totals[-1]
    s = [totals[i] for i in range(dim)]
    scaled_cov = [[n * totals[dim + i * dim + j] - s[i] * s[j] for j in range(dim)] for i in range(dim)]  # n^2 V
    trace = sum(scaled_cov[i][i] for i in range(dim))
    lam, x = eigen(np.array(scaled_cov, dtype=object))
    count = min(components, dim)
    e = [float(lam[k]) / (n * n) for k in range(count)]
    flat = [ek <= FLAT * trace / (n * n) for ek in e]
    # (n y - S) for every dimension, exact; projected with v / (n sqrt(e)) in double
    centred = F.zip_with("y", F.array(*(F.lit(v).cast("long") for v in s)), lambda y, t: F.lit(n) * y - t)
    deviation = F.aggregate(centred, F.lit(0).cast("decimal(38,0)"),
                            lambda acc, c: acc + c.cast("decimal(38,0)") * c.cast("decimal(38,0)")).cast("long")
    projected = []
    for k in range(count):
        if flat[k]:
            projected.append(F.lit(None).cast("double"))
            continue
        coef = F.array(*(F.lit(float(x[d, k]) / (n * float(np.sqrt(e[k])))) for d in range(dim)))
        projected.append(F.aggregate(F.zip_with(centred, coef, lambda c, w: c.cast("double") * w), F.lit(0.0), lambda p, q: p + q))
    done = staged(rows.select("vec_id", deviation.alias("deviation"), F.array(*projected).alias("w")))
    live = [k for k in range(count) if not flat[k]]
    identity_error = 0.0
    if live:
        w = F.col("w")
        sums = done.agg(*(F.sum(w[i]).alias(f"s{i}") for i in live),
                        *(F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i in live for j in live if i <= j)).first()
        identity_error = max(abs(sums[f"p{i}_{j}"] / n - (sums[f"s{i}"] / n) * (sums[f"s{j}"] / n) - (i == j))
                             for i in live for j in live if i <= j)
    explained = F.array(*(F.lit(ek / (trace / (n * n)) if trace else 0.0) for ek in e))
    pairs = F.zip_with("w", explained, lambda a, b: F.struct(a.alias("w"), b.alias("x")))
    return (done.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode(pairs).alias("k", "z"))
            .select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation",
                    F.col("z.w").alias("whitened"), F.col("z.x").alias("explained"),
                    F.lit(float(identity_error)).alias("identity_error")))
