"""Connected components of a table of links, and groups that stream through a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.cluster import staged
from stumpline.sources.staging import drop_table


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step of large star (all neighbours) or small star (smaller neighbours): hang them below the least one."""
    ends = edges if not larger else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = ends.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node that can be reached.

    Large and small stars by turns, each round written to the shared folder, until a round changes nothing. Minima are
    combined before the shuffle, so a node with many links is no group; the number of rounds grows with the logarithm.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, before = staged(edges), None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        last, now, before = now, staged(_stars(_stars(now, True), False)), mark
        drop_table(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_roots(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least name of its component."""
    roots = names.copy()
    while True:
        least = np.where(linked, roots[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(roots, least)
        new = np.minimum(new, roots[np.searchsorted(names, new)]) if (np.diff(names) > 0).all() else new
        if (new == roots).all():
            return roots
        roots = new


def streamed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, of input that is sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield _one(held)
            held = []
        for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield _one([*held, batch.slice(low, high - low)])
            held = []
        held.append(batch.slice(cuts[-2], batch.num_rows - cuts[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def tiled(rows: DataFrame, name: str, size: int, member: str) -> DataFrame:
    """Rows of (group, rows in it) with the pairs of blocks that compare them all: ``tile`` and ``block``.

    A group over ``size`` is cut into blocks by a hash of its members; a row goes to each pair of blocks that its own
    is in, so that no task gets more than two blocks, and every two members meet in one tile.
    """
    blocks = F.ceil(F.col(name) / F.lit(size)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(member), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rows = rows.select("*", other)
    return rows.withColumn("tile", F.least("block", "other") * F.lit(1 << 20) + F.greatest("block", "other")).drop("other")
