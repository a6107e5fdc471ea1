"""Jaccard join on word shingles by chosen paths.

A document's set is the hashes of its runs of ``SHINGLE`` words. Texts of equal sets are one class, which is joined as
one set. In each of several runs, a set is put into a bucket for each of its tokens that a keyed hash samples with
probability 1 / (threshold x size); sets that share much sample the same tokens. Buckets of up to ``SMALL`` sets are
compared by brute force; larger ones are split again by tokens sampled anew under the bucket's path, up to ``DEPTH``
levels, and what is large still (many texts that are all alike) is compared in tiles. With p(0) = 1 and
p(k) = 1 - exp(-p(k - 1)), a pair at the threshold meets in a run with probability p(depth) at least; runs are repeated
until the chance to meet in one of them reaches ``RECALL``.

Comparing has two steps: sketches (the least hash of each of 128 ranges) drop sets without a partner in their bucket
that comes near the threshold, then the sets themselves are intersected. A pair that meets in several buckets counts in
the first one that both are in. Links never become rows: a tile returns each set's number of links and the least member
of its local component.

Defined results: texts of fewer words than a shingle have one shingle, all their words; texts without words (null ones
too) and rows without an id link with nothing; repeated rows link with each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import binary, distinct, flat, keyed, mixed, pieces, span_hashes, window_hashes, words
from stumpline.llm.cluster import bounded_text, ship, staged, without_rows
from stumpline.llm.components import components, local_roots, streamed_groups, tiled

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
SMALL = 64
DEPTH = 3
TILE = 512
BINS = 128
NEAR = 0.6
FEW = 64
SENT = 200_000
TOKEN_BITS = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def token_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of all rows, and where each row's begin."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    rolled = window_hashes(hashes, shingle, 11)
    inside = (np.arange(len(rolled)) - first[row[: len(rolled)]] + shingle) <= n[row[: len(rolled)]]
    rolled, row = rolled[inside], row[: len(inside)][inside]
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        rolled = np.append(rolled, [window_hashes(hashes[first[i] : first[i + 1]], int(n[i]), 11)[0] for i in short])
        row = np.append(row, short)
    if len(n) > 1 << (64 - TOKEN_BITS):
        raise ValueError("too many rows in a piece")
    both = np.sort((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (rolled >> np.uint64(64 - TOKEN_BITS)))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    begins = np.searchsorted(both, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS))
    return both & np.uint64((1 << TOKEN_BITS) - 1), begins


def limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes below it are sampled: a share of 1 / (threshold x size)."""
    return np.minimum(2.0**64 - 2048, 2.0**64 / (threshold * np.maximum(sizes, 1))).astype(np.uint64)


def first_paths(tokens: np.ndarray, begins: np.ndarray, runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of the first level of all runs."""
    sizes = np.diff(begins)
    limit = np.repeat(limits(sizes, threshold), sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rows, paths = [], []
    for r in range(runs):
        chosen = np.flatnonzero(mixed(tokens ^ keyed(r)) < limit)
        rows.append(row[chosen])
        paths.append(mixed(tokens[chosen] * _STEP + keyed(1000 + r)))
    return np.concatenate(rows), np.concatenate(paths)


def next_paths(tokens: np.ndarray, path: np.uint64, threshold: float) -> np.ndarray:
    """Paths below ``path`` of one set."""
    chosen = tokens[mixed(tokens ^ mixed(np.array([path]) + _STEP)) < limits(np.array([len(tokens)]), threshold)]
    return mixed(chosen * _STEP + path)


def sketches(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A byte for each of ``BINS`` ranges of hashes: of the range's least token, 0 where there is none."""
    rows = len(begins) - 1
    out = np.zeros((rows, BINS), np.uint8)
    cell = np.repeat(np.arange(rows), np.diff(begins)) * BINS + (tokens >> np.uint64(TOKEN_BITS - 7)).astype(np.int64)
    least = np.flatnonzero(np.diff(cell, prepend=-1))
    out.reshape(-1)[cell[least]] = (mixed(tokens[least]) >> np.uint64(56)).astype(np.int64) % 255 + 1
    return out


def _scan(runs: int, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text", 1 << 20):
            tokens, begins = token_sets(data, offsets)
            raw = tokens.tobytes()
            row, paths = first_paths(tokens, begins, runs, threshold)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(len(begins))).astype(np.int32)
            sketch = sketches(tokens, begins)
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.select(["key", "doc_id"]).columns,
                    binary([hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in itertools.pairwise(begins.tolist())]),
                    pa.array(np.diff(begins), pa.int32()),
                    binary([s.tobytes() for s in sketch]),
                    pa.ListArray.from_arrays(cuts, pa.array(paths[order].view(np.int64))),
                ],
                ["key", "doc_id", "cls", "n", "sketch", "paths"],
            )

    return scan


SCANNED = "key long, doc_id long, cls binary, n int, sketch binary, paths array<long>"


def _split(threshold: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text", 1 << 20):
            tokens, begins = token_sets(data, offsets)
            cls, out, owner = rows.column("cls").to_pylist(), [], []
            for i, paths in enumerate(rows.column("paths").to_pylist()):
                for path in np.array(paths, np.int64).view(np.uint64):
                    below = next_paths(tokens[begins[i] : begins[i + 1]], path, threshold)
                    out.append(below)
                    owner += [cls[i]] * len(below)
            paths = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(paths), binary(owner)], ["path", "cls"])

    return split


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in pieces(batches, "text", 1 << 20):
        tokens, begins = token_sets(data, offsets)
        raw = tokens.tobytes()
        yield pa.RecordBatch.from_arrays([rows.column("cls"), binary([raw[8 * a : 8 * b] for a, b in itertools.pairwise(begins.tolist())])], ["cls", "tokens"])


# Comparing within a tile.


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products of 0/1 columns, some at a time."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    sides = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    common = np.intersect1d(*(distinct(s)[0] for s in sides), assume_unique=True)
    total = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets, every in zip((left, right), sides, strict=True):
        at = np.searchsorted(common, every)
        held = at < len(common)
        held[held] = common[at[held]] == every[held]
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]))
    for low in range(0, len(common), 4096):
        tables = []
        for (row, at), sets in zip(places, (left, right), strict=True):
            within = (at >= low) & (at < low + 4096)
            table = np.zeros((len(sets), min(4096, len(common) - low)), np.float32)
            table[row[within], at[within] - low] = 1
            tables.append(table)
        total += tables[0] @ tables[1].T
    return total.astype(np.int64)


def compared(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a tile are its left and right side: two blocks, or one block twice."""
    block = rows.column("block").to_numpy()
    low, high = divmod(rows.column("tile")[0].as_py(), 1 << 20)
    return np.flatnonzero(block == low), np.flatnonzero(block == high)


def _near(threshold: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of a tile with a partner whose size and sketch come near; (path, cls)."""
        for rows in streamed_groups(batches, ["path", "tile"]):
            if rows.num_rows < 2:
                continue
            left, right = compared(rows)
            n = rows.column("n").to_numpy().astype(float)
            sketch = np.frombuffer(flat(rows.column("sketch"))[0].tobytes(), np.uint8).reshape(-1, BINS)
            found = np.zeros(rows.num_rows, bool)
            for low in range(0, len(left), 64):
                some = left[low : low + 64]
                a, b = sketch[some][:, None, :], sketch[right][None, :, :]
                same = ((a == b) & (a > 0)).sum(2)
                either = ((a > 0) | (b > 0)).sum(2)
                small, large = np.minimum.outer(n[some], n[right]), np.maximum.outer(n[some], n[right])
                near = (small >= threshold * large) & ((same >= NEAR * either) | (small <= FEW)) & (some[:, None] != right[None, :])
                found[some[near.any(1)]] = True
                found[right[near.any(0)]] = True
            kept = np.flatnonzero(found)
            if len(kept):
                yield rows.select(["path", "cls"]).take(pa.array(kept))

    return keep


LINKS = "rep long, links long, root long"


def _linked(threshold: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in streamed_groups(batches, ["path", "tile"]):
            if rows.num_rows < 2:
                continue
            order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
            rows = rows.take(pa.array(order))
            left, right = compared(rows)
            rep, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
            path = rows.column("path")[0].as_py()
            data, offsets = flat(rows.column("tokens"))
            tokens = np.frombuffer(data.tobytes(), np.uint64)
            sets = [tokens[a:b] for a, b in itertools.pairwise((offsets // 8).tolist())]
            n = np.array([len(s) for s in sets])
            inner = overlaps([sets[i] for i in left], [sets[i] for i in right])
            linked = inner >= threshold * (n[left][:, None] + n[right][None, :] - inner) - 1e-9
            linked &= left[:, None] != right[None, :]
            if linked.any():
                earlier = [np.array([p for p in x if p < path], np.int64).view(np.uint64) for x in rows.column("every").to_pylist()]
                linked &= overlaps([earlier[i] for i in left], [earlier[i] for i in right]) == 0
            if not linked.any():
                continue
            whole = np.zeros((len(rep), len(rep)), bool)
            whole[np.ix_(left, right)] = linked
            whole |= whole.T
            some = whole.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array((whole @ size)[some]), pa.array(local_roots(whole, rep)[some])], ["rep", "links", "root"])

    return link


# The Spark side.


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of some classes. Up to ``SENT`` keys are sent to the scan, so that only their texts are shuffled."""
    texts = docs.select("key", "text")
    if wanted.count() <= SENT:
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    return texts.join(wanted, "key")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two sets or more, with the bucket's size."""
    return rows.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "path")


def leaves(classes: DataFrame, docs: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(path, cls, size): the buckets in which sets are compared."""
    level = staged(_sized(classes.select(F.explode("paths").alias("path"), "cls")))
    found = []
    for k in range(1, depth + 1):
        large = level.where(F.col("size") > SMALL)
        if k == depth or large.isEmpty():
            found.append(level)
            break
        found.append(level.where(F.col("size") <= SMALL))
        wanted = staged(large.groupBy("cls").agg(F.collect_list("path").alias("paths")).join(classes.select("cls", "key"), "cls"))
        split = _texts_of(docs, wanted).select("cls", "paths", "text").mapInArrow(_split(threshold), "path long, cls binary")
        level = staged(_sized(split.distinct()))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Buckets with the same members compare the same pairs: one of them is enough.
    members = every.groupBy("path").agg(F.first("size").alias("size"), F.sum(F.hash("cls").cast("long")).alias("s"), F.bit_xor(F.xxhash64("cls")).alias("x"))
    return every.join(members.groupBy("size", "s", "x").agg(F.min("path").alias("path")).select("path"), "path")


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (least id that links reach), n_links (other documents linked), kept (the id is the class's), key."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    scanned = staged(rows.mapInArrow(_scan(runs_for(recall, depth), threshold), SCANNED))
    named = scanned.where("cls is not null and doc_id is not null")
    classes = staged(
        named.groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("key").alias("key"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")
        )
    )
    buckets = leaves(classes, rows, threshold, depth)
    met = tiled(buckets.join(classes.select("cls", "n", "sketch"), "cls"), "size", TILE, "cls")
    near = met.repartition("path", "tile").sortWithinPartitions("path", "tile").mapInArrow(_near(threshold), "path long, cls binary")
    near = staged(near.distinct())
    resized = near.join(near.groupBy("path").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "path")
    every = near.groupBy("cls").agg(F.collect_list("path").alias("every"))
    wanted = staged(every.join(classes.select("cls", "key", "rep", "copies"), "cls"))
    sets = _texts_of(rows, wanted.select("cls", "key")).select("cls", "text").mapInArrow(_sets, "cls binary, tokens binary")
    sets = sets.dropDuplicates(["cls"])
    full = tiled(resized.join(wanted.select("cls", "rep", F.col("copies").alias("size"), "every"), "cls").join(sets, "cls"), "members", TILE, "cls")
    full = full.select("path", "tile", "block", "rep", "size", "every", "tokens").repartition("path", "tile").sortWithinPartitions("path", "tile")
    links = staged(full.mapInArrow(_linked(threshold), LINKS))

    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = classes.select("cls", "rep", "copies").join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    facts = facts.select("cls", F.coalesce("component", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = scanned.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(facts, "cls", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return joined.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"), "key")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The documents without those that are linked to one that stays: of each class the least (doc_id, key)."""
    linked = staged(similar_documents(docs).where("n_links > 0").select("class_id", F.struct("doc_id", "key").alias("row")))
    best = linked.groupBy("class_id").agg(F.min("row").alias("row"))
    gone = linked.join(best.select("class_id", F.col("row").alias("best")), "class_id").where("row <> best").select("row.key")
    again = linked.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row.key")
    return without_rows(docs, {"key": F.xxhash64(F.col("doc_id").cast("long"), bounded_text(docs, "text"))}, gone, again)
