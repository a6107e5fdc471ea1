"""Removal of repeated passages: fixed reference blocks, probed by every rolling window, extended to maximal repeats.

``WINDOW`` consecutive words repeat if the same words start anywhere else. Every such window holds one of its document's
non-overlapping blocks of ``BLOCK`` words, as twice a block is no longer than a window and a word. So:

1. Index: each document's blocks at multiples of ``BLOCK``. Probe: each window of ``BLOCK`` words at any place. Both are
   dealt by hash to buckets; a run of documents sends each probe once (and whether it saw it twice). A block is hit if
   its words occur twice. Hashes are cut to 32 bits within a bucket, which can only hit too much.
2. The documents of hit blocks are written once, dealt by key, as a bucketed table, so that what follows moves hashes and
   not texts. Hits are extended: all windows of ``WINDOW`` words around a hit block are compared by hashes of more than
   64 bits, again once for each run of documents, and a bit comes back for each. Windows that repeat and overlap
   merge into the maximal exact repeats; their words go.

A passage that is in a third of all documents is one hash for each run of documents: nothing is paired, and no group
meets in one task.

Defined results: a null text has no words; texts shorter than a window lose nothing; rows that are equal in id and text
are repeats of each other; null ids are kept as such; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import PIECE, binary, distinct, flat, pieces, span_hashes, window_hashes, words
from stumpline.llm.cluster import bounded_text, ship, staged

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
RUN_WORDS = 1 << 21
SENT = 200_000

PROBES = "bucket int, probes binary, twice binary, index binary, keys binary, blocks binary"
_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each row's first word, each word's row, and its place in its row."""
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return span_hashes(data, starts, ends), first, row, np.arange(len(starts)) - first[row]


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x)))


class _Run:
    """Probes and index blocks of a run of documents, until they are sent."""

    def __init__(self, window: int, block: int, buckets: int):
        self.window, self.block, self.buckets = window, block, buckets
        self.clear()

    def clear(self) -> None:
        self.words = 0
        self.hashes: list[np.ndarray] = []
        self.index: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        hashes, first, row, place = word_hashes(data, offsets)
        rolled = window_hashes(hashes, self.block, 1)
        row, place = row[: len(rolled)], place[: len(rolled)]
        length = np.diff(first)[row]
        inside = (place + self.block <= length) & (length >= self.window)
        rolled, row, place = rolled[inside], row[inside], place[inside]
        address = ((rolled >> _HIGH) % np.uint64(self.buckets) << _HIGH) | (rolled & _LOW)
        self.hashes.append(address)
        anchor = place % self.block == 0
        self.index.append((address[anchor], keys[row[anchor]], (place[anchor] // self.block).astype(np.int32)))
        self.words += len(hashes)

    def send(self) -> pa.RecordBatch:
        seen, times = runs_of(np.concatenate(self.hashes))
        twice = seen[times > 1]
        address, keys, blocks = (np.concatenate(x) for x in zip(*self.index, strict=True))
        order = np.argsort(address)
        address, keys, blocks = address[order], keys[order], blocks[order]
        edges = np.arange(self.buckets + 1, dtype=np.uint64) << _HIGH
        cuts = [np.searchsorted(x, edges) for x in (seen, twice, address)]
        columns = []
        for values, at in ((seen, 0), (twice, 1), (address, 2)):
            raw = (values & _LOW).astype("<u4").tobytes()
            columns.append(binary([raw[4 * a : 4 * b] for a, b in itertools.pairwise(cuts[at].tolist())]))
        for values in (keys, blocks):
            raw, width = values.tobytes(), values.itemsize
            columns.append(binary([raw[width * a : width * b] for a, b in itertools.pairwise(cuts[2].tolist())]))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.arange(self.buckets), pa.int32()), *columns], ["bucket", "probes", "twice", "index", "keys", "blocks"])


def _probes(window: int, block: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(window, block, buckets)
        for rows, data, offsets in pieces(batches, "text"):
            run.add(rows.column("key").to_numpy(), data, offsets)
            if run.words >= RUN_WORDS:
                yield run.send()
        if run.words:
            yield run.send()

    return send


def _joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(flat(chunk)[0].tobytes(), dtype) for chunk in column.chunks]) if column.num_chunks else np.zeros(0, dtype)


def _hit_blocks(bucket: pa.Table) -> pa.Table:
    """Of one bucket's index, the blocks whose words occur twice."""
    seen, times = runs_of(_joined(bucket["probes"], "<u4"))
    hit = np.union1d(seen[times > 1], _joined(bucket["twice"], "<u4"))
    found = np.isin(_joined(bucket["index"], "<u4"), hit)
    return pa.table({"key": _joined(bucket["keys"], "<i8")[found], "block": _joined(bucket["blocks"], "<i4")[found]})


def near_hits(length: np.ndarray, first: np.ndarray, total: int, blocks: list[np.ndarray], window: int, block: int) -> np.ndarray:
    """For each word of a run: does a window that holds a hit block start there?"""
    edge = np.zeros(total + 1, np.int64)
    for n, begin, hit in zip(length, first, blocks, strict=True):
        hit = hit[(hit + 1) * block <= n] * block
        low, high = np.maximum(hit + block - window, 0), np.minimum(hit, n - window) + 1
        ok = low < high
        np.add.at(edge, begin + low[ok], 1)
        np.add.at(edge, begin + high[ok], -1)
    return np.cumsum(edge[:-1]) > 0


def _chunks(group: pa.Table) -> Iterator[pa.Table]:
    """A group in a fixed order, in runs of rows of limited size; the same for every reader of the group."""
    group = group.sort_by("ord")
    sizes = np.cumsum(_sizes(group["text"]))
    low = 0
    while low < group.num_rows:
        before = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, before + PIECE, "right")))
        yield group.slice(low, high - low).combine_chunks()
        low = high


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.diff(flat(chunk)[1]) for chunk in column.chunks])


class _Candidates:
    """Windows of a chunk around its hit blocks: their starts, and their distinct hashes by bucket."""

    def __init__(self, chunk: pa.Table, window: int, block: int, buckets: int):
        data, offsets = flat(chunk["text"].chunk(0))
        hashes, self.first, _, _ = word_hashes(data, offsets)
        self.length = np.diff(self.first)
        blocks = [np.array(x, np.int64) for x in chunk["blocks"].to_pylist()]
        near = near_hits(self.length, self.first[:-1], len(hashes), blocks, window, block)
        self.at = np.flatnonzero(near)
        key = window_hashes(hashes, window, 2)[self.at]
        bucket = window_hashes(hashes, window, 3)[self.at] % np.uint64(buckets)
        self.order = np.lexsort((key, bucket))
        key, bucket = key[self.order], bucket[self.order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        begin = np.flatnonzero(new)
        self.which = np.cumsum(new) - 1
        self.keys, self.buckets = key[begin], bucket[begin].astype(np.int64)
        self.twice = np.diff(np.append(begin, len(key))) > 1

    def by_bucket(self) -> list[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.buckets, prepend=-1, append=-1))
        return [(int(self.buckets[a]), slice(a, b)) for a, b in itertools.pairwise(cuts.tolist())]


WINDOWS = "part int, chunk int, bucket int, hashes binary, twice binary"
BITS = "part int, chunk int, bucket int, repeated binary"
REMOVED = "key long, n_removed long, kept_sha256 string"


def _windows(window: int, block: int, buckets: int):
    def send(group: pa.Table) -> pa.Table:
        rows = []
        for number, chunk in enumerate(_chunks(group)):
            found = _Candidates(chunk, window, block, buckets)
            part = chunk["part"][0].as_py()
            rows += [(part, number, b, found.keys[s].tobytes(), np.packbits(found.twice[s]).tobytes()) for b, s in found.by_bucket()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table(
            {
                "part": pa.array(columns[0], pa.int32()), "chunk": pa.array(columns[1], pa.int32()), "bucket": pa.array(columns[2], pa.int32()),
                "hashes": binary(list(columns[3])), "twice": binary(list(columns[4])),
            }
        )

    return send


def _repeated(bucket: pa.Table) -> pa.Table:
    """For each chunk's hashes in a bucket, a bit: does it occur twice?"""
    each = [np.frombuffer(x, np.uint64) for x in bucket["hashes"].to_pylist()]
    _, _, which = distinct(np.concatenate(each))
    shared = np.split((np.bincount(which) > 1)[which], np.cumsum([len(x) for x in each])[:-1])
    bits = [
        np.packbits(x | (np.unpackbits(np.frombuffer(twice, np.uint8), count=len(x)) > 0)).tobytes()
        for x, twice in zip(shared, bucket["twice"].to_pylist(), strict=True)
    ]
    return bucket.select(["part", "chunk", "bucket"]).append_column("repeated", binary(bits))


def kept_digest(text: bytes, gone: np.ndarray | None = None) -> str:
    kept = text.split() if gone is None else itertools.compress(text.split(), (~gone).tolist())
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _removals(window: int, block: int, buckets: int):
    def apply(group: pa.Table, answers: pa.Table) -> pa.Table:
        bits = {(r["chunk"], r["bucket"]): r["repeated"] for r in answers.to_pylist()}
        keys, removed, digests = [], [], []
        for number, chunk in enumerate(_chunks(group)) if group.num_rows else ():
            found = _Candidates(chunk, window, block, buckets)
            repeated = np.zeros(len(found.keys), bool)
            for b, s in found.by_bucket():
                repeated[s] = np.unpackbits(np.frombuffer(bits[number, b], np.uint8), count=s.stop - s.start)
            starts = found.at[found.order[repeated[found.which]]]
            edge = np.zeros(found.first[-1] + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for key, text, a, b in zip(chunk["key"].to_pylist(), chunk["text"].cast(pa.binary()).to_pylist(), found.first[:-1], found.first[1:], strict=True):
                n = int(gone[a:b].sum())
                if n:
                    keys.append(key)
                    removed.append(n)
                    digests.append(kept_digest(text, gone[a:b]))
        return pa.table({"key": pa.array(keys, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    return apply


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in pieces(batches, "text"):
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in itertools.pairwise(offsets.tolist())]
        yield pa.RecordBatch.from_arrays(
            [*rows.select(["key", "doc_id"]).columns, pa.array([len(t.split()) for t in texts], pa.int64()), pa.array([kept_digest(t) for t in texts])],
            ["key", "doc_id", "n_words", "whole_sha256"],
        )


def repeats_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document (kept words joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    block = (window + 1) // 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")

    probes = keyed.select("key", "text").mapInArrow(_probes(window, block, parts), PROBES)
    hits = probes.groupBy("bucket").applyInArrow(_hit_blocks, "key long, block int")
    hits = staged(hits.groupBy("key").agg(F.collect_set("block").alias("blocks")))

    wanted = keyed.select("key", "text")
    if hits.count() <= SENT:  # few enough to be sent to the scan, so that only their texts are shuffled
        wanted = wanted.join(F.broadcast(hits.select("key")), "key", "left_semi")
    name = f"hit_documents_{uuid.uuid4().hex}"
    placed = wanted.join(hits, "key").select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), F.monotonically_increasing_id().alias("ord"), "key", "text", "blocks")
    placed.repartition(parts, "part").write.bucketBy(parts, "part").option("compression", "zstd").saveAsTable(name)
    placed = spark.table(name)

    sent = placed.groupBy("part").applyInArrow(_windows(window, block, parts), WINDOWS)
    answers = sent.groupBy("bucket").applyInArrow(_repeated, BITS)
    removed = placed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_removals(window, block, parts), REMOVED)
    removed = removed.groupBy("key").agg(F.first("n_removed").alias("n_removed"), F.first("kept_sha256").alias("kept_sha256"))

    every = keyed.mapInArrow(_summary, "key long, doc_id long, n_words long, whole_sha256 string")
    return every.join(removed, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )
