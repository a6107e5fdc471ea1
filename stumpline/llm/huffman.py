"""Token ids in files: canonical length-limited Huffman codes from global counts.

A file set is a folder that Spark writes and reads. Its rows are blocks that are decoded by themselves: a run of
documents in ascending id order, their bit strings (each from a byte's first bit on), and a checkpoint, the bit offset
within the document, before every ``STRIDE`` ids. The code lengths, from which the canonical codes follow, stand in a
row of their own folder. Decoding looks up ``LIMIT`` bits at a time in a table and goes through all stretches between
checkpoints of a block in step.

Only counts (one row for each id of the vocabulary) and one total for each file part reach the driver.

Defined results: a null or empty text is its end id alone; rows without an id come first; rows that repeat an id keep
the order of their position in the input; an empty table gives files without blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpline.llm.arrays import binary, flat, pieces
from stumpline.llm.cluster import ship
from stumpline.llm.tokens import WIDE_ID
from stumpline.sources.staging import work_dir

LIMIT = 20
STRIDE = 256
BLOCK_BYTES = 1 << 20
_PAD = 4


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code without a code over ``limit`` bits; 0 for ids that never occur.

    Package-merge: in each of ``limit`` rounds the weights are merged with the pairs of the round before; of the last
    round the cheapest 2 n - 2 entries are taken, and of each round before, the pairs that they came from.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    rounds, row = [], weights
    is_leaf = np.ones(n, bool)
    for _ in range(limit):
        rounds.append(is_leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by_weight = np.argsort(both, kind="stable")
        row, is_leaf = both[by_weight], by_weight < n
    taken = 2 * n - 2
    depth = np.zeros(n + 1, np.int64)
    for leaves in reversed(rounds):
        singles = int(leaves[:taken].sum())
        depth[0] += 1
        depth[singles] -= 1
        taken = 2 * (min(taken, len(leaves)) - singles)
        if not taken:
            break
    lengths[order] = np.cumsum(depth[:-1])
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        sizes = lengths[order].astype(np.int64)
        steps = np.int64(1) << (LIMIT - sizes)
        codes[order] = ((np.cumsum(steps) - steps) >> (LIMIT - sizes)).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next ``LIMIT`` bits."""
    ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return ids, sizes


def encode_rows(ids: np.ndarray, begins: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of rows of ids: all bytes, each row's first byte, all checkpoints, each row's first checkpoint."""
    size = lengths[ids].astype(np.int64)
    bits = np.concatenate([[0], np.cumsum(size)])
    row_bits = bits[begins]
    row_bytes = np.concatenate([[0], np.cumsum((np.diff(row_bits) + 7) // 8)])
    counts = np.diff(begins)
    within = bits[:-1] - np.repeat(row_bits[:-1], counts)
    at = within + np.repeat(row_bytes[:-1] * 8, counts)
    window = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    words = np.zeros(row_bytes[-1] // 4 + 2, np.uint64)
    if len(word):  # neighbours share a word; only the last code of a word can reach into the next
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        last = np.append(begin[1:], len(word)) - 1
        words[word[begin]] += np.add.reduceat(window >> np.uint64(32), begin)
        words[word[last] + 1] += window[last] & np.uint64(0xFFFFFFFF)
    out = words.astype(">u4").view(np.uint8)
    marks = (counts + STRIDE - 1) // STRIDE
    first_mark = np.concatenate([[0], np.cumsum(marks)])
    nth = np.arange(first_mark[-1]) - np.repeat(first_mark[:-1], marks)
    checkpoints = within[np.repeat(begins[:-1], marks) + nth * STRIDE].astype("<u4")
    return out[: row_bytes[-1]], row_bytes, checkpoints, first_mark


def decode_rows(data: np.ndarray, first_byte: np.ndarray, counts: np.ndarray, checkpoints: np.ndarray, table: tuple) -> np.ndarray:
    """Ids of rows one after the other: every stretch between checkpoints is a lane, all lanes go in step."""
    table_ids, table_sizes = table
    wide = np.concatenate([data, np.zeros(_PAD, np.uint8)]).astype(np.uint32)
    words = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    marks = (counts + STRIDE - 1) // STRIDE
    lanes = int(marks.sum())
    left = np.full(lanes, STRIDE, np.int64)
    last = np.cumsum(marks) - 1
    left[last[marks > 0]] = (counts - (marks - 1) * STRIDE)[marks > 0]
    at = np.repeat(first_byte, marks) * 8 + checkpoints.astype(np.int64)
    begin = np.cumsum(left) - left
    order = np.argsort(-left, kind="stable")
    at, begin, left = at[order], begin[order], left[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    live = lanes
    for step in range(int(left[0]) if lanes else 0):
        while left[live - 1] <= step:
            live = int(np.searchsorted(-left[:live], -step))
        here = at[:live]
        peek = (words[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[begin[:live] + step] = table_ids[peek]
        at[:live] += table_sizes[peek]
    return out


# The Spark side.


def id_counts(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, n) over all rows; a task sends one row for each id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for _, data, _ in pieces(batches, "ids"):
            part = np.bincount(data.view(dtype) if data.flags.aligned else np.frombuffer(data.tobytes(), dtype))
            total = np.pad(total, (0, max(0, len(part) - len(total))))
            total[: len(part)] += part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coded(lengths: np.ndarray, dtype: np.dtype, bounds: np.ndarray) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for rows, data, offsets in pieces(batches, "ids"):
            out, first_byte, checkpoints, first_mark = encode_rows(np.frombuffer(data.tobytes(), dtype), offsets // dtype.itemsize, codes, lengths)
            raw, marks = out.tobytes(), checkpoints.tobytes()
            ids = rows.column("doc_id")
            part = np.where(ids.is_valid(), np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left"), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    *(rows.column(c) for c in ("doc_id", "row", "n_tokens")),
                    binary([raw[a:b] for a, b in zip(first_byte[:-1], first_byte[1:], strict=True)]),
                    binary([marks[4 * a : 4 * b] for a, b in zip(first_mark[:-1], first_mark[1:], strict=True)]),
                ],
                ["part", "doc_id", "row", "n_tokens", "bits", "marks"],
            )

    return encode


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield batch.slice(low, high - low)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted documents as blocks; each knows how many ids of its part come before it."""
    part, before, block = -1, 0, 0
    for rows, data, offsets in pieces(_by_part(batches), "bits", BLOCK_BYTES):
        if rows.column("part")[0].as_py() != part:
            part, before, block = rows.column("part")[0].as_py(), 0, 0
        counts = rows.column("n_tokens").to_numpy(zero_copy_only=False).astype("<i8")
        ids = rows.column("doc_id")
        marks, _ = flat(rows.column("marks"))
        has_id = np.asarray(ids.is_valid())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int64()),
                pa.array([before], pa.int64()),
                pa.array([int(counts.sum())], pa.int64()),
                binary([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()]),
                binary([has_id.astype(np.uint8).tobytes()]),
                binary([counts.tobytes()]),
                binary([offsets.astype("<i8").tobytes()]),
                binary([marks.tobytes()]),
                binary([data.tobytes()]),
            ],
            ["part", "block", "before", "n_ids", "doc_ids", "has_id", "counts", "first_byte", "marks", "bits"],
        )
        before += int(counts.sum())
        block += 1


BLOCKS = "part int, block long, before long, n_ids long, doc_ids binary, has_id binary, counts binary, first_byte binary, marks binary, bits binary"


def write_ids(tokens: DataFrame, path: str, dtype: np.dtype) -> None:
    """Write (doc_id, n_tokens, ids) as a file set in ascending doc_id order.

    ``tokens`` is read three times, so it should be a written table: for the counts, for the ids at which the files'
    parts meet (its doc_id column alone), and for the codes. What is shuffled is the codes.
    """
    spark = tokens.sparkSession
    ship(spark)
    counts = {r["id"]: r["n"] for r in id_counts(tokens, dtype).collect()}  # bounded by the vocabulary
    total = np.zeros(max(counts, default=-1) + 1, np.int64)
    for i, n in counts.items():
        total[i] = n
    lengths = code_lengths(total)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(tokens.approxQuantile("doc_id", [i / parts for i in range(1, parts)], max(0.1 / parts, 1e-4)) if parts > 1 else [], float)
    rows = tokens.withColumn("row", F.monotonically_increasing_id())
    coded = rows.mapInArrow(_coded(lengths, dtype, bounds), "part int, doc_id long, row long, n_tokens long, bits binary, marks binary")
    ordered = coded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "row")
    ordered.mapInArrow(_blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids of all documents before it), n_tokens, ids as 32-bit integers."""
    return _read(spark, path, whole=True)


def summarised_ids(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_ids``, with the crc32 of the decoded ids instead of the ids."""
    return _read(spark, path, whole=False)


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    ship(spark)
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/codes").first()["lengths"], np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    per_part = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row a file part
    base, ids_before = {}, 0
    for part in sorted(per_part):
        base[part] = ids_before
        ids_before += per_part[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                counts = np.frombuffer(block["counts"], "<i8")
                first_byte = np.frombuffer(block["first_byte"], "<i8")
                ids = decode_rows(np.frombuffer(block["bits"], np.uint8), first_byte[:-1], counts, np.frombuffer(block["marks"], "<u4"), table)
                ends = np.cumsum(counts)
                raw = ids.astype(WIDE_ID).tobytes()
                rows = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends, counts, strict=True)]
                missing = np.frombuffer(block["has_id"], np.uint8) == 0
                last = binary(rows) if whole else pa.array([zlib.crc32(r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(block["doc_ids"], "<i8"), mask=missing), pa.array(base[block["part"]] + block["before"] + ends - counts), pa.array(counts), last],
                    ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"],
                )

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids binary" if whole else "ids_crc32 long"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
