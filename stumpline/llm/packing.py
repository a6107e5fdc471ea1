"""Packing documents into training sequences: each window is filled with the lexical neighbours of its first document.

Documents are laid out by a weighted min-hash of their token ids (rarer ids weigh more), so that texts with words in
common lie near each other, and ties are broken by a hash of the document id, so that no key is too large for a part. A
part is one task's run of this order; it goes through its documents in shards of ``SHARD`` tokens. A shard has a
BM25 inverted index with the document frequencies and the mean length of the whole corpus. The longest unused document
is the seed of a window; the index returns its unused neighbours by score, which fill the window greedily, and the best
one that is too long is cut to fill what is left. Leftovers go on to the next shard; a part's last leftovers are cut
into sequences whose lengths are powers of two. So nothing is padded.

Of the corpus, only document frequencies (one row for each id of the vocabulary), totals and the bounds of the parts
reach the driver.

Defined results: a null or empty text is its end id alone and is packed like others; rows that repeat an id are packed
each; a document longer than a window is cut at every window's length first; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import binary, keyed, mixed, pieces
from stumpline.llm.cluster import ship, staged
from stumpline.llm.tokens import WIDE_ID, id_type, places, tokenised

WINDOW = 4096
SHARD = 1 << 20
K1, B = 1.2, 0.75


def idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency; ids in more than half of the documents tell nothing."""
    return np.maximum(0.0, np.log((documents - frequency + 0.5) / (frequency + 0.5)))


class Index:
    """BM25 inverted index of one shard: for each id, its documents and their weights."""

    def __init__(self, ids: list[np.ndarray], weight: np.ndarray, mean_length: float):
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        telling = weight[flat] > 0
        every = np.sort(owner[telling] * len(weight) + flat[telling])
        begin = np.flatnonzero(np.diff(every, prepend=-1))
        pairs, tf = every[begin], np.diff(np.append(begin, len(every))).astype(np.float32)
        owner, term = np.divmod(pairs, len(weight))
        self.terms, self.of_doc = term, np.searchsorted(owner, np.arange(len(ids) + 1))
        scores = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean_length))
        order = np.argsort(term)
        first = np.flatnonzero(np.diff(term[order], prepend=-1))
        self.known, self.offsets = term[order][first], np.append(first, len(term))
        self.docs, self.scores = owner[order], scores[order]
        self.size = len(ids)

    def neighbours(self, doc: int) -> np.ndarray:
        """Score of every document of the shard for this one's ids."""
        which = np.searchsorted(self.known, self.terms[self.of_doc[doc] : self.of_doc[doc + 1]])
        at, _ = places(self.offsets, which)
        return np.bincount(self.docs[at], weights=self.scores[at], minlength=self.size)


class Packer:
    """One part's documents, packed shard by shard. A piece is (document, start, length); windows leave when full."""

    def __init__(self, weight: np.ndarray, mean_length: float, window: int = WINDOW):
        self.weight, self.mean, self.window = weight, mean_length, window
        self.left: list[tuple] = []  # (document, ids, start): what isn't packed yet

    def feed(self, docs: list[tuple]) -> Iterator[list[tuple]]:
        """Pack documents (key, ids) while a whole window can be filled."""
        pool = self.left + [(key, ids, 0) for key, ids in docs]
        ids = [p[1] for p in pool]
        start = np.array([p[2] for p in pool], np.int64)
        size = np.array([len(x) for x in ids], np.int64) - start
        for i in np.flatnonzero(size >= self.window):
            for _ in range(size[i] // self.window):
                yield [(pool[i][0], ids[i], int(start[i]), self.window)]
                start[i] += self.window
            size[i] %= self.window
        remaining = int(size.sum())
        if remaining >= self.window:
            index = Index(ids, self.weight, self.mean)
            by_size = np.argsort(-size, kind="stable")
            at = 0
            again: list[int] = []  # cut documents, the next seeds
            while remaining >= self.window:
                while not again and size[by_size[at]] == 0:
                    at += 1
                seed = again.pop() if again else int(by_size[at])
                window = [(pool[seed][0], ids[seed], int(start[seed]), int(size[seed]))]
                space = self.window - int(size[seed])
                size[seed] = 0
                scores = index.neighbours(seed)
                order = np.argsort(-scores, kind="stable")
                order = order[size[order] > 0]
                while space:
                    fits = np.flatnonzero(size[order] <= space)
                    if not len(fits):
                        break
                    lengths = size[order[fits]]
                    n = int(np.searchsorted(np.cumsum(lengths), space, "right"))  # as many neighbours as fit in a row
                    for i in order[fits[:n]].tolist():
                        window.append((pool[i][0], ids[i], int(start[i]), int(size[i])))
                        space -= int(size[i])
                        size[i] = 0
                    order = order[size[order] > 0]
                if space:
                    i = int(order[0])
                    window.append((pool[i][0], ids[i], int(start[i]), space))
                    start[i] += space
                    size[i] -= space
                    again.append(i)
                remaining -= self.window
                yield window
        self.left = [(pool[i][0], ids[i], int(start[i])) for i in np.flatnonzero(size > 0)]

    def finish(self) -> Iterator[list[tuple]]:
        """The leftovers in sequences whose lengths are powers of two."""
        total = sum(len(ids) - start for _, ids, start in self.left)
        rest = [list(x) for x in self.left]
        self.left = []
        while total:
            space = min(self.window, 1 << (total.bit_length() - 1))
            total -= space
            window = []
            while space:
                key, ids, start = rest[0]
                n = min(space, len(ids) - start)
                window.append((key, ids, start, n))
                space -= n
                rest[0][2] += n
                if rest[0][2] == len(ids):
                    rest.pop(0)
            yield window


# The Spark side.


def document_frequencies(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, n): the number of documents with the id; a task sends one row for each id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for _, data, offsets in pieces(batches, "ids"):
            bits = 8 * dtype.itemsize
            wide = np.uint32 if bits == 16 and len(offsets) <= 1 << 16 else np.uint64
            row = np.repeat(np.arange(len(offsets) - 1, dtype=wide), np.diff(offsets) // dtype.itemsize)
            pairs = np.sort((row << wide(bits)) | np.frombuffer(data.tobytes(), dtype))
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            found = np.bincount((pairs[new] & wide((1 << bits) - 1)).astype(np.int64))
            total = np.pad(total, (0, max(0, len(found) - len(total))))
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def lexical_keys(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """The tokens with ``key``: two weighted min-hashes of the ids, then a hash of the document id."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        for rows, data, offsets in pieces(batches, "ids"):
            ids = np.frombuffer(data.tobytes(), dtype)
            top = int(ids.max()) + 1
            if not values or len(values[0]) < top:
                n = np.arange(max(top, 1 << 16), dtype=np.uint64)
                draw = [(mixed(n + keyed(k)) >> np.uint64(11)).astype(np.float64) / 2.0**53 for k in (1, 2)]
                values = [-np.log1p(-u) / np.log2(2.0 + n) for u in draw]  # later merges are rarer
            begins = offsets[:-1] // dtype.itemsize
            high, low = (_code(np.minimum.reduceat(v[ids], begins), bits) for v, bits in zip(values, (24, 16), strict=True))
            salt = mixed(rows.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) + keyed(3)) >> np.uint64(42)
            key = ((high << np.uint64(38)) | (low << np.uint64(22)) | salt).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(key)], [*rows.schema.names, "key"])

    return tokens.mapInArrow(add, "doc_id long, n_tokens long, ids binary, key long")


def _code(x: np.ndarray, bits: int) -> np.ndarray:
    """Equal values get equal codes, others most likely not."""
    return mixed(x.view(np.uint64)) >> np.uint64(64 - bits)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(tokens: DataFrame, dtype: np.dtype, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack (doc_id, n_tokens, ids); one row a piece, with its ids if asked for.

    ``tokens`` should have a ``key`` (see ``lexical_keys``) and be a written table: it is read for the frequencies, for
    the bounds of the parts (its key column alone) and for the packing.
    """
    spark = tokens.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals = tokens.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).first()
    documents, mean = totals["docs"], (totals["tokens"] or 0) / max(1, totals["docs"])
    frequency = {r["id"]: r["n"] for r in document_frequencies(tokens, dtype).collect()}  # bounded by the vocabulary
    weight = np.zeros(max(frequency, default=0) + 1)
    for i, n in frequency.items():
        weight[i] = n
    weight = idf(weight, documents).astype(np.float32)
    bounds = tokens.approxQuantile("key", [i / parts for i in range(1, parts)], max(0.1 / parts, 1e-4)) if parts > 1 else []
    names = [field.split()[0] for field in PIECES.split(", ")] + ["ids"] * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, waiting, tokens_waiting, packer = None, 0, [], 0, None

        def rows(windows: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for filled in windows:
                offset = 0
                for doc, ids, start, length in filled:
                    raw = ids[start : start + length].astype(WIDE_ID).tobytes()
                    out.append((doc, start, length, zlib.crc32(raw), len(ids), (part << 40) + sequence, offset, raw))
                    offset += length
                sequence += 1
                if len(out) > 4096:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

        for batch in batches:
            for number, doc, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if number != part:
                    if packer:
                        yield from rows(packer.feed(waiting))
                        yield from rows(packer.finish())
                    part, sequence, waiting, tokens_waiting, packer = number, 0, [], 0, Packer(weight, mean, window)
                ids = np.frombuffer(raw.as_py(), dtype)
                waiting.append((doc, ids))
                tokens_waiting += len(ids)
                if tokens_waiting >= SHARD:
                    yield from rows(packer.feed(waiting))
                    waiting, tokens_waiting = [], 0
        if packer:
            yield from rows(packer.feed(waiting))
            yield from rows(packer.finish())

    numbered = tokens.mapInArrow(_part_of(np.array(bounds, float)), "doc_id long, ids binary, key long, part int")
    ordered = numbered.repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id")
    return ordered.select("part", "doc_id", "ids").mapInArrow(pack, PIECES + ", ids binary" * with_ids)


def _part_of(bounds: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(bounds, batch.column("key").to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "ids", "key")), pa.array(part, pa.int32())], ["doc_id", "ids", "key", "part"])

    return add


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), *([binary(columns[7])] if "ids" in names else [])], names)


def packed_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack whole documents."""
    dtype = id_type()
    tokens = staged(lexical_keys(tokenised(docs), dtype), "zstd")
    return packed(tokens, dtype, with_ids=with_ids)


def padding(pieces_of: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences, their tokens and the places that padding fills: none where a length is a power of two."""
    lengths = pieces_of.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return lengths.agg(
        F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(whole, 0).otherwise(F.lit(window) - F.col("n"))).alias("padding")
    )
