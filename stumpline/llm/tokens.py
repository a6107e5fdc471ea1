"""Token ids of whole texts by a vocabulary file of the tokenizers library.

Most of a corpus is words that it has met before. Texts are cut where the vocabulary's own pattern always cuts (white
space, and between an ASCII letter, digit and sign), the library encodes each distinct unit once, and a worker keeps
what it has encoded, up to ``KEPT`` units. Units in which other characters could matter to the pattern stay whole, and
documents that spell out one of the vocabulary's special tokens are given to the library as they are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import IS_SPACE, binary, distinct, pieces, span_hashes
from stumpline.llm.cluster import bounded_text, ship

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
KEPT = 1 << 20
JOINED = 256
ID = np.dtype("<u2")
WIDE_ID = np.dtype("<u4")

_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[ord("'")] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def places(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the runs ``offsets[i]:offsets[i + 1]`` are, for each i of ``which``; the runs' lengths."""
    begins = offsets[which]
    lengths = offsets[which + 1] - begins
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths), lengths


def expanded(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[i]:offsets[i + 1]]`` for each i of ``which``, one after the other, and their lengths."""
    at, lengths = places(offsets, which)
    return values[at], lengths


class Vocabulary:
    """A vocabulary file and the units that this worker has encoded with it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"].encode() for x in json.load(f).get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        self.dtype = ID if size <= 1 << 16 else WIDE_ID
        self.ends_word = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = piece.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Start anew: sorted keys, each one's slot, and the slots' ids one after the other."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _one_by_one(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _together(self, units: list[str]) -> tuple[list, list]:
        """Ids of units that are one word each to the vocabulary, and how many: joined, and parted where a word ends."""
        ids: list = []
        lengths: list = []
        groups = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        for group, x in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(x.ids, self.dtype)
            cuts = np.flatnonzero(self.ends_word[got]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(got):
                ids.append(got)
                lengths.append(np.diff(cuts, prepend=0))
            else:
                each = self._one_by_one(group)
                ids += each
                lengths.append([len(e) for e in each])
        return ids, lengths

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        """Encode new units; their keys are sorted and not known yet."""
        plain, mixed = [], []
        for i, u in enumerate(units):
            (plain if u.isalpha() or (u.isascii() and "'" not in u and u.isprintable()) else mixed).append(i)
        ids, lengths = self._together([units[i] for i in plain])
        each = self._one_by_one([units[i] for i in mixed])
        kinds = [np.asarray(x, self.dtype) for x in (*ids, *each)]
        lengths = np.concatenate([*lengths, [len(e) for e in each]]).astype(np.int64)
        slots = np.empty(len(units), np.int64)
        slots[plain + mixed] = len(self.keys) + np.arange(len(units))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.ids = np.concatenate([self.ids, *kinds])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])

    def _whole_rows(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the rows as they are."""
        ids = self._one_by_one([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return np.concatenate([np.asarray(x, self.dtype) for x in ids]), np.array([len(x) for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece and the number of ids of each row, without an end id."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self._whole_rows(raw, offsets)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(rows, np.int64)
        starts, ends, first = _units(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(rows, np.int64)
        data = _folded(data, starts, ends)
        unique, at, inverse = distinct(span_hashes(data, starts, ends))
        if not (((ends - starts) == (ends - starts)[at][inverse]).all()):
            return self._whole_rows(raw, offsets)  # two units share a hash
        if len(self.keys) > KEPT:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        known = (self.keys[np.minimum(place, len(self.keys) - 1)] == unique) if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            raw = data.tobytes()
            self.learn(unique[~known], [raw[starts[i] : ends[i]].decode() for i in at[~known]])
            place = np.searchsorted(self.keys, unique)
        ids, lengths = expanded(self.ids, self.offsets, self.slots[place][inverse])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[first])


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the pattern never joins with their neighbours, and each row's first one."""
    kind = _KIND[data]
    inside = ~IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)  # a cut before the byte
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a != _OTHER) & (b != _OTHER) & ((a != b) | (a == _DIGIT))
    cut[offsets] = True
    begins = inside & cut[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    stops = inside & cut[1:]
    stops[:-1] |= inside[:-1] & ~inside[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lower case for units that are ASCII alone; in others, composition may come before lower case."""
    lower = _LOWER[data]
    capital = np.flatnonzero(lower != data)
    mixed = np.zeros(len(starts), bool)
    mixed[np.searchsorted(starts, np.flatnonzero(data >= 128), "right") - 1] = True
    keep = capital[mixed[np.searchsorted(starts, capital, "right") - 1]]
    lower[keep] = data[keep]
    return lower


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every row's ids followed by the end id, and where each row begins."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end_id, ids.dtype)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[1:] - 1] = False
    out[inner] = ids
    return out, offsets


def _tokenised(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for rows, data, offsets in pieces(batches, "text"):
            ids, begins = with_end(*words.encode(data, offsets), end_id)
            raw, width = ids.tobytes(), ids.itemsize
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(begins)), binary([raw[a * width : b * width] for a, b in zip(begins[:-1], begins[1:], strict=True)])],
                ["doc_id", "n_tokens", "ids"],
            )

    return encode


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text and the end id, as little-endian integers in a binary.

    A null or empty text is the end id alone. Ids take two bytes where the vocabulary has at most 65,536, else four.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(WORD_BPE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    return rows.mapInArrow(_tokenised(path, end_id), "doc_id long, n_tokens long, ids binary")


def id_type(path: str | None = None) -> np.dtype:
    return vocabulary(path or public_tokenizers.path(WORD_BPE)).dtype
