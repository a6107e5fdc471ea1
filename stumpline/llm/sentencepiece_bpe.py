"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model file is one of merge type with byte fallback: a text becomes one symbol a character, the best-scored
neighbours that form a piece merge first (the leftmost of equals), and what is no piece in the end becomes bytes. Here
each candidate merge, a pair of neighbouring symbols at their places, is skipped with probability ``dropout``, by a hash
keyed by seed, word, the word's draw and the pair's places: the same for every run and machine, different for every
seed. All segmentations decode to the same text.

Pieces never join a word's last character to the space of the next word (checked when the model is read), so the words
of a text, each with the spaces before it, are segmented by themselves. The words of some documents are one table of
symbols, and each round of the agenda merges the best pair of every word at once. With dropout every occurrence of a word
is segmented by itself: its draw is one of ``VARIANTS``, all values of a hash, by document and place, so the variety of a
word grows with its occurrences. Only without dropout are equal words segmented once.

Defined results: a null or empty text has no ids; with dropout 0 ids are those of the sentencepiece library, but for the
model's own space sign in a text, which becomes bytes here so that it comes back; repeated rows have equal ids; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import binary, distinct, keyed, mixed, pieces, span_hashes
from stumpline.llm.cluster import bounded_text, ship
from stumpline.llm.tokens import WIDE_ID, expanded

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
VARIANTS = 2**64 - 1
SPACE = "▁"
LITERAL = 0x110000  # stands for a space sign that a text itself has
PIECE_BYTES = 1 << 20
TABLE = 1 << 18  # symbols merged at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The model's pieces as tables: characters to symbols, pairs of symbols to what they merge into."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        usable = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(self.size)]
        if any(SPACE in name.lstrip(SPACE) for name, ok in zip(names, usable, strict=True) if ok):
            raise ValueError("a piece joins words")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = model.unk_id()
        at = {name: i for i, (name, ok) in enumerate(zip(names, usable, strict=True)) if ok}
        # Symbols are ids of pieces; characters that aren't pieces get numbers after them, by code point.
        self.of_character = np.arange(LITERAL + 1, dtype=np.int64) + self.size
        self.of_character[LITERAL] = ord(SPACE) + self.size
        for name, i in at.items():
            if len(name) == 1:
                self.of_character[ord(name)] = i
        pairs, merged = [], []
        for name, i in at.items():
            for cut in range(1, len(name)):
                left, right = name[:cut], name[cut:]
                if (len(left) == 1 or left in at) and (len(right) == 1 or right in at):
                    pairs.append((self._symbol(at, left) << 32) | self._symbol(at, right))
                    merged.append(i)
        order = np.argsort(pairs)
        self.pairs, self.merged = np.array(pairs, np.int64)[order], np.array(merged, np.int64)[order]
        # A table with open addresses: a pair's slot by hash, and the next ones where it is taken.
        self.slots = 1 << int(np.ceil(np.log2(4 * len(pairs) + 4)))
        self.table = np.full(self.slots, -1, np.int64)
        self.deepest = 1
        place = self._slot(self.pairs)
        for k, p in enumerate(place.tolist()):
            depth = 1
            while self.table[p] >= 0:
                p, depth = (p + 1) % self.slots, depth + 1
            self.table[p] = k
            self.deepest = max(self.deepest, depth)
        scores = np.array([model.get_score(i) for i in range(self.size)])
        # The rank of a merge: higher scores first. Equal scores share a rank, so that the place decides.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.raw = [b"" if not ok else name.replace(SPACE, " ").encode() for name, ok in zip(names, usable, strict=True)]
        for b in range(256):
            self.raw[self.bytes[b]] = bytes([b])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_offsets = np.concatenate([[0], np.cumsum([len(r) for r in self.raw])])

    def _symbol(self, at: dict[str, int], name: str) -> int:
        return at[name] if name in at else int(self.of_character[ord(name)])

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (mixed(pairs.astype(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges into, or -1."""
        pairs = (left << 32) | right
        place = self._slot(pairs)
        out = np.full(len(pairs), -1, np.int64)
        open_ = np.arange(len(pairs))
        for _ in range(self.deepest):
            k = self.table[place[open_]]
            hit = (k >= 0) & (self.pairs[np.maximum(k, 0)] == pairs[open_])
            out[open_[hit]] = self.merged[k[hit]]
            open_ = open_[(k >= 0) & ~hit]
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) % self.slots
        return out


def segmented(model: Pieces, symbols: np.ndarray, begins: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge the symbols of many words; ``keys`` decide what is skipped. Returns symbols and where words begin.

    In a round, every word merges its best candidate: least rank, then leftmost. Words without a candidate are done.
    """
    limit = np.uint64(min(2**64 - 1, int(dropout * 2.0**64)))
    count = np.diff(begins)
    word = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(symbols)) - begins[:-1][word]
    done_words, done_symbols, done_places = [], [], []
    best_of = np.full(len(count), np.iinfo(np.int64).max)
    candidate = np.full(len(symbols), -1, np.int64)
    fresh = np.ones(len(symbols), bool)  # candidates to look up again: (i, i + 1)
    end = begins[1:][word]  # where the word's last symbol ends, in places of the whole
    end = end - begins[:-1][word]
    while len(symbols):
        inner = np.zeros(len(symbols), bool)
        inner[:-1] = word[1:] == word[:-1]
        look = np.flatnonzero(fresh & inner)
        candidate[fresh] = -1
        found = model.merges(symbols[look], symbols[look + 1])
        if limit and len(look):
            after = np.where(np.append(inner[1:], False)[look], place[np.minimum(look + 2, len(place) - 1)], end[look])
            spot = (place[look] << 42) | (place[look + 1] << 21) | after
            skipped = mixed(keys[word[look]] ^ mixed(spot.astype(np.uint64) + _GOLD)) < limit
            found[skipped] = -1
        candidate[look] = found
        some = np.flatnonzero(candidate >= 0)
        value = (model.rank[candidate[some]] << 32) | some
        best_of[word[some]] = np.iinfo(np.int64).max
        first = np.flatnonzero(np.diff(word[some], prepend=-1))
        if len(some):
            best_of[word[some[first]]] = np.minimum.reduceat(value, first)
        alive = np.zeros(len(count), bool)
        alive[word[some]] = True
        stay = alive[word]
        if not stay.all():
            over = ~stay
            done_words.append(word[over])
            done_symbols.append(symbols[over])
            done_places.append(place[over])
        if not len(some):
            break
        chosen = best_of[word[some[first]]] & 0xFFFFFFFF
        symbols[chosen] = candidate[chosen]
        fresh = np.zeros(len(symbols), bool)
        fresh[chosen] = True
        before = chosen[chosen > 0] - 1
        fresh[before] = True
        keep = stay
        keep[chosen + 1] = False
        symbols, word, place, end, candidate, fresh = (x[keep] for x in (symbols, word, place, end, candidate, fresh))
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(len(count) + 1, np.int64)
    words, result, places = np.concatenate(done_words), np.concatenate(done_symbols), np.concatenate(done_places)
    order = np.argsort((words << 32) | places)
    return result[order], np.searchsorted(words[order], np.arange(len(count) + 1))


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte that each begins at."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64), lead


class Coder:
    """Encodes and decodes pieces of a table."""

    def __init__(self, model: Pieces, dropout: float, seed: int):
        self.model, self.dropout, self.seed = model, dropout, keyed(seed)

    def encode(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's begin. ``rows`` are numbers that stand for the rows in the hashes."""
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        # Every text begins with a space that isn't in it.
        starts = offsets[:-1][full]
        data = np.insert(data, starts, 32)
        begin = starts + np.arange(len(full))
        code, lead = _code_points(data)
        gap = code == 32
        code[code == ord(SPACE)] = LITERAL
        code[gap] = ord(SPACE)
        opens = gap.copy()
        opens[1:] &= ~gap[:-1]
        row_first = np.searchsorted(lead, begin)
        opens[row_first] = True
        unit = np.flatnonzero(opens)
        stop = np.append(unit[1:], len(code))
        lead = np.append(lead, len(data))
        hashes = span_hashes(data, lead[unit], lead[stop])
        if self.dropout:
            row = np.searchsorted(row_first, unit, "right") - 1
            place = unit - row_first[row]
            draw = mixed(rows[full[row]] ^ mixed(place.astype(np.uint64) + self.seed)) % np.uint64(VARIANTS)
            keys, which = mixed(hashes + draw * _GOLD), np.arange(len(unit))
            symbols, begins = self.model.of_character[code], np.append(unit, len(code))
        else:
            keys, at, which = distinct(hashes)
            if not ((stop - unit)[at][which] == stop - unit).all():
                raise ValueError("two words share a hash")
            symbols, _ = expanded(self.model.of_character[code], np.append(unit, len(code)), at)
            begins = np.concatenate([[0], np.cumsum((stop - unit)[at])])
        symbols, begins = self._merged(symbols, begins, keys ^ self.seed)
        ids, begins = self._with_bytes(symbols, begins)
        ids, lengths = expanded(ids, begins, which)
        total = np.concatenate([[0], np.cumsum(lengths)])
        first_unit = np.searchsorted(unit, row_first)
        ends = np.zeros(len(offsets), np.int64)
        ends[full + 1] = total[np.append(first_unit[1:], len(unit))]
        return ids, np.maximum.accumulate(ends)

    def _merged(self, symbols: np.ndarray, begins: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``segmented`` for runs of about ``TABLE`` symbols."""
        cuts = np.unique(np.append(np.searchsorted(begins, np.arange(0, begins[-1], TABLE)), len(keys)))
        out = [segmented(self.model, symbols[begins[a] : begins[b]].copy(), begins[a : b + 1] - begins[a], keys[a:b], self.dropout) for a, b in itertools.pairwise(cuts.tolist())]
        ends = np.cumsum([0, *(len(x) for x, _ in out)])
        return np.concatenate([x for x, _ in out]), np.concatenate([*(e[:-1] + at for (_, e), at in zip(out, ends[:-1], strict=True)), ends[-1:]])

    def _with_bytes(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their bytes."""
        odd = np.flatnonzero(symbols >= self.model.size)
        if not len(odd):
            return symbols, begins
        size = np.ones(len(symbols), np.int64)
        spelled = [chr(int(c)).encode() for c in symbols[odd] - self.model.size]
        size[odd] = [len(s) for s in spelled]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = np.repeat(symbols, size)
        ids[np.repeat(ends[odd], size[odd]) + np.concatenate([np.arange(len(s)) for s in spelled])] = self.model.bytes[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, ends[begins]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and where each row's begin; the space before a text goes."""
        out, lengths = expanded(self.model.raw_bytes, self.model.raw_offsets, ids)
        ends = np.concatenate([[0], np.cumsum(lengths)])[begins]
        full = np.flatnonzero(np.diff(ends) > 0)
        gone = full[out[ends[full]] == 32]
        kept = np.ones(len(out), bool)
        kept[ends[gone]] = False
        less = np.zeros(len(begins), np.int64)
        less[gone + 1] = 1
        return out[kept], ends - np.cumsum(less)


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


# The Spark side.


def _keys_of(rows: pa.RecordBatch) -> np.ndarray:
    return mixed(rows.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64) + _GOLD)


def encoded(docs: DataFrame, seed: int = 0, dropout: float = DROPOUT, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of every whole text as little-endian 32-bit integers."""
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(MODEL)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pieces_of(path), dropout, seed)
        for rows, data, offsets in pieces(batches, "text", PIECE_BYTES):
            ids, begins = coder.encode(data, offsets, _keys_of(rows))
            raw = ids.astype(WIDE_ID).tobytes()
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(begins)), binary([raw[4 * a : 4 * b] for a, b in itertools.pairwise(begins.tolist())])], ["doc_id", "n_tokens", "ids"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded``, whatever its seed."""
    ship(tokens.sparkSession)
    path = path or public_tokenizers.path(MODEL)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pieces_of(path), 0.0, 0)
        for rows, data, offsets in pieces(batches, "ids", 4 * PIECE_BYTES):
            out, ends = coder.decode(np.frombuffer(data.tobytes(), WIDE_ID).astype(np.int64), offsets // 4)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([raw[a:b].decode() for a, b in itertools.pairwise(ends.tolist())], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def summarised(docs: DataFrame, seed: int = 0, dropout: float = DROPOUT, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32 and lossless (is the decoded text the text?) of every document.

    Encodes and decodes a run of documents in one go, so ids needn't leave the task.
    """
    ship(docs.sparkSession)
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(pieces_of(path), dropout, seed)
        for rows, data, offsets in pieces(batches, "text", PIECE_BYTES):
            ids, begins = coder.encode(data, offsets, _keys_of(rows))
            out, ends = coder.decode(ids, begins)
            coded, plain, text = ids.astype(WIDE_ID).tobytes(), out.tobytes(), data.tobytes()
            back = [plain[a:b] for a, b in itertools.pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(begins)),
                    pa.array([zlib.crc32(coded[4 * a : 4 * b]) for a, b in itertools.pairwise(begins.tolist())], pa.int64()),
                    pa.array([zlib.crc32(b) for b in back], pa.int64()),
                    pa.array([b == text[x:y] for b, (x, y) in zip(back, itertools.pairwise(offsets.tolist()), strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "lossless"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, lossless boolean")
