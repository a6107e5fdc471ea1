"""Secret scan: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are order-1 transition tables over the characters of keys. They are trained on labelled samples: the random
side on the values that the fixed patterns find in the corpus and on ``SEEDED`` seeded strings of each of the usual
alphabets, the ordinary side on all other words of the corpus, but for the runs that are to be judged. A run of key characters is a secret if the log-likelihood
ratio of the two models, for each transition, reaches ``RATIO``.

One pass over whole texts finds the patterns' spans, the few runs long enough to be scored, and the transition counts
(one table of fixed size a task, summed by Spark); a second step scores the runs. Nothing else is kept of the texts.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; spans of the models never
overlap those of the patterns, which always stay; what a pattern leaves of a run is scored part by part; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import flat
from stumpline.llm.cluster import bounded_text, ship, staged

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

LENGTH = 16
DISTINCT = 8
RATIO = 0.3
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LENGTH)
SEEDED = 500

CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(CHARACTERS)
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(SIZE)
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", CHARACTERS[:62], CHARACTERS[:64])


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then in the order of ``KINDS``."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def parsed(spans: str) -> list[tuple[int, int, str]]:
    parts = (s.split(":") for s in spans.split(",") if s)
    return [(int(start), int(end), kind) for kind, start, end in parts]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """What the spans already found (by start) leave of the runs long and varied enough.

    Length and variety are those of the whole run, so that a short rest of a key is judged too; a single character has no
    transition.
    """
    out, first = [], 0
    ends = list(itertools.accumulate((b for _, b, _ in taken), max))
    for m in RUN.finditer(text):
        if len(set(m[0])) < DISTINCT:
            continue
        at, stop = m.span()
        while first < len(taken) and ends[first] <= at:
            first += 1
        k = first
        while k < len(taken) and taken[k][0] < stop:
            if taken[k][0] - at > 1:
                out.append((at, text[at : taken[k][0]]))
            at = max(at, taken[k][1])
            k += 1
        if stop - at > 1:
            out.append((at, text[at:stop]))
    return out


def transitions(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring key characters."""
    codes = _CODE[data]
    pairs = codes[:-1] * SIZE + codes[1:]
    return np.bincount(pairs[(codes[:-1] >= 0) & (codes[1:] >= 0)], minlength=SIZE * SIZE)


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def seeded_strings(seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=32)) for alphabet in ALPHABETS for _ in range(SEEDED)]


def trained(random_counts: np.ndarray, ordinary_counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each transition. Seen secrets weigh as much as the seeded strings, however many."""
    seeded = sum((transitions(_bytes(s)) for s in seeded_strings()), np.zeros(SIZE * SIZE, np.int64))

    def conditional(counts: np.ndarray, prior: float) -> np.ndarray:
        table = counts.reshape(SIZE, SIZE) + prior
        return table / table.sum(1, keepdims=True)

    weight = seeded.sum() / max(1, random_counts.sum())
    return np.log(conditional(seeded + random_counts * min(1.0, weight), 0.5)) - np.log(conditional(ordinary_counts, 0.5))


def ratio(table: np.ndarray, run: str) -> float:
    """Mean log-likelihood ratio of a run's transitions."""
    codes = _CODE[_bytes(run)]
    return float(table[codes[:-1], codes[1:]].mean())


# The Spark side.

FOUND = "doc_id long, base string, runs array<struct<start: int, run: string>>, ordinary binary, random binary"
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("run", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary, secret = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
    empty = pa.nulls(0, pa.binary())
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            rows = batch.slice(low, 256)
            ordinary += transitions(flat(rows.column("text"))[0])
            base, runs = [], []
            for text in rows.column("text").to_pylist():
                spans = pattern_spans(text)
                found = candidates(text, spans)
                base.append(written(spans))
                runs.append([{"start": at, "run": run} for at, run in found])
                for _, run in found:  # what is to be judged isn't a sample of either side
                    ordinary -= transitions(_bytes(run))
                for start, end, kind in spans:
                    counts = transitions(_bytes(text[start:end]))
                    ordinary -= counts
                    secret += transitions(_bytes(ASSIGN.match(text[start:end])[2])) if kind == "assign" else counts
            empty = pa.nulls(len(base), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(base), pa.array(runs, _RUNS), empty, empty], ["doc_id", "base", "runs", "ordinary", "random"])
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, _RUNS), pa.array([np.maximum(ordinary, 0).tobytes()]), pa.array([secret.tobytes()])],
        ["doc_id", "base", "runs", "ordinary", "random"],
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SIZE * SIZE), np.int64)
    for batch in batches:
        for side, name in enumerate(("ordinary", "random")):
            for x in batch.column(name):
                total[side] += np.frombuffer(x.as_py(), np.int64)
    at = np.flatnonzero(total.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], ["pair", "ordinary", "random"])


def scanned(docs: DataFrame) -> DataFrame:
    """Every document's spans: doc_id, base and spans as ``kind:start:end`` joined by commas.

    base are the patterns' spans, spans those of the models too.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    found = staged(rows.mapInArrow(_scan, FOUND))
    counts = found.where("ordinary is not null").select("ordinary", "random").mapInArrow(_summed, "pair long, ordinary long, random long")
    random_counts, ordinary_counts = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
    for r in counts.groupBy("pair").agg(F.sum("ordinary").alias("ordinary"), F.sum("random").alias("random")).collect():  # SIZE ** 2 rows at most
        random_counts[r["pair"]], ordinary_counts[r["pair"]] = r["random"], r["ordinary"]
    table = trained(random_counts, ordinary_counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, sums = [], []
            for base, runs in zip(batch.column("base").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                more = [(r["start"], r["start"] + len(r["run"]), "markov") for r in runs if ratio(table, r["run"]) >= RATIO]
                every.append(written(sorted(parsed(base) + more, key=lambda s: (s[0], KINDS.index(s[2])))) if more else base)
                sums.append(hashlib.sha256(base.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(every, pa.string()), pa.array(sums, pa.string())], ["doc_id", "base", "spans", "base_sha256"])

    return found.where("ordinary is null").select("doc_id", "base", "runs").mapInArrow(score, "doc_id long, base string, spans string, base_sha256 string")


def digest(scan: DataFrame) -> DataFrame:
    """Counts of each kind of pattern beside the spans."""
    counts = (F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS[:3])
    return scan.select("doc_id", *counts, "base_sha256", "spans")


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every span of their text replaced; n_chars follows the text. Other columns stay.

    The models are trained on the whole table first, then each text is masked where it lies: nothing is joined.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    counts = rows.mapInArrow(_scan, FOUND).where("ordinary is not null").select("ordinary", "random").mapInArrow(_summed, "pair long, ordinary long, random long")
    random_counts, ordinary_counts = np.zeros(SIZE * SIZE, np.int64), np.zeros(SIZE * SIZE, np.int64)
    for r in counts.groupBy("pair").agg(F.sum("ordinary").alias("ordinary"), F.sum("random").alias("random")).collect():  # SIZE ** 2 rows at most
        random_counts[r["pair"]], ordinary_counts[r["pair"]] = r["random"], r["ordinary"]
    table = trained(random_counts, ordinary_counts)
    return docs.mapInArrow(_masking(docs.columns, table, mask), docs.schema)


def _masking(columns: list[str], table: np.ndarray, mask: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index("text")
            texts = [t if t is None else _without(t, table, mask) for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in columns:
                n = columns.index("n_chars")
                lengths = [old if new is None else len(new) for new, old in zip(texts, arrays[n].to_pylist(), strict=True)]
                arrays[n] = pa.array(lengths, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return apply


def _without(text: str, table: np.ndarray, mask: str) -> str:
    spans = pattern_spans(text)
    spans += [(at, at + len(run), "markov") for at, run in candidates(text, spans) if ratio(table, run) >= RATIO]
    parts, end = [], 0
    for start, stop, _ in sorted(spans):
        if start >= end:
            parts += [text[end:start], mask]
        end = max(end, stop)
    return "".join([*parts, text[end:]]) if spans else text
