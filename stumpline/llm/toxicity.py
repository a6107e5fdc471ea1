"""Toxicity scores by a classifier with counterfactual regularisation.

The features of a text are which words and word beginnings (of ``PREFIXES`` code points) it has, and which of them
``LEVELS`` times or more. They are counted over a bounded sample of labelled rows, ``SAMPLE`` (those whose id's hash is least), in Spark; the
``MOST_FEATURES`` that part the labels best, by the likelihood-ratio statistic, are kept if it reaches ``LEAST_GAIN``.
A logistic model over them is fitted on the driver. Besides the usual penalty, every labelled text that names a group
(``IDENTITY_TERMS``) is paired with the same text in which all mentions of the name are swapped for others of its set,
and every name is inserted once and as often as each of ``LEVELS``; the squared difference of the two scores (their log-odds) is added to the loss. So a name by
itself moves no score, even where it is frequent in texts labelled as toxic.

Scoring reads every whole text once. Nothing but the text is an input of a score.

Defined results: a null or empty text gets the score of a text without features; labels that are null are not used, of
several labels for one id the greatest counts; without labels of both kinds all scores are the share of ones (0 if there
are none); null ids are scored and are not held out; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import distinct, pieces, span_hashes, words
from stumpline.llm.cluster import bounded_text, hashed_sample, ship

SAMPLE = 20_000
PREFIXES = (3, 4, 5, 6)
LEVELS = (2, 3)
MOST_FEATURES = 4096
LEAST_GAIN = 18.0
LEAST_ROWS = 4
PENALTY = 0.5
COUNTERFACTUAL = 20.0
SWAPS = 4
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

# Names of groups, by set; swaps stay within a set.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("blind", "deaf", "disabled", "autistic", "old", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christ", "moslem", "jude", "hindu", "buddhist", "atheist"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
)
_SETS = {term: group for group in IDENTITY_TERMS for term in group}


def word_features(word: str) -> list[str]:
    """A word and its beginnings; ``word`` is lower case without signs around it."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)] if word else []


def plain_word(raw: bytes) -> str:
    """Lower case, without the signs around it."""
    word = raw.decode().lower()
    if word.isalnum():
        return word
    low, high = 0, len(word)
    while low < high and not word[low].isalnum():
        low += 1
    while high > low and not word[high - 1].isalnum():
        high -= 1
    return word[low:high]


def levels(counts: dict[str, int]) -> list[str]:
    """Features of a text from how often it has each word or beginning."""
    return [*counts, *(f"{k}*{name}" for name, n in counts.items() for k in LEVELS if n >= k)]


def word_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct words of a piece, and for each of its rows which of them it has, and how often."""
    starts, ends, first = words(data, offsets)
    if not len(starts):
        return [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(offsets) - 1)
    _, at, which = distinct(span_hashes(data, starts, ends))
    raw = data.tobytes()
    names = [plain_word(raw[starts[i] : ends[i]]) for i in at]
    return names, [np.unique(which[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]


def gain(n_ones: int, n_zeros: int) -> Column:
    """Likelihood-ratio statistic of having a feature against the label, from its columns ones and zeros."""
    ones, zeros, n = F.col("ones"), F.col("zeros"), n_ones + n_zeros
    have = ones + zeros

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (
        part(ones, have * n_ones / n) + part(zeros, have * n_zeros / n) + part(n_ones - ones, (n - have) * n_ones / n) + part(n_zeros - zeros, (n - have) * n_zeros / n)
    )


def fitted(rows: list[np.ndarray], labels: np.ndarray, differences: list[dict[int, int]], size: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the regularised logistic model, by accelerated gradient steps.

    ``rows`` are the features of the texts; ``differences`` are text minus counterfactual, by feature.
    """
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return np.zeros(size), -30.0 if share == 0 else 30.0
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64)
    d_row = np.array([i for i, d in enumerate(differences) for _ in d], np.int64)
    d_column = np.array([j for d in differences for j in d], np.int64)
    d_value = np.array([v for d in differences for v in d.values()], float)
    n, pull = len(labels), COUNTERFACTUAL / max(1, len(differences))
    widest = max(len(r) for r in rows) + 1
    swing = sum(v * v for d in differences for v in d.values()) / max(1, len(differences))
    step = 1 / (widest / 4 + PENALTY / n + 2 * COUNTERFACTUAL * swing)
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    ahead_w, ahead_b, momentum = w.copy(), b, 1.0
    for _ in range(rounds):
        odds = np.bincount(row, weights=ahead_w[column], minlength=n) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) / n
        change = np.bincount(d_row, weights=d_value * ahead_w[d_column], minlength=max(1, len(differences)))
        slope = np.bincount(column, weights=error[row], minlength=size) + PENALTY / n * ahead_w
        slope += 2 * pull * np.bincount(d_column, weights=d_value * change[d_row], minlength=size)
        new_w, new_b = ahead_w - step * slope, ahead_b - 4 / widest * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead_w = new_w + (momentum - 1) / following * (new_w - w)
        ahead_b = new_b + (momentum - 1) / following * (new_b - b)
        w, b, momentum = new_w, new_b, following
    return w, float(b)


def summed(features: list, row: tuple[np.ndarray, np.ndarray]) -> dict[str, int]:
    """How often a row has each feature of its words."""
    counts: dict[str, int] = {}
    for k, n in zip(*(x.tolist() for x in row), strict=True):
        for f in features[k]:
            counts[f] = counts.get(f, 0) + n
    return counts


class Features:
    """The features that are kept, by name."""

    def __init__(self, names: list[str]):
        self.at = {name: i for i, name in enumerate(names)}
        self.used = {name.split("*", 1)[1] if name[0].isdigit() and name[1:2] == "*" else name for name in names}

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        names, rows = word_sets(data, offsets)
        found = [[f for f in word_features(name) if f in self.used] for name in names]
        some = np.array([bool(f) for f in found], bool)
        for which, n in rows:
            keep = some[which] if len(which) else np.zeros(0, bool)
            yield self.numbers(summed(found, (which[keep], n[keep])))

    def numbers(self, counts: dict[str, int]) -> np.ndarray:
        return np.array(sorted(i for f in levels(counts) if (i := self.at.get(f)) is not None), np.int64)

    def difference(self, counts: dict[str, int], gone: str | None, new: str | None, times: int) -> dict[int, int]:
        """Features of a text minus those it has with ``times`` times ``new`` for ``gone``; only what these touch is looked at."""
        before = {f: counts.get(f, 0) for term in (gone, new) if term for f in word_features(term)}
        after = dict(before)
        for term, sign in ((gone, -times), (new, times)):
            for f in word_features(term) if term else ():
                after[f] += sign
        change = Counter(self._present(before))
        change.subtract(self._present(after))
        return {i: v for i, v in change.items() if v}

    def _present(self, counts: dict[str, int]) -> list[int]:
        return self.numbers({f: n for f, n in counts.items() if n > 0}).tolist()

    def swaps(self, names: list[str], row: tuple[np.ndarray, np.ndarray], key: int) -> list[dict[int, int]]:
        """Counterfactuals of a text that names groups: every mention of one is swapped."""
        out: list[dict[int, int]] = []
        mentions: dict[str, int] = {}
        for k, n in zip(*(x.tolist() for x in row), strict=True):
            if names[k] in _SETS:
                mentions[names[k]] = mentions.get(names[k], 0) + n
        counts = summed([word_features(name) for name in names], row) if mentions else {}
        for term, times in sorted(mentions.items()):
            others = [x for x in _SETS[term] if x != term]
            begin = zlib.crc32(f"{key} {term}".encode())
            out += [self.difference(counts, term, others[(begin + k) % len(others)], times) for k in range(min(SWAPS, len(others)))]
        return [d for d in out if d]

    def insertions(self) -> list[dict[int, int]]:
        """Counterfactuals of neutral mentions: every name once and as often as each of the levels."""
        return [d for term in sorted(_SETS) for times in (1, *LEVELS) if (d := self.difference({}, None, term, times))]


class Model:
    def __init__(self, names: list[str], weights: np.ndarray, bias: float):
        self.names, self.weights, self.bias = names, weights, bias

    def scores(self, features: Features, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odds = [self.weights[f].sum() + self.bias for f in features.of_rows(data, offsets)]
        return 1 / (1 + np.exp(-np.clip(np.array(odds), -30, 30)))

    def score(self, text: str) -> float:
        raw = np.frombuffer(text.encode(), np.uint8)
        return float(self.scores(Features(self.names), raw, np.array([0, len(raw)]))[0])


# The Spark side.


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature, the rows of either label that have it."""
    for rows, data, offsets in pieces(batches, "text"):
        names, sets = word_sets(data, offsets)
        features = [word_features(name) for name in names]
        total: dict[str, list[int]] = {}
        for label, row in zip(rows.column("toxic").to_pylist(), sets, strict=True):
            for f in levels(summed(features, row)):
                total.setdefault(f, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([n[k] for n in total.values()], pa.int64()) for k in (1, 0))], ["feature", "ones", "zeros"])


def _described(names: list[str]):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(names)
        for rows, data, offsets in pieces(batches, "text"):
            named, sets = word_sets(data, offsets)
            swaps = [
                [[*d.keys(), *d.values()] for d in features.swaps(named, row, i or 0)] for i, row in zip(rows.column("doc_id").to_pylist(), sets, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column("toxic"), pa.array([f.tolist() for f in features.of_rows(data, offsets)], pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "features", "swaps"],
            )

    return describe


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic): at most ``sample`` ids, none of the held-out fold. The bound allows the broadcast."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    chosen = hashed_sample(ids.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), sample, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, sample)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_ones, n_zeros = n.get(1, 0), n.get(0, 0)
    if not n_ones or not n_zeros:
        return Model([], np.zeros(0), 30.0 if n_ones else -30.0)
    counts = rows.mapInArrow(_counted, "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    best = counts.where(F.col("ones") + F.col("zeros") >= LEAST_ROWS).withColumn("gain", gain(n_ones, n_zeros)).where(F.col("gain") >= LEAST_GAIN)
    best = best.orderBy(F.desc("gain"), "feature").limit(MOST_FEATURES)
    names = [r["feature"] for r in best.collect()]  # bounded
    described = rows.mapInArrow(_described(names), "toxic int, features array<int>, swaps array<array<int>>").collect()  # bounded by the sample
    features = Features(names)
    differences = [dict(zip(s[: len(s) // 2], s[len(s) // 2 :], strict=True)) for r in described for s in r["swaps"]]
    differences += features.insertions()
    weights, bias = fitted([np.array(r["features"], np.int64) for r in described], np.array([r["toxic"] for r in described], float), differences, len(names))
    return Model(names, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.names)
        for rows, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.scores(features, data, offsets))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bounded_text(docs, "text").alias("text"))
    scores = rows.mapInArrow(score, "doc_id long, score double")
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    ship(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.names)
        for rows, data, offsets in pieces(batches, "text"):
            yield rows.filter(pa.array(model.scores(features, data, offsets) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
