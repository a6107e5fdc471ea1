"""Near-duplicate vectors by product quantisation.

A coarse quantiser deals the vectors to inverted lists; each vector's residual to its list's centre is coded by the
nearest codeword of every subspace. Both are fitted on ``SAMPLE`` vectors (those whose hash is least), on the driver.
A vector is at home in its own list, and asks each list from whose border it is at most half the margin away: the border
is the plane half way between the two centres, and of a pair that is parted by it, one end is at most half their distance
from it. The margin is the distance of a pair at the threshold (0.32 at 0.95), so no linked pair is ever parted unseen;
a pair of which both ends ask the other's list counts in the list of the smaller number. In a list, table lookups of a
row's distances to the codewords give its distance to every vector at home there (a pair is left out as soon as some
subspaces alone exceed the limit); those within the threshold and the code's own known error are kept, so the codes lose no pair; an exact cosine in double precision decides.

Equal vectors are one class and compared once. Lists are compared in tiles of bounded size (a block at home with another
one, or with a block of those that ask), which return numbers of links and local components, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link
with nothing; vectors of another dimension than most link among their own dimension only (compared without codes);
repeated rows link with each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.llm.arrays import binary, flat
from stumpline.llm.cluster import hashed_sample, ship, staged
from stumpline.llm.components import components, local_roots, streamed_groups
from stumpline.llm.jaccard_join import compared

THRESHOLD = 0.95
MARGIN = 0.2  # an earlier default, kept for callers that name it; it may miss pairs near a border
_MARGIN_SLACK = 1e-3  # float32 rounding of distances to the centres
SAMPLE = 20_000
MOST_LISTS = 512
CODEWORDS = 256
SUBSPACE = 4
TILE = 1024  # rows at home in one tile
ASKING = 4096  # rows that ask, in one tile
ROUNDS = 12
FIRST = 4  # subspaces looked up before pairs are left out, and at once later on
_SLACK = 1e-4
_ROUNDED = 1e-5  # more than float32 sums of squares are off by


def k_means(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres of Lloyd's rounds from ``k`` random rows; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = closest(x, centres)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres.astype(np.float32)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for low in range(0, len(x), 8192):
        out[low : low + 8192] = ((centres**2).sum(1)[None, :] - 2 * x[low : low + 8192] @ centres.T).argmin(1)
    return out


class Quantiser:
    """Coarse centres and, for each subspace of the residuals, codewords."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = k_means(sample, lists)
        wide = self.centres.astype(np.float64)
        squares = (wide**2).sum(1)
        self.apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * wide @ wide.T, 1e-12))
        residual = sample - self.centres[closest(sample, self.centres)]
        self.cuts = list(range(0, sample.shape[1], SUBSPACE)) + [sample.shape[1]]
        self.codewords = [k_means(residual[:, a:b], CODEWORDS, a + 1) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the distance between each vector and what its codes stand for."""
        own = closest(x, self.centres)
        residual = x - self.centres[own]
        codes = np.zeros((len(x), len(self.codewords)), np.uint8)
        error = np.zeros(len(x))
        for m, words in enumerate(self.codewords):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = closest(part, words)
            error += ((part - words[codes[:, m]]) ** 2).sum(1)
        return own, codes, np.sqrt(error)

    def near_lists(self, x: np.ndarray, own: np.ndarray, margin: float = MARGIN) -> np.ndarray:
        """For each vector and list: is the plane half way to that list's centre within the margin?"""
        wide, centres = x.astype(np.float64), self.centres.astype(np.float64)
        distance = (centres**2).sum(1)[None, :] - 2 * wide @ centres.T
        return (distance - distance[np.arange(len(x)), own][:, None]) / (2 * self.apart[own]) <= margin

    def distances(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: exact queries against one list's coded vectors, by table lookups."""
        residual = queries - self.centres[centre]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, words in enumerate(self.codewords):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            table = (part**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * part @ words.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))

    def _table(self, residual: np.ndarray, m: int) -> np.ndarray:
        """Squared distances to the codewords of a subspace, but for the residual's own square."""
        part, words = residual[:, self.cuts[m] : self.cuts[m + 1]], self.codewords[m]
        return np.column_stack((part, np.ones(len(part), np.float32))) @ np.column_stack((-2 * words, (words**2).sum(1))).T

    def within(self, queries: np.ndarray, centre: int, codes: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """``distances(...) <= limit`` (one limit a coded vector). A distance is at least what a few subspaces add up to,
        so the others are looked up only for pairs, and their tables made only for queries, that those leave."""
        residual = queries - self.centres[centre]
        order = np.argsort([-words.var(0).sum() for words in self.codewords], kind="stable")
        squares = np.stack([(residual[:, self.cuts[m] : self.cuts[m + 1]] ** 2).sum(1) for m in order], 1)
        most = (limit**2).astype(np.float32) + np.float32(_ROUNDED)
        total = np.repeat(squares[:, :FIRST].sum(1)[:, None], len(codes), 1)
        for m in order[:FIRST]:
            total += self._table(residual, m).take(codes[:, m], 1)
        query, coded = np.nonzero(total <= most[None, :])
        total = total[query, coded]
        for low in range(FIRST, len(order), FIRST):
            left, query_left = np.unique(query, return_inverse=True)
            total += squares[query, low : low + FIRST].sum(1)
            for m in order[low : low + FIRST]:
                total += self._table(residual[left], m)[query_left, codes[coded, m]]
            near = total <= most[coded]
            query, coded, total = query[near], coded[near], total[near]
        near = np.sqrt(np.maximum(total, 0)) <= limit[coded]
        out = np.zeros((len(queries), len(codes)), bool)
        out[query[near], coded[near]] = True
        return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors, digests, dims = batch.column("vec_id"), [], [], []
        for i, v in zip(ids.to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = np.array(v, np.float64) if i is not None and v and None not in v else np.zeros(0)
            fine = len(x) and np.isfinite(x).all() and x.any()
            raw = x.tobytes() if fine else None
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            vectors.append(short.tobytes() if fine and (short == x).all() else raw)
            dims.append(len(x) if fine else None)
            digests.append(hashlib.blake2b(raw, digest_size=16).digest() if fine else None)
        yield pa.RecordBatch.from_arrays([ids, binary(digests), pa.array(dims, pa.int32()), binary(vectors)], ["vec_id", "cls", "dim", "vector"])


READ = "vec_id long, cls binary, dim int, vector binary"


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that very large or small components do no harm."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors are kept in single precision where that is exact."""
    short = pc.binary_length(column).to_numpy(zero_copy_only=False) == 4 * dim
    out = np.empty((len(column), dim))
    for kind, at in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        if len(at):
            out[at] = np.frombuffer(flat(column.take(pa.array(at)))[0].tobytes(), kind).reshape(-1, dim)
    return out


DEALT = "cls binary, dim int, rep long, copies long, vector binary, list long, codes binary, error double, asked array<long>, bits binary"


def _dealt(quantiser: Quantiser | None, dim: int, margin: float):
    """Each class's list, codes and error, and the lists that it asks, by number and as bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                rows = batch.slice(low, 1024)
                dims = rows.column("dim").to_numpy()
                n = len(dims)
                lists, codes, errors = -dims.astype(np.int64), [b""] * n, np.zeros(n)
                asked, bits = [[] for _ in range(n)], [b""] * n
                main = np.flatnonzero(dims == dim)
                if len(main):
                    x = unit(_matrix(rows.column("vector").take(pa.array(main)), dim)).astype(np.float32)
                    own, code, error = quantiser.encode(x)
                    near = quantiser.near_lists(x, own, margin / 2)
                    near[np.arange(len(x)), own] = False
                    packed = np.packbits(near, axis=1)
                    for k, i in enumerate(main):
                        lists[i], codes[i], errors[i] = own[k], code[k].tobytes(), error[k]
                        asked[i], bits[i] = np.flatnonzero(near[k]).tolist(), packed[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(lists), binary(codes), pa.array(errors), pa.array(asked, pa.list_(pa.int64())), binary(bits)],
                    [*rows.schema.names, "list", "codes", "error", "asked", "bits"],
                )

    return deal


def _met(dealt: DataFrame) -> DataFrame:
    """Rows of the tiles: a list's rows at home in blocks, each with every other one and with each block of those that ask."""
    units = F.concat(F.array(F.struct(F.col("list").alias("unit"), F.lit(True).alias("home"))),
                     F.transform("asked", lambda u: F.struct(u.alias("unit"), F.lit(False).alias("home"))))
    sizes = dealt.select(F.explode(units).alias("u")).groupBy("u.unit").agg(
        F.count_if("u.home").alias("homes"), F.count_if(~F.col("u.home")).alias("asking")
    )
    sizes = staged(sizes.where("homes > 0 and homes + asking > 1"))  # a row for each list
    blocks, others = F.ceil(F.col("homes") / TILE).cast("int"), F.ceil(F.col("asking") / ASKING).cast("int")
    home = F.col("home")
    rows = dealt.select("dim", "rep", "copies", "vector", "list", "codes", "error", "bits", F.explode(units).alias("u")).select("*", "u.*").drop("u")
    rows = rows.join(F.broadcast(sizes), "unit").withColumn("block", F.when(home, F.pmod(F.xxhash64("rep"), blocks)).otherwise(
        blocks + F.pmod(F.xxhash64("rep"), others)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(home, blocks + others).otherwise(blocks) - 1)))
    return rows.select(
        "unit", (F.least("block", "other") * F.lit(1 << 20) + F.greatest("block", "other")).alias("tile"), "block", "home", "rep", "copies", "list", "dim", "vector",
        *(F.when(home, F.col(c)).alias(c) for c in ("codes", "error", "bits")),  # those that ask need none
    )


LINKS = "rep long, links long, root long"


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For both sides of a matrix of links, the least name of each row's component."""
    far = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], far).min(0))
        new_left = np.minimum(left, np.where(linked, new_right[None, :], far).min(1))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _linked(quantiser: Quantiser | None, threshold: float):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in streamed_groups(batches, ["unit", "tile"]):
            if rows.num_rows < 2:
                continue
            rows = rows.take(pa.array(np.argsort(rows.column("rep").to_numpy(), kind="stable")))
            left, right = compared(rows)  # the left side is at home
            if not len(left) or not len(right):
                continue
            unit_, dim = rows.column("unit")[0].as_py(), rows.column("dim")[0].as_py()
            rep, size, lists = (rows.column(c).to_numpy() for c in ("rep", "copies", "list"))
            exact = unit(_matrix(rows.column("vector"), dim))
            maybe = left[:, None] != right[None, :]
            if unit_ >= 0:
                at_home = rows.take(pa.array(left))
                codes = np.frombuffer(flat(at_home.column("codes"))[0].tobytes(), np.uint8).reshape(len(left), -1)
                maybe &= quantiser.within(exact[right].astype(np.float32), unit_, codes, reach + at_home.column("error").to_numpy()).T
            some, others = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            if not len(some):
                continue
            low, high = divmod(rows.column("tile")[0].as_py(), 1 << 20)
            if low == high:  # one block twice: every pair is there in both orders
                some = others = np.union1d(some, others)
            maybe = maybe[np.ix_(some, others)]
            linked = (exact[left[some]] @ exact[right[others]].T >= threshold) & maybe
            left, right = left[some], right[others]
            if unit_ >= 0 and (lists[right] != unit_).any():  # asked from both sides: in the list of the smaller number
                bits = np.frombuffer(flat(at_home.take(pa.array(some)).column("bits"))[0].tobytes(), np.uint8).reshape(len(left), -1)
                asks = np.unpackbits(bits, axis=1)[:, lists[right]] > 0
                linked &= ~(asks & (lists[right] < unit_)[None, :])
            if low == high:
                linked |= linked.T
            if not linked.any():
                continue
            rows_hit, columns_hit = linked.any(1), linked.any(0)
            linked, left, right = linked[np.ix_(rows_hit, columns_hit)], left[rows_hit], right[columns_hit]
            if low == high:
                yield _counted(rep[left], linked @ size[right], local_roots(linked, rep[left]))
            else:
                roots = _roots(linked, rep[left], rep[right])
                yield _counted(rep[left], linked @ size[right], roots[0])
                yield _counted(rep[right], linked.T @ size[left], roots[1])

    return link


def _counted(rep: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], ["rep", "links", "root"])


def _list_count(n: int) -> int:
    return int(max(1, min(MOST_LISTS, round(np.sqrt(n) / 2))))


def safe_margin(threshold: float) -> float:
    """Distance of unit vectors at the threshold, and rounding slack: a pair parted by a border has both ends nearer
    to it than their own distance, so with this margin no pair at or above the threshold can be missed."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _MARGIN_SLACK


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None) -> DataFrame:
    """vec_id, n_links (other vectors with at least that cosine), component_id (least id that links reach), kept.

    ``margin`` defaults to ``safe_margin(threshold)``; a smaller one trades links near borders for fewer list copies.
    """
    margin = safe_margin(threshold) if margin is None else margin
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    read = staged(rows.mapInArrow(_read, READ))
    classes = staged(read.where("cls is not null").groupBy("cls", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, quantiser = (sizes["dim"], None) if sizes else (0, None)
    if sizes:
        sample = hashed_sample(classes.where(F.col("dim") == dim), SAMPLE, "cls").select("vector").collect()  # bounded
        quantiser = Quantiser(unit(_matrix(pa.array([r["vector"] for r in sample], pa.binary()), dim)).astype(np.float32), _list_count(sizes["n"]))
    dealt = staged(classes.select("cls", "dim", "rep", "copies", "vector").mapInArrow(_dealt(quantiser, dim, margin), DEALT))
    full = _met(dealt).repartition("unit", "tile").sortWithinPartitions("unit", "tile")
    links = staged(full.mapInArrow(_linked(quantiser, threshold), LINKS))

    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    facts = classes.select("cls", "rep", "copies").join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
    facts = facts.select("cls", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = read.select("vec_id", "cls").join(facts, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
