"""Spark's gradient-boosted trees, grown from histograms: what ``GBTClassifier`` and ``GBTRegressor`` fit, in less time.

Same method: the first tree fits the label (+1 and -1 for a classifier), each later one the negative gradient of the
loss; splits by variance reduction over at most 32 bins a feature, a share of the rows a tree, a share of the features
a node, leaves are weighted means. The result is Spark's own model, written in its stored form and loaded.

Rows are binned once and kept as arrays, one per partition, with their scores. A level of a tree is one short job: each
task returns sums of weight and weighted target by (node, feature, bin), the driver adds them up and picks the splits.
What the driver receives is bounded by tasks x nodes x features x bins, whatever the number of rows. Of two siblings
only the lighter is summed, the other is what their parent has beyond it. Held-out losses come with the first job of the
next tree; where they decide the length, growing stops with ``patience`` trees past the best. Adding a tree's values
keeps the rows in place: the new scores are written by the next job, and every ``CUT`` trees the lineage is cut by a
checkpoint. Every job sends a partition's rows to Python, so they hold little: three features' bins in two bytes, labels
and weights by number, the score; a count by three bins at once gives the counts by each.

A job takes about a tenth of a second whatever it sums, and tasks that end forget where their rows stand in the growing
tree. So where they can, all tasks of a table stay in one barrier stage till all trees are grown (``Gathering``): the
first one picks the splits, orders and sums go through files in the session's shared folder. A table of at most ``ALONE``
rows is one task. A job a level is left for tables of more than ``HELD_ROWS`` rows a slot, and for sessions whose shared
folder tasks can't open as a local path, or whose executors come and go; there up to ``ONE_TASK`` rows are one task.
"""

from __future__ import annotations

import json
import math
import os
import pickle
import shutil
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpline.llm.cluster import ship
from stumpline.plans.boosting import bin_edges
from stumpline.sources.staging import _drop, work_dir

MOST_ROWS = 1_000_000  # rows that one partition holds at most
ONE_TASK = MOST_ROWS  # rows that one task may grow trees on alone
ALONE = 250_000  # rows that are grown on sooner by one task than by several
HELD_ROWS = 3_000_000  # rows that one task of several holds at most
LOOK = 0.0001  # seconds between two looks for a file
TASK_ROWS = 20_000  # rows that are worth a task of their own
CUT = 20
BINS = 32
LEAF = -1
PACKED = 3  # features in one code, five bits each
CELLS = 1 << 15  # sums that are counted at once
BLOCK = 1 << 16  # rows that are worked on at once: what is computed of them stays in the processor's cache


@dataclass(frozen=True)
class Growth:
    classifier: bool
    trees: int
    depth: int
    step: float
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42
    patience: int | None = None  # None: held-out rows decide nothing


@dataclass
class Tree:
    """Nodes by number, children after their parents."""

    feature: list[int]
    cut: list[int]  # bins up to this go left
    left: list[int]
    right: list[int]
    weight: list[float]
    total: list[float]  # weighted sum of the target
    gain: list[float]

    @classmethod
    def of_root(cls) -> Tree:
        return cls([LEAF], [0], [LEAF], [LEAF], [0.0], [0.0], [-1.0])

    def values(self) -> np.ndarray:
        weight, total = np.array(self.weight), np.array(self.total)
        return np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)

    def places(self, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The node that each of ``rows`` (columns of ``codes``) ends in."""
        at = np.zeros(len(rows), np.int32)
        split = np.array(self.feature) != LEAF
        level = np.zeros(1, np.int64)
        while split[level].any():
            at = self.children(codes, rows, at)
            level = np.array([c for n in level for c in ((self.left[n], self.right[n]) if split[n] else ())])
        return at

    def children(self, codes: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where rows go from the nodes ``at``: the right child's number follows the left one's; a leaf's rows stay."""
        feature = np.array(self.feature, np.int32)
        leaf = feature == LEAF
        feature[leaf] = 0
        cut = np.where(leaf, BINS, np.array(self.cut)).astype(np.uint16)
        left = np.where(leaf, np.arange(len(leaf)), np.array(self.left)).astype(np.int32)
        start, shift = (feature // PACKED).astype(np.int64) * codes.shape[1], (5 * (feature % PACKED)).astype(np.uint16)
        if len(leaf) == 1 or (at == at[:1]).all() and len(at):  # all in one node
            n = int(at[0]) if len(at) else 0
            bins = (codes[feature[n] // PACKED, rows] >> shift[n]) & np.uint16(BINS - 1)
            return left[n] + (bins > cut[n]).astype(np.int32)
        bins = (codes.reshape(-1).take(start.take(at) + rows) >> shift.take(at)) & np.uint16(BINS - 1)
        return left.take(at) + (bins > cut.take(at))


# ---- one partition's rows ----


def _blocks(stop: int, start: int = 0) -> Iterator[slice]:
    return (slice(i, min(i + BLOCK, stop)) for i in range(start, stop, BLOCK))


def _few(values: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The values by number where there are few different ones, else as they are."""
    known, number = np.unique(values, return_inverse=True)
    if len(known) > 1 << 16:
        return values, None
    return number.astype(np.uint8 if len(known) <= 1 << 8 else np.uint16), known


@dataclass
class Rows:
    codes: np.ndarray  # (features / PACKED, rows) bins
    features: int
    label: tuple[np.ndarray, np.ndarray | None]
    weight: tuple[np.ndarray, np.ndarray | None] | None  # None: all 1
    train: int  # so many rows train, those after them are held out
    score: np.ndarray
    grown: int  # trees in the score
    number: int  # of the partition

    @classmethod
    def of(cls, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, number: int) -> Rows:
        """Ordered by what the rows hold, so that no fetch order plays a part."""
        groups = range(0, len(bins), PACKED)
        codes = np.array([sum(b.astype(np.uint16) << np.uint16(5 * i) for i, b in enumerate(bins[g : g + PACKED])) for g in groups], np.uint16)
        order = np.lexsort((*codes, label, weight, held))
        weights = None if (weight == 1).all() else _few(weight[order])
        return cls(np.ascontiguousarray(codes[:, order]), len(bins), _few(label[order]), weights, int((~held).sum()),
                   np.zeros(len(label)), 0, number)

    def labels(self, rows) -> np.ndarray:
        return self.label[0][rows] if self.label[1] is None else self.label[1][self.label[0][rows]]

    def weights(self, rows) -> np.ndarray | None:
        if self.weight is None:
            return None
        return self.weight[0][rows] if self.weight[1] is None else self.weight[1][self.weight[0][rows]]

    def ready(self, spec: Growth) -> Rows:
        """Draws the next tree's rows, their bins and their targets."""
        if spec.rows < 1:
            draws = np.random.default_rng((spec.seed, self.grown, self.number))
            share = np.zeros(len(self.score), bool)
            for b in _blocks(self.train):
                share[b] = draws.random(b.stop - b.start) < spec.rows
            self.drawn, self.others = np.flatnonzero(share), np.flatnonzero(~share)
            self.picked = np.empty((len(self.codes), len(self.drawn)), self.codes.dtype)
            for group, code in zip(self.picked, self.codes, strict=True):
                np.take(code, self.drawn, out=group, mode="clip")  # unbuffered
        else:
            self.drawn, self.others = np.arange(self.train), np.arange(self.train, len(self.score))
            self.picked = np.ascontiguousarray(self.codes[:, : self.train])
        self.goal = np.empty(len(self.drawn))
        for b in _blocks(len(self.drawn)):
            rows = self.drawn[b]
            label = self.labels(rows)
            if not self.grown:
                self.goal[b] = label
            elif spec.classifier:
                self.goal[b] = 4 * label / (1 + np.exp(np.minimum(2 * label * self.score[rows], 700.0)))
            else:
                self.goal[b] = 2 * (label - self.score[rows])
        return self

    def __getstate__(self) -> dict:  # what ready() made is made anew where it is used
        return {k: v for k, v in self.__dict__.items() if k not in ("drawn", "others", "picked", "goal")}

    def histograms(self, tree: Tree, nodes: list[int], places: np.ndarray) -> np.ndarray:
        """(node, feature, bin) sums of weight and weighted target over the drawn rows in ``nodes``."""
        slots = np.full(len(tree.feature), -1, np.int64)
        slots[nodes] = np.arange(len(nodes))
        out = np.zeros((len(nodes), self.features, BINS, 2))
        together = PACKED if len(nodes) * BINS**PACKED <= CELLS else PACKED - 1
        counted = {}  # the sums by several features' bins at once
        for b in _blocks(len(self.drawn)):
            use, added, slot, codes = self.drawn[b], self.goal[b], None, self.picked[:, b]
            if nodes != [0]:
                slot = slots.take(places[b])
                at = np.flatnonzero(slot >= 0)
                use, added, slot, codes = use.take(at), added.take(at), slot.take(at), codes.take(at, 1)
            weight = self.weights(use)
            added = added if weight is None else weight * added  # without weights, counting the rows gives their sums
            for f in range(0, self.features, PACKED):
                code = codes[f // PACKED].astype(np.int64)
                for first in range(0, min(PACKED, self.features - f), together):
                    n = min(together, PACKED - first, self.features - f - first)
                    size = BINS**n
                    cell = (code >> 5 * first) & (size - 1)
                    if len(nodes) > 1:
                        cell += slot * size
                    for c, values in enumerate((weight, added)):
                        sums = np.bincount(cell, values, len(nodes) * size)
                        if (f + first, n, c) in counted:
                            counted[f + first, n, c] += sums
                        else:
                            counted[f + first, n, c] = sums.astype(float, copy=False)  # counts, and sums of no rows, are whole numbers
        for (f, n, c), sums in counted.items():
            sums = sums.reshape(len(nodes), *[BINS] * n)
            for k in range(n):  # the first feature is the last axis
                out[:, f + k, :, c] = sums.sum(tuple(a for a in range(1, n + 1) if a != n - k))
        return out

    def loss(self, spec: Growth) -> np.ndarray:
        """Sums of weighted loss and of weight over the held-out rows."""
        out = np.zeros(2)
        for b in _blocks(len(self.score), self.train):
            y, score, weight = self.labels(b), self.score[b], self.weights(b)
            weight = np.ones(len(y)) if weight is None else weight
            if spec.classifier:
                margin = 2 * y * score
                each = 2 * (np.log1p(np.exp(-np.abs(margin))) + np.maximum(-margin, 0))
            else:
                each = (y - score) ** 2
            out += (weight * each).sum(), weight.sum()
        return out

    def summed(self, spec: Growth, tree: Tree, nodes: list[int], places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """With the losses where a tree begins: they belong to the trees before it. ``places``: nodes of the drawn rows."""
        places = tree.places(self.codes, self.drawn) if places is None else places
        return self.histograms(tree, nodes, places), self.loss(spec) if nodes == [0] else np.zeros(2)

    def with_tree(self, tree: Tree, step: float, places: np.ndarray | None = None) -> Rows:
        """``places``: nodes of the drawn rows."""
        values, score = step * tree.values(), self.score.copy()
        if places is None:
            for b in _blocks(len(score)):
                score[b] += values.take(tree.places(self.codes, np.arange(b.start, b.stop)))
        else:
            for b in _blocks(len(self.drawn)):
                score[self.drawn[b]] += values.take(places[b])
            for b in _blocks(len(self.others)):
                rows = self.others[b]
                score[rows] += values.take(tree.places(self.codes, rows))
        return Rows(self.codes, self.features, self.label, self.weight, self.train, score, self.grown + 1, self.number)


def _packed(edges: list[list[float]], spec: Growth, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows as one value."""
    from pyspark import TaskContext

    cuts = [np.array(e) for e in edges]
    bins, plain = [], []
    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
        bins.append(np.array([np.searchsorted(c, values[:, f]) for f, c in enumerate(cuts)], np.uint8).reshape(len(cuts), -1))
        plain.append(np.array([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]))
    if bins:
        b, (label, weight, held) = np.concatenate(bins, 1), np.concatenate(plain, 1)
    else:
        b, (label, weight, held) = np.zeros((len(cuts), 0), np.uint8), np.zeros((3, 0))
    if spec.classifier:
        label = 2 * label - 1
    rows = Rows.of(b, label, weight, held > 0, TaskContext.get().partitionId())
    yield pa.RecordBatch.from_pydict({"rows": [pickle.dumps(rows)]})


def cut_points(df: DataFrame, features: list[str]) -> list[list[float]]:
    """Where a feature may be split: between all its values where they are few, else at quantiles."""
    many = df.agg(*(F.approx_count_distinct(c).alias(c) for c in features)).first()
    few = [c for c in features if many[c] <= 2 * BINS]
    values = df.agg(*(F.collect_set(F.col(c).cast("double")).alias(c) for c in few)).first().asDict() if few else {}
    known = {c: sorted(v) for c, v in values.items() if len(v) <= BINS}
    rest = [c for c in features if c not in known]
    known |= dict(zip(rest, bin_edges(df, rest, BINS), strict=True)) if rest else {}
    return [[(a + b) / 2 for a, b in zip(known[c], known[c][1:])] if c not in rest else known[c] for c in features]


# ---- growing ----

Summed = Callable[[Tree, list[int]], tuple[np.ndarray, np.ndarray]]


def _split_all(spec: Growth, tree: Tree, number: int, nodes: list[int], sums: np.ndarray) -> None:
    """Splits every node that gains by it; the children's totals follow from the sums."""
    features = sums.shape[1]
    keep = math.ceil(spec.columns * features)
    allowed = np.ones((len(nodes), features), bool)
    if keep < features:
        for i, node in enumerate(nodes):
            allowed[i, np.random.default_rng((spec.seed, number, node)).permutation(features)[keep:]] = False
    below = np.cumsum(sums, 2)[:, :, :-1]
    wl, sl = below[..., 0], below[..., 1]
    w, s = (np.array(c)[nodes][:, None, None] for c in (tree.weight, tree.total))
    wr, sr = w - wl, s - sl
    ok = (wl > 1e-9 * w) & (wr > 1e-9 * w) & allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (sl**2 / wl + sr**2 / wr - s**2 / w) / w, -np.inf)
    flat = gain.reshape(len(nodes), -1)
    top = flat.max(1, keepdims=True)
    best = (flat >= top - 1e-9 * np.abs(top)).argmax(1)  # first of equal gains, but for rounding: least feature, then bin
    for i, node in enumerate(nodes):
        weight, total = tree.weight[node], tree.total[node]
        if weight <= 0 or not flat[i, best[i]] > 1e-12 * (1 + (total / weight) ** 2):
            continue
        f, b = divmod(int(best[i]), BINS - 1)
        tree.feature[node], tree.cut[node], tree.gain[node] = f, b, float(flat[i, best[i]])
        tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
        for child_weight, child_total in ((wl[i, f, b], sl[i, f, b]), (wr[i, f, b], sr[i, f, b])):
            tree.feature.append(LEAF)
            tree.cut.append(0)
            tree.left.append(LEAF)
            tree.right.append(LEAF)
            tree.weight.append(float(child_weight))
            tree.total.append(float(child_total))
            tree.gain.append(-1.0)


def grown_tree(spec: Growth, number: int, tree: Tree, root: np.ndarray, summed: Summed) -> Tree:
    """One tree, level by level, from the sums of its root."""
    tree.weight[0], tree.total[0] = (float(v) for v in root[0, 0].sum(0))
    nodes, sums = [0], root
    for level in range(spec.depth):
        _split_all(spec, tree, number, nodes, sums)
        parents = [(i, n) for i, n in enumerate(nodes) if tree.feature[n] != LEAF]
        if not parents or level + 1 == spec.depth:
            break
        pairs = [(tree.left[n], tree.right[n]) for _, n in parents]
        lighter = [l if tree.weight[l] <= tree.weight[r] else r for l, r in pairs]
        found, _ = summed(tree, lighter)
        other = sums[[i for i, _ in parents]] - found
        left_found = np.array([one == l for one, (l, _) in zip(lighter, pairs, strict=True)])[:, None, None, None]
        nodes = [child for pair in pairs for child in pair]
        sums = np.stack((np.where(left_found, found, other), np.where(left_found, other, found)), 1).reshape(-1, *found.shape[1:])
    return tree


def grown_trees(spec: Growth, summed: Summed, add: Callable[[Tree, float], None], best_length) -> tuple[list[Tree], list[float]]:
    """All trees, and the held-out error after each; with ``patience`` only the trees up to the least error."""
    trees: list[Tree] = []
    errors: list[float] = []
    for number in range(spec.trees + 1):
        tree = Tree.of_root()
        root, loss = summed(tree, [0])
        if number and loss[1]:
            errors.append(float(loss[0] / loss[1]))
            if spec.patience is not None and best_length(errors, spec.patience)[1]:
                break
        if number == spec.trees:
            break
        trees.append(grown_tree(spec, number, tree, root, summed))
        add(trees[-1], spec.step if number else 1.0)
    if spec.patience is not None and errors:
        trees = trees[: best_length(errors, spec.patience)[0]]
    return trees, errors


class Alone:
    """The rows of one partition, in its task, and where the drawn ones stand in the tree that grows."""

    def __init__(self, rows: Rows, spec: Growth):
        self.rows, self.spec, self.places = rows.ready(spec), spec, None

    def move(self, tree: Tree) -> None:
        """Drawn rows whose node was split since go on to its children."""
        for b in _blocks(len(self.places)):
            self.places[b] = tree.children(self.rows.picked, np.arange(b.start, b.stop), self.places[b])

    def summed(self, tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if nodes == [0]:
            self.places = np.zeros(len(self.rows.drawn), np.uint8 if self.spec.depth < 8 else np.int32)
        else:
            self.move(tree)
        return self.rows.summed(self.spec, tree, nodes, self.places)

    def add(self, tree: Tree, step: float) -> None:
        self.move(tree)
        self.rows = self.rows.with_tree(tree, step, self.places).ready(self.spec)


def _grown_alone(spec: Growth, best_length, rows: Iterator[Rows]) -> Iterator[tuple[list[Tree], list[float]]]:
    for one in rows:
        alone = Alone(one, spec)
        yield grown_trees(spec, alone.summed, alone.add, best_length)


class Gathering:
    """The tasks of one barrier stage, which all run at once. The first one posts what to do next and adds up the others' sums."""

    def __init__(self, folder: str, me: int, tasks: int):
        self.folder, self.me, self.tasks = Path(folder), me, tasks
        self.number = self.read_by_all = 0  # of orders

    def write(self, name: str, value) -> None:
        part = self.folder / f"{name}.part"
        part.write_bytes(pickle.dumps(value))
        os.replace(part, self.folder / name)  # whole when it gets its name

    def read(self, name: str):
        """Waits for it. The driver removes the folder when the job has ended."""
        looks = 0
        while True:
            try:
                return pickle.loads((self.folder / name).read_bytes())
            except FileNotFoundError:
                looks += 1
                if looks % 10_000 == 0 and not self.folder.exists():
                    raise RuntimeError("the other tasks are gone") from None
                time.sleep(LOOK)

    def post(self, order) -> None:
        self.number += 1
        self.write(f"{self.number}", order)

    def added_up(self, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums, loss = own
        for task in range(1, self.tasks):
            name = f"{self.number}-{task}"
            more = self.read(name)
            sums, loss = sums + more[0], loss + more[1]
            (self.folder / name).unlink()
        while self.read_by_all < self.number:  # who sent sums has read the orders up to here
            self.read_by_all += 1
            (self.folder / f"{self.read_by_all}").unlink()
        return sums, loss

    def orders(self) -> Iterator:
        while (order := self.read(f"{self.number + 1}")) is not None:
            self.number += 1
            yield order

    def send(self, sums: tuple[np.ndarray, np.ndarray]) -> None:
        self.write(f"{self.number}-{self.me}", sums)


class Leading:
    """The first task's rows, and the orders to the others: nodes to sum, or a tree to add and its step."""

    def __init__(self, alone: Alone, gathering: Gathering):
        self.alone, self.gathering = alone, gathering

    def summed(self, tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        self.gathering.post((tree, nodes, None))
        return self.gathering.added_up(self.alone.summed(tree, nodes))

    def add(self, tree: Tree, step: float) -> None:
        self.gathering.post((tree, None, step))
        self.alone.add(tree, step)


def _grown_together(spec: Growth, best_length, folder: str, rows: Iterator[Rows]) -> Iterator:
    """The trees, from the first task; nothing where some task doesn't see the folder."""
    task = BarrierTaskContext.get()
    alone = Alone(next(rows), spec)
    seen = task.allGather(uuid.uuid4().hex if os.path.isdir(folder) else "")
    if not all(seen):
        return
    here = f"{folder}/{seen[0]}"  # no other attempt's files
    os.makedirs(here, exist_ok=True)
    gathering = Gathering(here, task.partitionId(), len(task.getTaskInfos()))
    if not gathering.me:
        leading = Leading(alone, gathering)
        grown = grown_trees(spec, leading.summed, leading.add, best_length)
        gathering.post(None)
        yield grown
        return
    for tree, nodes, step in gathering.orders():
        if nodes is None:
            alone.add(tree, step)
        else:
            gathering.send(alone.summed(tree, nodes))


def _slots(spark: SparkSession) -> int:
    """Tasks that run at once now: what a barrier stage may have."""
    context = spark.sparkContext._jsc.sc()
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _shared_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that tasks may open, if it is one and all tasks of a stage can run at once."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _together(spec: Growth, rows: RDD, best_length, shared: str) -> tuple[list[Tree], list[float]] | None:
    """None where it can't be done so. Spark doesn't try a barrier stage again: after a lost task, jobs do the work anew."""
    folder = f"{shared}/trees-{uuid.uuid4().hex}"
    os.makedirs(folder)
    try:
        found = rows.barrier().mapPartitions(partial(_grown_together, spec, best_length, folder)).collect()
    except Py4JJavaError as error:
        warnings.warn(f"trees are grown by a job a level, as tasks that ran together failed: {str(error)[:2000]}", stacklevel=2)
        return None
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return found[0] if found else None


def _summed_parts(spec: Growth, tree: Tree, nodes: list[int], rows: Iterator[Rows]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for one in rows:
        yield one.ready(spec).summed(spec, tree, nodes)


def _with_tree(tree: Tree, step: float, rows: Iterator[Rows]) -> Iterator[Rows]:
    for one in rows:
        yield one.with_tree(tree, step)


class Spread:
    """The rows of all partitions, one cached value each."""

    def __init__(self, spark: SparkSession, rows: RDD, spec: Growth):
        self.spark, self.spec = spark, spec
        self.rows, self.before = rows.persist(StorageLevel.MEMORY_AND_DISK), None
        self.added, self.cut = 0, None
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(f"{work_dir(spark)}/checkpoints")

    def summed(self, tree: Tree, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = self.rows.mapPartitions(partial(_summed_parts, self.spec, tree, nodes))
        if found.getNumPartitions() > 64:
            sums, loss = found.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        else:
            parts = found.collect()
            sums, loss = sum(p[0] for p in parts), sum(p[1] for p in parts)
        if self.before is not None:  # the job above wrote the rows that follow it
            self.before.unpersist()
            self.before = None
            if self.rows.isCheckpointed():
                if self.cut:
                    _drop(self.spark, self.cut)
                self.cut = self.rows.getCheckpointFile()
        return sums, loss

    def add(self, tree: Tree, step: float) -> None:
        self.before = self.rows
        self.rows = self.rows.mapPartitions(partial(_with_tree, tree, step), preservesPartitioning=True)
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.added += 1
        if self.added % CUT == 0:
            self.rows.checkpoint()

    def close(self) -> None:
        self.rows.unpersist()
        if self.before is not None:
            self.before.unpersist()
        if self.cut:
            _drop(self.spark, self.cut)


def _loaded(rows: Iterator) -> Iterator[Rows]:
    for row in rows:
        yield pickle.loads(row[0])


def fit(spec: Growth, df: DataFrame, features: list[str], best_length) -> tuple[list[Tree], list[float], list[list[float]]]:
    """Trees on the rows of ``df`` (_features vector, _label, _weight, _held), held-out errors, and the bins' edges."""
    spark = df.sparkSession
    ship(spark)
    edges = cut_points(df.where(~F.col("_held")), features)
    n = df.count()
    table = df.select(vector_to_array("_features").alias("values"), F.col("_label").cast("double"),
                      F.col("_weight").cast("double"), F.col("_held").cast("double"))

    def dealt(parts: int) -> RDD:
        return table.repartition(parts).mapInArrow(partial(_packed, edges, spec), "rows binary").rdd.mapPartitions(_loaded)

    slots = _slots(spark)
    tasks = min(slots, -(-n // TASK_ROWS))
    if min(ALONE, ONE_TASK) < n <= tasks * HELD_ROWS and tasks > 1 and (shared := _shared_folder(spark)):
        if grown := _together(spec, dealt(tasks), best_length, shared):
            return *grown, edges
    slots = max(1, spark.sparkContext.defaultParallelism)
    parts = 1 if n <= ONE_TASK else min(slots * -(-n // (slots * MOST_ROWS)), -(-n // TASK_ROWS))  # whole rounds of tasks
    rows = dealt(parts)
    if parts == 1:
        trees, errors = rows.mapPartitions(partial(_grown_alone, spec, best_length)).collect()[0]
        return trees, errors, edges
    spread = Spread(spark, rows, spec)
    try:
        trees, errors = grown_trees(spec, spread.summed, spread.add, best_length)
    finally:
        spread.close()
    return trees, errors, edges


# ---- as Spark's model ----

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
    "numCategories: int>>"
)


def _node_rows(trees: list[Tree], edges: list[list[float]]) -> Iterator[tuple]:
    """Rows of the stored form. Impurities aren't kept: the stats give each node's weight and mean, without spread."""
    for t, tree in enumerate(trees):
        for i, value in enumerate(tree.values().tolist()):
            f, weight = tree.feature[i], tree.weight[i]
            split = (f, [edges[f][tree.cut[i]]], -1) if f != LEAF else (-1, [], -1)
            stats = [weight, weight * value, weight * value * value]
            yield t, (i, value, 0.0, stats, round(weight), tree.gain[i], tree.left[i], tree.right[i], split)


def as_spark_model(spark: SparkSession, estimator, trees: list[Tree], edges: list[list[float]], classifier: bool):
    """The trees as the model that ``estimator`` would have returned."""
    path = f"{work_dir(spark)}/models-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    given = {p.name: v for p, v in estimator._paramMap.items()}
    default = {p.name: v for p, v in estimator._defaultParamMap.items()}
    package = "classification" if classifier else "regression"
    name = "GBTClassificationModel" if classifier else "GBTRegressionModel"
    now, version = int(time.time() * 1000), spark.version

    def described(kind: str, uid: str, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.{kind}", "timestamp": now, "sparkVersion": version, "uid": uid,
                           "paramMap": more.pop("paramMap"), "defaultParamMap": more.pop("defaultParamMap")} | more)

    whole = described(f"{package}.{name}", estimator.uid, paramMap=given, defaultParamMap=default,
                      numFeatures=len(edges), numTrees=len(trees))
    in_tree = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
               "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}
    each = [(t, described("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}",
                          paramMap={k: v for k, v in given.items() if k in in_tree},
                          defaultParamMap={k: v for k, v in default.items() if k in in_tree}), estimator.getStepSize() if t else 1.0)
            for t in range(len(trees))]
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(list(_node_rows(trees, edges)), NODES).coalesce(1).write.parquet(f"{path}/data")
    model = (GBTClassificationModel if classifier else GBTRegressionModel).load(path)
    _drop(spark, path)
    return model
