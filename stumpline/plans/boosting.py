"""Gradient-boosted trees for several training sets at once: the folds of a cross-validation and the final model.

Every row carries, for each model, whether it trains it and whether it is held out for it. Trees grow level by level,
and one aggregation a level serves all models: rows are spread over (model, node) by the splits found so far, and
sums of gradient, hessian and rows are taken by (model, node, feature, bin). From these the driver picks each node's
split by the second-order gain; what it receives is bounded by models x nodes x features x bins, whatever the number
of rows. Features are cut into bins once, at quantiles of the whole table.

The raw scores of every row are written (staged) once every ``REFRESH`` trees; in between, the trees since the last
write are applied as expressions over literal tables of splits and leaves, so nothing but the staged table is read and
lineage never grows. Early stopping is inside the one fit: the held-out loss of every model after each tree is summed
in the pass that writes the scores, and a model's length is the best one, looking ``patience`` trees past it; its
later trees are cut, never refitted.

Trees, leaves and bin edges are plain tables; a model predicts with a JVM-side expression whose size depends on
the depth only. Missing feature values go left, like the least values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stumpline.sources.staging import drop_table, staged

REFRESH = 10
NO_SPLIT = -1


@dataclass(frozen=True)
class Boosting:
    classifier: bool
    trees: int
    depth: int
    step: float
    bins: int = 32
    l2: float = 1.0
    min_rows: int = 1
    min_hessian: float = 1e-6
    rows: float = 1.0  # share of training rows a tree sees, by a hash of row and tree
    columns: float = 1.0  # share of features a tree may split on
    patience: int | None = None
    seed: int = 42


@dataclass
class Forest:
    """One fitted model: base score, trees as heap-ordered tables, bin edges of its features."""

    features: list[str]
    edges: list[list[float]]
    base: float
    classifier: bool
    depth: int
    feature: list[list[int]] = field(default_factory=list)  # per tree, per node: feature index or NO_SPLIT
    threshold: list[list[int]] = field(default_factory=list)  # bin: at most this goes left
    leaf: list[list[float]] = field(default_factory=list)  # value of a node that ends there (step included)
    gain: list[list[float]] = field(default_factory=list)

    def truncated(self, n: int) -> Forest:
        return Forest(self.features, self.edges, self.base, self.classifier, self.depth, self.feature[:n],
                      self.threshold[:n], self.leaf[:n], self.gain[:n])

    def raw(self, values: str) -> Column:
        """Raw score of a row whose feature values are the SQL array ``values`` (null: left)."""
        cuts = [[_edge(self.edges, f, b) for f, b in zip(fs, bs, strict=True)] for fs, bs in zip(self.feature, self.threshold, strict=True)]
        return F.lit(self.base) + F.expr(_trees_sum(values, self.feature, cuts, self.leaf, self.depth))

    def prediction(self, df: DataFrame) -> Column:
        raw = self.raw("array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in self.features) + ")")
        return 1 / (1 + F.exp(-raw)) if self.classifier else raw

    def importances(self) -> list[float]:
        total = np.zeros(len(self.features))
        for fs, gs in zip(self.feature, self.gain, strict=True):
            for f, g in zip(fs, gs, strict=True):
                if f != NO_SPLIT:
                    total[f] += g
        return list(total / total.sum()) if total.sum() > 0 else [0.0] * len(self.features)


def _edge(edges: list[list[float]], f: int, b: int) -> float:
    return edges[f][b] if f != NO_SPLIT else 0.0


def _lit_array(values: list, kind: str) -> str:
    """A constant array as SQL: JSON text read by Spark's JSON reader (repr of a float reads back exactly).

    One string instead of a literal a value: the SQL parser is slow on thousands of literals.
    """
    text = "[" + ",".join(repr(float(v)) if kind == "double" else str(int(v)) for v in values) + "]"
    return f"from_json('{text}', 'array<{kind}>')"


_names = iter(range(1 << 62))


def _walk(values: str, feature: str, threshold: str, offset: str, depth: int) -> str:
    """SQL of the node reached in one tree: from the root, ``depth`` steps; a node without a split keeps the row.

    ``values`` are raw feature values against raw edges, or bins against bin numbers: x > edge b iff bin(x) > b.
    A lambda variable carries the node, so the text doesn't grow with the depth; built as text, it costs the driver
    one call however many trees it holds.
    """
    if not depth:
        return "0"
    k = next(_names)
    nd, at = f"nd{k}", f"({offset} + nd{k} + 1)"
    f = f"element_at({feature}, {at})"
    right = f"coalesce(element_at({values}, greatest({f}, 0) + 1) > element_at({threshold}, {at}), false)"
    return (f"aggregate(sequence(1, {depth}), 0, ({nd}, i{k}) -> CASE WHEN {f} = {NO_SPLIT} THEN {nd} "
            f"ELSE 2 * {nd} + 1 + CASE WHEN {right} THEN 1 ELSE 0 END END)")


def _trees_sum(values: str, feature: list[list[int]], threshold: list[list], leaf: list[list[float]], depth: int) -> str:
    """SQL of the sum of the leaf values of all trees, walked over constant tables of size trees x nodes."""
    if not feature:
        return "CAST(0 AS DOUBLE)"
    nodes = (1 << (depth + 1)) - 1
    feats = _lit_array([f for t in feature for f in t], "int")
    cuts = _lit_array([float(c) for t in threshold for c in t], "double")
    leaves = _lit_array([float(v) for t in leaf for v in t], "double")
    k = next(_names)
    walk = _walk(values, feats, cuts, f"t{k} * {nodes}", depth)
    return (f"aggregate(sequence(0, {len(feature) - 1}), CAST(0 AS DOUBLE), "
            f"(acc{k}, t{k}) -> acc{k} + element_at({leaves}, t{k} * {nodes} + {walk} + 1))")


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Distinct quantile cuts of every feature over all rows: one aggregation."""
    shares = [b / bins for b in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features)).first()
    return [sorted({float(v) for v in (row[c] or []) if v is not None}) for c in features]


def binned(values: str, edges: list[list[float]]) -> Column:
    """Bin of every feature of the SQL array ``values``: the number of its edges below the value; null is bin 0."""
    out = [f"coalesce(size(filter({_lit_array(cuts, 'double')}, e -> element_at({values}, {i + 1}) > e)), 0)"
           for i, cuts in enumerate(edges)]
    return F.expr("array(" + ", ".join(out) + ")") if out else F.array().cast("array<int>")


def _loss(raw: Column, y: Column, classifier: bool) -> Column:
    if classifier:
        return F.log1p(F.exp(-F.abs(raw))) + F.greatest(raw, F.lit(0.0)) - y * raw
    return (raw - y) * (raw - y)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, spec: Boosting, allowed: np.ndarray):
    """(gain, feature, bin) of the best split of one node from its histograms (features x bins), or None."""
    G, H = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    gl, hl, nl = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1], np.cumsum(n, 1)[:, :-1]
    gr, hr, nr = G - gl, H - hl, n.sum(1, keepdims=True) - nl
    gain = gl**2 / (hl + spec.l2) + gr**2 / (hr + spec.l2) - G**2 / (H + spec.l2)
    ok = (nl >= spec.min_rows) & (nr >= spec.min_rows) & (hl >= spec.min_hessian) & (hr >= spec.min_hessian)
    ok &= allowed[:, None]
    gain = np.where(ok, gain, -np.inf)
    if not np.isfinite(gain).any() or gain.max() <= 1e-12:
        return None
    f, b = np.unravel_index(np.argmax(gain), gain.shape)  # first of equal gains: least feature, then bin
    return float(gain[f, b]), int(f), int(b)


def fit_all(df: DataFrame, features: list[str], target: str, train: list[Column], held: list[Column], spec: Boosting,
            weight: str | None = None) -> tuple[list[Forest], list[list[float]]]:
    """One forest for every pair of (training rows, held-out rows) conditions, grown together.

    Returns the forests (cut to their best length where ``spec.patience`` is set) and, per model, the held-out loss
    after every tree (tree 0: the base score alone).
    """
    models = len(train)
    edges = bin_edges(df, features, spec.bins)
    values = "array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in features) + ")"
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = staged(df.select(
        F.monotonically_increasing_id().alias("_row"), F.col(target).cast("double").alias("_y"), w.alias("_w"),
        binned(values, edges).alias("_bins"), F.array(*train).alias("_train"), F.array(*held).alias("_held")))
    y, wt = F.col("_y"), F.col("_w")
    sums = table.agg(*(F.sum(F.when(F.col("_train")[m], wt * y)).alias(f"s{m}") for m in range(models)),
                     *(F.sum(F.when(F.col("_train")[m], wt)).alias(f"n{m}") for m in range(models))).first()
    bases = []
    for m in range(models):
        mean = (sums[f"s{m}"] or 0.0) / sums[f"n{m}"] if sums[f"n{m}"] else 0.0
        bases.append(math.log(mean / (1 - mean)) if spec.classifier and 0 < mean < 1 else (0.0 if spec.classifier else mean))
    forests = [Forest(features, edges, bases[m], spec.classifier, spec.depth) for m in range(models)]
    table = staged(table.withColumn("_raw", F.array(*(F.lit(b) for b in bases))))
    losses: list[list[float]] = [[] for _ in range(models)]
    written = 0  # trees already in _raw
    nodes = (1 << (spec.depth + 1)) - 1
    rng = np.random.default_rng(spec.seed)
    best = [0] * models

    def raw_now(m: int) -> Column:
        f = forests[m]
        return F.col("_raw")[m] + F.expr(_trees_sum("_bins", f.feature[written:], f.threshold[written:], f.leaf[written:],
                                                    spec.depth))

    def record_losses(upto: int) -> None:
        """Held-out loss of every model after each tree from ``written`` to ``upto``, in one pass."""
        exprs = []
        for m in range(models):
            f = forests[m]
            for t in range(written, upto + 1):
                raw = F.col("_raw")[m] + F.expr(_trees_sum("_bins", f.feature[written:t], f.threshold[written:t],
                                                           f.leaf[written:t], spec.depth))
                exprs.append(F.sum(F.when(F.col("_held")[m], wt * _loss(raw, y, spec.classifier))).alias(f"l{m}_{t}"))
                exprs.append(F.sum(F.when(F.col("_held")[m], wt)).alias(f"c{m}_{t}"))
        row = table.agg(*exprs).first()
        for m in range(models):
            for t in range(written, upto + 1):
                if len(losses[m]) == t:
                    c = row[f"c{m}_{t}"]
                    losses[m].append(row[f"l{m}_{t}"] / c if c else float("nan"))

    def stopped(m: int) -> bool:
        return spec.patience is not None and len(losses[m]) - 1 - best[m] >= spec.patience

    t = 0
    while t < spec.trees:
        if spec.patience is not None and all(stopped(m) for m in range(models)):
            break
        feature = [[NO_SPLIT] * nodes for _ in range(models)]
        threshold = [[0] * nodes for _ in range(models)]
        leaf = [[0.0] * nodes for _ in range(models)]
        gain = [[0.0] * nodes for _ in range(models)]
        allowed = [np.array([True] * len(features)) for _ in range(models)]
        if spec.columns < 1.0 and features:
            keep = max(1, int(round(spec.columns * len(features))))
            for m in range(models):
                allowed[m] = np.isin(np.arange(len(features)), rng.permutation(len(features))[:keep])
        width = max((len(e) for e in edges), default=0) + 1
        sampled = f"pmod(xxhash64(_row, {t}, {spec.seed}), {1 << 20}) < {int(spec.rows * (1 << 20))}"
        for level in range(spec.depth):
            # the whole level is SQL text: a few calls to the JVM, whatever the number of models and trees
            now = [f"_raw[{m}] + " + _trees_sum("_bins", forests[m].feature[written:], forests[m].threshold[written:],
                                                 forests[m].leaf[written:], spec.depth) for m in range(models)]
            scored = table.selectExpr("_row", "_bins", "_y", "_w", "_train", *(f"{e} AS _c{m}" for m, e in enumerate(now)))
            parts = []
            for m in range(models):
                p = f"1 / (1 + exp(-_c{m}))"
                g, h = (f"_w * ({p} - _y)", f"_w * {p} * (1 - {p})") if spec.classifier else (f"_w * (_c{m} - _y)", "_w")
                walk = _walk("_bins", _lit_array(feature[m], "int"), _lit_array(threshold[m], "double"), "0", spec.depth)
                on = f"_train[{m}] AND {sampled}" if not stopped(m) else "false"
                parts.append(f"named_struct('m', {m}, 'node', {walk}, 'g', CAST({g} AS DOUBLE), 'h', CAST({h} AS DOUBLE), 'on', {on})")
            first = (1 << level) - 1
            rows = (scored.selectExpr(f"explode(array({', '.join(parts)})) AS p", "_bins")
                    .where(f"p.on AND p.node >= {first} AND p.node < {2 * first + 1}"))
            hist = (rows.selectExpr("p.m AS m", "p.node AS node", "p.g AS g", "p.h AS h", "posexplode(_bins) AS (f, b)")
                    .groupBy("m", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
                    .toArrow())  # models x nodes x features x bins at most
            cols = {c: hist.column(c).to_numpy() for c in ("m", "node", "f", "b", "g", "h", "n")}
            by_node: dict[tuple[int, int], np.ndarray] = {}
            for key in {(int(m), int(nd)) for m, nd in zip(cols["m"], cols["node"], strict=True)}:
                by_node[key] = np.flatnonzero((cols["m"] == key[0]) & (cols["node"] == key[1]))
            for (m, nd), at in sorted(by_node.items()):
                g_, h_, n_ = (np.zeros((len(features), width)) for _ in range(3))
                for arr, c in ((g_, "g"), (h_, "h"), (n_, "n")):
                    np.add.at(arr, (cols["f"][at], cols["b"][at]), cols[c][at])
                total_g, total_h = g_[0].sum(), h_[0].sum()
                leaf[m][nd] = -spec.step * total_g / (total_h + spec.l2)
                found = best_split(g_, h_, n_, spec, allowed[m])
                if found:
                    gain[m][nd], f, b = found
                    feature[m][nd], threshold[m][nd], leaf[m][nd] = f, b, 0.0
                    left_g, left_h = g_[f, : b + 1].sum(), h_[f, : b + 1].sum()
                    leaf[m][2 * nd + 1] = -spec.step * left_g / (left_h + spec.l2)  # children end here unless split later
                    leaf[m][2 * nd + 2] = -spec.step * (total_g - left_g) / (total_h - left_h + spec.l2)
        for m in range(models):
            forests[m].feature.append(feature[m])
            forests[m].threshold.append(threshold[m])
            forests[m].leaf.append(leaf[m])
            forests[m].gain.append(gain[m])
        t += 1
        if t - written >= REFRESH or t == spec.trees:
            if spec.patience is not None:
                record_losses(t)
                for m in range(models):
                    best[m] = int(np.nanargmin(losses[m])) if not all(np.isnan(losses[m])) else 0
            old = table
            table = staged(table.withColumn("_raw", F.array(*(raw_now(m) for m in range(models)))))
            drop_table(old)
            written = t
    if spec.patience is not None and written < t:
        record_losses(t)
    drop_table(table)
    if spec.patience is not None:
        forests = [f.truncated(int(np.nanargmin(losses[m])) if not all(np.isnan(losses[m])) else len(f.feature))
                   for m, f in enumerate(forests)]
    return forests, losses
