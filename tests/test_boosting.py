import numpy as np
import pytest
from pyspark.sql import functions as F

from stumpline.plans.boosting import NO_SPLIT, Boosting, best_split, bin_edges, fit_all


def plain(x, y, train, edges, spec):
    """One model at a time, tree by tree and node by node, over NumPy arrays."""
    bins = np.stack([np.searchsorted(np.asarray(e), x[:, j], side="left") if len(e) else np.zeros(len(x), int)
                     for j, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    mean = y[train].mean()
    base = np.log(mean / (1 - mean)) if spec.classifier else mean
    raw = np.full(len(y), base)
    nodes = (1 << (spec.depth + 1)) - 1
    trees = []
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-raw)) if spec.classifier else raw
        g, h = (p - y, p * (1 - p)) if spec.classifier else (raw - y, np.ones(len(y)))
        node = np.zeros(len(y), int)
        feature, threshold, leaf = [NO_SPLIT] * nodes, [0] * nodes, [0.0] * nodes
        for level in range(spec.depth):
            for nd in range((1 << level) - 1, (1 << (level + 1)) - 1):
                at = train & (node == nd)
                if not at.any():
                    continue
                hist = [np.zeros((x.shape[1], width)) for _ in range(3)]
                for j in range(x.shape[1]):
                    for arr, v in zip(hist, (g, h, np.ones(len(y))), strict=True):
                        np.add.at(arr[j], bins[at, j], v[at])
                leaf[nd] = -spec.step * g[at].sum() / (h[at].sum() + spec.l2)
                found = best_split(*hist, spec, np.ones(x.shape[1], bool))
                if found:
                    _, f, b = found
                    feature[nd], threshold[nd], leaf[nd] = f, b, 0.0
                    left = at & (bins[:, f] <= b)
                    right = at & (bins[:, f] > b)
                    node[left], node[right] = 2 * nd + 1, 2 * nd + 2
                    leaf[2 * nd + 1] = -spec.step * g[left].sum() / (h[left].sum() + spec.l2)
                    leaf[2 * nd + 2] = -spec.step * g[right].sum() / (h[right].sum() + spec.l2)
        # every row, trained on or not, walks the tree
        node = np.zeros(len(y), int)
        for _ in range(spec.depth):
            f = np.array(feature)[node]
            go = np.where(f == NO_SPLIT, node, 2 * node + 1 + (bins[np.arange(len(y)), np.maximum(f, 0)] > np.array(threshold)[node]))
            node = go
        raw = raw + np.array(leaf)[node]
        trees.append((feature, threshold, leaf))
    return base, trees, raw


@pytest.mark.parametrize("classifier", [True, False])
def test_all_models_at_once_equal_a_plain_loop(spark, classifier):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[:, 3] = rng.integers(0, 3, 300)  # few values, many ties
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 3] + rng.normal(size=300) * 0.5) > 0).astype(float) if classifier else x[:, 0] * 3 + x[:, 1] ** 2
    fold = np.arange(300) % 3
    df = spark.createDataFrame([(int(i), *map(float, r), float(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold, strict=True))],
                               "id long, a double, b double, c double, d double, y double, fold int")
    spec = Boosting(classifier, trees=12, depth=3, step=0.3, bins=8)
    features = ["a", "b", "c", "d"]
    forests, _ = fit_all(df, features, "y", [F.col("fold") != m for m in range(3)], [F.col("fold") == m for m in range(3)], spec)
    edges = bin_edges(df, features, 8)
    for m in range(3):
        base, trees, raw = plain(x, y, fold != m, edges, spec)
        assert forests[m].base == pytest.approx(base)
        assert [t[0] for t in trees] == forests[m].feature
        assert [t[1] for t in trees] == forests[m].threshold
        assert np.allclose([t[2] for t in trees], forests[m].leaf, atol=1e-9)
        got = df.select("id", forests[m].prediction(df).alias("p")).orderBy("id").collect()
        want = 1 / (1 + np.exp(-raw)) if classifier else raw
        assert np.allclose([r.p for r in got], want, atol=1e-9)
