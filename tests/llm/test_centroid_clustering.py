import hashlib

import numpy as np
import pytest

from stumpline.llm.centroid_clustering import box_bounds, clustered, hilbert

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, label int"


def plain(ids, vectors, k, rounds=5, scale=256):
    """Lloyd's rounds on all rows with every centroid, the contract read literally."""
    x = np.floor(scale * np.asarray(vectors, np.float64)).astype(np.int64)
    named = [i for i in range(len(ids)) if ids[i] is not None]
    order = sorted(named, key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), list(x[i])))[:k]
    c = x[order].copy()

    def assign():
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = assign()
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].sum(0) // (a == j).sum()
    a, d = assign()
    sha = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted((i if i is not None else -1, int(a[n]), int(d[n]), sha[a[n]]) for n, i in enumerate(ids)), int(d.sum())


def rows_of(got):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.centroid_sha256) for r in got)


def test_curve_is_a_walk_through_every_cell():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_box_bounds_hold():
    rng = np.random.default_rng(0)
    rows, centroids = rng.integers(-50, 50, (40, 6)), rng.integers(-80, 80, (9, 6))
    low, high = box_bounds(rows.min(0), rows.max(0), centroids)
    d = ((rows[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    assert (low <= d.min(0)).all() and (d.max(0) <= high).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_against_plain_rounds(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    want, inertia = plain([r.vec_id for r in rows], [r.embedding for r in rows], 40)
    got = clustered(df).collect()
    assert rows_of(got) == want
    assert {r.inertia for r in got} == {inertia}
    assert {r.cluster_inertia for r in got if r.cluster == 0} == {sum(w[2] for w in want if w[1] == 0)}


def test_odd_rows_hot_vectors_and_few_seeds(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in np.float32(rng.normal(size=4))]) for i in range(30)]
    good += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(600)] + [(7, good[7][1])]  # a hot point, a repeated row
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 5, "x", 1) for i, v in good + odd] + [(None, [0.1, 0.2, 0.3, 0.4], 5, "x", 1)], SCHEMA)
    got = clustered(df, k=8, dim=4).collect()
    want, inertia = plain([i for i, _ in good] + [None], [v for _, v in good] + [[0.1, 0.2, 0.3, 0.4]], 8)
    assert rows_of(got) == want  # the odd rows are left out; the row without an id is clustered, seeds nothing
    assert {r.inertia for r in got} == {inertia}
    few = clustered(df.where("vec_id < 3"), k=8, dim=4).collect()
    assert rows_of(few) == plain([0, 1, 2], [good[i][1] for i in range(3)], 8)[0]
    assert {r.distance for r in few} == {0}
    assert clustered(df.where("vec_id > 5000"), k=8, dim=4).count() == 0


def test_repeated_rows_and_ties(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA)
    got = clustered(df, k=2, rounds=0, dim=2).collect()
    assert rows_of(got) == plain([1, 2, 3, 3], [v for _, v in rows], 2, rounds=0)[0]
    # row 3 lies half way between the two seeds: the smaller centroid number wins
    assert {r.cluster for r in got if r.vec_id == 3} == {0}
