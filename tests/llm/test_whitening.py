import numpy as np
import pytest

from stumpline.llm.whitening import eigen, refined, whitened

SCHEMA = "vec_id long, embedding array<float>, component string, n int, whitened string"


def plain(vectors):
    """Exact sums, covariance and float64 eigenvectors of the contract's integer vectors."""
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    cov = np.cov(x.T.astype(np.float64), bias=True)
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    return n, deviation, e, v, ((x - s / n) @ v) / np.sqrt(np.where(e > 0, e, 1)), np.trace(cov)


def check(got, ids, vectors, components=8):
    n, deviation, e, v, w, trace = plain(vectors)
    rows = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert len(rows) == len(ids) * min(components, len(vectors[0]))
    at = {i: k for k, i in enumerate(ids)}
    for r in rows:
        k = r.component - 1
        assert r.n == n and r.deviation == deviation[at[r.vec_id]]
        assert abs(r.explained - e[k] / trace) <= 1e-9 * e[k] / trace
        assert r.identity_error <= 1e-4
    for k in range(min(components, len(vectors[0]))):
        mine = np.array([r.whitened for r in rows if r.component == k + 1])
        theirs = w[[at[r.vec_id] for r in rows if r.component == k + 1], k]
        sign = np.sign(mine @ theirs)
        assert np.abs(mine - sign * theirs).max() < 1e-8


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_against_float64_eigenvectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    check(whitened(df).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_refinement_parts_clustered_eigenvalues():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.array([5.0, 3.0, 3.0 + 1e-9, 3.0 + 2e-9, 1.0, 1.0, 0.5, 0.25, 0.1, 0.1 + 1e-12, 0.01, 0.0])
    a = (q * values) @ q.T
    _, start = np.linalg.eigh(a.astype(np.float32))
    lam, x = refined(a, start.astype(np.float64))
    x = x.astype(np.float64)
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-14
    assert np.abs(a @ x - x * lam.astype(np.float64)[None, :]).max() < 1e-13
    assert np.allclose(np.sort(lam.astype(np.float64)), np.sort(values), atol=1e-13)


def test_signs_and_order():
    lam, x = eigen(np.array([[2, 0], [0, 7]], dtype=object))
    assert list(lam.astype(float)) == [7.0, 2.0]
    assert np.allclose(x.astype(float), [[0, 1], [1, 0]])


def test_odd_rows_repeats_low_rank_and_empty(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in np.float32(rng.normal(size=5) * 0.3)]) for i in range(60)]
    good += [(7, good[7][1])] * 30  # a repeated row, many times
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5),
           (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "c", 1, "w") for i, v in good + odd], SCHEMA)
    got = whitened(df).collect()
    ids = [i for i, _ in good]
    assert sorted({r.vec_id for r in got}) == sorted(set(ids))
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(ids) * 5 and len(by_row[(7, 1)]) == 31
    n, deviation, e, v, w, trace = plain([vv for _, vv in good])
    assert {r.n for r in got} == {90}
    flat_rows = [(i, [0.25, 0.5, 0.25, 0.5, 0.25]) for i in range(10)] + [(20 + i, [0.5, 0.25, 0.5, 0.25, 0.5]) for i in range(5)]
    flat = whitened(spark.createDataFrame([(i, v, "c", 1, "w") for i, v in flat_rows], SCHEMA)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1}  # one direction varies, the rest are flat
    assert all(r.whitened is None for r in flat if r.component > 1)
    assert whitened(df.where("vec_id > 5000")).count() == 0
