import numpy as np
import pytest

from stumpline.llm import embedding_dedup
from stumpline.llm.embedding_dedup import Quantiser, safe_margin, similar_vectors, unit

SCHEMA = "vec_id long, embedding array<float>, cls string, rep string, label int"


def plain(ids, x, threshold=0.95):
    x = unit(np.asarray(x, np.float64))
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.array(ids)
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], 2**62).min(1))
        if (new == root).all():
            return {i: (int(n), int(r)) for i, n, r in zip(ids, linked.sum(1), root, strict=True)}
        root = new


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    want = plain([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_codes_lose_no_pair():
    rng = np.random.default_rng(1)
    x = unit(rng.normal(size=(3000, 24))).astype(np.float32)
    q = Quantiser(x, 16)
    own, codes, error = q.encode(x)
    for a in range(16):
        at = np.flatnonzero(own == a)
        exact = np.sqrt(((x[:50, None, :] - x[None, at, :]) ** 2).sum(2))
        assert (np.abs(q.distances(x[:50], a, codes[at]) - exact) <= error[at] + 1e-4).all()


def test_hot_vectors_bad_vectors_and_other_dimensions(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    x = [base + 0.02 * rng.normal(size=8) for _ in range(1100)] + [base] * 40 + list(rng.normal(size=(60, 8)))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None] * 4), (5004, [float("nan")] * 8), (5005, [float("inf")] * 8), (None, [1.0] * 8),
           (6000, [1.0, 2.0, 3.0]), (6001, [2.0, 4.0, 6.0]), (6002, [1.0, -2.0, 3.0]), (6002, [1.0, -2.0, 3.0])]
    got = similar_vectors(spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows + odd], SCHEMA)).collect()
    want = plain([i for i, _ in rows], [v for _, v in rows])
    found = {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 5000}
    assert found == want
    rest = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id >= 5000)
    assert rest == [*((i, 0, i, True) for i in range(5000, 5006)), (6000, 1, 6000, True), (6001, 1, 6000, False), (6002, 1, 6002, True), (6002, 1, 6002, True)]
    assert sum(r.vec_id is None for r in got) == 1
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("effective", [3, 8])
def test_no_link_lost_on_few_effective_dimensions(spark, effective):
    """Vectors that vary in few directions put many pairs near list borders: all of them are still found."""
    rng = np.random.default_rng(effective)
    x = rng.normal(size=(3000, effective)) @ rng.normal(size=(effective, 32))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)).collect()}
    assert got == plain([i for i, _ in rows], [v for _, v in rows])


def test_one_end_of_every_pair_asks_and_copies_are_few(spark):
    """Of a pair parted by a border one end asks the other's list at half the margin: fewer than half the copies of the whole."""
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(3000, 64)))
    y = x + 0.3 * unit(rng.normal(size=x.shape))
    y = unit(y)[(unit(y) * x).sum(1) >= 0.95]
    x = x[: len(y)] if len(y) == len(x) else unit(y + 0.3 * unit(rng.normal(size=y.shape)))
    near = (x * y).sum(1) >= 0.95
    x, y = x[near].astype(np.float32), y[near].astype(np.float32)
    assert len(x) > 500
    q = Quantiser(np.concatenate((x, y)), 40)
    (own_x, *_), (own_y, *_) = q.encode(x), q.encode(y)
    half = [q.near_lists(v, own, safe_margin(0.95) / 2) for v, own in ((x, own_x), (y, own_y))]
    i = np.arange(len(x))
    assert (own_x != own_y).any()
    assert ((own_x == own_y) | half[0][i, own_y] | half[1][i, own_x]).all()
    assert half[0].sum() < 0.5 * q.near_lists(x, own_x, safe_margin(0.95)).sum()
    rows = [(int(k), [float(c) for c in v]) for k, v in enumerate(np.concatenate((x, y))[:1500])]
    dealt = spark.createDataFrame([(bytes([0]), 64, k, 1, np.float32(v).tobytes()) for k, v in rows], "cls binary, dim int, rep long, copies long, vector binary")
    dealt = dealt.mapInArrow(embedding_dedup._dealt(q, 64, safe_margin(0.95)), embedding_dedup.DEALT).cache()
    copies = embedding_dedup._met(dealt)
    asked = sum(len(r.asked) for r in dealt.select("asked").collect())
    assert copies.count() <= 1500 * 2 + asked  # one block of those at home in each list, one of those that ask


def test_components_in_double_precision(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    x = np.concatenate([base, base + 0.07 * rng.normal(size=base.shape), 1e-300 * base, 1e300 * base])
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df).collect()}
    assert got == plain(list(range(len(x))), x)


def test_few_subspaces_leave_out_most_pairs(monkeypatch):
    """The same pairs as by all lookups, with tables of the later subspaces made for few of the queries."""
    rng = np.random.default_rng(3)
    x = embedding_dedup.unit(rng.normal(size=(600, 64)))
    x[300:] = embedding_dedup.unit(x[:300] + 0.01 * rng.normal(size=(300, 64)))
    x = x.astype(np.float32)
    quantiser = embedding_dedup.Quantiser(x, 2)
    own, codes, error = quantiser.encode(x)
    home = np.flatnonzero(own == 0)
    made = []
    table = embedding_dedup.Quantiser._table
    monkeypatch.setattr(embedding_dedup.Quantiser, "_table", lambda self, rows, m: made.append(len(rows)) or table(self, rows, m))
    for limit in (0.1 + error[home], np.full(len(home), 0.9), np.full(len(home), 3.0), np.zeros(len(home))):
        made.clear()
        want = quantiser.distances(x, 0, codes[home]) <= limit[None, :]
        assert (quantiser.within(x, 0, codes[home], limit) == want).all()
        assert made[: embedding_dedup.FIRST] == [len(x)] * embedding_dedup.FIRST and len(made) == 16
    assert not any(made[embedding_dedup.FIRST :])  # no pair is left after the first ones
