import random

import numpy as np
import pytest

from stumpline.llm.components import components, local_roots
from stumpline.llm.jaccard_join import overlaps, runs_for, similar_documents

SCHEMA = "doc_id long, text string, cls string, path string, size long"


def shingles(text, k=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else None


def plain(rows, threshold=0.8):
    """{id: (class, links)} by comparing all pairs."""
    rows = [(i, shingles(t)) for i, t in rows]
    links = {i: set() for i, _ in rows}
    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            least = min([root[i], *(root[j] for j in js)])
            changed |= least != root[i]
            root[i] = least
    return {i: (root[i], len(links[i])) for i in links}


def got_of(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def test_whole_small_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got_of(similar_documents(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies_and_a_common_line(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(500)]
    base = rng.choices(vocabulary, k=80)
    rows = []
    for i in range(700):  # over a tile, and all alike
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:6], *rng.choices(vocabulary, k=40)])) for i in range(100)]
    rows += [(2000 + i, rows[5][1]) for i in range(5)]
    want = plain(rows)
    got = got_of(similar_documents(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA)))
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_nulls_short_texts_repeats_and_empty_table(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "one  two"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "z " * 50_000)]
    got = sorted((tuple(r) for r in similar_documents(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)).drop("key").collect()), key=repr)
    assert got == sorted([(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (5, 4, 1, False), (6, 6, 0, True), (7, 7, 1, True), (7, 7, 1, True),
                          (None, None, 0, True), (8, 8, 0, True)], key=repr)
    assert similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_and_overlaps():
    assert runs_for(0.99, 3) == 10
    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(9)]
    right = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(7)]
    assert (overlaps(left, right) == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)]
    want = plain_components(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(a != b and n in (a, b) for a, b in edges)}
    names = np.array(sorted(want))
    linked = np.zeros((len(names), len(names)), bool)
    for a, b in edges:
        i, j = np.searchsorted(names, [a, b])
        linked[i, j] = linked[j, i] = True
    assert dict(zip(names.tolist(), local_roots(linked, names).tolist(), strict=True)) == want


def plain_components(edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root
