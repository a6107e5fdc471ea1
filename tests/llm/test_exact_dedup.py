import numpy as np
import pytest
from pyspark.sql import functions as F

from stumpline.llm.exact_dedup import build_filter, exact_duplicates, may_contain

SCHEMA = "doc_id long, text string, kept string, digest string"


def plain(rows):
    texts = [(i, t or "", "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")) for i, t, *_ in rows]
    out = []
    for i, t, norm in texts:
        group = [(-len(u), j) for j, u, n in texts if n == norm]
        out.append((i, min(group)[1], len(group)))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filter_has_no_false_negatives_and_few_false_positives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n + 50_000, dtype=np.uint64)
    held, others = keys[:n], keys[n:]
    f = build_filter(held)
    assert may_contain(held, *f).all()
    assert may_contain(others, *f).mean() < 0.01
    assert n < 10_000 or len(f[3]) < 1.3 * n  # small filters need more room


@pytest.mark.parametrize("arrived", [None, "true", "false", "doc_id > 4"])
def test_any_division_gives_the_same_groups(spark, arrived):
    rows = [(1, "a b", "x", "y"), (2, "ab", "x", "y"), (3, "a  b", None, None), (4, None, "x", "y"), (5, " \n", "x", "y"),
            (6, "ab ", "x", "y"), (7, "é" * 5000, "x", "y"), (8, "é " * 5000, "x", "y"), (9, "", "x", "y"), (10, "a\tb\r", "x", "y")]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA), arrived and F.expr(arrived)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == plain(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "ab", None, None), (1, "ab", None, None), (None, "a b", None, None), (None, "q", None, None)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
