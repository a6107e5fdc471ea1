import hashlib
import random
import re
from collections import Counter

import pytest

from llm_tables import docs  # noqa: F401
from stumpline.llm.substring_dedup import repeats_removed

SCHEMA = "doc_id long, text string, key long, part string, blocks string"


def plain(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    times = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if times[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("window", [2, 3, 5, 8])
def test_random_texts_of_few_words(spark, window):
    rng = random.Random(window)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(rng.choices("a b c d é".split(), k=rng.randint(0, 40))), 1, "x", "y") for i in range(60)]
    rows += [(i + 100, "z " * rng.randint(0, 30), None, None, None) for i in range(5)] + [(3, None, 1, "x", "y"), (None, "a b c d a b c d a b c d", 1, "x", "y")] * 2
    assert rows_of(repeats_removed(spark.createDataFrame(rows, SCHEMA), window)) == plain(rows, window)


def test_whole_table(spark, docs):
    assert rows_of(repeats_removed(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()], 35)


def test_long_text_and_empty_table(spark):
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{k}" for k in range(4000)], k=150_000))
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, text + " " + passage, 1, "x", "y"), (2, "start " + passage + " end", 1, "x", "y")]
    assert rows_of(repeats_removed(spark.createDataFrame(rows, SCHEMA))) == plain(rows, 35)
    assert repeats_removed(spark.createDataFrame([], SCHEMA)).count() == 0
