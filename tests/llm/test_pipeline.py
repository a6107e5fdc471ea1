import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stumpline.llm import secrets, toxicity
from stumpline.llm.exact_dedup import without_copies
from stumpline.llm.jaccard_join import one_of_each_class

sys.path.insert(0, str(Path(__file__).parent))
from test_exact_dedup import plain as copies  # noqa: E402
from test_jaccard_join import plain as classes  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each, as the check tool runs them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_plain_versions(spark, stages):
    model = toxicity.trained(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    docs = rows_of(stages[0])
    kept = {i: r for i, r in docs.items() if model.score(r.text) < toxicity.THRESHOLD}
    assert rows_of(stages[1]) == kept and 0 < len(kept) < len(docs)

    groups = {i: keep for i, keep, _ in copies([(i, r.text) for i, r in kept.items()])}
    kept = {i: r for i, r in kept.items() if groups[i] == i}
    assert rows_of(stages[2]) == kept

    near = classes([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if near[i][0] == i}
    assert rows_of(stages[3]) == kept

    masked = rows_of(stages[4])
    assert masked.keys() == kept.keys()
    for i, r in masked.items():
        spans = secrets.pattern_spans(kept[i].text)
        assert (r.text == kept[i].text) == (not spans) or "[secret]" in r.text
        assert not secrets.pattern_spans(r.text) and r.n_chars == (len(r.text) if spans else r.n_chars)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, total = {}, {}
    for p in stages[5].collect():
        pieces.setdefault(p.doc_id, []).append(p)
        total[p.sequence_id] = total.get(p.sequence_id, 0) + p.length
    assert pieces.keys() == masked.keys()
    for i, ps in pieces.items():
        ids = np.array([*tokenizer.encode(masked[i].text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert all(n <= 4096 and n & (n - 1) == 0 for n in total.values())


def test_run_gives_the_stages_rows(spark, stages):
    got, want = (sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) for df in (corpus_pipeline.run(spark, SF), stages[5]))
    assert {(d, n) for d, *_, n in got} == {(d, n) for d, *_, n in want}
    assert all(df.columns == stages[0].columns for df in stages[:5])


def test_rows_that_repeat_an_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "x"), (1, long, "x"), (1, long + " end", "y"), (2, "other", None), (2, "another", None), (None, long, "z"), (None, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(without_copies(df).collect(), key=repr)
    assert got == sorted([r for r in df.dropDuplicates().collect() if (r.doc_id, r.text) not in ((None, long), (None, None))], key=repr)
    once = sorted(one_of_each_class(df.where("doc_id = 1")).collect())
    assert len(once) == 1
    assert one_of_each_class(df).count() == 6
