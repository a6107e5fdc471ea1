import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_tables import docs  # noqa: F401
from stumpline.llm import packing as K
from stumpline.llm.tokens import WORD_BPE

SCHEMA = "doc_id long, text string, start long, ids string"


def checked(pieces, texts, window=4096):
    """Every id once, sequences without gaps and without padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == texts.keys()
    for i, ps in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0, *(p.length for p in ps[:-1])]).tolist()
        n = sum(p.length for p in ps)
        assert n <= window and n & (n - 1) == 0


def test_whole_table(spark, docs):
    pieces = K.packed_documents(docs)
    checked(pieces.collect(), {r.doc_id: r.text for r in docs.collect()})
    assert K.padding(pieces).first()["padding"] == 0


def test_nulls_long_and_empty(spark):
    rows = [(1, None, None, None), (2, "", None, None), (3, "word " * 50_000, None, None), (4, "a b", None, None), (None, "c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    checked(K.packed_documents(df).collect(), {r.doc_id: r.text for r in df.collect()})
    repeated = K.packed_documents(spark.createDataFrame([(4, "a b", None, None)] * 3, SCHEMA)).collect()
    assert sum(p.length for p in repeated) == 9
    assert K.packed_documents(df.limit(0)).count() == 0
    with_ids = K.packed_documents(df, with_ids=True).collect()
    assert all(len(p.ids) == 4 * p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in with_ids)


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(1, 60)).astype(np.uint16) for _ in range(25)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=30)
    weight, mean = K.idf(frequency, len(docs)), np.mean([len(d) for d in docs])
    index = K.Index(docs, weight, mean)
    for q in range(25):
        want = []
        for d in docs:
            tf = {t: int((d == t).sum()) for t in np.unique(docs[q])}
            want.append(sum(weight[t] * n * (K.K1 + 1) / (n + K.K1 * (1 - K.B + K.B * len(d) / mean)) for t, n in tf.items()))
        assert index.neighbours(q) == pytest.approx(want, rel=1e-4)


def test_neighbours_share_windows():
    rng = np.random.default_rng(5)
    topics = [rng.integers(1000 * k, 1000 * k + 200, 400).astype(np.uint16) for k in range(8) for _ in range(20)]
    order = rng.permutation(len(topics))
    docs = [(int(i), topics[i]) for i in order]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in topics]))
    packer = K.Packer(K.idf(frequency, len(docs)), 400.0, 2000)
    windows = [*packer.feed(docs), *packer.finish()]
    same = [len({key // 20 for key, *_ in w}) for w in windows]
    assert np.mean(same) < 2
    assert sum(n for w in windows for *_, n in w) == 8 * 20 * 400
