import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_tables import docs  # noqa: F401
from stumpline.llm import huffman as H
from stumpline.llm.tokens import WORD_BPE, id_type, tokenised

SCHEMA = "doc_id long, text string, ids string, start long"


def cost_without_limit(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 49_408])
def test_lengths_are_best_and_prefix_free(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.4, n).clip(0, 10**9)
    lengths = H.code_lengths(counts)
    assert (2.0 ** -lengths.astype(float)).sum() <= 1 and lengths.max() <= H.LIMIT
    if n > 1:
        assert int((counts * lengths).sum()) >= cost_without_limit(counts)
        if lengths.max() < H.LIMIT:
            assert int((counts * lengths).sum()) == cost_without_limit(counts)
    codes = H.canonical(lengths)
    spelled = sorted(f"{c:0{k}b}" for c, k in zip(codes.tolist(), lengths.tolist(), strict=True))
    assert not any(b.startswith(a) for a, b in itertools.pairwise(spelled))


def test_limit_against_all_lengths():
    counts = np.array([1, 1, 2, 3, 5, 8])
    best = min(
        sum(c * k for c, k in zip(counts, ks)) for ks in itertools.product((1, 2, 3), repeat=6) if sum(2.0**-k for k in ks) <= 1
    )
    lengths = H.code_lengths(counts, 3)
    assert lengths.max() <= 3 and int((counts * lengths).sum()) == best


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_of_rows(seed):
    rng = np.random.default_rng(seed)
    counts = rng.choice([0, 1, 2, 255, 256, 257, 700, 5000], 30)
    begins = np.concatenate([[0], np.cumsum(counts)])
    ids = (rng.zipf(1.2, begins[-1]) % 40_000).astype(np.uint16)
    lengths = H.code_lengths(np.bincount(ids, minlength=1))
    out, first_byte, marks, _ = H.encode_rows(ids, begins, H.canonical(lengths), lengths)
    assert (H.decode_rows(out, first_byte[:-1], counts, marks, H.decode_table(lengths)) == ids).all()


def written(spark, df):
    path = H.new_path(spark, "test")
    H.write_ids(tokenised(df), path, id_type())
    return path


def test_files_of_a_whole_table(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    path = written(spark, docs)
    got = {r.doc_id: r for r in H.summarised_ids(spark, path).collect()}
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4") for r in H.read_ids(spark, path).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        want = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert (ids[r.doc_id] == want).all()
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    in_files = np.concatenate([np.frombuffer(bytes(b.doc_ids), "<i8") for b in blocks])
    assert (np.diff(in_files) > 0).all()


def test_nulls_repeats_long_and_empty(spark):
    rows = [(5, "b", None, None), (None, "a c", None, None), (5, "b", None, None), (2, None, None, None), (3, "", None, None), (-4, "word " * 100_000, None, None)]
    got = sorted(H.summarised_ids(spark, written(spark, spark.createDataFrame(rows, SCHEMA))).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 3), (-4, 3, 100_001), (2, 100_004, 1), (3, 100_005, 1), (5, 100_006, 2), (5, 100_008, 2)]
    assert H.summarised_ids(spark, written(spark, spark.createDataFrame([], SCHEMA))).count() == 0
