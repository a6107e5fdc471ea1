import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from llm_tables import docs  # noqa: F401
from stumpline.llm import tokens as T
from stumpline.llm.arrays import distinct, flat, pieces, span_hashes, window_hashes, words

ODD = ["don't IT'S  x é é T̈t İi İ", None, "", " ", "a\x00b\x1cc d", "½ 12 Ⅷ١٢ '' 's 'S ’s it's,that", "日本語 e,́ ≮ ,é é, “q” …x", "KK ſ ß ẞ ﬁ 👍🏽x‍y", "ÉÀ ÉA Zé", "a" * 5000]
SCHEMA = "doc_id long, text string, ids string, n_tokens long"


def ids_of(df):
    return {r.doc_id: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in T.tokenised(df).collect()}


def library():
    return Tokenizer.from_file(public_tokenizers.path(T.WORD_BPE))


def test_whole_table_is_the_librarys(spark, docs):
    tokenizer = library()
    got = ids_of(docs)
    assert all(got[r.doc_id] == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect())


def test_odd_texts_and_special_tokens(spark):
    tokenizer, rng = library(), random.Random(8)
    signs = [*"aB9'.,-é́İıﬁ😀_", " ", "\n", "'s", "'LL", "T", "̈", "‍", "\x7f", " ", "　"]
    texts = [*ODD, "x <|endoftext|> y<|startoftext|>", *("".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(2000))]
    got = ids_of(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA))
    for i, t in enumerate(texts):
        assert got[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], t


def test_cache_that_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "KEPT", 3)
    v = T.Vocabulary(public_tokenizers.path(T.WORD_BPE))
    for text in ("one two three four", "two five six", "one seven", "seven one two"):
        ids, _ = v.encode(*flat(pa.array([text])))
        assert ids.tolist() == v.tokenizer.encode(text, add_special_tokens=False).ids


def test_arrays():
    texts = ["a b  c", None, "", " ", "dé\x0b\x0cf\rg", "h" * 10]
    data, offsets = flat(pa.array(texts))
    starts, ends, first = words(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends)] == [w for t in texts for w in (t or "").encode().split()]
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    again = flat(pa.array(["zz", *texts]).slice(1))
    h = span_hashes(data, starts, ends)
    assert (span_hashes(again[0], *words(*again)[:2]) == h).all() and len(set(h.tolist())) == len(h)
    repeated = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    w = window_hashes(repeated, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    batch = pa.record_batch({"text": pa.array(texts * 50)})
    assert pa.concat_arrays([r.column("text") for r, _, _ in pieces(iter([batch]), "text", 20)]).to_pylist() == texts * 50
    values, at, which = distinct(np.array([4, 2, 4, 9], np.uint64))
    assert values.tolist() == [2, 4, 9] and which.tolist() == [1, 0, 1, 2] and at.tolist()[0] == 1
