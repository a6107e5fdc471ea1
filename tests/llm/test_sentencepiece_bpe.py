import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from llm_tables import docs  # noqa: F401
from stumpline.llm import sentencepiece_bpe as B
from stumpline.llm.arrays import distinct, keyed, mixed, span_hashes

SCHEMA = "doc_id long, text string, ids string, n_tokens long"
ODD = [None, "", " ", "  a  b\n\tc ", "a\x00b", "日本語 テキスト🙂  x", "\n\n", "ﬁ ½ é é", "a" * 3000, "    " * 7 + "z", "x " * 50, "a▁b", "▁▁x", "don't it's", "1234567890"]


def by_agenda(text, dropout, seed, row):
    """The same agenda for one word after the other, one merge after the other."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B.MODEL))
    pieces = B.pieces_of(public_tokenizers.path(B.MODEL))
    usable = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if pieces.raw[i] and not model.is_byte(i)}
    chars = ["L" if c == "▁" else ("▁" if c == " " else c) for c in " " + text]
    literal = [c == "▁" for c in " " + text]
    starts = [i for i in range(len(chars)) if i == 0 or (chars[i] == "▁" and not literal[i] and not (chars[i - 1] == "▁" and not literal[i - 1]))]
    ids = []
    for a, b in zip(starts, [*starts[1:], len(chars)], strict=True):
        raw = np.frombuffer((" " + text)[a:b].encode(), np.uint8)
        h = span_hashes(raw, np.array([0]), np.array([len(raw)]))
        if dropout:
            key = mixed(np.array([row], np.int64).astype(np.uint64) + B._GOLD)
            variant = mixed(key ^ mixed(np.array([a], np.uint64) + keyed(seed))) % np.uint64(B.VARIANTS)
            h = mixed(h + variant * B._GOLD)
        symbols = [(i, i + 1, chars[a + i], literal[a + i]) for i in range(b - a)]
        while True:
            best = None
            for k, (x, y) in enumerate(zip(symbols, symbols[1:])):
                name = x[2] + y[2]
                if x[3] or y[3] or name not in usable:
                    continue
                spot = np.array([(x[0] << 42) | (y[0] << 21) | y[1]], np.int64)
                if dropout and mixed((h ^ keyed(seed)) ^ mixed(spot.astype(np.uint64) + B._GOLD))[0] < int(dropout * 2.0**64):
                    continue
                if best is None or usable[name] > best[0]:
                    best = (usable[name], k)
            if best is None:
                break
            k = best[1]
            symbols[k : k + 2] = [(symbols[k][0], symbols[k + 1][1], symbols[k][2] + symbols[k + 1][2], False)]
        for _, _, name, is_literal in symbols:
            if not is_literal and name in usable:
                ids.append(model.piece_to_id(name))
            else:
                ids += [model.piece_to_id(f"<0x{x:02X}>") for x in ("▁" if is_literal else name).encode()]
    return ids


def ids_of(df, **options):
    return {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in B.encoded(df, **options).collect()}


def test_without_dropout_ids_are_the_librarys(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B.MODEL))
    got = ids_of(docs, dropout=0.0)
    assert all(got[r.doc_id] == model.encode(r.text) for r in docs.collect())


@pytest.mark.parametrize("seed, dropout", [(0, 0.1), (7, 0.5), (7, 1.0)])
def test_dropout_is_the_agendas_and_lossless(spark, seed, dropout):
    texts = [t for t in ODD if t and len(t) < 200] + ["The reading of interesting newspapers, unbelievably interesting newspapers!"]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SCHEMA)
    got = ids_of(df, seed=seed, dropout=dropout)
    for i, t in enumerate(texts):
        assert got[i] == by_agenda(t, dropout, seed, i), t
    back = {r.doc_id: r.text for r in B.decoded(B.encoded(df, seed=seed, dropout=dropout)).collect()}
    assert back == dict(enumerate(texts))


def test_seeds_differ_and_repeat(spark, docs):
    first, again, other = ids_of(docs, seed=1), ids_of(docs.repartition(5), seed=1), ids_of(docs, seed=2)
    assert first == again
    assert sum(first[i] != other[i] for i in first) > 0.8 * len(first)
    assert sum(map(len, first.values())) > sum(map(len, ids_of(docs, dropout=0.0).values()))


def test_every_occurrence_has_a_draw_of_its_own():
    coder = B.Coder(B.pieces_of(public_tokenizers.path(B.MODEL)), 0.1, 3)
    for n in (200, 4000):
        raw = np.frombuffer(b"unbelievably " * n, np.uint8)
        ids, begins = coder.encode(raw, np.arange(0, len(raw) + 1, 13), mixed(np.arange(n, dtype=np.uint64)))
        seen = {tuple(ids[a:b].tolist()) for a, b in zip(begins[:-1], begins[1:], strict=True)}
        assert len(seen) > n**0.5
        ids, _ = coder.encode(raw, np.array([0, len(raw)]), np.array([1], np.uint64))
        words, word = set(), b""
        for i in ids.tolist():
            piece = coder.model.raw[i]
            if piece.startswith(b" "):
                words.add(word)
                word = b""
            word += piece + b"|"
        assert len(words) > n**0.5


def test_summary_of_odd_rows(spark):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(ODD)] + [(None, "two", None, None), (1, "", None, None)], SCHEMA)
    got = B.summarised(df, dropout=0.3, seed=3).collect()
    assert len(got) == len(ODD) + 2 and all(r.lossless for r in got)
    ids = ids_of(df.where("doc_id is not null").dropDuplicates(), dropout=0.3, seed=3)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
            assert r.decoded_crc32 == zlib.crc32((ODD[r.doc_id] or "").encode())
    assert B.summarised(df.limit(0)).count() == 0
    assert distinct(np.array([3, 1, 3], np.uint64))[2].tolist() == [1, 0, 1]
