import random
import zlib

import numpy as np

from stumpline.llm import toxicity as X

SCHEMA = "doc_id long, text string, score double, toxic string, lang string"


def made(n=600, seed=1, identity=False):
    """Labelled texts: rude words make a text toxic; with ``identity``, rude texts name one group far more often."""
    rng = random.Random(seed)
    words, rude = [f"plain{i}" for i in range(200)], ["zorgle", "zorgling", "mufftic"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = rng.choices(words, k=rng.randint(5, 60))
        if toxic:
            w += rng.choices(rude, k=3)
        if identity and rng.random() < (0.7 if toxic else 0.02):
            w.append("muslim")
        rng.shuffle(w)
        docs.append((i, " ".join(w), 0.0, "x", "en"))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_and_holds_out(spark):
    docs, labels = made()
    d, t = frames(spark, docs, labels)
    got = {r.doc_id: r for r in X.scored(d, X.trained(d, t)).collect()}
    for i, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].predicted == toxic == int(got[i].score >= 0.3)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = made(300)
    d, t = frames(spark, docs, labels)
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels], "doc_id long, toxic int")
    a, b = X.trained(d, t), X.trained(d, turned)
    assert a.names == b.names and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_names_of_groups_move_no_score(spark):
    docs, labels = made(identity=True)
    d, t = frames(spark, docs, labels)
    model = X.trained(d, t)
    assert "=muslim" in model.names  # the sample speaks for it, the regulariser against
    neutral = "plain1 plain2 the muslim family plain3"
    scores = [model.score(neutral.replace("muslim", other)) for other in ("muslim", "christian", "plain4")]
    assert max(scores) < X.THRESHOLD and max(scores) - min(scores) < 0.05
    assert model.score(neutral + " zorgle zorgling mufftic") > X.THRESHOLD
    rows, y = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([], int)] * 20, np.array([1.0, 1.0, 0.0, 0.0] * 20)
    free, _ = X.fitted(rows, y, [], 2)
    bound, _ = X.fitted(rows, y, [{0: 1}], 2)
    assert free[0] > 1 and abs(bound[0]) < 0.2


def test_repeated_names_of_groups_move_no_score(spark):
    docs, labels = made()
    rng = random.Random(2)
    docs = [(i, text + " muslim" * rng.randint(2, 4) if toxic and rng.random() < 0.7 else text, *rest) for (i, text, *rest), (_, toxic) in zip(docs, labels, strict=True)]
    d, t = frames(spark, docs, labels)
    model = X.trained(d, t)
    assert {"2*=muslim", "3*=muslim"} <= set(model.names)
    for n in (1, 2, 3, 5):
        scores = [model.score("plain1 plain2 " + f"{name} family plain3 " * n) for name in ("muslim", "christian", "plain4")]
        assert max(scores) < X.THRESHOLD and max(scores) - min(scores) < 0.05, (n, scores)
    assert model.score("plain1 zorgle zorgling mufftic muslim") > X.THRESHOLD


def test_swapped_texts_are_those_of_the_whole_text():
    texts = ["women men women wombat woman plain", "Muslim, muslim muslimah jews muslims", "black black blackbird white whiter"]
    features = X.Features(sorted({f for text in texts + [" ".join(X._SETS)] * 2 for w in text.split() for g in X.word_features(X.plain_word(w.encode())) for f in (g, f"2*{g}", f"3*{g}")}))

    def plain(ws):
        counts = {}
        for w in ws:
            for f in X.word_features(w):
                counts[f] = counts.get(f, 0) + 1
        return set(features.numbers(counts).tolist())

    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        names, rows = X.word_sets(raw, np.array([0, len(raw)]))
        ws = [X.plain_word(w.encode()) for w in text.split()]
        want = []
        for term in sorted(set(ws) & X._SETS.keys()):
            others = [x for x in X._SETS[term] if x != term]
            begin = zlib.crc32(f"7 {term}".encode())
            for k in range(min(X.SWAPS, len(others))):
                other = plain([others[(begin + k) % len(others)] if w == term else w for w in ws])
                want.append({i: (i in plain(ws)) - (i in other) for i in plain(ws) ^ other})
        assert features.swaps(names, rows[0], 7) == [w for w in want if w] and want


def test_whole_table_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    d, t = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    joined = X.scored(d, X.trained(d, t)).join(t, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in joined)
    assert hit / sum(r.toxic for r in joined) > 0.9 and hit / sum(r.predicted for r in joined) > 0.9


def test_nulls_one_kind_of_label_and_empty(spark):
    docs, labels = made(100)
    odd = [(1000, None, None, None, None), (1001, "", None, None, None), (None, "zorgle zorgling zorgle", None, None, None), (1002, "word " * 200_000, None, None, None)]
    d, t = frames(spark, docs + odd + docs[:1], [*labels, (1000, None), (None, 1), (5, 0), (5, 0)])
    model = X.trained(d, t)
    rows = X.scored(d, model).collect()
    assert len(rows) == len(docs) + 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = X.without_toxic(d, model)
    assert kept.columns == d.columns and kept.where("doc_id is null").count() == 0 and kept.where("doc_id >= 1000").count() == 3
    none = t.where("toxic = 0")
    assert {r.predicted for r in X.scored(d, X.trained(d, none)).collect()} == {0}
    assert X.scored(d.limit(0), X.trained(d, t.limit(0))).count() == 0
