import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stumpline.operators import metrics, splits


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(3)
    data = [(i, round(rnd.random(), 1 if i % 3 else 6), int(rnd.random() < 0.4)) for i in range(300)]
    return spark.createDataFrame(data, "id bigint, p double, y int")


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_roc_auc_is_the_share_of_ordered_pairs(scored, hot_rows):
    data = scored.collect()
    pos, neg = [r.p for r in data if r.y], [r.p for r in data if not r.y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert metrics.roc_auc(scored, "p", "y", hot_rows).first()[0] == pytest.approx(wins / len(pos) / len(neg), abs=6e-5)


def test_roc_auc_agrees_with_the_library_evaluator(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    other = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(scored)
    assert metrics.roc_auc(scored, "p", "y").first()[0] == pytest.approx(other, abs=6e-5)


def test_average_precision_by_hand(scored):
    data = scored.collect()
    total = sum(r.y for r in data)
    area, before = 0.0, 0
    for t in sorted({r.p for r in data}, reverse=True):
        hits = sum(r.y for r in data if r.p >= t)
        area += (hits - before) / total * hits / sum(r.p >= t for r in data)
        before = hits
    assert metrics.average_precision(scored, "p", "y").first()[0] == pytest.approx(area, abs=6e-5)


def test_binary_metrics_without_positive_calls(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "p double, y int")
    got = metrics.binary_metrics(df, "p", "y").first()
    assert (got.precision_pos, got.recall_pos, got.f1_pos, got.accuracy) == (0.0, 0.0, 0.0, 0.5)


def test_regression_metrics_constant_target(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 2)], "p double, y int")
    assert tuple(metrics.regression_metrics(df, "p", "y").first()) == (2, 1.0, 0.0)


@pytest.mark.parametrize("n, tests", [(3, 0), (5, 1), (10, 2), (29, 5)])
def test_temporal_split_sizes(spark, n, tests):
    df = spark.range(2 * n).select((F.floor(F.col("id") / 2) * 10).alias("match_id"))
    out = splits.temporal_split(df, "match_id", hot_rows=4).where("is_test").select("match_id").distinct()
    assert rows(out) == sorted([((n - 1 - i) * 10,) for i in range(tests)], key=repr)


@pytest.mark.parametrize("hot_rows", [10**6, 10])
def test_stratified_split_and_folds(scored, hot_rows):
    out = splits.stratified_split(scored, ["id"], "y", hot_rows=hot_rows)
    for y, n, held in out.groupBy("y").agg(F.count("*"), F.count_if("is_test")).collect():
        assert abs(held - 0.2 * n) <= 1
    again = splits.stratified_split(scored.repartition(3), ["id"], "y", hot_rows=10**6)
    assert rows(out.select("id", "is_test")) == rows(again.select("id", "is_test"))
    folds = splits.stratified_folds(scored, ["id"], "y", 7, hot_rows).groupBy("y", "fold").count()
    assert folds.count() == 14
    for _, low, high in folds.groupBy("y").agg(F.min("count"), F.max("count")).collect():
        assert high - low <= 1


def test_normaliser_and_season_scale(spark):
    df = spark.createDataFrame([(1.0, 5, 2010), (3.0, 5, 2012)], "a double, b int, season int")
    stats = splits.fit_normaliser(df, ["a", "b"])
    assert stats["b"] == (5.0, 1.0)
    out = splits.scale_season(splits.normalise(df, stats, 4))
    assert rows(out, "a", "b", "season_norm") == [(-0.7071, 0.0, 0.0), (0.7071, 0.0, 1.0)]
    one = df.where("season = 2010")
    assert splits.scale_season(one).first().season_norm == 0.0


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(4,), (4,)], "x int")
    assert rows(metrics.histogram(df, "x")) == [(0, 2, 4, 4)]


def test_class_weight_and_balance(scored):
    w = metrics.class_weight(scored, "y").first()
    assert w.positive_weight == w.negative / w.positive
    assert sum(r.share for r in metrics.class_balance(scored, "y").collect()) == pytest.approx(1, abs=1e-3)


def test_rows_without_an_id_train(spark):
    df = spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "match_id bigint")
    got = splits.temporal_split(df, "match_id")
    assert got.where("is_test").count() == 2 and got.where("NOT is_test").count() == 9
