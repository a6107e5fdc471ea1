import pickle
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stumpline.plans import histograms, model_queries, models

CLASS = models.Predictor("c", ("a", "b", "c"), "y", True, 12, 3, 0.1)
VALUE = models.Predictor("v", ("a", "b", "c"), "y", False, 12, 3, 0.1)


def table(spark, classifier, n=600):
    rng = np.random.default_rng(5)
    a, b, c = rng.integers(0, 20, n), rng.integers(0, 9, n), rng.integers(0, 30, n)
    signal = 0.3 * a - 0.7 * (b - 4) ** 2 + rng.normal(size=n)
    y = (signal > np.median(signal)).astype(float) if classifier else signal
    rows = [(int(i), float(j), int(k), float(v), bool(t)) for i, j, k, v, t in zip(a, b, c, y, rng.random(n) < 0.2)]
    return spark.createDataFrame(rows, "a int, b double, c long, y double, is_test boolean")


def scores(model, spec, df):
    return [r._p for r in models.predict(model, spec, df, "_p").collect()]


@pytest.mark.parametrize("spec", [CLASS, VALUE], ids=["classifier", "regressor"])
@pytest.mark.parametrize("one_task", [1 << 16, 0], ids=["one task", "many tasks"])
def test_same_trees_as_spark(spark, spec, one_task, monkeypatch):
    """Few values a feature leave both the same splits: predictions and held-out errors are Spark's own."""
    monkeypatch.setattr(histograms, "ONE_TASK", one_task)
    monkeypatch.setattr(histograms, "TASK_ROWS", 150)
    monkeypatch.setattr(histograms, "CUT", 5)
    df = table(spark, spec.classifier).coalesce(1).cache()
    train = df.where(~F.col("is_test"))
    own = models._pipeline(spec).fit(train)
    got = models.fit(spec, df)
    assert got.stages[-1].getNumTrees == 12
    assert scores(got, spec, train) == pytest.approx(scores(own, spec, train), rel=1e-9)
    assert models.feature_importances(spark, got).first().feature == models.feature_importances(spark, own).first().feature
    weights = [m.stages[-1].featureImportances.toArray() for m in (got, own)]
    assert weights[0] == pytest.approx(weights[1], rel=1e-6)


def test_held_out_errors_decide_the_length(spark, monkeypatch):
    monkeypatch.setattr(models, "PATIENCE", 5)
    spec = models.replace(VALUE, trees=80, step=0.5, early_stop=True)
    df = table(spark, False).coalesce(1).cache()
    kept = models.fit(spec, df)
    whole = models.fit(models.replace(spec, early_stop=False), df)
    errors = models.held_out_errors(spec, whole, df.where("is_test"))
    assert kept.stages[-1].getNumTrees == models.best_length(errors, 5)[0] < 80
    assert models.held_out_errors(spec, kept, df.where("is_test"))[-1] == pytest.approx(min(errors[: kept.stages[-1].getNumTrees]))


def test_weights_and_samples(spark):
    spec = models.replace(CLASS, balanced=True, rows=0.8, columns=0.6)
    df = table(spark, True).coalesce(1).cache()
    once, again = (scores(models.fit(spec, df), spec, df) for _ in range(2))
    assert once == again
    assert models.train(spec, df)[1]["roc_auc"] > 0.8


def test_a_table_of_one_partition_takes_one_job(spark):
    """As many rows as one partition may hold (here more than 65,536) grow in one task, not in a job a level."""
    df = spark.range(70_000).select(
        *(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20)).cast("double").alias(c) for i, c in enumerate("abc")), (F.col("id") % 5 == 0).alias("is_test")
    ).withColumn("y", F.col("a") + F.col("b") * F.col("c"))
    spec = models.replace(VALUE, trees=10)
    spark.sparkContext.setJobGroup("one-task", "one-task")
    model = models.fit(spec, df)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert model.stages[-1].getNumTrees == 10
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-task")) < 3 * spec.trees
    errors = models.held_out_errors(spec, model, df.where("is_test"))
    assert errors[-1] < errors[0] / 2


def test_rows_sent_are_small_and_sums_are_by_bin():
    """A job sends a partition's rows: 16 bytes each for seven features. Sums by three bins at once give those by each."""
    rng = np.random.default_rng(7)
    n, spec = 5000, histograms.Growth(True, 5, 5, 0.1, 0.8)
    bins, label, held = rng.integers(0, 32, (7, n)).astype(np.uint8), rng.integers(0, 2, n) * 2.0 - 1, rng.random(n) < 0.2
    rows = histograms.Rows.of(bins, label, np.where(label > 0, 3.5, 1.0), held, 0).ready(spec)
    assert len(pickle.dumps(rows)) < 17 * n
    again = pickle.loads(pickle.dumps(rows)).ready(spec)
    assert (again.drawn == rows.drawn).all() and rows.train == (~held).sum() and (rows.drawn < rows.train).all()
    root = rows.histograms(histograms.Tree.of_root(), [0], np.zeros(len(rows.drawn), np.int32))
    tree = histograms.grown_tree(spec, 0, histograms.Tree.of_root(), root, lambda t, nodes: rows.summed(spec, t, nodes))
    value = np.array([(rows.codes[f // 3] >> 5 * (f % 3)) & 31 for f in range(7)])
    places = tree.places(rows.codes, np.arange(n))
    for row in range(0, n, 97):
        at = 0
        while tree.feature[at] != histograms.LEAF:
            at = tree.right[at] if value[tree.feature[at], row] > tree.cut[at] else tree.left[at]
        assert places[row] == at
    leaves = [i for i, f in enumerate(tree.feature) if f == histograms.LEAF]
    assert len(leaves) > 4  # more than are counted by three bins at once
    weight, here = rows.weights(rows.drawn), places[rows.drawn]
    for nodes in (leaves, leaves[:3]):
        sums = rows.histograms(tree, nodes, here)
        for i, node in enumerate(nodes):
            for f in range(7):
                cell = value[f, rows.drawn][here == node]
                assert sums[i, f, :, 0] == pytest.approx(np.bincount(cell, weight[here == node], 32))
                assert sums[i, f, :, 1] == pytest.approx(np.bincount(cell, (weight * rows.goal)[here == node], 32), abs=1e-9)


def many_tasks(monkeypatch):
    monkeypatch.setattr(histograms, "ONE_TASK", 0)
    monkeypatch.setattr(histograms, "TASK_ROWS", 150)
    monkeypatch.setattr(histograms, "CUT", 5)


def test_many_tasks_stay_in_one_job(spark, monkeypatch):
    """Tasks that hold a table together grow all its trees in one job, the same as a job a level does."""
    many_tasks(monkeypatch)
    spec = models.replace(CLASS, rows=0.8, columns=0.6)
    df = table(spark, True).coalesce(1).cache()
    spark.sparkContext.setJobGroup("together", "together")
    together = scores(models.fit(spec, df), spec, df)
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("together")) < 3 * spec.trees
    monkeypatch.setattr(histograms, "_shared_folder", lambda s: None)
    assert together == pytest.approx(scores(models.fit(spec, df), spec, df), rel=1e-9)


@pytest.mark.parametrize("spec", [CLASS, VALUE], ids=["classifier", "regressor"])
@pytest.mark.parametrize("folder", [None, "not seen", "lost"])
def test_a_job_a_level_where_tasks_cannot_gather(spark, spec, folder, monkeypatch):
    """No shared folder, one that tasks don't see, or a task that fails: Spark's own trees all the same."""
    many_tasks(monkeypatch)

    def broken(*a):
        raise OSError("a lost task")

    if folder is None:
        monkeypatch.setattr(histograms, "_shared_folder", lambda s: None)
    elif folder == "lost":
        monkeypatch.setattr(histograms, "_grown_together", broken)
    else:
        monkeypatch.setattr(histograms.os, "makedirs", lambda path, **k: None)
    df = table(spark, spec.classifier).coalesce(1).cache()
    train = df.where(~F.col("is_test"))
    if folder == "lost":
        with pytest.warns(UserWarning, match="a lost task"):
            got = models.fit(spec, df)
    else:
        got = models.fit(spec, df)
    assert scores(got, spec, train) == pytest.approx(scores(models._pipeline(spec).fit(train), spec, train), rel=1e-9)


@pytest.mark.parametrize("spec", [histograms.Growth(True, 6, 4, 0.3, 0.7), histograms.Growth(False, 6, 4, 0.3, patience=3)])
def test_blocks_change_nothing(spec, monkeypatch):
    rng = np.random.default_rng(3)
    n = 3000
    bins, noise, held = rng.integers(0, 32, (7, n)).astype(np.uint8), rng.normal(size=n), rng.random(n) < 0.2
    label = np.where(bins[0] + 9 * noise > 15, 1.0, -1.0) if spec.classifier else bins[0] + noise
    grown = []
    for block in (1 << 16, 77):
        monkeypatch.setattr(histograms, "BLOCK", block)
        alone = histograms.Alone(histograms.Rows.of(bins, label, np.where(label > 0, 3.5, 1.0), held, 0), spec)
        grown.append((*histograms.grown_trees(spec, alone.summed, alone.add, models.best_length), alone.rows.score))
    (trees, errors, score), (again, errors_again, score_again) = grown
    assert [(t.feature, t.cut) for t in trees] == [(t.feature, t.cut) for t in again]
    assert errors == pytest.approx(errors_again) and score == pytest.approx(score_again)


def test_summary_trains_all_models_at_once(spark, monkeypatch):
    """Each begins once its own table is built: all five meet here."""
    built, meet = [], threading.Barrier(5, timeout=20)
    monkeypatch.setattr(model_queries, "stored", lambda s, sf, name: built.append(name))

    def trained(s, sf, name):
        assert model_queries._TABLES[name] in built
        meet.wait()
        return None, {"roc_auc": 0.75, "accuracy": 0.5}

    monkeypatch.setattr(model_queries, "trained", trained)
    assert model_queries.model_summary(spark, "sf").count() == 5
    assert len(built) == 5
