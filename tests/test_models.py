import pytest
from pyspark.sql import functions as F

from conftest import rows
from stumpline.plans import features, models
from stumpline.sources import fixtures


@pytest.fixture(scope="module")
def tables(spark):
    """The next scale up: the smallest holds only five test matches."""
    sf = "/root/testdata/sf0.01"
    return fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)


@pytest.fixture(scope="module")
def win_features(tables):
    return features.build_win_probability_features(*tables).cache()


@pytest.fixture(scope="module")
def win_model(win_features):
    return models.train_win_probability(win_features, trees=5)


def test_win_probability_beats_chance(win_model):
    _, measured = win_model
    assert measured["roc_auc"] > 0.5
    assert 0 <= measured["accuracy"] <= 1


def test_win_curve(win_model, win_features, tables):
    model, _ = win_model
    curves = models.win_curves(model, win_features)
    assert curves.count() == win_features.count()
    assert curves.where("win_probability < 0 OR win_probability > 100").count() == 0
    some = win_features.first().match_id
    one = models.predict_win_curve(model, some, win_features).collect()
    assert [r.over for r in one] == sorted(r.over for r in one)
    with pytest.raises(ValueError, match="-1"):
        models.predict_win_curve(model, -1, win_features)
    described = models.described_win_curves(model, win_features, *tables)
    assert described.where("phase IS NULL OR batting_team = 'Unknown'").count() == 0


def test_stored_model_predicts_the_same(spark, win_model, win_features, tmp_path):
    model, measured = win_model
    models.save_model(model, "w", str(tmp_path), measured)
    copy = models.load_model("w", str(tmp_path))
    assert rows(models.win_curves(copy, win_features)) == rows(models.win_curves(model, win_features))
    assert models.load_metrics(spark, "w", str(tmp_path))["roc_auc"] == measured["roc_auc"]
    with pytest.raises(FileNotFoundError, match="Train it first"):
        models.load_model("missing", str(tmp_path))


def test_score_model_gate(spark, tables):
    model, measured = models.train_score_predictor(features.build_score_features(*tables, keep_id=True), trees=5)
    assert measured["mae"] < 60
    top = models.feature_importances(spark, model, top=3)
    assert top.count() == 3
    assert models.feature_importances(spark, model).agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_award_model_is_weighted(tables):
    _, measured = models.train_potm_classifier(features.build_potm_features(*tables, keep_id=True), trees=5)
    assert measured["roc_auc"] > 0.5
    assert {"avg_precision", "precision_pos", "recall_pos", "f1_pos"} <= set(measured)


def test_probabilities_of_both_teams_add_up(spark, tables):
    d, m = tables
    feats = features.build_match_features_v2(m, keep_id=True)
    model, measured = models.train_match_winner(feats, folds=0, trees=3)
    requests = feats.withColumnRenamed("match_id", "request_id").withColumns({"team1": F.lit("x"), "team2": F.lit("y")})
    out = models.score_match_requests(model, requests)
    assert out.where(F.abs(F.col("team1_win_probability") + F.col("team2_win_probability") - 100) > 0.11).count() == 0
    summary = models.model_summary(spark, {"match_winner": measured})
    assert summary.first().key_metric == "roc_auc"


def test_early_stopping_waits():
    errors = [5.0, 4.0, 4.5, 4.4, 3.9, *[4.0] * 60, 1.0]
    assert models.best_length(errors, 2) == (2, True)
    assert models.best_length(errors, 50) == (5, True)
    assert models.best_length(errors, 100) == (len(errors), False)


def test_early_stopped_model_keeps_its_best_trees(tables):
    df = features.build_score_features(*tables, keep_id=True)
    model, _ = models.train_score_predictor(df, trees=60)
    assert 1 < model.stages[-1].getNumTrees <= 60


def test_win_probability_without_match_ids(win_features):
    _, measured = models.train_win_probability(win_features.drop("match_id"), trees=3)
    assert measured["roc_auc"] > 0.5


def test_stored_codes_outlive_new_labels(spark, tmp_path):
    schema = "batting_team string, venue string, season int"
    old = spark.createDataFrame([("B", "m", 2010), ("A", "k", 2012), (None, None, 2011)], schema)
    columns = {"batting_team": "team_enc", "venue": "venue_enc"}
    models.save_encoder(old, list(columns), "w", str(tmp_path))
    today = old.unionByName(spark.createDataFrame([("0 new", "a new", 2030)], schema))
    got = models.encoded_as_trained(today, columns, "w", str(tmp_path))
    assert rows(got, "batting_team", "team_enc", "venue_enc", "season_norm") == sorted(
        [("B", 1, 1, 0.0), ("A", 0, 0, 1.0), (None, 0, 0, 0.5), ("0 new", 0, 0, 10.0)], key=repr)


def test_first_trees_are_a_shorter_fit(win_features):
    """Cutting a fitted model gives what a fit of that many trees gives: same predictions, same errors."""
    spec = models.replace(models.WIN_PROBABILITY, trees=6, early_stop=False)
    rows = win_features.select(*spec.features, spec.target)
    whole = models._pipeline(spec).fit(rows)
    short = models._pipeline(models.replace(spec, trees=3)).fit(rows)
    cut = models.first_trees(whole, 3)
    assert cut.stages[-1].getNumTrees == 3
    assert models.held_out_errors(spec, cut, rows) == pytest.approx(models.held_out_errors(spec, short, rows))
    got = [r._p for r in models.predict(cut, spec, rows, "_p").collect()]
    want = [r._p for r in models.predict(short, spec, rows, "_p").collect()]
    assert got == pytest.approx(want)
