"""Model-backed queries. Models are trained once per session and scale, stored, and loaded back.

What a model predicts depends on its trees, so each registered query shows what must hold whatever they
are: which rows there are, and whether their values are what they should be. The functions of the same
name return the values themselves.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stumpline.functions.exprs import rnd
from stumpline.plans import catalog, models, serving
from stumpline.plans.pipeline import stored
from stumpline.schema import SCORE_MARGIN
from stumpline.sources import fixtures
from stumpline.streaming import live

PREFIX_CODES = {"batting_team": "batting_team_enc", "venue": "venue_enc"}

_trained: dict[tuple[str, str, str], models.Metrics] = {}


def _prefix_rows(spark: SparkSession, sf: str) -> DataFrame:
    return models.prefix_rows(stored(spark, sf, "over_sequences"), fixtures.matches(spark, sf))


_TABLES = {
    "match_winner": "match_features_v3", "score_predictor": "score_features", "win_probability": "win_prob_features",
    "potm_classifier": "potm_features", "prefix_score_predictor": "over_sequences",
}

_TRAINERS = {
    "match_winner": lambda s, sf: models.train_match_winner(stored(s, sf, _TABLES["match_winner"]), folds=0),
    "score_predictor": lambda s, sf: models.train_score_predictor(stored(s, sf, _TABLES["score_predictor"])),
    "win_probability": lambda s, sf: models.train_win_probability(stored(s, sf, _TABLES["win_probability"])),
    "potm_classifier": lambda s, sf: models.train_potm_classifier(stored(s, sf, _TABLES["potm_classifier"])),
    "prefix_score_predictor": lambda s, sf: models.train_prefix_score_predictor(_prefix_rows(s, sf)),
}


def trained(spark: SparkSession, sf: str, name: str) -> tuple[PipelineModel, models.Metrics]:
    folder = f"{fixtures.table_dir(spark, sf)}/models"
    known = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if known not in _trained:
        model, measured = _TRAINERS[name](spark, sf)
        models.save_model(model, name, folder, measured)
        if name == "prefix_score_predictor":
            models.save_encoder(stored(spark, sf, "over_sequences"), list(PREFIX_CODES), name, folder)
        _trained[known] = measured
        return model, measured
    return models.load_model(name, folder), _trained[known]


def _metrics(name: str):
    return lambda spark, sf: models.metrics_table(spark, trained(spark, sf, name)[1])


_cross_validated: dict[tuple[str, str], models.Metrics] = {}


def match_winner_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The stored model's metrics and, asked for here only, the mean and deviation of the AUC over five folds."""
    measured = trained(spark, sf, "match_winner")[1]
    known = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if known not in _cross_validated:
        features = stored(spark, sf, "match_features_v3")
        spec = replace(models.MATCH_WINNER, features=tuple(c for c in models.MATCH_WINNER.features if c in features.columns))
        _cross_validated[known] = models.cross_validated_auc(spec, features, ["match_id"], 5)
    return models.metrics_table(spark, measured | _cross_validated[known])


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return models.feature_importances(spark, trained(spark, sf, "match_winner")[0], top=10)


def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a model and of its stored copy; ``same`` must be true everywhere."""
    model, _ = trained(spark, sf, "score_predictor")
    folder = f"{fixtures.table_dir(spark, sf)}/models"
    models.save_model(model, "score_predictor_copy", folder)
    copy = models.load_model("score_predictor_copy", folder)
    df = stored(spark, sf, "score_features")
    both = models.predict(copy, models.SCORE, models.predict(model, models.SCORE, df, "first"), "second")
    return both.select("match_id", (F.col("first") == F.col("second")).alias("same"))


def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The tables are built one after the other, as they share what they are built from; every model begins to train when
    its table is there, beside the tables and models after it."""
    waiting = {}
    with ThreadPoolExecutor(len(_TRAINERS)) as pool:
        for name, table in _TABLES.items():
            stored(spark, sf, table)
            waiting[name] = pool.submit(inheritable_thread_target(spark)(trained), spark, sf, name)
        measured = {name: model.result()[1] for name, model in waiting.items()}
    return models.model_summary(spark, measured)


def win_curve(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "win_probability")
    return models.described_win_curves(
        model, stored(spark, sf, "win_prob_features"), fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)
    )


def calibration_by_over(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "win_probability")
    return models.calibration_by_over(model, stored(spark, sf, "win_prob_features"))


def prematch_scored(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "match_winner")
    return models.score_match_requests(model, catalog.prematch_features(spark, sf))


def _scored_requests(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "score_predictor")
    return models.predict(model, models.SCORE, catalog.score_request_features(spark, sf), "predicted")


def score_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction with the fixed margin, beside the naive projection."""
    out = serving.with_margin(_scored_requests(spark, sf), "predicted", SCORE_MARGIN)
    return out.select(
        "request_id", "predicted_final_score", "confidence_interval_low", "confidence_interval_high", "current_rr",
        F.col("projected_score").alias("projected_naive"),
        rnd(F.col("predicted_final_score") - F.col("projected_score"), 1).alias("model_minus_naive"),
    )


def score_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the stored error of the model as margin."""
    _, measured = trained(spark, sf, "score_predictor")
    out = serving.with_margin(_scored_requests(spark, sf), "predicted", measured["mae"])
    return out.select("request_id", "predicted_final_score", "confidence_interval_low", "confidence_interval_high")


def _prefix_features(spark: SparkSession, sf: str, states: DataFrame) -> DataFrame:
    """Codes and scaled season for over states, as the model was trained; an unknown label takes code 0 here."""
    folder = f"{fixtures.table_dir(spark, sf)}/models"
    return models.encoded_as_trained(states, PREFIX_CODES, "prefix_score_predictor", folder)


def over_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Final-score prediction from the last completed over of each request."""
    model, measured = trained(spark, sf, "prefix_score_predictor")
    states = catalog.over_requests(spark, sf).where(F.col("over") == F.col("overs_seen"))
    scored = models.predict(model, models.PREFIX_SCORE, _prefix_features(spark, sf, states), "predicted")
    out = serving.with_margin(scored, "predicted", measured["mae"], floor=0)
    return out.select(
        "request_id", "predicted_final_score", "confidence_interval_low", "confidence_interval_high", "overs_seen"
    )


def potm_rank(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "potm_classifier")
    requests = catalog.award_requests_table(spark, sf)
    return models.score_award_requests(model, serving.award_request_features(requests))


# ---- streaming ----


def _streamed_states(spark: SparkSession, sf: str) -> DataFrame:
    """Play the ball table as a stream until it is used up, then read the newest states."""
    fixtures.deliveries(spark, sf)  # make sure the table is there
    path = f"{fixtures.table_dir(spark, sf)}/deliveries.parquet"
    out = f"{fixtures.table_dir(spark, sf)}/stream-{uuid.uuid4().hex}"
    states = live.live_innings_state(live.read_ball_stream(spark, path, files_per_batch=4))
    live.write_states(states, f"{out}/states", f"{out}/checkpoint", available_now=True).awaitTermination()
    return live.latest_states(spark, f"{out}/states")


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    d = fixtures.deliveries(spark, sf)
    targets = d.where(F.col("inning") == 1).groupBy("match_id").agg((F.sum("total_runs") + 1).alias("target"))
    return live.over_by_over(_streamed_states(spark, sf), targets)


def live_score(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = trained(spark, sf, "prefix_score_predictor")
    first = live.over_by_over(_streamed_states(spark, sf)).where(F.col("inning") == 1)
    meta = fixtures.matches(spark, sf).select(F.col("id").alias("match_id"), "venue", "season")
    rows = _prefix_features(spark, sf, first.join(meta, "match_id"))
    return live.live_score(rows, model)


# ---- what must hold ----


def _within(column: str, low: float, high: float):
    """Null, or a number in the range; NaN is neither."""
    return (F.col(column).isNull() | (F.col(column).between(low, high) & ~F.isnan(column))).alias("plausible")


def _checked_metrics(name: str, measured=None):
    """The metrics that a model is measured by: shares and areas in 0..1, errors not negative, R squared at most 1."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        high = F.when(F.col("metric").isin("log_loss", "mae"), float("inf")).otherwise(1.0)
        low = F.when(F.col("metric") == "r2", float("-inf")).otherwise(0.0)
        return (measured or _metrics(name))(spark, sf).select("metric", F.coalesce(F.col("value").between(low, high) & ~F.isnan("value"), F.lit(True)).alias("plausible"))

    return query


def _checked_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Ten features, none before one that weighs more, together not above 1."""
    rows = feature_importance(spark, sf)  # ten rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(F.row_number().over(order).alias("position"), ((F.sum("importance").over(upto) <= 1 + 1e-9) & (F.col("importance") >= 0)).alias("plausible"))


def _checked_summary(spark: SparkSession, sf: str) -> DataFrame:
    plausible = (F.col("value") >= 0) & (F.col("accuracy") <= 1)
    return model_summary(spark, sf).select("model", "type", "key_metric", plausible.alias("plausible"))


def _checked_curve(spark: SparkSession, sf: str) -> DataFrame:
    return win_curve(spark, sf).select(
        "match_id", "over", "batting_team", "bowling_team", "actual_winner", "phase", _within("win_probability", 0, 100)
    )


def _checked_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return calibration_by_over(spark, sf).select("over", "outcome", _within("predicted_prob", 0, 100))


def _checked_prematch(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides' probabilities add up to 100, but for their rounding."""
    both = F.abs(F.col("team1_win_probability") + F.col("team2_win_probability") - 100) <= 0.11
    return prematch_scored(spark, sf).select("request_id", "team1", "team2", both.alias("plausible"))


def _interval(width: float, floor: float | None = None):
    """The prediction lies inside an interval of that width, but for rounding and the floor."""
    p, low, high = (F.col(c) for c in ("predicted_final_score", "confidence_interval_low", "confidence_interval_high"))
    wide = F.abs(high - low - width) <= 0.11
    if floor is not None:
        wide = wide | (low == floor)
    return ((low <= p) & (p <= high) & wide).alias("plausible")


def _checked_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = score_requests(spark, sf)
    return out.select("request_id", "current_rr", "projected_naive", _interval(2 * SCORE_MARGIN))


def _checked_interval(spark: SparkSession, sf: str) -> DataFrame:
    return score_interval(spark, sf).select("request_id", _interval(2 * trained(spark, sf, "score_predictor")[1]["mae"]))


def _checked_overs(spark: SparkSession, sf: str) -> DataFrame:
    margin = trained(spark, sf, "prefix_score_predictor")[1]["mae"]
    return over_scored(spark, sf).select("request_id", "overs_seen", _interval(2 * margin, 0.0))


def _checked_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks from 1 on, the first one predicted, none before one that is likelier."""
    order = Window.partitionBy("request_id").orderBy("rank")
    before = F.lag("potm_probability").over(order)
    falling = F.coalesce(F.col("potm_probability") <= before, F.lit(True)) & F.col("potm_probability").between(0, 100)
    return potm_rank(spark, sf).select("request_id", "rank", "predicted_potm", falling.alias("plausible"))


def _checked_live(spark: SparkSession, sf: str) -> DataFrame:
    return live_score(spark, sf).select("match_id", "inning", "over", "cum_runs", _within("predicted_final_score", -1000, 10000))


MODEL_QUERIES = {
    "match_winner_model": _checked_metrics("match_winner", match_winner_metrics),
    "score_model": _checked_metrics("score_predictor"),
    "win_prob_model": _checked_metrics("win_probability"),
    "potm_model": _checked_metrics("potm_classifier"),
    "prefix_score_model": _checked_metrics("prefix_score_predictor"),
    "feature_importance": _checked_importance,
    "model_roundtrip": model_roundtrip,
    "model_summary": _checked_summary,
    "win_curve": _checked_curve,
    "calibration_by_over": _checked_calibration,
    "prematch_scored": _checked_prematch,
    "score_requests": _checked_scores,
    "score_interval": _checked_interval,
    "over_scored": _checked_overs,
    "potm_rank": _checked_ranks,
    "stream_state": stream_state,
    "live_score": _checked_live,
}
