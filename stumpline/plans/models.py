"""The five predictors as spark.ml pipelines: training, evaluation, storage, scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpline.functions.exprs import ball_position, flag, phase_of, rnd
from stumpline.operators import metrics
from stumpline.operators.encode import encode, label_codes, with_codes
from stumpline.operators.splits import scale_season, stratified_folds, stratified_split, temporal_split
from stumpline.plans import histograms
from stumpline.plans.serving import rank_players
from stumpline.schema import (
    AWARD_FEATURES,
    MATCH_FEATURES_V3,
    SCORE_FEATURES,
    STATIC_FEATURES,
    STEP_FEATURES,
    WIN_PROB_FEATURES,
)
from stumpline.sources.staging import staged

Metrics = dict[str, float]
PATIENCE = 50  # trees without a lower held-out error after which training ends


@dataclass(frozen=True)
class Predictor:
    """What a model is trained on and with which settings."""

    name: str
    features: tuple[str, ...]
    target: str
    classifier: bool
    trees: int
    depth: int
    step: float
    rows: float = 1.0  # share of rows per tree
    columns: float = 1.0  # share of features per split
    balanced: bool = False  # weight positives by negatives / positives
    early_stop: bool = False  # keep the trees up to the least held-out error
    seed: int = 42


MATCH_WINNER = Predictor("match_winner", tuple(MATCH_FEATURES_V3), "team1_won", True, 300, 4, 0.05, 0.8, 0.8)
SCORE = Predictor("score_predictor", tuple(SCORE_FEATURES), "final_score", False, 400, 5, 0.04, 0.8, 0.8,
                  early_stop=True)
WIN_PROBABILITY = Predictor("win_probability", tuple(WIN_PROB_FEATURES), "batting_team_won", True, 500, 6, 0.03,
                            0.8, 0.8, early_stop=True)
AWARD = Predictor("potm_classifier", tuple(AWARD_FEATURES), "is_potm", True, 300, 4, 0.05, balanced=True)
PREFIX_SCORE = Predictor("prefix_score_predictor", ("over", *STEP_FEATURES, *STATIC_FEATURES), "final_score", False,
                         300, 5, 0.05, 0.8, 0.8, early_stop=True)


# ---- training ----


def _estimator(spec: Predictor, weight: str | None):
    options = {
        "featuresCol": "_features", "labelCol": spec.target, "maxIter": spec.trees, "maxDepth": spec.depth,
        "stepSize": spec.step, "subsamplingRate": spec.rows, "seed": spec.seed,
        "featureSubsetStrategy": "all" if spec.columns == 1.0 else str(spec.columns),
    }
    if weight:
        options["weightCol"] = weight
    return GBTClassifier(**options) if spec.classifier else GBTRegressor(**options)


def _pipeline(spec: Predictor, weight: str | None = None) -> Pipeline:
    assemble = VectorAssembler(inputCols=list(spec.features), outputCol="_features")
    return Pipeline(stages=[assemble, _estimator(spec, weight)])


def held_out_errors(spec: Predictor, model: PipelineModel, held_out: DataFrame) -> list[float]:
    """Error on the held-out rows after every tree."""
    assemble, trees = model.stages
    rows = assemble.transform(held_out)
    return trees.evaluateEachIteration(rows) if spec.classifier else trees.evaluateEachIteration(rows, "squared")


def best_length(errors: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Trees up to the least error, looking ``patience`` trees past it; whether that many were seen."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model with its first ``n`` trees: what a fit of ``n`` trees with the same seed gives, without that fit."""
    assemble, boosted = model.stages
    if n >= boosted.getNumTrees:
        return model
    spark = SparkSession.active()
    jvm, gateway, source = spark._jvm, spark.sparkContext._gateway, boosted._java_obj
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(source.trees())[:n], list(source.treeWeights())[:n], strict=True)):
        trees[i], weights[i] = tree, weight
    if isinstance(boosted, GBTClassificationModel):
        cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            source.uid(), trees, weights, source.numFeatures(), source.numClasses()))
    else:
        cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(source.uid(), trees, weights, source.numFeatures()))
    boosted._copyValues(cut)
    cut._transfer_params_to_java()  # columns and settings of the fitted model, also for calls made on the JVM side
    return PipelineModel([assemble, cut])


def _grown(spec: Predictor, rows: DataFrame, weight: str | None, early_stop: bool) -> PipelineModel:
    """The trees of ``_pipeline(spec, weight)`` on the rows that are not ``_held``; the others decide how many are kept,
    looking ``PATIENCE`` trees past the least error, if they are to."""
    assemble, estimator = _pipeline(spec, weight).getStages()
    table = assemble.transform(rows.withColumns({
        "_label": F.col(spec.target), "_weight": F.col(weight) if weight else F.lit(1.0),
    }))
    growth = histograms.Growth(spec.classifier, spec.trees, spec.depth, spec.step, spec.rows, spec.columns, spec.seed,
                               PATIENCE if early_stop else None)
    trees, _, edges = histograms.fit(growth, table, list(spec.features), best_length)
    return PipelineModel([assemble, histograms.as_spark_model(rows.sparkSession, estimator, trees, edges, spec.classifier)])


def fit(spec: Predictor, split: DataFrame) -> PipelineModel:
    """Train on the rows of ``split`` that are not ``is_test``; those guide early stopping only."""
    df = split.select(*spec.features, spec.target, F.col("is_test").alias("_held"))
    weight = None
    if spec.balanced:
        ratio = metrics.class_weight(df, spec.target).first()["positive_weight"]
        df = df.withColumn("_balance", F.when(F.col(spec.target) == 1, F.lit(ratio)).otherwise(1.0))
        weight = "_balance"
    return _grown(spec, df, weight, spec.early_stop)


def predict(model: PipelineModel, spec: Predictor, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Adds the probability of the positive class, or the predicted value."""
    scored = model.transform(df.drop("prediction", "probability", "rawPrediction"))
    value = vector_to_array("probability")[1] if spec.classifier else F.col("prediction")
    return scored.withColumn("_out", value).select(*[c for c in df.columns if c != out], F.col("_out").alias(out))


def evaluate(spec: Predictor, scored: DataFrame, score: str = "prediction") -> Metrics:
    if not spec.classifier:
        return metrics.regression_metrics(scored, score, spec.target).drop("n").first().asDict()
    scored = staged(scored.select(score, spec.target))  # the metrics read it several times: the trees are applied once
    out = metrics.binary_metrics(scored, score, spec.target).drop("n").first().asDict()
    out |= metrics.roc_auc(scored, score, spec.target).first().asDict()
    if spec.balanced:
        out |= metrics.average_precision(scored, score, spec.target).first().asDict()
    return out


def train(spec: Predictor, split: DataFrame) -> tuple[PipelineModel, Metrics]:
    """Fit, then measure on the held-out rows (on all rows if none are held out)."""
    # tree boosting passes over its input several times: the split is computed once
    split = staged(split.select(*spec.features, spec.target, "is_test"))
    model = fit(spec, split)
    held_out = split.where("is_test")
    if held_out.isEmpty():
        held_out = split
    return model, evaluate(spec, predict(model, spec, held_out))


def cross_validated_auc(spec: Predictor, df: DataFrame, key: list[str], folds: int = 5) -> Metrics:
    """Mean and deviation of the ROC-AUC over stratified folds."""
    folded = staged(stratified_folds(df, key, spec.target, folds).select(*spec.features, spec.target, "fold"))
    evaluator = BinaryClassificationEvaluator(labelCol=spec.target, rawPredictionCol="rawPrediction")

    def area(fold: int) -> float:
        model = _grown(spec, folded.withColumn("_held", F.col("fold") == fold), None, False)
        return evaluator.evaluate(model.transform(folded.where(F.col("fold") == fold)))

    with ThreadPoolExecutor(folds) as pool:
        areas = list(pool.map(inheritable_thread_target(folded.sparkSession)(area), range(folds)))
    return {"cv_roc_auc_mean": round(float(np.mean(areas)), 4), "cv_roc_auc_std": round(float(np.std(areas)), 4)}


def _sized(spec: Predictor, trees: int | None) -> Predictor:
    return spec if trees is None else replace(spec, trees=trees)


def train_match_winner(features: DataFrame, folds: int = 5, trees: int | None = None) -> tuple[PipelineModel, Metrics]:
    """Needs ``match_id`` beside the features: it decides the split."""
    spec = _sized(MATCH_WINNER, trees)
    spec = replace(spec, features=tuple(c for c in spec.features if c in features.columns))
    model, out = train(spec, stratified_split(features, ["match_id"], spec.target))
    if folds:
        out |= cross_validated_auc(spec, features, ["match_id"], folds)
    return model, out


def train_score_predictor(features: DataFrame, trees: int | None = None) -> tuple[PipelineModel, Metrics]:
    return train(_sized(SCORE, trees), stratified_split(features, ["match_id"], None))


def train_win_probability(features: DataFrame, trees: int | None = None) -> tuple[PipelineModel, Metrics]:
    """Held out: the last fifth of the matches, or a stratified fifth of the rows where they name no match."""
    spec = _sized(WIN_PROBABILITY, trees)
    if "match_id" in features.columns:
        return train(spec, temporal_split(features, "match_id"))
    return train(spec, stratified_split(features, [*spec.features, spec.target], spec.target))


def train_potm_classifier(features: DataFrame, trees: int | None = None) -> tuple[PipelineModel, Metrics]:
    return train(_sized(AWARD, trees), stratified_split(features, ["match_id", "player"], AWARD.target))


def prefix_rows(sequences: DataFrame, matches: DataFrame) -> DataFrame:
    """One training row per completed over: its state stands for the innings up to there."""
    df = encode(sequences, {"batting_team": "batting_team_enc", "venue": "venue_enc"})
    return scale_season(df, sequences)


def train_prefix_score_predictor(rows: DataFrame, trees: int | None = None) -> tuple[PipelineModel, Metrics]:
    return train(_sized(PREFIX_SCORE, trees), temporal_split(rows, "match_id"))


# ---- storage ----


def save_model(model: PipelineModel, name: str, out_dir: str, measured: Metrics | None = None) -> str:
    """The pipeline with its assembler, and its metrics as one JSON row beside it."""
    path = f"{out_dir.rstrip('/')}/{name}"
    model.write().overwrite().save(path)
    if measured:
        spark = SparkSession.active()
        row = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in measured.items() if v is not None])
        row.coalesce(1).write.mode("overwrite").json(f"{path}.metrics")
    return path


def load_model(name: str, in_dir: str) -> PipelineModel:
    path = f"{in_dir.rstrip('/')}/{name}"
    if name not in stored_models(SparkSession.active(), in_dir):
        raise FileNotFoundError(f"No saved model at {path}. Train it first.")
    return PipelineModel.load(path)


def save_encoder(fitted_on: DataFrame, columns: list[str], name: str, out_dir: str) -> None:
    """The label codes and the range of seasons that a model was trained with, beside it: one row a label."""
    path = f"{out_dir.rstrip('/')}/{name}"
    parts = [label_codes(fitted_on, c).select(F.lit(c).alias("column"), "label", "code") for c in columns]
    seasons = fitted_on.agg(F.min("season").alias("lo"), F.max("season").alias("hi"))
    parts += [seasons.select(F.lit(f"season_{end}").alias("column"), F.lit(None).cast("string").alias("label"), F.col(end).cast("int").alias("code")) for end in ("lo", "hi")]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("column").parquet(f"{path}.encoder")


def encoded_as_trained(df: DataFrame, columns: dict[str, str], name: str, in_dir: str, unknown: str = "zero") -> DataFrame:
    """Codes and scaled season by what is stored with the model: new labels in today's tables change nothing."""
    stored = df.sparkSession.read.schema("label string, code int, column string").parquet(f"{in_dir.rstrip('/')}/{name}.encoder")
    for column, out in columns.items():
        df = with_codes(df, stored.where(F.col("column") == column).select("label", "code"), column, out, unknown)
    seasons = {r["column"]: r["code"] for r in stored.where(F.col("column").isin("season_lo", "season_hi")).collect()}  # two rows
    lo, hi = seasons["season_lo"], seasons["season_hi"]
    return df.withColumn("season_norm", (F.col("season") - F.lit(lo)) / F.lit(max(hi - lo, 1)))


def stored_models(spark: SparkSession, in_dir: str) -> list[str]:
    """Names of the models in a folder: which predictions a service can give."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(in_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    return sorted(n for n in names if "." not in n)


def load_metrics(spark: SparkSession, name: str, in_dir: str) -> Metrics:
    return spark.read.json(f"{in_dir.rstrip('/')}/{name}.metrics").first().asDict()


# ---- reports on a model ----


def feature_importances(spark: SparkSession, model: PipelineModel, top: int | None = None) -> DataFrame:
    """As many rows as the model has features, largest first."""
    names = model.stages[0].getInputCols()
    weights = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, importance double")
    rows = rows.orderBy(F.desc("importance"), "feature")
    return rows.limit(top) if top else rows


def metrics_table(spark: SparkSession, measured: Metrics) -> DataFrame:
    rows = [(k, None if v is None else float(v)) for k, v in sorted(measured.items())]
    return spark.createDataFrame(rows, "metric string, value double")


def model_summary(spark: SparkSession, measured: dict[str, Metrics]) -> DataFrame:
    """One row per model: what kind it is, its key metric, and accuracy (R squared for a regression)."""
    rows = []
    for name, m in sorted(measured.items()):
        regression = "mae" in m
        rows.append(
            (
                name, "Regressor" if regression else "Classifier", "mae" if regression else "roc_auc",
                float(m["mae"] if regression else m["roc_auc"]), float(m["r2"] if regression else m["accuracy"]),
            )
        )
    return spark.createDataFrame(rows, "model string, type string, key_metric string, value double, accuracy double")


# ---- scoring ----


def percent(probability: Column | str) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return rnd(p * 100, 1)


def win_curves(model: PipelineModel, win_features: DataFrame) -> DataFrame:
    """Win probability of the batting side after every over, for all matches at once."""
    scored = predict(model, WIN_PROBABILITY, win_features, "_p")
    return scored.select("match_id", "over", percent("_p").alias("win_probability"))


def predict_win_curve(model: PipelineModel, match_id: int, win_features: DataFrame) -> DataFrame:
    """One match; an unknown id is an error."""
    rows = win_features.where(F.col("match_id") == match_id)
    if rows.isEmpty():
        raise ValueError(f"match_id {match_id} not found in the win-probability features")
    return win_curves(model, rows).select("over", "win_probability").orderBy("over")


def described_win_curves(
    model: PipelineModel, win_features: DataFrame, deliveries: DataFrame, matches: DataFrame
) -> DataFrame:
    """Curves with both sides, the actual winner and the phase of each over."""
    pairs = deliveries.where(F.col("inning") == 2).groupBy("match_id", "batting_team", "bowling_team")
    first = pairs.agg(F.min(ball_position()).alias("_first"))
    sides = first.groupBy("match_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_first"))).alias(c) for c in ("batting_team", "bowling_team")]
    )
    outcome = matches.select(F.col("id").alias("match_id"), F.col("winner").alias("actual_winner"))
    out = win_curves(model, win_features).join(sides, "match_id", "left").join(outcome, "match_id", "left")
    unknown = {c: F.coalesce(c, F.lit("Unknown")) for c in ("batting_team", "bowling_team")}
    return out.withColumns({**unknown, "phase": phase_of()})


def calibration_by_over(model: PipelineModel, win_features: DataFrame) -> DataFrame:
    """Mean predicted probability per over, split by how the chase ended."""
    scored = predict(model, WIN_PROBABILITY, win_features, "_p")
    outcome = F.when(F.col("batting_team_won") == 1, "Won").otherwise("Lost")
    return scored.groupBy("over", outcome.alias("outcome")).agg(F.avg(F.col("_p") * 100).alias("predicted_prob"))


def score_match_requests(model: PipelineModel, features: DataFrame) -> DataFrame:
    spec = replace(MATCH_WINNER, features=tuple(model.stages[0].getInputCols()))
    scored = predict(model, spec, features, "_p")
    return scored.select(
        "request_id", "team1", "team2", percent("_p").alias("team1_win_probability"),
        percent(1 - F.col("_p")).alias("team2_win_probability"),
    )


def score_award_requests(model: PipelineModel, features: DataFrame) -> DataFrame:
    scored = predict(model, AWARD, features, "_p").withColumn("potm_probability", percent("_p"))
    ranked = rank_players(scored)
    return ranked.select(
        "request_id", "player_name", "potm_probability", "strike_rate", "economy", "rank",
        flag(F.col("rank") == 1).alias("predicted_potm"),
    )
