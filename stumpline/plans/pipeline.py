"""The stored feature tables and the job that writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stumpline.operators.form import compute_team_rolling_form
from stumpline.plans import features
from stumpline.sources import fixtures
from stumpline.sources.io import load_parquet, save_processed

# table name -> builder over (deliveries, matches); ids ride along so that splits are reproducible
FEATURE_TABLES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "team_rolling_form": compute_team_rolling_form,
    "match_features": lambda d, m: features.build_match_features_v2(m, keep_id=True),
    "match_features_v3": lambda d, m: features.build_match_features_v3(m, d, keep_id=True),
    "win_prob_features": features.build_win_probability_features,
    "score_features": lambda d, m: features.build_score_features(d, m, keep_id=True),
    "potm_features": lambda d, m: features.build_potm_features(d, m, keep_id=True),
    "over_sequences": features.build_over_sequences,
}


def materialize(deliveries: DataFrame, matches: DataFrame, out_dir: str, names=None) -> dict[str, str]:
    """Write the cleaned tables and the feature tables; the stored form table feeds the v3 features."""
    spark = matches.sparkSession
    paths = {
        "matches": save_processed(matches, "matches", out_dir),
        "deliveries": save_processed(deliveries, "deliveries", out_dir),
    }
    d, m = load_parquet(spark, "deliveries", out_dir), load_parquet(spark, "matches", out_dir)
    for name in names or FEATURE_TABLES:
        if name == "match_features_v3" and "team_rolling_form" in paths:
            form = load_parquet(spark, "team_rolling_form", out_dir)
            df = features.build_match_features_v3(m, d, keep_id=True, team_form=form)
        else:
            df = FEATURE_TABLES[name](d, m)
        paths[name] = save_processed(df, name, out_dir)
    return paths


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A feature table of a scale directory, built and written on first use in the session."""

    def build() -> DataFrame:
        return FEATURE_TABLES[name](fixtures.deliveries(spark, sf_dir), fixtures.matches(spark, sf_dir))

    return fixtures.materialised(spark, sf_dir, name, build)
