"""Every operator as a named query over a scale directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stumpline.functions.exprs import rnd
from stumpline.operators import encode, form, metrics, players, quality, splits, teams, venues
from stumpline.plans import features, serving
from stumpline.schema import (
    AWARD_FEATURES,
    FORM_COLUMNS,
    MATCH_FEATURES_V2,
    STEP_FEATURES,
    TEAM_CODES,
)
from stumpline.plans.pipeline import FEATURE_TABLES, stored
from stumpline.sources import clean, fixtures
from stumpline.sources.io import load_parquet, save_processed

Query = Callable[[SparkSession, str], DataFrame]


def _balls(op, *args, **kwargs) -> Query:
    return lambda spark, sf: op(fixtures.deliveries(spark, sf), *args, **kwargs)


def _matches(op, *args, **kwargs) -> Query:
    return lambda spark, sf: op(fixtures.matches(spark, sf), *args, **kwargs)


def _both(op, *args, **kwargs) -> Query:
    return lambda spark, sf: op(fixtures.deliveries(spark, sf), fixtures.matches(spark, sf), *args, **kwargs)


def _over(build: Query, op, *args, **kwargs) -> Query:
    """An operator on top of another query's result."""
    return lambda spark, sf: op(build(spark, sf), *args, **kwargs)


def _table(name: str) -> Query:
    """A stored feature table, written on first use."""
    return lambda spark, sf: stored(spark, sf, name)


def _builder(name: str) -> Query:
    """A feature table built anew."""
    return _both(FEATURE_TABLES[name])


# feature tables as stored: what the queries on top of them read
team_form = _table("team_rolling_form")
match_v2 = _table("match_features")
win_prob = _table("win_prob_features")
score = _table("score_features")
award = _table("potm_features")
sequences = _table("over_sequences")
match_v1 = _matches(features.build_match_features, keep_id=True)


# ---- queries that need a little wiring ----


def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the match table partitioned by season and read it back."""
    matches = fixtures.matches(spark, sf)
    folder = fixtures.table_dir(spark, sf)
    save_processed(matches, "matches_by_season", folder, partition_by="season")
    return load_parquet(spark, "matches_by_season", folder).select(*matches.columns)


def backfill_derived(spark: SparkSession, sf: str) -> DataFrame:
    stored = fixtures.deliveries(spark, sf).drop("is_legal_delivery", "is_wicket")
    flagged = clean.add_delivery_flags(stored)
    return flagged.select("match_id", "inning", "over", "ball", "is_legal_delivery", "is_wicket")


def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    df = fixtures.matches(spark, sf)
    coded = encode.encode(df, {"venue": "venue_enc", "team1": "team1_enc", "winner": "winner_enc"})
    return coded.select("id", "venue", "team1", "winner", "venue_enc", "team1_enc", "winner_enc")


def encode_union(spark: SparkSession, sf: str) -> DataFrame:
    return encode.union_label_codes(fixtures.matches(spark, sf), "team1", "team2")


def encode_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Codes fitted on decided matches only, applied to all with both lenient policies."""
    df = fixtures.matches(spark, sf)
    fitted = encode.label_codes(teams.decided(df), "winner")
    out = encode.with_codes(df, fitted, "winner", "winner_zero", "zero")
    out = encode.with_codes(out, fitted, "winner", "winner_minus", "minus_one")
    out = encode.with_codes(out, fitted, "venue", "venue_minus", "minus_one")
    return out.select("id", "winner", "venue", "winner_zero", "winner_minus", "venue_minus")


def sequence_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded and normalised over rows; statistics come from the training matches only."""
    df = splits.temporal_split(sequences(spark, sf), "match_id")
    df = encode.encode(df, {"batting_team": "batting_team_enc", "venue": "venue_enc"})
    stats = splits.fit_normaliser(df.where(~F.col("is_test")), STEP_FEATURES)
    out = splits.normalise(splits.scale_season(df), stats, 6)
    return out.select(
        "match_id", "over", "is_test", *STEP_FEATURES, "batting_team_enc", "venue_enc",
        rnd("season_norm", 6).alias("season_norm"), "final_score",
    )


def batting_form(spark: SparkSession, sf: str) -> DataFrame:
    out = form.player_match_batting(fixtures.deliveries(spark, sf))
    return out.select("match_id", "player", rnd("bat_avg", 6).alias("bat_avg"), rnd("bat_sr", 6).alias("bat_sr"))


def bowling_form(spark: SparkSession, sf: str) -> DataFrame:
    out = form.player_match_bowling(fixtures.deliveries(spark, sf))
    return out.select("match_id", "player", rnd("bowl_econ", 6).alias("bowl_econ"), rnd("bowl_sr", 6).alias("bowl_sr"))


def player_form(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling batting and bowling form of every player, long form."""
    d, m = fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)

    def long(df: DataFrame, columns: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("stat"), rnd(c, 4).alias("value")) for c in columns]
        return df.select("match_id", "player", "team", F.explode(F.array(*cells)).alias("c")).select(
            "match_id", "player", "team", "c.*"
        )

    bat, bowl = form.player_forms(d, m)
    return long(bat, FORM_COLUMNS[:2]).unionByName(long(bowl, FORM_COLUMNS[2:]))


def prefix_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix expansion reduced to what an array-free engine can check."""
    df = features.prefix_sequences(sequences(spark, sf))
    added = F.aggregate("steps", F.lit(0).cast("bigint"), lambda acc, s: acc + s["runs_in_over"])
    return df.select(
        "match_id", "prefix", F.size("steps").alias("steps"), added.alias("runs"),
        F.element_at("steps", -1)["cum_runs"].alias("last_cum_runs"), "final_score",
    )


def top_margins(spark: SparkSession, sf: str) -> DataFrame:
    m = fixtures.matches(spark, sf)
    lists = [
        teams.biggest_wins(m, by).select(F.lit(by).alias("kind"), "id", "winner", F.col(by).alias("margin"))
        for by in ("win_by_runs", "win_by_wickets")
    ]
    return lists[0].unionByName(lists[1])


def prior_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = teams.prior_win_rates(fixtures.matches(spark, sf))
    return out.withColumn("win_rate_diff", rnd("win_rate_diff", 4))


def prematch_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per recorded match."""
    winner_side = F.when(F.col("toss_winner") == F.col("team1"), "team1").otherwise("team2")
    return fixtures.matches(spark, sf).select(
        F.col("id").alias("request_id"), "team1", "team2", "venue", winner_side.alias("toss_winner"),
        "toss_decision", "season",
    )


def prematch_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    m = fixtures.matches(spark, sf)
    out = teams.win_rate_before_season(prematch_requests(spark, sf), m, "team1", "win_rate_team1")
    out = teams.win_rate_before_season(out, m, "team2", "win_rate_team2")
    return out.select("request_id", "team1", "team2", "season", "win_rate_team1", "win_rate_team2")


def prematch_features(spark: SparkSession, sf: str) -> DataFrame:
    return serving.prematch_features(
        prematch_requests(spark, sf), fixtures.matches(spark, sf), team_form(spark, sf)
    )


def over_requests_table(spark: SparkSession, sf: str) -> DataFrame:
    """One request per first innings: its overs as an array."""
    step = F.struct("over", "runs_in_over", "wickets_in_over", "boundaries_in_over")
    return sequences(spark, sf).groupBy(F.col("match_id").alias("request_id"), "batting_team", "venue", "season").agg(
        F.sort_array(F.collect_list(step)).alias("overs")
    )


def award_requests_table(spark: SparkSession, sf: str) -> DataFrame:
    """One request per match: the lines of its players."""
    d, m = fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)
    lines = features.player_match_totals(d).join(
        m.select(F.col("id").alias("match_id"), "winner"), "match_id"
    )
    line = F.struct(
        F.col("player").alias("player_name"), "runs_scored", "balls_faced", "wickets_taken", "runs_given",
        "balls_bowled", F.coalesce((F.col("team") == F.col("winner")).cast("int"), F.lit(0)).alias("player_won"),
    )
    return lines.groupBy(F.col("match_id").alias("request_id")).agg(
        F.sort_array(F.collect_list(line)).alias("players")
    )


def score_requests_table(spark: SparkSession, sf: str) -> DataFrame:
    m = fixtures.matches(spark, sf).select(F.col("id").alias("match_id"), "venue", "season")
    half = venues.over_ten_snapshot(fixtures.deliveries(spark, sf)).join(m, "match_id")
    return half.select(
        F.col("match_id").alias("request_id"), "batting_team", "venue", "season", "runs_10", "wickets_10",
        "boundaries_10",
    )


def over_requests(spark: SparkSession, sf: str) -> DataFrame:
    return serving.over_request_states(over_requests_table(spark, sf))


def score_request_features(spark: SparkSession, sf: str) -> DataFrame:
    return serving.score_request_features(
        score_requests_table(spark, sf), fixtures.deliveries(spark, sf), fixtures.matches(spark, sf)
    )


def award_request_features(spark: SparkSession, sf: str) -> DataFrame:
    return serving.award_request_features(award_requests_table(spark, sf)).drop("position")


def request_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Match, score and award requests whose fields break a rule, seasons moved into the allowed decades."""
    moved = F.col("season") + 14
    match_requests = prematch_requests(spark, sf).withColumn("season", moved)
    score_requests = score_requests_table(spark, sf).withColumns({"season": moved, "runs_10": F.col("runs_10") * 2})
    kinds = {
        "match": (match_requests, serving.match_request_rules()),
        "score": (score_requests, serving.score_request_rules()),
        "award": (award_requests_table(spark, sf), serving.award_request_rules()),
        "over": (over_requests_table(spark, sf).withColumn("season", moved), serving.over_request_rules()),
    }
    out = None
    for kind, (df, rules) in kinds.items():
        bad = serving.invalid_requests(df, rules).select(F.lit(kind).alias("kind"), "request_id", "rule")
        out = bad if out is None else out.unionByName(bad)
    return out


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Decided matches with a simple deterministic score for team1, used to exercise the metrics."""
    share = F.try_divide(F.col("win_rate_team1"), F.col("win_rate_team1") + F.col("win_rate_team2"))
    return match_v2(spark, sf).select("match_id", "team1_won", F.coalesce(share, F.lit(0.5)).alias("score"))


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.temporal_split(win_prob(spark, sf), "match_id").select("match_id", "over", "is_test")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(match_v1(spark, sf), ["match_id"], "team1_won").select(
        "match_id", "team1_won", "is_test"
    )


def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(match_v1(spark, sf), ["match_id"], "team1_won", 5).select(
        "match_id", "team1_won", "fold"
    )


def unusable_matches(spark: SparkSession, sf: str) -> DataFrame:
    return serving.unusable_matches(fixtures.matches(spark, sf), win_prob(spark, sf))


def unknown_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for the recorded ids and as many ids beyond them."""
    ids = fixtures.matches(spark, sf).select(F.explode(F.array(F.col("id"), F.col("id") + 100000)).alias("match_id"))
    return serving.unknown_matches(ids, win_prob(spark, sf))


def win_rate_by_over(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_by(win_prob(spark, sf), ["over"], "batting_team_won", "raw_win_rate", 6)


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Target shares of the three classification tables."""
    targets = {
        "match": (match_v2(spark, sf), "team1_won"),
        "win_probability": (win_prob(spark, sf), "batting_team_won"),
        "award": (award(spark, sf), "is_potm"),
    }
    out = None
    for name, (df, target) in targets.items():
        part = metrics.class_balance(df, target).select(
            F.lit(name).alias("table"), F.col(target).alias("target"), "n", "share"
        )
        out = part if out is None else out.unionByName(part)
    return out


def player_batting_named(spark: SparkSession, sf: str) -> DataFrame:
    """Player page for named players within a season range: both filters reach the scan."""
    return players.player_batting(
        fixtures.deliveries(spark, sf), fixtures.matches(spark, sf),
        ["Mumbai Indians P1", "Mumbai Indians P5", "Chennai Super Kings P3"], (1993, 1997),
    )


def label_frames(spark: SparkSession, sf: str) -> DataFrame:
    return quality.value_report(
        fixtures.matches(spark, sf), ["team1", "team2", "toss_winner", "winner"], list(TEAM_CODES)
    )


FORM_RANGES = {"rolling_bat_avg": (0, 80), "rolling_bat_sr": (0, None), "rolling_bowl_econ": (2, 25),
               "rolling_bowl_sr": (0, 20)}

CHECKED: dict[str, Query] = {
    # sources and cleaning
    "load_matches": lambda s, sf: clean.clean_matches(fixtures.raw_matches(s, sf)),
    "load_deliveries": lambda s, sf: clean.clean_deliveries(fixtures.raw_deliveries(s, sf)),
    "parquet_roundtrip": parquet_roundtrip,
    "backfill_derived": backfill_derived,
    "over_index_check": _balls(quality.over_index_check),
    "null_report": _matches(quality.null_report, ["id", "season", "city", "team1", "winner", "venue", "date"]),
    "range_report": _over(team_form, quality.range_report, FORM_RANGES),
    "value_report": label_frames,
    "label_encode": label_encode,
    "encode_union": encode_union,
    "encode_unknown": encode_unknown,
    "sequence_norm": sequence_norm,
    "health_listing": _matches(quality.listing),
    "dataset_profile": _both(quality.dataset_profile),
    # players
    "batting_career": _balls(players.batting_career_stats),
    "batting_phase": _balls(players.batting_phase_stats),
    "bowling_career": _balls(players.bowling_career_stats),
    "bowling_phase": _balls(players.bowling_phase_economy),
    "partnerships": _balls(players.partnership_stats),
    "player_batting": _both(players.player_batting),
    "player_batting_named": player_batting_named,
    "player_batting_season": _both(players.player_batting_by_season),
    "player_bowling": _both(players.player_bowling),
    "player_bowling_season": _both(players.player_bowling_by_season),
    "leaderboard_bat": _balls(players.batting_leaderboard),
    "leaderboard_bowl": _balls(players.bowling_leaderboard),
    "all_players": _balls(players.all_players),
    "top_batters": _balls(players.top_run_scorers),
    "top_bowlers": _balls(players.top_wicket_takers),
    "dot_pressure": _balls(players.dot_ball_pressure),
    "phase_top20_bat": _balls(players.batting_phases_of_busiest),
    "phase_top20_bowl": _balls(players.bowling_phases_of_busiest),
    "qualified_medians": _balls(players.qualified_medians),
    "player_team": _balls(features.player_teams),
    # venues and seasons
    "venue_par": _both(venues.venue_par_scores),
    "venue_avg_rr": _both(venues.venue_run_rates),
    "season_trend": _both(venues.season_trend),
    "season_counts": _matches(teams.matches_per_season),
    "toss_by_season": _matches(teams.toss_decisions),
    "toss_advantage": _matches(teams.toss_advantage),
    "top_venues": _matches(teams.top_venues),
    "top_awards": _matches(teams.top_awards),
    "team_wins": _matches(teams.team_wins),
    "top_margins": top_margins,
    "super_over": _both(teams.super_over_scores),
    "super_over_matches": _balls(teams.super_over_matches),
    "head_to_head": _matches(teams.head_to_head_matrix),
    "head_to_head_long": _matches(teams.head_to_head),
    # form and history
    "batting_form": batting_form,
    "bowling_form": bowling_form,
    "player_form": player_form,
    "team_form": _builder("team_rolling_form"),
    "latest_form": _over(team_form, form.latest_team_form),
    "prior_win_rate": prior_win_rate,
    "prematch_win_rate": prematch_win_rate,
    # feature tables
    "match_features_v1": match_v1,
    "match_features_v2": _over(_builder("match_features"), lambda df: df.withColumn("win_rate_diff", rnd("win_rate_diff", 4))),
    "match_features_v3": _over(
        _builder("match_features_v3"),
        lambda df: df.withColumns(
            {c: rnd(c, 4) for c in df.columns if c.endswith("_diff")}
        ),
    ),
    "win_prob_features": _builder("win_prob_features"),
    "score_features": _builder("score_features"),
    "potm_features": _over(
        _builder("potm_features"), lambda df: df.withColumns({c: rnd(c, 6) for c in ("strike_rate", "economy")})
    ),
    "over_sequences": _builder("over_sequences"),
    "prefix_sequences": prefix_lengths,
    "naive_curve": _over(sequences, features.naive_curve),
    # feature tables described
    "win_rate_by_over": win_rate_by_over,
    "class_balance": class_balance,
    "class_weight": _over(award, metrics.class_weight, "is_potm"),
    "feature_corr": _over(match_v2, metrics.target_correlations, MATCH_FEATURES_V2, "team1_won"),
    "score_summary": _over(score, metrics.describe_column, "final_score"),
    "score_histogram": _over(score, metrics.histogram, "final_score"),
    "score_trendline": _over(score, metrics.trend_line, "runs_10", "final_score"),
    "potm_box": _over(award, metrics.quartiles_by_class, "is_potm", AWARD_FEATURES[:6]),
    # splits and metrics
    "temporal_split": temporal_split,
    "stratified_split": stratified_split,
    "kfold": kfold,
    "binary_metrics": _over(rated, metrics.binary_metrics, "score", "team1_won"),
    "roc_auc": _over(rated, metrics.roc_auc, "score", "team1_won"),
    "avg_precision": _over(rated, metrics.average_precision, "score", "team1_won"),
    "naive_projection_error": _over(score, metrics.regression_metrics, "projected_score", "final_score"),
    # requests
    "usable_matches": _over(win_prob, serving.usable_matches),
    "unusable_matches": unusable_matches,
    "unknown_matches": unknown_matches,
    "prematch_features": prematch_features,
    "score_request_features": score_request_features,
    "award_request_features": award_request_features,
    "over_requests": over_requests,
    "request_violations": request_violations,
}
