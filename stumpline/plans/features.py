"""Feature tables. Every history column looks only at matches before the row's own match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stumpline.functions.exprs import (
    ball_position,
    boundary,
    first_innings,
    flag,
    ratio,
    regulation,
    rnd,
    total,
    totals_with_side,
)
from stumpline.functions.ordered import HOT_ROWS, date_key, prior_totals
from stumpline.operators.encode import encode
from stumpline.operators.form import compute_team_rolling_form
from stumpline.operators.teams import decided, prior_win_rates
from stumpline.operators.venues import over_ten_snapshot
from stumpline.schema import (
    AWARD_FEATURES,
    FORM_COLUMNS,
    FORM_MATCHES,
    INNINGS_BALLS,
    INNINGS_OVERS,
    MATCH_FEATURES_V1,
    MATCH_FEATURES_V2,
    MATCH_FEATURES_V3,
    SCORE_FEATURES,
    STEP_FEATURES,
    WIN_PROB_FEATURES,
)
from stumpline.sources.staging import staged

MATCH_CODES = {"venue": "venue_enc", "team1": "team1_enc", "team2": "team2_enc"}


def _pick(df: DataFrame, columns: list[str], keep_id: list[str] | None) -> DataFrame:
    """Final select. ``keep_id`` columns ride along but do not decide which rows are dropped."""
    return df.select(*(keep_id or []), *columns).dropna(subset=columns)


# ---- match outcome ----


def _match_base(matches: DataFrame) -> DataFrame:
    """Decided matches with toss flags, target and label codes."""
    df = decided(matches).withColumns(
        {
            "toss_winner_is_team1": flag(F.col("toss_winner") == F.col("team1")),
            "bat_first": flag(F.col("toss_decision") == "bat"),
            "team1_won": flag(F.col("winner") == F.col("team1")),
        }
    )
    return encode(df, MATCH_CODES).withColumnRenamed("id", "match_id")


def build_match_features(matches: DataFrame, keep_id: bool = False) -> DataFrame:
    return _pick(_match_base(matches), MATCH_FEATURES_V1 + ["team1_won"], ["match_id"] if keep_id else None)


def _match_base_v2(matches: DataFrame, hot_rows: int) -> DataFrame:
    return _match_base(matches).join(prior_win_rates(matches, hot_rows), "match_id")


def build_match_features_v2(matches: DataFrame, keep_id: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    df = _match_base_v2(matches, hot_rows)
    return _pick(df, MATCH_FEATURES_V2 + ["team1_won"], ["match_id"] if keep_id else None)


def build_match_features_v3(
    matches: DataFrame,
    deliveries: DataFrame,
    n_matches: int = FORM_MATCHES,
    keep_id: bool = False,
    team_form: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """v2 plus both teams' rolling player form. ``team_form`` may be passed where it is already stored."""
    if team_form is None:
        team_form = compute_team_rolling_form(deliveries, matches, n_matches, hot_rows=hot_rows)
    # fold the two sides to one row per match: the form table is shuffled and joined once
    pairing = matches.select(F.col("id").alias("match_id"), "team1", "team2")
    sides = team_form.join(pairing, "match_id").groupBy("match_id").agg(
        *[
            F.max(F.when(F.col("team") == F.col(side), F.col(c))).alias(f"{side}_{c}")
            for side in ("team1", "team2")
            for c in FORM_COLUMNS
        ]
    )
    df = _match_base_v2(matches, hot_rows).join(sides, "match_id", "left")
    df = df.withColumns(
        {f"{c}_diff": F.col(f"team1_{c}") - F.col(f"team2_{c}") for c in FORM_COLUMNS[:3]}
    )
    return _pick(df, MATCH_FEATURES_V3 + ["team1_won"], ["match_id"] if keep_id else None)


# ---- chase state ----


def chase_states(deliveries: DataFrame) -> DataFrame:
    """Second innings after every over, with the target, from one pass over the balls.

    The target counts all balls flagged as innings 1, super overs included.
    """
    chasing = (F.col("inning") == 2) & ~F.col("is_super_over")
    overs = totals_with_side(
        deliveries.where((F.col("inning") == 1) | chasing),
        ["match_id", "inning", "over"],
        "batting_team",
        {"runs_in_over": F.sum("total_runs"), "wickets_in_over": total(F.col("is_wicket"))},
    )
    match = Window.partitionBy("match_id")
    upto = Window.partitionBy("match_id").orderBy("inning", "over")
    second = F.col("inning") == 2

    def running(c: str):
        return F.sum(F.when(second, F.col(c))).over(upto.rowsBetween(Window.unboundedPreceding, 0))

    df = overs.withColumns(
        {
            "target": F.sum(F.when(F.col("inning") == 1, F.col("runs_in_over"))).over(match) + 1,
            "runs_scored": running("runs_in_over"),
            "wickets_fallen": running("wickets_in_over"),
        }
    ).where(second)
    df = df.withColumns(
        {
            "balls_completed": F.col("over") * 6,
            "balls_remaining": INNINGS_BALLS - F.col("over") * 6,
            "runs_required": F.col("target") - F.col("runs_scored"),
        }
    )
    return df.withColumns(
        {
            "current_rr": ratio("runs_scored", F.col("balls_completed") / 6, 2),
            "required_rr": ratio("runs_required", F.col("balls_remaining") / 6, 2),
        }
    )


def build_win_probability_features(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    outcome = matches.select(F.col("id").alias("match_id"), "winner", "venue")
    # staged, as it is read three times: for the rows and for the labels of each code
    df = staged(chase_states(deliveries).join(outcome, "match_id", "left"))
    df = df.withColumn("batting_team_won", flag(F.col("batting_team") == F.col("winner")))
    df = encode(df, {"venue": "venue_enc", "batting_team": "batting_team_enc"})
    return _pick(df, WIN_PROB_FEATURES + ["batting_team_won", "match_id"], None)


# ---- first-innings total from the half-way point ----


def build_score_features(
    deliveries: DataFrame, matches: DataFrame, keep_id: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    meta = matches.select(F.col("id").alias("match_id"), "venue", "season", "date")
    snapshot = staged(over_ten_snapshot(deliveries).join(meta, "match_id", "left"))
    df = snapshot.withColumns(
        {"current_rr": rnd(F.col("runs_10") / 10, 3), "_day": date_key()}
    ).withColumn("projected_score", rnd(F.col("current_rr") * 20, 1))
    df = prior_totals(
        df, ["venue"], ["_day", "match_id"], {"_runs": F.col("runs_10"), "_n": F.lit(1)}, hot_rows,
        sizing=matches,
    )
    overall = snapshot.agg(F.avg("runs_10") / 10).first()[0]
    df = df.withColumn("venue_avg_rr", F.coalesce(ratio("_runs", F.col("_n") * 10, 3), F.lit(overall)))
    df = df.withColumn("scoring_pressure", rnd(F.col("current_rr") - F.col("venue_avg_rr"), 3))
    df = encode(df, {"venue": "venue_enc", "batting_team": "batting_team_enc"})
    return _pick(df, SCORE_FEATURES + ["final_score"], ["match_id"] if keep_id else None)


# ---- player of the match ----


def player_match_totals(deliveries: DataFrame) -> DataFrame:
    """(match_id, player) batting and bowling totals and side, from one pass over the balls.

    Each ball counts once for its striker and once for its bowler. Where a name appears on
    both sides of a match, the batting side is taken.
    """
    legal = F.col("is_legal_delivery")
    roles = F.array(
        F.struct(F.col("batsman").alias("player"), F.col("batting_team").alias("team"), F.lit(True).alias("bats")),
        F.struct(F.col("bowler").alias("player"), F.col("bowling_team").alias("team"), F.lit(False).alias("bats")),
    )
    balls = regulation(deliveries).select(
        "match_id", "inning", "over", "ball", "batsman_runs", "total_runs", "is_legal_delivery", "is_wicket",
        F.explode(roles).alias("role"),
    )
    balls = balls.select("*", "role.*").where(F.col("player").isNotNull())
    bats = F.col("bats")
    bowls = ~bats & legal

    def added(condition, c):
        return F.sum(F.when(condition, c).otherwise(0))

    # the side joins the keys first: see totals_with_side
    sides = balls.groupBy("match_id", "player", "bats", "team").agg(
        added(bats, F.col("batsman_runs")).alias("runs_scored"),
        total(bats & legal).alias("balls_faced"),
        total(bowls & F.col("is_wicket")).alias("wickets_taken"),
        added(bowls, F.col("total_runs")).alias("runs_given"),
        total(bowls).alias("balls_bowled"),
        F.min(ball_position()).alias("_first"),
    )

    def earliest(condition):
        return F.min_by("team", F.when(condition & F.col("team").isNotNull(), F.col("_first")))

    lines = ("runs_scored", "balls_faced", "wickets_taken", "runs_given", "balls_bowled")
    return (
        sides.repartition("match_id")
        .groupBy("match_id", "player")
        .agg(
            total(bats).alias("_batted"),
            *[F.sum(c).alias(c) for c in lines],
            F.coalesce(earliest(bats), earliest(~bats)).alias("team"),
        )
    )


def player_teams(deliveries: DataFrame) -> DataFrame:
    """(match_id, player, team) for everyone who batted or bowled; the batting side wins a conflict."""
    return player_match_totals(deliveries).select("match_id", "player", "team").where(F.col("team").isNotNull())


def build_potm_features(deliveries: DataFrame, matches: DataFrame, keep_id: bool = False) -> DataFrame:
    # a bowler without a single legal ball has no bowling line
    df = player_match_totals(deliveries).where((F.col("_batted") > 0) | (F.col("balls_bowled") > 0))
    award = matches.select(F.col("id").alias("match_id"), F.col("player_of_match").alias("potm"), "winner")
    df = df.join(award, "match_id", "left").withColumns(
        {
            "strike_rate": F.coalesce(ratio("runs_scored", "balls_faced", scale=100), F.lit(0.0)),
            "economy": F.coalesce(ratio("runs_given", F.col("balls_bowled") / 6), F.lit(0.0)),
            "is_potm": flag(F.col("player") == F.col("potm")),
            "player_won": flag(F.col("team") == F.col("winner")),
        }
    )
    return _pick(df, AWARD_FEATURES + ["is_potm"], ["match_id", "player"] if keep_id else None)


# ---- over sequences ----


def build_over_sequences(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """First innings over by over with running totals and the final score."""
    overs = totals_with_side(
        first_innings(deliveries),
        ["match_id", "over"],
        "batting_team",
        {
            "runs_in_over": F.sum("total_runs"),
            "wickets_in_over": total(F.col("is_wicket")),
            "boundaries_in_over": total(boundary()),
            "balls_in_over": total(F.col("is_legal_delivery")),
        },
    )
    match = Window.partitionBy("match_id")
    upto = match.orderBy("over").rowsBetween(Window.unboundedPreceding, 0)
    df = overs.withColumns(
        {
            "cum_runs": F.sum("runs_in_over").over(upto),
            "cum_wickets": F.sum("wickets_in_over").over(upto),
            "final_score": F.sum("runs_in_over").over(match),
        }
    ).withColumn("current_rr", ratio("cum_runs", "over", 3))
    meta = matches.select(F.col("id").alias("match_id"), "venue", "season")
    return df.join(meta, "match_id", "left").select(
        "match_id", "over", *STEP_FEATURES, "batting_team", "venue", "season", "final_score"
    ).dropna()


def prefix_sequences(sequences: DataFrame, max_prefix: int = INNINGS_OVERS) -> DataFrame:
    """One row per (match, k): the first k overs as an array, for k up to ``max_prefix``."""
    order = Window.partitionBy("match_id").orderBy("over")
    step = F.struct("over", *STEP_FEATURES)
    return (
        sequences.withColumns(
            {
                "prefix": F.row_number().over(order),
                "steps": F.collect_list(step).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            }
        )
        .where(F.col("prefix") <= max_prefix)
        .select("match_id", "prefix", "steps", "batting_team", "venue", "season", "final_score")
    )


def naive_curve(sequences: DataFrame) -> DataFrame:
    """Run rate so far times twenty after every over seen."""
    order = Window.partitionBy("match_id").orderBy("over")
    k = F.row_number().over(order)
    runs = F.sum("runs_in_over").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sequences.select(
        "match_id", "over", rnd(runs / k * INNINGS_OVERS, 0).alias("naive_projection"), "final_score"
    )


