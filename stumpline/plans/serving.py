"""Scoring requests as tables: validation rules and feature assembly for whole batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpline.functions.exprs import flag, ratio, rnd
from stumpline.operators.encode import label_codes, labels_are_few, union_label_codes, with_codes
from stumpline.operators.form import latest_team_form
from stumpline.operators.quality import invalid_rows
from stumpline.operators.teams import win_rate_before_season
from stumpline.operators.venues import overall_run_rate, venue_run_rates
from stumpline.schema import FORM_COLUMNS, FORM_PRIORS, MATCH_FEATURES_V3, SCORE_FEATURES

# ---- fixed limits of the request fields ----

SEASON_RANGE = (2008, 2030)
RUNS_10_RANGE = (0, 150)
WICKETS_RANGE = (0, 10)
OVER_RUNS_RANGE = (0, 36)
PLAYERS_RANGE = (1, 22)
OVERS_RANGE = (1, 20)


def _within(c: Column | str, limits: tuple[int, int]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.between(*limits)


def match_request_rules() -> dict[str, Column]:
    return {
        "toss_winner": F.col("toss_winner").isin("team1", "team2"),
        "toss_decision": F.col("toss_decision").isin("bat", "field"),
        "season": _within("season", SEASON_RANGE),
    }


def score_request_rules() -> dict[str, Column]:
    return {
        "season": _within("season", SEASON_RANGE),
        "runs_10": _within("runs_10", RUNS_10_RANGE),
        "wickets_10": _within("wickets_10", WICKETS_RANGE),
        "boundaries_10": F.col("boundaries_10") >= 0,
    }


def award_request_rules() -> dict[str, Column]:
    """``players`` is an array of structs."""
    counts = ("runs_scored", "balls_faced", "wickets_taken", "runs_given", "balls_bowled")

    def not_negative(field: str) -> Column:
        return F.forall("players", lambda p: p[field] >= 0)

    rules = {"players_size": _within(F.size("players"), PLAYERS_RANGE)}
    rules |= {c: not_negative(c) for c in counts}
    rules["player_won"] = F.forall("players", lambda p: p["player_won"].isin(0, 1))
    rules["runs_without_balls"] = F.forall("players", lambda p: (p["balls_faced"] > 0) | (p["runs_scored"] <= 0))
    return rules


def over_request_rules() -> dict[str, Column]:
    """``overs`` is an array of structs."""
    return {
        "season": _within("season", SEASON_RANGE),
        "overs_size": _within(F.size("overs"), OVERS_RANGE),
        "runs_in_over": F.forall("overs", lambda o: _within(o["runs_in_over"], OVER_RUNS_RANGE)),
        "wickets_in_over": F.forall("overs", lambda o: _within(o["wickets_in_over"], WICKETS_RANGE)),
        "boundaries_in_over": F.forall("overs", lambda o: o["boundaries_in_over"] >= 0),
    }


def invalid_requests(requests: DataFrame, rules: dict[str, Column], keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """Every broken rule of every request."""
    return invalid_rows(requests, rules, keep)


# ---- match winner ----


def prematch_features(
    requests: DataFrame,
    matches: DataFrame,
    team_form: DataFrame | None = None,
    unknown: str = "error",
) -> DataFrame:
    """Feature rows for (request_id, team1, team2, venue, toss_winner, toss_decision, season).

    Win rates come from the seasons before the requested one. Form is each team's latest row of
    ``team_form``, with fixed priors for a team without one; without a form table the form columns
    are left out. Team codes come from both team columns together.
    """
    few = labels_are_few(matches, ["venue", "team1", "team2"])
    df = requests.withColumns(
        {
            "toss_winner_is_team1": flag((F.col("toss_winner") == "team1") | (F.col("team1") == F.col("team2"))),
            "bat_first": flag(F.col("toss_decision") == "bat"),
        }
    )
    teams = union_label_codes(matches, "team1", "team2")
    df = with_codes(df, label_codes(matches, "venue", few), "venue", "venue_enc", unknown, few)
    for side in ("team1", "team2"):
        df = with_codes(df, teams, side, f"{side}_enc", unknown, few)
        df = win_rate_before_season(df, matches, side, f"win_rate_{side}")
    df = df.withColumn("win_rate_diff", rnd(F.col("win_rate_team1") - F.col("win_rate_team2"), 4))
    features = [c for c in MATCH_FEATURES_V3 if "rolling" not in c]
    if team_form is not None:
        latest = latest_team_form(team_form).drop("match_id")
        for side in ("team1", "team2"):
            named = latest.withColumnsRenamed({"team": "_team", **{c: f"{side}_{c}" for c in FORM_COLUMNS}})
            named = F.broadcast(named) if few else named
            df = df.join(named, F.col(side) == F.col("_team"), "left").drop("_team")
            df = df.withColumns(
                {f"{side}_{c}": rnd(F.coalesce(f"{side}_{c}", F.lit(FORM_PRIORS[c])), 3) for c in FORM_COLUMNS}
            )
        df = df.withColumns(
            {f"{c}_diff": rnd(F.col(f"team1_{c}") - F.col(f"team2_{c}"), 3) for c in FORM_COLUMNS[:3]}
        )
        features = MATCH_FEATURES_V3
    return df.select("request_id", "team1", "team2", *features)


# ---- score after ten overs ----


def score_request_features(
    requests: DataFrame, deliveries: DataFrame, matches: DataFrame, unknown: str = "error"
) -> DataFrame:
    """Feature rows for (request_id, batting_team, venue, season, runs_10, wickets_10, boundaries_10)."""
    few = labels_are_few(matches, ["venue", "team1", "team2"])
    rates = venue_run_rates(deliveries, matches).withColumnRenamed("venue", "_venue")
    df = requests.join(F.broadcast(rates) if few else rates, F.col("venue") == F.col("_venue"), "left")
    df = df.withColumns(
        {
            "current_rr": rnd(F.col("runs_10") / 10, 3),
            "venue_avg_rr": F.coalesce("venue_avg_rr", overall_run_rate(deliveries).scalar()),
        }
    )
    df = df.withColumns(
        {
            "projected_score": rnd(F.col("current_rr") * 20, 1),
            "scoring_pressure": rnd(F.col("current_rr") - F.col("venue_avg_rr"), 3),
        }
    )
    df = with_codes(df, label_codes(matches, "venue", few), "venue", "venue_enc", unknown, few)
    df = with_codes(df, label_codes(deliveries, "batting_team"), "batting_team", "batting_team_enc", unknown)
    return df.select("request_id", *SCORE_FEATURES)


def with_margin(scored: DataFrame, prediction: str, margin: float, floor: float | None = None) -> DataFrame:
    """Prediction to one place, and the interval of +- margin around it."""
    p = rnd(prediction, 1)
    base = p if floor is not None else F.col(prediction)
    low = base - margin
    if floor is not None:
        low = F.greatest(low, F.lit(float(floor)))
    return scored.withColumns(
        {
            "predicted_final_score": p,
            "confidence_interval_low": rnd(low, 1),
            "confidence_interval_high": rnd(base + margin, 1),
        }
    )


# ---- score after any over ----


def over_request_states(requests: DataFrame) -> DataFrame:
    """(request_id, batting_team, venue, season, overs) to one row per completed over with running totals.

    Every over counts as six balls.
    """
    rows = requests.select(
        "request_id", "batting_team", "venue", "season", F.size("overs").alias("overs_seen"),
        F.posexplode("overs").alias("_pos", "o"),
    )
    rows = rows.select("*", "o.runs_in_over", "o.wickets_in_over", "o.boundaries_in_over").withColumn(
        "over", F.col("_pos") + 1
    )
    upto = Window.partitionBy("request_id").orderBy("over").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "cum_runs": F.sum("runs_in_over").over(upto),
            "cum_wickets": F.sum("wickets_in_over").over(upto),
            "balls_in_over": F.lit(6),
        }
    ).withColumn("current_rr", ratio("cum_runs", "over", 3))
    return rows.drop("_pos", "o")


# ---- player of the match ----


def award_request_features(requests: DataFrame) -> DataFrame:
    """(request_id, players) to one feature row per player, in the order given."""
    rows = requests.select("request_id", F.posexplode("players").alias("position", "p")).select(
        "request_id", "position", "p.*"
    )
    return rows.withColumns(
        {
            "strike_rate": F.coalesce(ratio("runs_scored", "balls_faced", 2, scale=100), F.lit(0.0)),
            "economy": F.coalesce(ratio("runs_given", F.col("balls_bowled") / 6, 2), F.lit(0.0)),
        }
    )


def rank_players(scored: DataFrame, probability: str = "potm_probability") -> DataFrame:
    """Rank within the request, most likely first; equal ones keep the order given."""
    order = Window.partitionBy("request_id").orderBy(F.desc(probability), "position")
    return scored.withColumn("rank", F.row_number().over(order))


# ---- histories behind the listings ----


def usable_matches(win_features: DataFrame) -> DataFrame:
    """Matches with a usable chase."""
    return win_features.select("match_id").distinct()


def unusable_matches(matches: DataFrame, win_features: DataFrame) -> DataFrame:
    ids = matches.select(F.col("id").alias("match_id"))
    return ids.join(usable_matches(win_features), "match_id", "left_anti")


def unknown_matches(requests: DataFrame, win_features: DataFrame) -> DataFrame:
    """Requested match ids that have no win curve."""
    return requests.select("match_id").distinct().join(usable_matches(win_features), "match_id", "left_anti")
