"""Team results: head to head, prior win rates, match-level trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stumpline.functions.exprs import flag, ratio, same, total
from stumpline.functions.ordered import HOT_ROWS, date_key, prior_totals
from stumpline.operators.encode import labels_are_few
from stumpline.schema import UNSEEN_TEAM_WIN_RATE


def decided(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("winner").isNotNull())


def head_to_head(matches: DataFrame) -> DataFrame:
    """Long form: wins of ``team`` over ``opponent``."""
    loser = F.when(same("winner", "team2"), F.col("team1")).otherwise(F.col("team2"))
    return (
        decided(matches)
        .groupBy(F.col("winner").alias("team"), loser.alias("opponent"))
        .agg(F.count(F.lit(1)).alias("wins"))
        .where(F.col("opponent").isNotNull())
    )


def head_to_head_matrix(matches: DataFrame, opponents: Sequence[str] | None = None) -> DataFrame:
    """Wide form, one column per opponent. Without a list the opponents come from the (small) long form."""
    pairs = head_to_head(matches).groupBy("team").pivot("opponent", list(opponents) if opponents else None)
    return pairs.agg(F.sum("wins")).fillna(0)


# ---- results before a match ----


def team_appearances(matches: DataFrame) -> DataFrame:
    """(match_id, date, team, played, won, side) for every team of every decided match.

    A winner outside the two named teams still gets the win on its record (side 0); a team named
    twice gets one entry with two matches played.
    """
    won_by: Column = F.col("winner")

    def entry(team: Column, played: Column, won: Column, side: int) -> Column:
        return F.struct(team.alias("team"), played.alias("played"), won.alias("won"), F.lit(side).alias("side"))

    t1, t2 = F.col("team1"), F.col("team2")
    both_sides = F.when(same(t1, t2), F.array(entry(t1, F.lit(2), flag(won_by == t1), 1))).otherwise(
        F.array(entry(t1, F.lit(1), flag(won_by == t1), 1), entry(t2, F.lit(1), flag(won_by == t2), 2))
    )
    outside = entry(won_by, F.lit(0), F.lit(1), 0)
    entries = F.when(same(won_by, t1) | same(won_by, t2), both_sides).otherwise(F.array_append(both_sides, outside))
    rows = decided(matches).select(F.col("id").alias("match_id"), "date", F.explode(entries).alias("e"))
    return rows.select("match_id", "date", "e.*")


def prior_win_rates(matches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Win rate of both teams before each decided match, ordered by (date, id); 0 for a debut.

    One row per match: match_id, win_rate_team1, win_rate_team2, win_rate_diff.
    """
    rows = team_appearances(matches).withColumn("_day", date_key())
    record = prior_totals(
        rows, ["team"], ["_day", "match_id", "side"],
        {"wins_before": F.col("won"), "played_before": F.col("played")}, hot_rows,
    )
    rate = ratio("wins_before", F.greatest("played_before", F.lit(1)), 4)
    sides = record.where(F.col("side") > 0).select("match_id", "side", rate.alias("rate"))
    pair = sides.groupBy("match_id").agg(
        F.max(F.when(F.col("side") == 1, F.col("rate"))).alias("win_rate_team1"),
        F.max(F.when(F.col("side") == 2, F.col("rate"))).alias("_second"),
    )
    pair = pair.select(
        "match_id", "win_rate_team1", F.coalesce("_second", "win_rate_team1").alias("win_rate_team2")
    )
    return pair.withColumn("win_rate_diff", F.col("win_rate_team1") - F.col("win_rate_team2"))


def season_win_rates(matches: DataFrame) -> DataFrame:
    """Per (team, season): wins and matches over all seasons up to and including this one.

    Undecided matches count as played. One row per team and season.
    """
    sides = matches.select(
        "season", "winner", F.explode(F.array_distinct(F.array("team1", "team2"))).alias("team")
    )
    played = sides.groupBy("team", "season").agg(F.count(F.lit(1)).alias("played"))
    won = (
        decided(matches)
        .groupBy(F.col("winner").alias("team"), "season")
        .agg(F.count(F.lit(1)).alias("won"))
    )
    per_season = played.join(won, ["team", "season"], "full").fillna(0, ["played", "won"])
    upto = Window.partitionBy("team").orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    return per_season.select(
        "team", "season",
        F.sum("played").over(upto).alias("played"),
        F.sum("won").over(upto).alias("won"),
    )


def win_rate_before_season(requests: DataFrame, matches: DataFrame, team: str, out: str) -> DataFrame:
    """Win rate of ``team`` over all seasons earlier than the request's ``season``.

    As-of lookup: the history is one row per team and season, so the requests meet a small table.
    """
    history = season_win_rates(matches).select(
        F.col("team").alias("_team"),
        F.struct("season", "played", "won").alias("_h"),
    )
    history = history.groupBy("_team").agg(F.sort_array(F.collect_list("_h")).alias("_past"))
    if labels_are_few(matches, ["team1", "team2"]):
        history = F.broadcast(history)
    joined = requests.join(history, F.col(team) == F.col("_team"), "left")
    earlier = F.filter("_past", lambda h: h["season"] < F.col("season"))
    last = F.try_element_at(earlier, F.lit(-1))
    rate = F.coalesce(ratio(last["won"], last["played"], 4), F.lit(UNSEEN_TEAM_WIN_RATE))
    return joined.withColumn(out, rate).drop("_team", "_past")


# ---- match trends ----


def matches_per_season(matches: DataFrame) -> DataFrame:
    return _counted(matches, ["season"], "matches").orderBy("season")


def toss_decisions(matches: DataFrame) -> DataFrame:
    return _counted(matches, ["season", "toss_decision"], "count").orderBy("season", "toss_decision")


def _counted(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def toss_advantage(matches: DataFrame) -> DataFrame:
    """Decided matches split by whether the toss winner won."""
    helped = total(same("toss_winner", "winner"))
    counts = matches.agg(helped.alias("won_toss_and_match"), F.count("winner").alias("decided"))
    return counts.select(
        "decided", "won_toss_and_match",
        (F.col("decided") - F.col("won_toss_and_match")).alias("lost_after_winning_toss"),
    )


def top_venues(matches: DataFrame, top: int = 20) -> DataFrame:
    return _counted(matches, ["venue"], "matches").orderBy(F.desc("matches"), "venue").limit(top)


def top_awards(matches: DataFrame, top: int = 15) -> DataFrame:
    named = _counted(matches, ["player_of_match"], "awards")
    return named.withColumnRenamed("player_of_match", "player").orderBy(F.desc("awards"), "player").limit(top)


def team_wins(matches: DataFrame) -> DataFrame:
    won = _counted(matches, ["winner"], "wins").withColumnRenamed("winner", "team")
    return won.orderBy(F.desc("wins"), "team")


def biggest_wins(matches: DataFrame, by: str, top: int = 10) -> DataFrame:
    """``by`` is win_by_runs or win_by_wickets."""
    ordered = matches.where(F.col(by).isNotNull()).orderBy(F.desc(by), "id").limit(top)
    return ordered.select("id", "season", "team1", "team2", "winner", by, "venue")


def super_over_scores(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    scores = (
        deliveries.where(F.col("is_super_over") & F.col("batting_team").isNotNull())
        .groupBy("match_id", "batting_team")
        .agg(F.sum("total_runs").alias("runs"), total(F.col("is_wicket")).alias("wickets"))
    )
    winners = matches.select(F.col("id").alias("match_id"), "winner")
    return scores.join(winners, "match_id").withColumn("won", same("batting_team", "winner"))


def super_over_matches(deliveries: DataFrame) -> DataFrame:
    return deliveries.where("is_super_over").agg(F.countDistinct("match_id").alias("super_over_matches"))
