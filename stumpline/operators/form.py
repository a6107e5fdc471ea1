"""Player and team form: what each side brings into a match, from earlier matches only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import charged_runs, credited_wicket, ratio, regulation, rnd, total, totals_with_side
from stumpline.functions.ordered import HOT_ROWS, NO_DATE, date_key, trailing_mean
from stumpline.schema import FORM_COLUMNS, FORM_MATCHES
from stumpline.sources.staging import staged


def player_match_lines(deliveries: DataFrame) -> DataFrame:
    """(match_id, player, bats): batting and bowling totals of a match with the side, from one pass over the balls."""
    legal = F.col("is_legal_delivery")
    roles = F.array(
        F.struct(F.col("batsman").alias("player"), F.col("batting_team").alias("side"), F.lit(True).alias("bats")),
        F.struct(F.col("bowler").alias("player"), F.col("bowling_team").alias("side"), F.lit(False).alias("bats")),
    )
    balls = regulation(deliveries).select(
        "match_id", "inning", "over", "ball", "batsman_runs", "is_legal_delivery", "is_wicket",
        (legal & credited_wicket(deliveries)).alias("credited"),
        F.when(legal, charged_runs(deliveries)).alias("charged"), F.explode(roles).alias("role"),
    )
    return totals_with_side(
        balls.select("*", "role.*").drop("role").where(F.col("player").isNotNull()),
        ["match_id", "player", "bats"],
        "side",
        {
            "runs": F.sum("batsman_runs"),
            "balls": total(legal),
            "dismissals": total(F.col("is_wicket")),
            "wickets": total(F.col("credited")),
            "runs_conceded": F.sum("charged"),
        },
    ).withColumnRenamed("side", "team")


def _batting(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select(
        "match_id", "player", "team", *more,
        F.coalesce(ratio("runs", "dismissals"), F.col("runs").cast("double")).alias("bat_avg"),
        F.coalesce(ratio("runs", "balls", scale=100), F.lit(0.0)).alias("bat_sr"),
    )


def _bowling(lines: DataFrame, *more: str) -> DataFrame:
    return lines.where(F.col("balls") > 0).select(
        "match_id", "player", "team", *more,
        ratio("runs_conceded", F.col("balls") / 6).alias("bowl_econ"),
        F.coalesce(ratio("balls", "wickets"), F.col("balls").cast("double")).alias("bowl_sr"),
    )


def player_match_batting(deliveries: DataFrame) -> DataFrame:
    """(match_id, player): average and strike rate of that match, with the side played for."""
    per_match = totals_with_side(
        regulation(deliveries).where(F.col("batsman").isNotNull()),
        ["match_id", F.col("batsman").alias("player")],
        "batting_team",
        {
            "runs": F.sum("batsman_runs"),
            "balls": total(F.col("is_legal_delivery")),
            "dismissals": total(F.col("is_wicket")),
        },
    )
    return _batting(per_match.withColumnRenamed("batting_team", "team"))


def player_match_bowling(deliveries: DataFrame) -> DataFrame:
    """(match_id, player): economy and strike rate over legal balls; the side comes from all balls."""
    legal = F.col("is_legal_delivery")
    per_match = totals_with_side(
        regulation(deliveries).where(F.col("bowler").isNotNull()),
        ["match_id", F.col("bowler").alias("player")],
        "bowling_team",
        {
            "wickets": total(legal & credited_wicket(deliveries)),
            "runs_conceded": F.sum(F.when(legal, charged_runs(deliveries))),
            "balls": total(legal),
        },
    )
    return _bowling(per_match.withColumnRenamed("bowling_team", "team"))


def _dated(per_match: DataFrame, matches: DataFrame) -> DataFrame:
    """The reduced table with its place in time, staged: the rows are partitioned by match already,
    so the date joins without moving them, and the form below moves them once, to their player."""
    days = matches.select(F.col("id").alias("match_id"), date_key().alias("_day"))
    return staged(per_match.join(days, "match_id", "left"))


def _form(dated: DataFrame, columns: list[str], n: int, hot_rows: int) -> DataFrame:
    # a match that is not in the match table has no date and comes last
    rows = dated.withColumn("_day", F.coalesce("_day", F.lit(NO_DATE)))
    means = {f"rolling_{c}": c for c in columns}
    return trailing_mean(rows, ["player"], ["_day", "match_id"], means, n, hot_rows, sizing=dated).drop("_day")


def player_batting_form(
    deliveries: DataFrame, matches: DataFrame, n_matches: int = FORM_MATCHES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean of the last n matches before each match; a debutant gets the overall mean."""
    return _batting_form(_dated(player_match_batting(deliveries), matches), n_matches, hot_rows)


def _batting_form(per_match: DataFrame, n_matches: int, hot_rows: int) -> DataFrame:
    form = _form(per_match, ["bat_avg", "bat_sr"], n_matches, hot_rows)
    overall = per_match.agg(F.avg("bat_avg").alias("avg"), F.avg("bat_sr").alias("sr")).first()
    return form.withColumns(
        {
            "rolling_bat_avg": F.coalesce("rolling_bat_avg", F.lit(overall["avg"])),
            "rolling_bat_sr": F.coalesce("rolling_bat_sr", F.lit(overall["sr"])),
        }
    )


def player_bowling_form(
    deliveries: DataFrame, matches: DataFrame, n_matches: int = FORM_MATCHES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """As for batting; a debutant's strike rate is the overall median, not the mean."""
    return _bowling_form(_dated(player_match_bowling(deliveries), matches), n_matches, hot_rows)


def _bowling_form(per_match: DataFrame, n_matches: int, hot_rows: int) -> DataFrame:
    form = _form(per_match, ["bowl_econ", "bowl_sr"], n_matches, hot_rows)
    # one small job over the distinct strike rates gives the median, and the mean from their sums
    rates = per_match.groupBy("bowl_sr").agg(F.count(F.lit(1)).alias("n"), F.sum("bowl_econ").alias("e"))
    overall = rates.agg(
        ratio(F.sum("e"), F.sum("n")).alias("econ"), F.percentile("bowl_sr", F.lit(0.5), F.col("n")).alias("sr")
    ).first()
    return form.withColumns(
        {
            "rolling_bowl_econ": F.coalesce("rolling_bowl_econ", F.lit(overall["econ"])),
            "rolling_bowl_sr": F.coalesce("rolling_bowl_sr", F.lit(overall["sr"])),
        }
    )


def player_forms(
    deliveries: DataFrame, matches: DataFrame, n_matches: int = FORM_MATCHES, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Batting and bowling form, the balls read once for both."""
    lines = _dated(player_match_lines(deliveries), matches)
    batting, bowling = _batting(lines.where("bats"), "_day"), _bowling(lines.where("NOT bats"), "_day")
    return _batting_form(batting, n_matches, hot_rows), _bowling_form(bowling, n_matches, hot_rows)


def compute_team_rolling_form(
    deliveries: DataFrame,
    matches: DataFrame,
    n_matches: int = FORM_MATCHES,
    keep_partial: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean form of a side's players entering each match, one row per (match_id, team).

    ``keep_partial`` keeps sides with only batting or only bowling rows.
    """

    def side_mean(form: DataFrame, columns: list[str]) -> DataFrame:
        named = form.where(F.col("team").isNotNull())
        return named.groupBy("match_id", "team").agg(*[rnd(F.avg(c), 3).alias(c) for c in columns])

    batting, bowling = player_forms(deliveries, matches, n_matches, hot_rows)
    bat, bowl = side_mean(batting, FORM_COLUMNS[:2]), side_mean(bowling, FORM_COLUMNS[2:])
    both = bat.join(bowl, ["match_id", "team"], "outer")
    return both if keep_partial else both.dropna()


def latest_team_form(team_form: DataFrame) -> DataFrame:
    """Row of the highest match id per team."""
    newest = F.max_by(F.struct("match_id", *FORM_COLUMNS), "match_id").alias("r")
    return team_form.groupBy("team").agg(newest).select("team", "r.*")
