"""Venue and season scoring levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stumpline.functions.exprs import boundary, first_innings, ratio, regulation, rnd, total, totals_with_side


def first_innings_scores(deliveries: DataFrame) -> DataFrame:
    return first_innings(deliveries).groupBy("match_id").agg(F.sum("total_runs").alias("first_innings_score"))


def venue_par_scores(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean and exact median first-innings total per venue."""
    at = matches.select(F.col("id").alias("match_id"), "venue").where(F.col("venue").isNotNull())
    scored = first_innings_scores(deliveries).join(at, "match_id")
    # scores are small integers: the venue groups meet as (score, count) pairs
    counts = scored.groupBy("venue", "first_innings_score").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("first_innings_score")
    return (
        counts.groupBy("venue")
        .agg(
            F.sum(score * F.col("n")).alias("_runs"),
            F.percentile("first_innings_score", F.lit(0.5), F.col("n")).alias("_median"),
            F.sum("n").alias("matches_hosted"),
        )
        .select(
            "venue",
            ratio("_runs", "matches_hosted", 1).alias("avg_first_innings"),
            rnd("_median", 1).alias("median_first_innings"),
            "matches_hosted",
        )
        .orderBy(F.desc("avg_first_innings"), "venue")
    )


def over_ten_snapshot(deliveries: DataFrame) -> DataFrame:
    """State of each first innings after ten overs, with its final score, from one pass."""
    early = F.col("over") <= 10
    # the side is the one that bats in these ten overs
    balls = first_innings(deliveries).withColumn("batting_team", F.when(early, F.col("batting_team")))
    return (
        totals_with_side(
            balls,
            ["match_id"],
            "batting_team",
            {
                "_balls_10": total(early),
                "runs_10": F.sum(F.when(early, F.col("total_runs"))),
                "wickets_10": total(early & F.col("is_wicket")),
                "boundaries_10": total(early & boundary()),
                "final_score": F.sum("total_runs"),
            },
        )
        .where(F.col("_balls_10") > 0)
        .drop("_balls_10")
    )


def venue_run_rates(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """All-time mean run rate over the first ten overs per venue, three places."""
    runs = (
        first_innings(deliveries)
        .where(F.col("over") <= 10)
        .groupBy("match_id")
        .agg(F.sum("total_runs").alias("runs_10"))
    )
    at = matches.select(F.col("id").alias("match_id"), "venue").where(F.col("venue").isNotNull())
    return (
        runs.join(at, "match_id")
        .groupBy("venue")
        .agg(F.sum("runs_10").alias("_runs"), F.count(F.lit(1)).alias("_n"))
        .select("venue", ratio("_runs", F.col("_n") * 10, 3).alias("venue_avg_rr"))
    )


def overall_run_rate(deliveries: DataFrame) -> DataFrame:
    """One row: mean run rate over the first ten overs of all first innings."""
    early = first_innings(deliveries).where(F.col("over") <= 10)
    per_match = early.groupBy("match_id").agg(F.sum("total_runs").alias("r"))
    return per_match.agg(ratio(F.sum("r"), F.count("r") * 10).alias("global_avg_rr"))


def season_trend(deliveries: DataFrame, matches: DataFrame) -> DataFrame:
    """Run rate and six rate per season; balls are added up per match before the season is attached."""
    per_match = (
        regulation(deliveries)
        .groupBy("match_id")
        .agg(
            F.sum("total_runs").alias("total_runs"),
            total(F.col("is_legal_delivery")).alias("total_balls"),
            total(F.col("batsman_runs") == 6).alias("total_sixes"),
            total(F.col("batsman_runs") == 4).alias("total_fours"),
        )
    )
    dated = matches.select(F.col("id").alias("match_id"), "season").where(F.col("season").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("total_runs", "total_balls", "total_sixes", "total_fours")]
    return (
        per_match.join(dated, "match_id")
        .groupBy("season")
        .agg(*sums)
        .withColumns(
            {
                "avg_run_rate": ratio("total_runs", F.col("total_balls") / 6, 2),
                "six_rate": rnd(ratio("total_sixes", "total_balls") * 6, 3),
            }
        )
        .orderBy("season")
    )
