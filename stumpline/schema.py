"""Column contracts of the two base tables and the fixed values the results depend on."""

from __future__ import annotations

# ---- fixed values (must equal the published data conventions) ----

TEAM_CODES = {
    "Sunrisers Hyderabad": "SRH",
    "Mumbai Indians": "MI",
    "Gujarat Lions": "GL",
    "Rising Pune Supergiant": "RPS",
    "Rising Pune Supergiants": "RPS",
    "Royal Challengers Bangalore": "RCB",
    "Kolkata Knight Riders": "KKR",
    "Delhi Daredevils": "DD",
    "Delhi Capitals": "DC",
    "Kings XI Punjab": "KXIP",
    "Punjab Kings": "PBKS",
    "Chennai Super Kings": "CSK",
    "Rajasthan Royals": "RR",
    "Deccan Chargers": "DC_old",
    "Kochi Tuskers Kerala": "KTK",
    "Pune Warriors": "PW",
}

# dismissals that are not credited to the bowler
UNCREDITED_DISMISSALS = ("run out", "retired hurt", "obstructing the field")

# (label, first over, last over); an over outside 1..20 belongs to no phase
PHASES = (("Powerplay", 1, 6), ("Middle", 7, 15), ("Death", 16, 20))

INNINGS_BALLS = 120
INNINGS_OVERS = 20
FORM_MATCHES = 5

# stand-ins for a team with no recorded form when scoring a request
FORM_PRIORS = {
    "rolling_bat_avg": 25.0,
    "rolling_bat_sr": 120.0,
    "rolling_bowl_econ": 8.0,
    "rolling_bowl_sr": 20.0,
}
UNSEEN_TEAM_WIN_RATE = 0.5
SCORE_MARGIN = 13.0  # half-width of the score interval when no stored error is given

# ---- required columns ----

MATCH_REQUIRED = (
    "id", "season", "team1", "team2", "toss_winner", "toss_decision", "winner",
    "win_by_runs", "win_by_wickets", "player_of_match", "venue",
)
DELIVERY_REQUIRED = (
    "match_id", "inning", "batting_team", "bowling_team", "over", "ball", "batsman", "bowler",
    "is_super_over", "batsman_runs", "extra_runs", "total_runs", "player_dismissed",
)
EXTRAS = ("wide_runs", "bye_runs", "legbye_runs", "noball_runs", "penalty_runs", "extra_runs")
MATCH_TEAM_COLUMNS = ("team1", "team2", "toss_winner", "winner")
DELIVERY_TEAM_COLUMNS = ("batting_team", "bowling_team")


def _types(spec: str) -> dict[str, str]:
    return dict(field.split() for field in spec.split(", "))


MATCH_CSV = _types(
    "id BIGINT, season INT, city STRING, date STRING, team1 STRING, team2 STRING, "
    "toss_winner STRING, toss_decision STRING, result STRING, dl_applied INT, winner STRING, "
    "win_by_runs INT, win_by_wickets INT, player_of_match STRING, venue STRING, "
    "umpire1 STRING, umpire2 STRING, umpire3 STRING"
)
DELIVERY_CSV = _types(
    "match_id BIGINT, inning INT, batting_team STRING, bowling_team STRING, over INT, ball INT, "
    "batsman STRING, non_striker STRING, bowler STRING, is_super_over INT, wide_runs INT, "
    "bye_runs INT, legbye_runs INT, noball_runs INT, penalty_runs INT, batsman_runs INT, "
    "extra_runs INT, total_runs INT, player_dismissed STRING, dismissal_kind STRING, fielder STRING"
)

# ---- feature lists (order matters to the models) ----

MATCH_FEATURES_V1 = ["toss_winner_is_team1", "bat_first", "venue_enc", "team1_enc", "team2_enc", "season"]
MATCH_FEATURES_V2 = MATCH_FEATURES_V1 + ["win_rate_team1", "win_rate_team2", "win_rate_diff"]
MATCH_FEATURES_V3 = MATCH_FEATURES_V2 + [
    "team1_rolling_bat_avg", "team1_rolling_bat_sr", "team2_rolling_bat_avg", "team2_rolling_bat_sr",
    "team1_rolling_bowl_econ", "team1_rolling_bowl_sr", "team2_rolling_bowl_econ", "team2_rolling_bowl_sr",
    "rolling_bat_avg_diff", "rolling_bat_sr_diff", "rolling_bowl_econ_diff",
]
WIN_PROB_FEATURES = [
    "over", "runs_scored", "wickets_fallen", "current_rr", "required_rr", "balls_remaining",
    "runs_required", "venue_enc", "batting_team_enc",
]
SCORE_FEATURES = [
    "runs_10", "wickets_10", "current_rr", "projected_score", "scoring_pressure", "boundaries_10",
    "batting_team_enc", "venue_enc", "season",
]
AWARD_FEATURES = [
    "runs_scored", "balls_faced", "strike_rate", "wickets_taken", "runs_given", "economy", "player_won",
]
STEP_FEATURES = [
    "runs_in_over", "wickets_in_over", "cum_runs", "cum_wickets", "current_rr", "boundaries_in_over",
    "balls_in_over",
]
STATIC_FEATURES = ["batting_team_enc", "venue_enc", "season_norm"]
FORM_COLUMNS = ["rolling_bat_avg", "rolling_bat_sr", "rolling_bowl_econ", "rolling_bowl_sr"]
