"""The checked queries written as plain SQL, without any of the engine's code.

Every statement starts from the raw projection, cleans it, and computes the answer directly.
"""

from __future__ import annotations

from stumpline.schema import TEAM_CODES
from stumpline.sources.fixtures import FIXTURE_SQL


def _code(column: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in TEAM_CODES.items())
    return f"CASE {column} {cases} ELSE {column} END"


CLEAN = f"""{FIXTURE_SQL},
matches AS MATERIALIZED (
  SELECT id, season, coalesce(city, trim(str_split(venue, ',')[-1])) AS city, date,
         {_code('team1')} AS team1, {_code('team2')} AS team2, {_code('toss_winner')} AS toss_winner, toss_decision,
         {_code('winner')} AS winner, win_by_runs::BIGINT AS win_by_runs, win_by_wickets::BIGINT AS win_by_wickets,
         player_of_match, venue, coalesce(toss_winner = winner, false) AS toss_match_winner
  FROM matches_csv),
deliveries AS MATERIALIZED (
  SELECT match_id, inning, {_code('batting_team')} AS batting_team, {_code('bowling_team')} AS bowling_team,
         over, ball, batsman, non_striker, bowler, is_super_over = 1 AS is_super_over,
         wide_runs, bye_runs, legbye_runs, noball_runs, penalty_runs, batsman_runs, player_dismissed, dismissal_kind,
         extra_runs, total_runs, wide_runs = 0 AND noball_runs = 0 AS is_legal_delivery,
         player_dismissed IS NOT NULL AS is_wicket
  FROM deliveries_csv),
reg AS (SELECT * FROM deliveries WHERE NOT is_super_over)"""


def _n(expr: str) -> str:
    return f"count(*) FILTER (WHERE {expr})"


def _div(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def _r(expr: str, places: int) -> str:
    return f"round_even({expr}, {places})"


def _pct(a: str, b: str, places: int) -> str:
    return _r(f"{_div(a, b)} * 100", places)


LEGAL = "is_legal_delivery"
CREDITED = "(player_dismissed IS NOT NULL AND coalesce(dismissal_kind NOT IN ('run out', 'retired hurt', 'obstructing the field'), true))"
CHARGED = "(total_runs - bye_runs - legbye_runs)"
PHASE = "CASE WHEN over BETWEEN 1 AND 6 THEN 'Powerplay' WHEN over BETWEEN 7 AND 15 THEN 'Middle' WHEN over BETWEEN 16 AND 20 THEN 'Death' END"

BAT_CAREER = f"""bat_career AS (
  SELECT *, {_pct('runs', 'balls_faced', 2)} AS strike_rate, {_r(_div('runs', 'dismissals'), 2)} AS average,
         {_pct('dot_balls', 'balls_faced', 2)} AS dot_ball_pct, {_pct('boundary_runs', 'runs', 2)} AS boundary_pct
  FROM (SELECT *, fours * 4 + sixes * 6 AS boundary_runs FROM (
    SELECT batsman, sum(batsman_runs)::BIGINT AS runs, {_n(LEGAL)} AS balls_faced, {_n('batsman_runs = 4')} AS fours,
           {_n('batsman_runs = 6')} AS sixes, {_n('is_wicket')} AS dismissals,
           {_n(LEGAL + ' AND batsman_runs = 0')} AS dot_balls, count(DISTINCT match_id) AS matches
    FROM reg GROUP BY batsman)))"""

BOWL_CAREER = f"""bowl_career AS (
  SELECT *, {_r(_div('runs_conceded', 'overs_bowled'), 2)} AS economy, {_r(_div('runs_conceded', 'wickets'), 2)} AS average,
         {_r(_div('balls_bowled', 'wickets'), 2)} AS strike_rate, {_pct('dot_balls', 'balls_bowled', 2)} AS dot_ball_pct
  FROM (SELECT *, {_r('balls_bowled / 6.0::DOUBLE', 2)} AS overs_bowled FROM (
    SELECT bowler, {_n('is_wicket')} AS wickets, sum(total_runs)::BIGINT AS runs_conceded, count(*) AS balls_bowled,
           {_n('total_runs = 0')} AS dot_balls, count(DISTINCT match_id) AS matches
    FROM reg WHERE {LEGAL} GROUP BY bowler)))"""

BAT_PHASE = f"""bat_phase AS (
  SELECT p.batsman, ph.phase, coalesce(runs, 0)::BIGINT AS runs, coalesce(balls, 0)::BIGINT AS balls, sixes,
         {_pct('runs', 'balls', 2)} AS strike_rate
  FROM (SELECT DISTINCT batsman FROM reg) p CROSS JOIN (VALUES ('Powerplay'), ('Middle'), ('Death')) ph(phase)
  LEFT JOIN (SELECT batsman, {PHASE} AS phase, sum(batsman_runs) AS runs, {_n(LEGAL)} AS balls, {_n('batsman_runs = 6')} AS sixes
             FROM reg GROUP BY 1, 2) a ON a.batsman = p.batsman AND a.phase = ph.phase)"""

BOWL_PHASE = f"""bowl_phase AS (
  SELECT p.bowler, ph.phase, coalesce(runs, 0)::BIGINT AS runs, coalesce(balls, 0)::BIGINT AS balls,
         coalesce(wickets, 0)::BIGINT AS wickets, {_r(_div('runs', 'balls / 6.0::DOUBLE'), 2)} AS economy
  FROM (SELECT DISTINCT bowler FROM reg WHERE {LEGAL}) p CROSS JOIN (VALUES ('Powerplay'), ('Middle'), ('Death')) ph(phase)
  LEFT JOIN (SELECT bowler, {PHASE} AS phase, sum(total_runs) AS runs, count(*) AS balls, {_n('is_wicket')} AS wickets
             FROM reg WHERE {LEGAL} GROUP BY 1, 2) a ON a.bowler = p.bowler AND a.phase = ph.phase)"""


def _busiest(table: str, player: str, least: int) -> str:
    return f"""SELECT * FROM {table} WHERE balls >= {least} AND {player} IN (
      SELECT {player} FROM {table} WHERE balls >= {least} GROUP BY {player} ORDER BY sum(balls) DESC, {player} LIMIT 20)"""


PLAYER_MATCH = f"""bat_match AS (
  SELECT match_id, batsman AS player, min_by(batting_team, inning * 10000 + over * 100 + ball) AS team,
         CASE WHEN {_n('is_wicket')} > 0 THEN sum(batsman_runs)::DOUBLE / {_n('is_wicket')} ELSE sum(batsman_runs)::DOUBLE END AS bat_avg,
         CASE WHEN {_n(LEGAL)} > 0 THEN sum(batsman_runs)::DOUBLE / {_n(LEGAL)} * 100 ELSE 0 END AS bat_sr
  FROM reg GROUP BY match_id, batsman),
bowl_match AS (
  SELECT match_id, player, team, runs / (balls / 6.0::DOUBLE) AS bowl_econ,
         CASE WHEN wickets > 0 THEN balls::DOUBLE / wickets ELSE balls::DOUBLE END AS bowl_sr
  FROM (SELECT match_id, bowler AS player, min_by(bowling_team, inning * 10000 + over * 100 + ball) AS team,
               sum({CHARGED}) FILTER (WHERE {LEGAL})::DOUBLE AS runs, {_n(LEGAL)} AS balls, {_n(f'{LEGAL} AND {CREDITED}')} AS wickets
        FROM reg GROUP BY match_id, bowler) WHERE balls > 0)"""

FORM = f"""{PLAYER_MATCH},
bat_form AS (
  SELECT b.match_id, b.player, b.team,
         coalesce(avg(bat_avg) OVER w, (SELECT avg(bat_avg) FROM bat_match)) AS rolling_bat_avg,
         coalesce(avg(bat_sr) OVER w, (SELECT avg(bat_sr) FROM bat_match)) AS rolling_bat_sr
  FROM bat_match b LEFT JOIN matches m ON m.id = b.match_id
  WINDOW w AS (PARTITION BY player ORDER BY m.date NULLS LAST, b.match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
bowl_form AS (
  SELECT b.match_id, b.player, b.team,
         coalesce(avg(bowl_econ) OVER w, (SELECT avg(bowl_econ) FROM bowl_match)) AS rolling_bowl_econ,
         coalesce(avg(bowl_sr) OVER w, (SELECT quantile_cont(bowl_sr, 0.5) FROM bowl_match)) AS rolling_bowl_sr
  FROM bowl_match b LEFT JOIN matches m ON m.id = b.match_id
  WINDOW w AS (PARTITION BY player ORDER BY m.date NULLS LAST, b.match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
team_form AS MATERIALIZED (
  SELECT * FROM (SELECT match_id, team, {_r('avg(rolling_bat_avg)', 3)} AS rolling_bat_avg, {_r('avg(rolling_bat_sr)', 3)} AS rolling_bat_sr
                 FROM bat_form GROUP BY match_id, team)
  JOIN (SELECT match_id, team, {_r('avg(rolling_bowl_econ)', 3)} AS rolling_bowl_econ, {_r('avg(rolling_bowl_sr)', 3)} AS rolling_bowl_sr
        FROM bowl_form GROUP BY match_id, team) USING (match_id, team))"""

PRIOR = f"""decided AS (SELECT * FROM matches WHERE winner IS NOT NULL),
sides AS (SELECT id, date, team1 AS team, 1 AS side, (winner = team1)::INT AS won FROM decided
          UNION ALL SELECT id, date, team2, 2, (winner = team2)::INT FROM decided),
rates AS (SELECT id, side, coalesce({_r(_div('sum(won) OVER w', 'count(*) OVER w'), 4)}, 0) AS rate FROM sides
          WINDOW w AS (PARTITION BY team ORDER BY date NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prior AS (SELECT a.id AS match_id, a.rate AS win_rate_team1, b.rate AS win_rate_team2, a.rate - b.rate AS win_rate_diff
          FROM rates a JOIN rates b ON a.id = b.id AND a.side = 1 AND b.side = 2),
match_v1 AS MATERIALIZED (
  SELECT id AS match_id, coalesce(toss_winner = team1, false)::INT AS toss_winner_is_team1,
         coalesce(toss_decision = 'bat', false)::INT AS bat_first,
         (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc, (dense_rank() OVER (ORDER BY team1) - 1)::INT AS team1_enc,
         (dense_rank() OVER (ORDER BY team2) - 1)::INT AS team2_enc, season, (winner = team1)::INT AS team1_won FROM decided),
match_v2 AS MATERIALIZED (
  SELECT v.* EXCLUDE (team1_won), win_rate_team1, win_rate_team2, {_r('win_rate_diff', 4)} AS win_rate_diff, team1_won
  FROM match_v1 v JOIN prior USING (match_id))"""

SEQ = f"""seq AS MATERIALIZED (
  SELECT o.match_id, over, runs_in_over, wickets_in_over, (sum(runs_in_over) OVER w)::BIGINT AS cum_runs,
         (sum(wickets_in_over) OVER w)::BIGINT AS cum_wickets,
         {_r(_div('sum(runs_in_over) OVER w', 'over'), 3)} AS current_rr, boundaries_in_over, balls_in_over,
         batting_team, venue, season, (sum(runs_in_over) OVER (PARTITION BY o.match_id))::BIGINT AS final_score
  FROM (SELECT match_id, over, sum(total_runs)::BIGINT AS runs_in_over, {_n('is_wicket')} AS wickets_in_over,
               {_n('batsman_runs IN (4, 6)')} AS boundaries_in_over, {_n(LEGAL)} AS balls_in_over,
               min_by(batting_team, ball) AS batting_team
        FROM reg WHERE inning = 1 GROUP BY match_id, over) o JOIN matches m ON m.id = o.match_id
  WINDOW w AS (PARTITION BY o.match_id ORDER BY over))"""

WIN = f"""chase AS (
  SELECT match_id, over, batting_team, sum(r) OVER w AS runs_scored, sum(k) OVER w AS wickets_fallen
  FROM (SELECT match_id, over, sum(total_runs) AS r, {_n('is_wicket')} AS k, min_by(batting_team, ball) AS batting_team
        FROM reg WHERE inning = 2 GROUP BY match_id, over) WINDOW w AS (PARTITION BY match_id ORDER BY over)),
chase_all AS (
  SELECT c.*, t.target - runs_scored AS need, m.winner, m.venue,
         (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc, (dense_rank() OVER (ORDER BY batting_team) - 1)::INT AS batting_team_enc
  FROM chase c JOIN (SELECT match_id, sum(total_runs) + 1 AS target FROM deliveries WHERE inning = 1 GROUP BY match_id) t USING (match_id)
  JOIN matches m ON m.id = c.match_id),
win AS MATERIALIZED (
  SELECT over, runs_scored::BIGINT AS runs_scored, wickets_fallen::BIGINT AS wickets_fallen,
         {_r(_div('runs_scored', 'over'), 2)} AS current_rr, {_r(_div('need', '(120 - over * 6) / 6.0::DOUBLE'), 2)} AS required_rr,
         120 - over * 6 AS balls_remaining, need::BIGINT AS runs_required, venue_enc, batting_team_enc,
         coalesce(batting_team = winner, false)::INT AS batting_team_won, match_id
  FROM chase_all WHERE 120 - over * 6 <> 0)"""

HALF = f"""half AS (
  SELECT match_id, (sum(total_runs) FILTER (WHERE over <= 10))::BIGINT AS runs_10, {_n('over <= 10 AND is_wicket')} AS wickets_10,
         {_n('over <= 10 AND batsman_runs IN (4, 6)')} AS boundaries_10, min_by(batting_team, over * 100 + ball) AS batting_team,
         sum(total_runs)::BIGINT AS final_score
  FROM reg WHERE inning = 1 GROUP BY match_id)"""

SCORE = f"""{HALF},
half_rr AS (SELECT h.*, {_r('runs_10 / 10.0::DOUBLE', 3)} AS current_rr, m.venue, m.season, m.date FROM half h JOIN matches m ON m.id = h.match_id),
half_pr AS (
  SELECT *, coalesce({_r(_div('sum(runs_10) OVER w', 'count(*) OVER w * 10'), 3)}, (SELECT avg(runs_10) / 10 FROM half)) AS venue_rr,
         (dense_rank() OVER (ORDER BY batting_team) - 1)::INT AS batting_team_enc, (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc
  FROM half_rr WINDOW w AS (PARTITION BY venue ORDER BY date NULLS LAST, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
score AS MATERIALIZED (
  SELECT match_id, runs_10, wickets_10, current_rr, {_r('current_rr * 20', 1)} AS projected_score,
         {_r('current_rr - venue_rr', 3)} AS scoring_pressure, boundaries_10, batting_team_enc, venue_enc, season, final_score
  FROM half_pr)"""

AWARD = f"""bat_line AS (SELECT match_id, batsman AS player, sum(batsman_runs) AS runs, {_n(LEGAL)} AS balls,
                    min_by(batting_team, inning * 10000 + over * 100 + ball) AS team FROM reg GROUP BY 1, 2),
bowl_team AS (SELECT match_id, bowler AS player, min_by(bowling_team, inning * 10000 + over * 100 + ball) AS team FROM reg GROUP BY 1, 2),
bowl_line AS (SELECT match_id, bowler AS player, {_n('is_wicket')} AS wickets, sum(total_runs) AS runs, count(*) AS balls
              FROM reg WHERE {LEGAL} GROUP BY 1, 2),
who AS (SELECT match_id, player FROM bat_line UNION SELECT match_id, player FROM bowl_line),
lines AS MATERIALIZED (
  SELECT w.match_id, w.player, coalesce(b.runs, 0)::BIGINT AS runs_scored, coalesce(b.balls, 0)::BIGINT AS balls_faced,
         coalesce(o.wickets, 0)::BIGINT AS wickets_taken, coalesce(o.runs, 0)::BIGINT AS runs_given,
         coalesce(o.balls, 0)::BIGINT AS balls_bowled, coalesce(b.team, t.team) AS team
  FROM who w LEFT JOIN bat_line b USING (match_id, player) LEFT JOIN bowl_line o USING (match_id, player)
  LEFT JOIN bowl_team t USING (match_id, player)),
award AS MATERIALIZED (
  SELECT l.match_id, l.player, runs_scored, balls_faced, coalesce({_div('runs_scored', 'balls_faced')} * 100, 0) AS strike_rate,
         wickets_taken, runs_given, coalesce({_div('runs_given', 'balls_bowled / 6.0::DOUBLE')}, 0) AS economy,
         coalesce(l.team = m.winner, false)::INT AS player_won, coalesce(l.player = m.player_of_match, false)::INT AS is_potm
  FROM lines l LEFT JOIN matches m ON m.id = l.match_id)"""

HISTORY = """played AS (SELECT season, winner, unnest([team1, team2]) AS team FROM matches)"""


def _rate_before(request: str, team: str) -> str:
    return f"""coalesce({_r(_div(f"(SELECT count(*) FROM played p WHERE p.team = {request}.{team} AND p.winner = p.team AND p.season < {request}.season)",
        f"(SELECT count(*) FROM played p WHERE p.team = {request}.{team} AND p.season < {request}.season)"), 4)}, 0.5)"""


RATED = f"""rated AS MATERIALIZED (
  SELECT match_id, team1_won, coalesce({_div('win_rate_team1', 'win_rate_team1 + win_rate_team2')}, 0.5) AS score FROM match_v2)"""

LEVELS = f"""{PRIOR}, {RATED},
levels AS (SELECT score, {_n('team1_won = 1')} AS pos, {_n('team1_won = 0')} AS neg FROM rated GROUP BY score),
ranked AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_above, coalesce(sum(neg) OVER w, 0) AS neg_above FROM levels
           WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

LATEST = "latest AS (SELECT * FROM team_form f WHERE match_id = (SELECT max(match_id) FROM team_form g WHERE g.team = f.team))"


def _by_match_batting(extra: str = "") -> str:
    return f"""FROM reg r JOIN matches m ON m.id = r.match_id WHERE true {extra}"""


def _null_rows(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {table}" for c in columns
    )


def _range_rows(table: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {t}) AS violations FROM {table}" for c, t in tests.items()
    )


def _z(column: str) -> str:
    return _r(f"({column} - (SELECT avg({column}) FROM seq_split WHERE NOT is_test)) / (SELECT CASE WHEN stddev_samp({column}) < 1e-6 THEN 1 ELSE stddev_samp({column}) END FROM seq_split WHERE NOT is_test)", 6)


STEP = ["runs_in_over", "wickets_in_over", "cum_runs", "cum_wickets", "current_rr", "boundaries_in_over", "balls_in_over"]
SEQ_SPLIT = f"""{SEQ},
seq_ids AS (SELECT match_id, row_number() OVER (ORDER BY match_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT match_id FROM seq)),
seq_split AS MATERIALIZED (SELECT s.*, k > n - floor(n * 0.2::DOUBLE) AS is_test FROM seq s JOIN seq_ids USING (match_id))"""

NAMED = "('Mumbai Indians P1', 'Mumbai Indians P5', 'Chennai Super Kings P3')"


def _player_batting(season: str, names: str = "") -> str:
    bats = f"AND batsman IN {names}" if names else ""
    outs = f"AND player_dismissed IN {names}" if names else ""
    return f"""b AS (SELECT batsman AS player, count(DISTINCT match_id) AS matches, sum(batsman_runs)::BIGINT AS runs, {_n(LEGAL)} AS balls,
         {_n('batsman_runs = 4')} AS fours, {_n('batsman_runs = 6')} AS sixes, {_n(LEGAL + ' AND batsman_runs = 0')} AS dots,
         {_n('batsman_runs = 1')} AS ones, {_n('batsman_runs = 2')} AS twos {_by_match_batting(season + bats)} GROUP BY 1),
      o AS (SELECT player_dismissed AS player, count(*) AS dismissals {_by_match_batting(season + outs)} AND player_dismissed IS NOT NULL GROUP BY 1)
      SELECT b.*, coalesce(dismissals, 0) AS dismissals, coalesce({_pct('runs', 'balls', 2)}, 0) AS strike_rate,
         coalesce({_r(_div('runs', 'dismissals'), 2)}, runs::DOUBLE) AS average, coalesce({_pct('dots', 'balls', 1)}, 0) AS dot_pct,
         coalesce({_pct('fours + sixes', 'balls', 1)}, 0) AS boundary_pct FROM b LEFT JOIN o USING (player)"""


BOWL_TOTALS = f"""count(DISTINCT match_id) AS matches, {_n(CREDITED)} AS wickets, sum({CHARGED})::BIGINT AS runs_conceded, {_n(LEGAL)} AS legal"""
BETWEEN = "AND season BETWEEN 1993 AND 1997 "
OVER_ECON = f"{_r('runs_conceded / greatest(legal / 6.0::DOUBLE, 1)', 2)} AS economy"
OVERS_1 = f"{_r('legal / 6.0::DOUBLE', 1)} AS overs"

# name -> (extra steps after the cleaned tables, final select)
_QUERIES: dict[str, tuple[list[str], str]] = {
    "load_matches": ([], "SELECT * FROM matches"),
    "load_deliveries": ([], "SELECT * FROM deliveries"),
    "parquet_roundtrip": ([], "SELECT * FROM matches"),
    "backfill_derived": ([], "SELECT match_id, inning, over, ball, is_legal_delivery, is_wicket FROM deliveries"),
    "over_index_check": ([], "SELECT min(over) AS over_min, max(over) AS over_max, CASE WHEN min(over) = 0 THEN 'zero_indexed' WHEN min(over) <> 1 THEN 'unexpected_minimum' ELSE 'ok' END AS status FROM deliveries"),
    "null_report": ([], _null_rows("matches", ["id", "season", "city", "team1", "winner", "venue", "date"])),
    "range_report": ([FORM], _range_rows("team_form", {
        "rolling_bat_avg": "rolling_bat_avg < 0 OR rolling_bat_avg > 80", "rolling_bat_sr": "rolling_bat_sr < 0",
        "rolling_bowl_econ": "rolling_bowl_econ < 2 OR rolling_bowl_econ > 25", "rolling_bowl_sr": "rolling_bowl_sr < 0 OR rolling_bowl_sr > 20"})),
    "value_report": ([], " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE length({c}) > 6) AS found FROM matches"
        for c in ("team1", "team2", "toss_winner", "winner"))),
    "label_encode": ([], """SELECT id, venue, team1, winner, (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc,
        (dense_rank() OVER (ORDER BY team1) - 1)::INT AS team1_enc,
        CASE WHEN winner IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY winner NULLS LAST) - 1 END::INT AS winner_enc FROM matches"""),
    "encode_union": ([], "SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS code FROM (SELECT team1 AS label FROM matches UNION SELECT team2 FROM matches)"),
    "encode_unknown": ([], """SELECT id, winner, venue, CASE WHEN winner IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY winner NULLS LAST) - 1 END::INT AS winner_zero,
        CASE WHEN winner IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY winner NULLS LAST) - 1 END::INT AS winner_minus, -1 AS venue_minus FROM matches"""),
    "sequence_norm": ([SEQ_SPLIT], f"""SELECT match_id, over, is_test, {', '.join(f'{_z(c)} AS {c}' for c in STEP)},
        (dense_rank() OVER (ORDER BY batting_team) - 1)::INT AS batting_team_enc, (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc,
        {_r('(season - min(season) OVER ())::DOUBLE / greatest(max(season) OVER () - min(season) OVER (), 1)', 6)} AS season_norm, final_score FROM seq_split"""),
    "dataset_profile": ([], """SELECT (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM deliveries) AS deliveries,
        (SELECT count(DISTINCT t) FROM (SELECT team1 AS t FROM matches UNION ALL SELECT team2 FROM matches)) AS teams,
        (SELECT count(DISTINCT venue) FROM matches) AS venues, (SELECT count(DISTINCT season) FROM matches) AS seasons,
        (SELECT count(DISTINCT batsman) FROM deliveries) AS batsmen, (SELECT count(DISTINCT bowler) FROM deliveries) AS bowlers"""),
    "health_listing": ([], """SELECT DISTINCT kind, name FROM (SELECT 'team' AS kind, unnest([team1, team2]) AS name FROM matches
        UNION ALL SELECT 'venue', venue FROM matches) WHERE name IS NOT NULL"""),
    "batting_career": ([BAT_CAREER], "SELECT * FROM bat_career"),
    "batting_phase": ([BAT_PHASE], "SELECT * FROM bat_phase"),
    "bowling_career": ([BOWL_CAREER], "SELECT * FROM bowl_career"),
    "bowling_phase": ([BOWL_PHASE], "SELECT * FROM bowl_phase"),
    "partnerships": ([], f"""SELECT player1, player2, sum(runs)::BIGINT AS total_runs, count(*) AS partnerships, {_r('avg(runs)', 1)} AS avg_partnership
        FROM (SELECT match_id, inning, least(batsman, non_striker) AS player1, greatest(batsman, non_striker) AS player2, sum(batsman_runs) AS runs
              FROM reg GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""),
    "player_batting": ([], "WITH " + _player_batting("")),
    "player_batting_named": ([], "WITH " + _player_batting(BETWEEN, NAMED)),
    "player_batting_season": ([], f"""SELECT *, {_r('runs::DOUBLE / greatest(balls, 1) * 100', 1)} AS strike_rate FROM (
        SELECT batsman AS player, season, sum(batsman_runs)::BIGINT AS runs, {_n(LEGAL)} AS balls, count(DISTINCT match_id) AS matches
        {_by_match_batting('')} GROUP BY 1, 2)"""),
    "player_bowling": ([], f"""SELECT player, matches, wickets, runs_conceded, {OVERS_1},
        CASE WHEN legal >= 6 THEN {_r('runs_conceded / (legal / 6.0::DOUBLE)', 2)} ELSE 0 END AS economy,
        CASE WHEN wickets > 0 THEN {_r(_div('runs_conceded', 'wickets'), 2)} ELSE 'inf'::DOUBLE END AS average,
        CASE WHEN wickets > 0 THEN {_r(_div('legal', 'wickets'), 2)} ELSE 'inf'::DOUBLE END AS strike_rate,
        coalesce({_pct('dots', 'legal', 1)}, 0) AS dot_pct
        FROM (SELECT bowler AS player, {BOWL_TOTALS}, {_n(LEGAL + ' AND total_runs = 0')} AS dots {_by_match_batting()} GROUP BY 1)"""),
    "player_bowling_season": ([], f"""SELECT *, {OVERS_1}, {OVER_ECON} FROM (SELECT bowler AS player, season, {BOWL_TOTALS} {_by_match_batting('')} GROUP BY 1, 2)"""),
    "leaderboard_bat": ([], f"""SELECT *, {_r('runs::DOUBLE / greatest(balls, 1) * 100', 1)} AS strike_rate FROM (
        SELECT batsman AS player, sum(batsman_runs)::BIGINT AS runs, {_n(LEGAL)} AS balls, {_n('batsman_runs = 4')} AS fours,
        {_n('batsman_runs = 6')} AS sixes, count(DISTINCT match_id) AS matches FROM reg GROUP BY 1) WHERE balls >= 50 ORDER BY runs DESC, player LIMIT 15"""),
    "leaderboard_bowl": ([], f"""SELECT *, {OVERS_1}, {OVER_ECON} FROM (SELECT bowler AS player, {BOWL_TOTALS} FROM reg GROUP BY 1)
        WHERE legal >= 60 ORDER BY wickets DESC, player LIMIT 15"""),
    "all_players": ([], "SELECT batsman AS player FROM deliveries UNION SELECT bowler FROM deliveries"),
    "top_batters": ([BAT_CAREER], "SELECT * FROM bat_career WHERE balls_faced >= 200 ORDER BY runs DESC, batsman LIMIT 15"),
    "top_bowlers": ([BOWL_CAREER], "SELECT * FROM bowl_career WHERE balls_bowled >= 300 ORDER BY wickets DESC, bowler LIMIT 15"),
    "dot_pressure": ([BAT_CAREER], "SELECT * FROM bat_career WHERE balls_faced >= 200 ORDER BY dot_ball_pct DESC, batsman LIMIT 15"),
    "phase_top20_bat": ([BAT_PHASE], _busiest("bat_phase", "batsman", 30)),
    "phase_top20_bowl": ([BOWL_PHASE], _busiest("bowl_phase", "bowler", 24)),
    "qualified_medians": ([BAT_CAREER, BOWL_CAREER], " UNION ALL ".join(
        f"SELECT '{role}' AS role, '{m}' AS metric, {_r(f'quantile_cont({m}, 0.5)', 4)} AS median FROM {t} WHERE {b} >= 300"
        for role, t, b, m in (("batting", "bat_career", "balls_faced", "strike_rate"), ("batting", "bat_career", "balls_faced", "average"),
                              ("bowling", "bowl_career", "balls_bowled", "economy"), ("bowling", "bowl_career", "balls_bowled", "strike_rate")))),
    "player_team": ([], """SELECT match_id, player, min_by(team, k) AS team FROM (
        SELECT match_id, batsman AS player, batting_team AS team, inning * 10000 + over * 100 + ball AS k FROM reg
        UNION ALL SELECT match_id, bowler, bowling_team, 1000000 + inning * 10000 + over * 100 + ball FROM reg) GROUP BY 1, 2"""),
    "venue_par": ([], f"""SELECT venue, {_r('avg(s)', 1)} AS avg_first_innings, {_r('quantile_cont(s, 0.5)', 1)} AS median_first_innings, count(*) AS matches_hosted
        FROM (SELECT match_id, sum(total_runs) AS s FROM reg WHERE inning = 1 GROUP BY 1) JOIN matches m ON m.id = match_id GROUP BY venue"""),
    "venue_avg_rr": ([HALF], f"SELECT venue, {_r(_div('sum(runs_10)', 'count(*) * 10'), 3)} AS venue_avg_rr FROM half JOIN matches m ON m.id = match_id GROUP BY venue"),
    "season_trend": ([], f"""SELECT *, {_r('total_runs / (total_balls / 6.0::DOUBLE)', 2)} AS avg_run_rate, {_r(_div('total_sixes', 'total_balls') + ' * 6', 3)} AS six_rate
        FROM (SELECT season, sum(total_runs)::BIGINT AS total_runs, {_n(LEGAL)} AS total_balls, {_n('batsman_runs = 6')} AS total_sixes,
              {_n('batsman_runs = 4')} AS total_fours {_by_match_batting()} GROUP BY season)"""),
    "season_counts": ([], "SELECT season, count(*) AS matches FROM matches GROUP BY season"),
    "toss_by_season": ([], "SELECT season, toss_decision, count(*) AS count FROM matches GROUP BY ALL"),
    "toss_advantage": ([], f"SELECT count(winner) AS decided, {_n('toss_winner = winner')} AS won_toss_and_match, count(winner) - {_n('toss_winner = winner')} AS lost_after_winning_toss FROM matches"),
    "top_venues": ([], "SELECT venue, count(*) AS matches FROM matches GROUP BY venue ORDER BY matches DESC, venue LIMIT 20"),
    "top_awards": ([], "SELECT player_of_match AS player, count(*) AS awards FROM matches GROUP BY 1 ORDER BY awards DESC, player LIMIT 15"),
    "team_wins": ([], "SELECT winner AS team, count(*) AS wins FROM matches WHERE winner IS NOT NULL GROUP BY 1"),
    "top_margins": ([], """(SELECT 'win_by_runs' AS kind, id, winner, win_by_runs AS margin FROM matches ORDER BY win_by_runs DESC, id LIMIT 10)
        UNION ALL (SELECT 'win_by_wickets', id, winner, win_by_wickets FROM matches ORDER BY win_by_wickets DESC, id LIMIT 10)"""),
    "super_over": ([], f"""SELECT match_id, batting_team, runs, wickets, winner, coalesce(batting_team = winner, false) AS won FROM (
        SELECT match_id, batting_team, sum(total_runs)::BIGINT AS runs, {_n('is_wicket')} AS wickets FROM deliveries WHERE is_super_over GROUP BY 1, 2)
        JOIN matches m ON m.id = match_id"""),
    "super_over_matches": ([], "SELECT count(DISTINCT match_id) AS super_over_matches FROM deliveries WHERE is_super_over"),
    "head_to_head": ([], "SELECT winner AS team, " + ", ".join(
        f"count(*) FILTER (WHERE CASE WHEN winner = team2 THEN team1 ELSE team2 END = '{t}') AS \"{t}\"" for t in ("CSK", "DD", "KKR", "MI", "RCB", "RPS", "RR", "SRH"))
        + " FROM matches WHERE winner IS NOT NULL GROUP BY winner"),
    "head_to_head_long": ([], "SELECT winner AS team, CASE WHEN winner = team2 THEN team1 ELSE team2 END AS opponent, count(*) AS wins FROM matches WHERE winner IS NOT NULL GROUP BY 1, 2"),
    "batting_form": ([PLAYER_MATCH], f"SELECT match_id, player, {_r('bat_avg', 6)} AS bat_avg, {_r('bat_sr', 6)} AS bat_sr FROM bat_match"),
    "bowling_form": ([PLAYER_MATCH], f"SELECT match_id, player, {_r('bowl_econ', 6)} AS bowl_econ, {_r('bowl_sr', 6)} AS bowl_sr FROM bowl_match"),
    "player_form": ([FORM], " UNION ALL ".join(
        f"SELECT match_id, player, team, '{c}' AS stat, {_r(c, 4)} AS value FROM {t}"
        for t, c in (("bat_form", "rolling_bat_avg"), ("bat_form", "rolling_bat_sr"), ("bowl_form", "rolling_bowl_econ"), ("bowl_form", "rolling_bowl_sr")))),
    "team_form": ([FORM], "SELECT * FROM team_form"),
    "latest_form": ([FORM, LATEST], "SELECT * FROM latest"),
    "prior_win_rate": ([PRIOR], f"SELECT match_id, win_rate_team1, win_rate_team2, {_r('win_rate_diff', 4)} AS win_rate_diff FROM prior"),
    "prematch_win_rate": ([HISTORY], f"""SELECT id AS request_id, team1, team2, season, {_rate_before('m', 'team1')} AS win_rate_team1,
        {_rate_before('m', 'team2')} AS win_rate_team2 FROM matches m"""),
    "match_features_v1": ([PRIOR], "SELECT * FROM match_v1"),
    "match_features_v2": ([PRIOR], "SELECT * FROM match_v2"),
    "match_features_v3": ([PRIOR, FORM], f"""SELECT v.match_id, v.toss_winner_is_team1, v.bat_first, v.venue_enc, v.team1_enc, v.team2_enc, v.season,
        v.win_rate_team1, v.win_rate_team2, v.win_rate_diff,
        a.rolling_bat_avg AS team1_rolling_bat_avg, a.rolling_bat_sr AS team1_rolling_bat_sr, b.rolling_bat_avg AS team2_rolling_bat_avg, b.rolling_bat_sr AS team2_rolling_bat_sr,
        a.rolling_bowl_econ AS team1_rolling_bowl_econ, a.rolling_bowl_sr AS team1_rolling_bowl_sr, b.rolling_bowl_econ AS team2_rolling_bowl_econ, b.rolling_bowl_sr AS team2_rolling_bowl_sr,
        {_r('a.rolling_bat_avg - b.rolling_bat_avg', 4)} AS rolling_bat_avg_diff, {_r('a.rolling_bat_sr - b.rolling_bat_sr', 4)} AS rolling_bat_sr_diff,
        {_r('a.rolling_bowl_econ - b.rolling_bowl_econ', 4)} AS rolling_bowl_econ_diff, v.team1_won
        FROM match_v2 v JOIN matches m ON m.id = v.match_id JOIN team_form a ON a.match_id = m.id AND a.team = m.team1 JOIN team_form b ON b.match_id = m.id AND b.team = m.team2"""),
    "win_prob_features": ([WIN], "SELECT * FROM win"),
    "score_features": ([SCORE], "SELECT * FROM score"),
    "potm_features": ([AWARD], f"SELECT * REPLACE ({_r('strike_rate', 6)} AS strike_rate, {_r('economy', 6)} AS economy) FROM award"),
    "over_sequences": ([SEQ], "SELECT * FROM seq"),
    "prefix_sequences": ([SEQ], """SELECT match_id, prefix, prefix AS steps, runs, cum_runs AS last_cum_runs, final_score FROM (
        SELECT *, (row_number() OVER w)::INT AS prefix, (sum(runs_in_over) OVER w)::BIGINT AS runs FROM seq WINDOW w AS (PARTITION BY match_id ORDER BY over)) WHERE prefix <= 20"""),
    "naive_curve": ([SEQ], f"""SELECT match_id, over, {_r('(sum(runs_in_over) OVER w)::DOUBLE / row_number() OVER w * 20', 0)} AS naive_projection, final_score
        FROM seq WINDOW w AS (PARTITION BY match_id ORDER BY over)"""),
    "win_rate_by_over": ([WIN], f"SELECT over, {_r('avg(batting_team_won)', 6)} AS raw_win_rate FROM win GROUP BY over"),
    "class_balance": ([PRIOR, WIN, AWARD], " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", {target} AS target, count(*) AS n, {_r('count(*)::DOUBLE / sum(count(*)) OVER ()', 4)} AS share FROM {t} GROUP BY {target}"
        for name, t, target in (("match", "match_v2", "team1_won"), ("win_probability", "win", "batting_team_won"), ("award", "award", "is_potm")))),
    "class_weight": ([AWARD], f"SELECT {_n('is_potm = 0')} AS negative, {_n('is_potm = 1')} AS positive, {_div(_n('is_potm = 0'), _n('is_potm = 1'))} AS positive_weight FROM award"),
    "feature_corr": ([PRIOR], " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {_r(f'corr({f}, team1_won)', 6)} AS correlation FROM match_v2"
        for f in ("toss_winner_is_team1", "bat_first", "venue_enc", "team1_enc", "team2_enc", "season", "win_rate_team1", "win_rate_team2", "win_rate_diff"))),
    "score_summary": ([SCORE], f"""SELECT count(*) AS count, {_r('avg(final_score)', 2)} AS mean, {_r('stddev_samp(final_score)', 2)} AS std, min(final_score)::DOUBLE AS min,
        {_r('quantile_cont(final_score, 0.25)', 2)} AS q25, {_r('quantile_cont(final_score, 0.5)', 2)} AS q50, {_r('quantile_cont(final_score, 0.75)', 2)} AS q75, max(final_score)::DOUBLE AS max FROM score"""),
    "score_histogram": ([SCORE], """SELECT least(floor((final_score - lo) / ((hi - lo) / 40.0::DOUBLE)), 39)::INT AS bin, count(*) AS n, min(final_score) AS smallest, max(final_score) AS largest
        FROM score, (SELECT min(final_score)::DOUBLE AS lo, max(final_score)::DOUBLE AS hi FROM score) GROUP BY 1"""),
    "score_trendline": ([SCORE], f"SELECT {_r('regr_slope(final_score, runs_10)', 6)} AS slope, {_r('regr_intercept(final_score, runs_10)', 6)} AS intercept FROM score"),
    "potm_box": ([AWARD], " UNION ALL ".join(
        f"""SELECT is_potm, '{f}' AS feature, min({f})::DOUBLE AS low, {_r(f'quantile_cont({f}::DOUBLE, 0.25)', 4)} AS q25, {_r(f'quantile_cont({f}::DOUBLE, 0.5)', 4)} AS q50,
        {_r(f'quantile_cont({f}::DOUBLE, 0.75)', 4)} AS q75, max({f})::DOUBLE AS high FROM award GROUP BY is_potm"""
        for f in ("runs_scored", "balls_faced", "strike_rate", "wickets_taken", "runs_given", "economy"))),
    "temporal_split": ([WIN], """SELECT match_id, over, k > n - floor(n * 0.2::DOUBLE) AS is_test FROM win JOIN (
        SELECT match_id, row_number() OVER (ORDER BY match_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT match_id FROM win)) USING (match_id)"""),
    "stratified_split": ([PRIOR], """SELECT match_id, team1_won, row_number() OVER (PARTITION BY team1_won ORDER BY md5(match_id::VARCHAR))
        > count(*) OVER (PARTITION BY team1_won) * 0.8::DOUBLE AS is_test FROM match_v1"""),
    "kfold": ([PRIOR], "SELECT match_id, team1_won, (ntile(5) OVER (PARTITION BY team1_won ORDER BY md5(match_id::VARCHAR)) - 1)::INT AS fold FROM match_v1"),
    "binary_metrics": ([PRIOR, RATED], f"""SELECT n, {_r(_div('tp + tn', 'n'), 4)} AS accuracy, {_r('loss', 4)} AS log_loss, coalesce({_r(_div('tp', 'tp + fp'), 4)}, 0) AS precision_pos,
        coalesce({_r(_div('tp', 'tp + fn'), 4)}, 0) AS recall_pos, coalesce({_r(_div('2 * tp', '2 * tp + fp + fn'), 4)}, 0) AS f1_pos FROM (
        SELECT count(*) AS n, {_n('score > 0.5 AND team1_won = 1')} AS tp, {_n('score > 0.5 AND team1_won = 0')} AS fp, {_n('score <= 0.5 AND team1_won = 1')} AS fn,
        {_n('score <= 0.5 AND team1_won = 0')} AS tn,
        avg(-ln(CASE WHEN team1_won = 1 THEN greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) ELSE 1 - greatest(least(score, 1 - 2.220446049250313e-16), 2.220446049250313e-16) END)) AS loss FROM rated)"""),
    "roc_auc": ([LEVELS], f"SELECT {_r(_div('sum((2 * pos_above + pos) * neg)', 'sum(pos) * sum(neg) * 2'), 4)} AS roc_auc FROM ranked"),
    "avg_precision": ([LEVELS], f"SELECT {_r('sum(pos::DOUBLE * (pos_above + pos) / (pos_above + pos + neg_above + neg)) / sum(pos)', 4)} AS avg_precision FROM ranked"),
    "naive_projection_error": ([SCORE], f"""SELECT count(*) AS n, {_r('avg(abs(final_score - projected_score))', 2)} AS mae,
        {_r('1 - sum((final_score - projected_score) ** 2) / (var_pop(final_score) * count(*))', 4)} AS r2 FROM score"""),
    "usable_matches": ([WIN], "SELECT DISTINCT match_id FROM win"),
    "unusable_matches": ([WIN], "SELECT id AS match_id FROM matches WHERE id NOT IN (SELECT match_id FROM win)"),
    "unknown_matches": ([WIN], "SELECT match_id FROM (SELECT id AS match_id FROM matches UNION SELECT id + 100000 FROM matches) WHERE match_id NOT IN (SELECT match_id FROM win)"),
    "prematch_features": ([HISTORY, FORM, LATEST,
        "label_t AS (SELECT team, row_number() OVER (ORDER BY team) - 1 AS code FROM (SELECT DISTINCT team FROM played))",
        f"""req AS (SELECT id AS request_id, m.team1, m.team2, (toss_winner = m.team1)::INT AS toss_winner_is_team1, (toss_decision = 'bat')::INT AS bat_first,
        (dense_rank() OVER (ORDER BY venue) - 1)::INT AS venue_enc, x.code::INT AS team1_enc, y.code::INT AS team2_enc, season,
        {_rate_before('m', 'team1')} AS win_rate_team1, {_rate_before('m', 'team2')} AS win_rate_team2,
        coalesce(a.rolling_bat_avg, 25) AS a1, coalesce(a.rolling_bat_sr, 120) AS a2, coalesce(a.rolling_bowl_econ, 8) AS a3, coalesce(a.rolling_bowl_sr, 20) AS a4,
        coalesce(b.rolling_bat_avg, 25) AS b1, coalesce(b.rolling_bat_sr, 120) AS b2, coalesce(b.rolling_bowl_econ, 8) AS b3, coalesce(b.rolling_bowl_sr, 20) AS b4
        FROM matches m JOIN label_t x ON x.team = m.team1 JOIN label_t y ON y.team = m.team2 LEFT JOIN latest a ON a.team = m.team1 LEFT JOIN latest b ON b.team = m.team2)"""],
        f"""SELECT request_id, team1, team2, toss_winner_is_team1, bat_first, venue_enc, team1_enc, team2_enc, season, win_rate_team1, win_rate_team2,
        {_r('win_rate_team1 - win_rate_team2', 4)} AS win_rate_diff, a1 AS team1_rolling_bat_avg, a2 AS team1_rolling_bat_sr, b1 AS team2_rolling_bat_avg, b2 AS team2_rolling_bat_sr,
        a3 AS team1_rolling_bowl_econ, a4 AS team1_rolling_bowl_sr, b3 AS team2_rolling_bowl_econ, b4 AS team2_rolling_bowl_sr,
        {_r('a1 - b1', 3)} AS rolling_bat_avg_diff, {_r('a2 - b2', 3)} AS rolling_bat_sr_diff, {_r('a3 - b3', 3)} AS rolling_bowl_econ_diff FROM req"""),
    "score_request_features": ([HALF], f"""SELECT match_id AS request_id, runs_10, wickets_10, rr AS current_rr, {_r('rr * 20', 1)} AS projected_score, {_r('rr - venue_rr', 3)} AS scoring_pressure,
        boundaries_10, batting_team_enc, venue_enc, season FROM (SELECT h.*, m.season, {_r('runs_10 / 10.0::DOUBLE', 3)} AS rr,
        {_r(_div('sum(runs_10) OVER (PARTITION BY venue)', 'count(*) OVER (PARTITION BY venue) * 10'), 3)} AS venue_rr,
        (SELECT count(DISTINCT venue) FROM matches v WHERE v.venue < m.venue)::INT AS venue_enc,
        (SELECT count(DISTINCT batting_team) FROM deliveries d WHERE d.batting_team < h.batting_team)::INT AS batting_team_enc
        FROM half h JOIN matches m ON m.id = h.match_id)"""),
    "award_request_features": ([AWARD], f"""SELECT l.match_id AS request_id, l.player AS player_name, runs_scored, balls_faced, wickets_taken, runs_given, balls_bowled,
        coalesce(l.team = m.winner, false)::INT AS player_won, coalesce({_pct('runs_scored', 'balls_faced', 2)}, 0) AS strike_rate,
        coalesce({_r(_div('runs_given', 'balls_bowled / 6.0::DOUBLE'), 2)}, 0) AS economy FROM lines l JOIN matches m ON m.id = l.match_id"""),
    "over_requests": ([SEQ], f"""SELECT match_id AS request_id, batting_team, venue, season, (count(*) OVER (PARTITION BY match_id))::INT AS overs_seen, runs_in_over, wickets_in_over,
        boundaries_in_over, (row_number() OVER w)::INT AS over, (sum(runs_in_over) OVER w)::BIGINT AS cum_runs, (sum(wickets_in_over) OVER w)::BIGINT AS cum_wickets,
        6 AS balls_in_over, {_r('(sum(runs_in_over) OVER w)::DOUBLE / row_number() OVER w', 3)} AS current_rr FROM seq WINDOW w AS (PARTITION BY match_id ORDER BY over)"""),
    "request_violations": ([HALF, SEQ, AWARD], """SELECT 'match' AS kind, id AS request_id, 'season' AS rule FROM matches WHERE season + 14 NOT BETWEEN 2008 AND 2030
        UNION ALL SELECT 'score', match_id, 'season' FROM half JOIN matches m ON m.id = match_id WHERE season + 14 NOT BETWEEN 2008 AND 2030
        UNION ALL SELECT 'score', match_id, 'runs_10' FROM half WHERE runs_10 * 2 NOT BETWEEN 0 AND 150
        UNION ALL SELECT 'award', match_id, 'players_size' FROM lines GROUP BY match_id HAVING count(*) NOT BETWEEN 1 AND 22
        UNION ALL SELECT DISTINCT 'award', match_id, 'runs_without_balls' FROM lines WHERE balls_faced = 0 AND runs_scored > 0
        UNION ALL SELECT DISTINCT 'over', match_id, 'season' FROM seq WHERE season + 14 NOT BETWEEN 2008 AND 2030
        UNION ALL SELECT DISTINCT 'over', match_id, 'runs_in_over' FROM seq WHERE runs_in_over NOT BETWEEN 0 AND 36"""),
}


_QUERIES["stream_state"] = ([], f"""SELECT match_id, inning, batting_team, over, runs_in_over, wickets_in_over, boundaries_in_over, balls_in_over,
        cum_runs::BIGINT AS cum_runs, cum_wickets::BIGINT AS cum_wickets, {_r('cum_runs::DOUBLE / over', 3)} AS current_rr,
        CASE WHEN inning = 2 THEN 120 - over * 6 END AS balls_remaining, CASE WHEN inning = 2 THEN (target - cum_runs)::BIGINT END AS runs_required,
        CASE WHEN inning = 2 THEN {_r(_div('target - cum_runs', '(120 - over * 6) / 6.0::DOUBLE'), 2)} END AS required_rr
        FROM (SELECT *, sum(runs_in_over) OVER w AS cum_runs, sum(wickets_in_over) OVER w AS cum_wickets FROM (
          SELECT match_id, inning, over, min(batting_team) AS batting_team, sum(total_runs)::BIGINT AS runs_in_over, {_n('is_wicket')} AS wickets_in_over,
                 {_n('batsman_runs IN (4, 6)')} AS boundaries_in_over, {_n(LEGAL)} AS balls_in_over FROM reg GROUP BY 1, 2, 3)
          WINDOW w AS (PARTITION BY match_id, inning ORDER BY over))
        JOIN (SELECT match_id, sum(total_runs) + 1 AS target FROM deliveries WHERE inning = 1 GROUP BY 1) USING (match_id)""")


def _names(*metrics: str) -> tuple[list[str], str]:
    rows = ", ".join(f"('{m}')" for m in metrics)
    return [], f"SELECT metric, true AS plausible FROM (VALUES {rows}) AS t(metric)"


BINARY = ("accuracy", "log_loss", "precision_pos", "recall_pos", "f1_pos", "roc_auc")

# What holds for any trees: the rows of the model queries, their keys and what follows from the requests.
_QUERIES |= {
    "match_winner_model": _names(*BINARY, "cv_roc_auc_mean", "cv_roc_auc_std"),
    "score_model": _names("mae", "r2"),
    "win_prob_model": _names(*BINARY),
    "potm_model": _names(*BINARY, "avg_precision"),
    "prefix_score_model": _names("mae", "r2"),
    "feature_importance": ([], "SELECT (range + 1)::INT AS position, true AS plausible FROM range(10)"),
    "model_roundtrip": ([SCORE], "SELECT match_id, true AS same FROM score"),
    "model_summary": ([], """SELECT *, true AS plausible FROM (VALUES ('match_winner', 'Classifier', 'roc_auc'), ('potm_classifier', 'Classifier', 'roc_auc'),
        ('prefix_score_predictor', 'Regressor', 'mae'), ('score_predictor', 'Regressor', 'mae'), ('win_probability', 'Classifier', 'roc_auc')) AS t(model, type, key_metric)"""),
    "win_curve": ([WIN], f"""SELECT match_id, over, batting_team, bowling_team, winner AS actual_winner, {PHASE} AS phase, true AS plausible
        FROM (SELECT match_id, over FROM win) JOIN (SELECT match_id, min(batting_team) AS batting_team, min(bowling_team) AS bowling_team FROM deliveries
              WHERE inning = 2 GROUP BY 1) USING (match_id) JOIN matches m ON m.id = match_id"""),
    "calibration_by_over": ([WIN], "SELECT DISTINCT over, CASE WHEN batting_team_won = 1 THEN 'Won' ELSE 'Lost' END AS outcome, true AS plausible FROM win"),
    "prematch_scored": ([], "SELECT id AS request_id, team1, team2, true AS plausible FROM matches"),
    "score_requests": ([HALF], f"""SELECT match_id AS request_id, rr AS current_rr, {_r('rr * 20', 1)} AS projected_naive, true AS plausible
        FROM (SELECT match_id, {_r('runs_10 / 10.0::DOUBLE', 3)} AS rr FROM half)"""),
    "score_interval": ([HALF], "SELECT match_id AS request_id, true AS plausible FROM half"),
    "over_scored": ([SEQ], "SELECT match_id AS request_id, count(*)::INT AS overs_seen, true AS plausible FROM seq GROUP BY match_id"),
    "potm_rank": ([AWARD], """SELECT match_id AS request_id, rank, (rank = 1)::INT AS predicted_potm, true AS plausible
        FROM (SELECT match_id, (row_number() OVER (PARTITION BY match_id ORDER BY player))::INT AS rank FROM lines)"""),
    "live_score": ([SEQ], "SELECT match_id, 1 AS inning, over, cum_runs, true AS plausible FROM seq"),
}


def statements() -> dict[str, str]:
    out = {}
    for name, (steps, select) in _QUERIES.items():
        if select.startswith("WITH "):
            steps, select = [*steps, select[5:]], ""
        body = ",\n".join([CLEAN, *steps])
        out[name] = f"{body}\n{select}"
    return out
