fx_score AS (SELECT match_id, sum(CASE WHEN inning = 1 THEN total_runs ELSE 0 END) AS r1,
                 sum(CASE WHEN inning = 2 THEN total_runs ELSE 0 END) AS r2,
                 sum(CASE WHEN inning = 2 AND player_dismissed IS NOT NULL THEN 1 ELSE 0 END) AS w2
          FROM deliveries_csv GROUP BY match_id),
fx_bat AS (SELECT match_id, batsman, sum(batsman_runs) AS r FROM deliveries_csv WHERE is_super_over = 0 GROUP BY match_id, batsman),
fx_best AS (SELECT match_id, batsman AS potm FROM (
           SELECT match_id, batsman, row_number() OVER (PARTITION BY match_id ORDER BY r DESC, batsman) AS k FROM fx_bat) b WHERE k = 1),
fx_order AS (
  SELECT CAST(floor(o_orderkey / 60) AS BIGINT) AS m, min_by(o_orderdate, o_orderkey) AS o_orderdate, min_by(o_orderstatus, o_orderkey) AS o_orderstatus,
         min_by(o_custkey, o_orderkey) AS o_custkey, min_by(o_orderpriority, o_orderkey) AS o_orderpriority
  FROM orders GROUP BY CAST(floor(o_orderkey / 60) AS BIGINT)),
matches_csv AS (
  SELECT m AS id, CAST(year(o_orderdate) AS INT) AS season,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE r_name END AS city, o_orderdate AS date,
         a.tname AS team1, b.tname AS team2,
         CASE WHEN o_custkey % 2 = 0 THEN a.tname ELSE b.tname END AS toss_winner,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'bat' ELSE 'field' END AS toss_decision,
         CASE WHEN r1 = r2 OR m % 40 = 7 THEN NULL WHEN r1 > r2 THEN a.tname ELSE b.tname END AS winner,
         CASE WHEN r1 > r2 THEN r1 - r2 ELSE 0 END AS win_by_runs,
         CASE WHEN r2 > r1 THEN greatest(10 - w2, 1) ELSE 0 END AS win_by_wickets,
         potm AS player_of_match, n_name || ' Ground, ' || r_name AS venue
  FROM fx_order JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  JOIN fx_team a ON a.ti = CAST(m % 8 AS INT)
  JOIN fx_team b ON b.ti = CAST((m % 8 + 1 + floor(m / 8) % 7) % 8 AS INT)
  JOIN fx_score ON fx_score.match_id = m
  JOIN fx_best ON fx_best.match_id = m)
