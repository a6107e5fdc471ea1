WITH fx_seq AS (
  SELECT CAST(floor(l_orderkey / 60) AS BIGINT) AS m,
         CASE WHEN l_orderkey % 60 < 30 THEN 1 ELSE 2 END AS half,
         row_number() OVER (
           PARTITION BY CAST(floor(l_orderkey / 60) AS BIGINT), CASE WHEN l_orderkey % 60 < 30 THEN 1 ELSE 2 END
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn,
         CAST(l_quantity AS INT) % 20 AS q, CAST(round(l_tax * 100) AS INT) AS tx,
         CAST(round(l_discount * 100) AS INT) AS dc,
         l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, l_returnflag AS rf
  FROM lineitem),
fx_team AS (SELECT * FROM (VALUES (0,'Mumbai Indians'),(1,'Chennai Super Kings'),(2,'Kolkata Knight Riders'),
  (3,'Royal Challengers Bangalore'),(4,'Delhi Daredevils'),(5,'Sunrisers Hyderabad'),(6,'Rajasthan Royals'),
  (7,'Rising Pune Supergiants')) AS t(ti, tname)),
fx_ball AS (
  SELECT m, half, rn, q, tx, dc, pk, sk, ln, rf, CAST(m % 8 AS INT) AS t1,
         CAST((m % 8 + 1 + floor(m / 8) % 7) % 8 AS INT) AS t2 FROM fx_seq),
fx_deliveries AS (
  SELECT m AS match_id, CASE WHEN rn > 120 THEN half + 2 ELSE half END AS inning,
         tb.tname AS batting_team, tw.tname AS bowling_team,
         CASE WHEN rn > 120 THEN CAST(floor((rn - 121) / 6) AS INT) + 1 ELSE CAST(floor((rn - 1) / 6) AS INT) + 1 END AS over,
         CAST((rn - 1) % 6 AS INT) + 1 AS ball,
         tb.tname || ' P' || CAST(pk % 11 + 1 AS STRING) AS batsman,
         tb.tname || ' P' || CAST((pk + 1 + sk % 10) % 11 + 1 AS STRING) AS non_striker,
         tw.tname || ' P' || CAST(sk % 5 + 7 AS STRING) AS bowler,
         CASE WHEN rn > 120 THEN 1 ELSE 0 END AS is_super_over,
         CASE WHEN tx = 0 THEN 1 ELSE 0 END AS wide_runs,
         CASE WHEN tx = 7 AND dc = 1 THEN 1 ELSE 0 END AS bye_runs,
         CASE WHEN tx = 6 AND dc = 2 THEN 1 ELSE 0 END AS legbye_runs,
         CASE WHEN tx = 8 AND dc >= 9 THEN 1 ELSE 0 END AS noball_runs,
         0 AS penalty_runs,
         CASE WHEN tx = 0 OR q < 8 THEN 0 WHEN q < 14 THEN 1 WHEN q < 16 THEN 2 WHEN q < 19 THEN 4 ELSE 6 END AS batsman_runs,
         CASE WHEN dc = 10 AND rf = 'R' AND ln % 2 = 0 THEN tb.tname || ' P' || CAST((pk + 1 + sk % 10) % 11 + 1 AS STRING)
              WHEN dc = 10 THEN tb.tname || ' P' || CAST(pk % 11 + 1 AS STRING) END AS player_dismissed,
         CASE WHEN dc = 10 THEN CASE rf WHEN 'R' THEN 'run out' WHEN 'A' THEN 'caught' ELSE 'bowled' END END AS dismissal_kind
  FROM fx_ball JOIN fx_team tb ON tb.ti = CASE WHEN half = 1 THEN t1 ELSE t2 END
            JOIN fx_team tw ON tw.ti = CASE WHEN half = 1 THEN t2 ELSE t1 END),
deliveries_csv AS (
  SELECT *, wide_runs + bye_runs + legbye_runs + noball_runs + penalty_runs AS extra_runs,
         batsman_runs + wide_runs + bye_runs + legbye_runs + noball_runs + penalty_runs AS total_runs
  FROM fx_deliveries)
