import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from stumpline.functions.ordered import date_key, prior_totals, ranked, trailing_mean
from stumpline.operators.encode import encode, label_codes, union_label_codes, unknown_labels, with_codes


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; one key is null; orders are unique per key."""
    rnd = random.Random(7)
    data = []
    for i in range(400):
        key = "hot" if i % 2 else rnd.choice(["a", "b", "c", None])
        data.append((key, rnd.randint(0, 40), i, rnd.randint(0, 9)))
    return spark.createDataFrame(data, "k string, day bigint, id bigint, v int")


def by_key(data):
    groups = {}
    for k, day, i, v in data:
        groups.setdefault(k, []).append((day, i, v))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_prior_totals_match_a_loop(skewed, hot_rows):
    got = prior_totals(skewed, ["k"], ["day", "id"], {"s": F.col("v"), "n": F.lit(1)}, hot_rows, ranges=9)
    want = []
    for k, g in by_key(skewed.collect()).items():
        s = n = 0
        for day, i, v in g:
            want.append((k, i, s, n))
            s, n = s + v, n + 1
    assert rows(got, "k", "id", "s", "n") == sorted(want, key=repr)


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("hot_rows", [10**6, 5])
def test_trailing_mean_matches_a_loop(skewed, n, hot_rows):
    got = trailing_mean(skewed, ["k"], ["day", "id"], {"m": "v"}, n, hot_rows, ranges=40)
    want = []
    for k, g in by_key(skewed.collect()).items():
        for at, (day, i, v) in enumerate(g):
            seen = [x[2] for x in g[max(0, at - n):at]]
            want.append((k, i, sum(seen) / len(seen) if seen else None))
    assert rows(got, "k", "id", "m") == sorted(want, key=repr)


@pytest.mark.parametrize("hot_rows, ranges", [(5, 2), (5, 7), (5, 50), (1000, None)])
def test_rank_over_the_whole_table(skewed, hot_rows, ranges):
    got = ranked(skewed, [], ["id"], hot_rows=hot_rows, ranges=ranges)
    assert rows(got, "id", "rank") == sorted([(i, i + 1) for i in range(400)], key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_partitioning_does_not_matter(spark, skewed, partitions):
    base = rows(prior_totals(skewed, ["k"], ["day", "id"], {"s": F.col("v")}, 5, ranges=9))
    again = prior_totals(skewed.repartition(partitions), ["k"], ["day", "id"], {"s": F.col("v")}, 5, ranges=9)
    assert rows(again.select(*skewed.columns, "s")) == base


def test_label_codes_both_ways(spark):
    names = [f"player {i:03d}" for i in range(150)] + ["Ångström", "zz", "a"]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "name string")
    few, many = label_codes(df, "name", True), label_codes(df, "name", False, hot_rows=20)
    want = sorted([(n, i) for i, n in enumerate(sorted(names))], key=repr)
    assert rows(few) == rows(many) == want


def test_encode_null_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert rows(encode(df, {"x": "code"})) == [("a", 0), ("b", 1), (None, -1)]
    fitted = label_codes(df, "x")
    new = spark.createDataFrame([("a",), ("q",)], "x string")
    assert rows(with_codes(new, fitted, "x", "c", "zero")) == [("a", 0), ("q", 0)]
    assert rows(with_codes(new, fitted, "x", "c", "null")) == [("a", 0), ("q", None)]
    assert rows(unknown_labels(new, fitted, "x")) == [("q",)]
    with pytest.raises(Exception, match="unrecognised x: q"):
        with_codes(new, fitted, "x", "c", "error").collect()


def test_union_codes(spark):
    df = spark.createDataFrame([("b", "c"), ("a", None)], "x string, y string")
    assert rows(union_label_codes(df, "x", "y")) == [("a", 0), ("b", 1), ("c", 2)]


def test_date_key_orders_like_the_date(spark):
    texts = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2010-04-01 00:00:00", "2010-04-01 02:30:00.25",
             "2010-04-01 02:30:00.3", "2400-02-29 12:00:00"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").selectExpr("t", "cast(t AS timestamp_ntz) AS date")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            keys = [r.k for r in df.select("t", date_key().alias("k")).orderBy("k").collect()]
            assert [r.t for r in df.orderBy(date_key()).collect()] == [*texts, None]
            assert keys[1] == 0 and keys[0] == -500000 and len(set(keys)) == 7
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_trailing_mean_skips_nulls_on_both_paths(spark, hot_rows):
    values = [None, 1.0, 2.0, None, 4.0, 5.0, None, 7.0, None, None, None, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, day int, v double")
    got = trailing_mean(df, ["k"], ["day"], {"m": "v"}, 2, hot_rows, ranges=4)
    want = []
    for i in range(len(values)):
        known = [v for v in values[max(0, i - 2) : i] if v is not None]
        want.append((i, sum(known) / len(known) if known else None))
    assert sorted((r.day, r.m) for r in got.collect()) == want
