"""Sketches, panes, bitmaps and SQL functions."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import text as X
from gatewatch.functions.sql import register
from gatewatch.operators import panes as PN
from gatewatch.operators import sketches as SK

T0 = dt.datetime(2024, 1, 1)


def test_merged_sketches_keep_their_bounds(spark):
    n = 40_000
    df = spark.range(n).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 20)).alias("ts"), (F.col("id") % 9_000).cast("string").alias("k"),
                               F.when(F.col("id") % 7 != 0, F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")).alias("v"))
    hours = SK.hourly_sketches(df, "ts", "k", "v")
    assert hours.count() == -(-n * 20 // 3600)
    got = SK.read_sketches(SK.merge_sketches(hours, [F.lit(1).alias("all")]), {"q10": 0.1, "q99": 0.99}).first()
    assert got["n"] == n and abs(got["n_keys"] - 9_000) < 0.04 * 9_000
    vals = sorted(r["v"] for r in df.where("v IS NOT NULL").select("v").collect())
    for q, p in (("q10", 0.1), ("q99", 0.99)):
        assert abs(sum(v <= got[q] for v in vals) / len(vals) - p) < 0.02
    assert SK.hourly_sketches(df.limit(0), "ts", "k", "v").count() == 0


def test_bitmaps_count_distinct_codes(spark):
    big = spark.range(1_000_000).select(F.lit("big").alias("g"), F.pmod(F.col("id") * 3, F.lit(600_000)).alias("c"))
    rows = [("a", 5), ("a", 5), ("a", -7), ("a", 32768), ("a", 32769), ("a", None), (None, 1), ("none", None)]
    df = big.unionByName(spark.createDataFrame(rows, "g string, c long"))
    got = {r["g"]: tuple(r)[1:] for r in SK.distinct_codes(df, "g", "c").collect()}
    assert got == {"big": (200_000, 0, 599_997), "a": (4, -7, 32769), None: (1, 1, 1)}


def test_sliding_counts_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(-4000, 4000))) for _ in range(500)] + [("a", None)]
    panes = PN.pane_counts(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", ["k"], 300)
    got = {(r["window_start"], r["k"]): r["n"] for r in PN.sliding_counts(panes, ["k"], 900, 300).collect()}
    want: dict = {}
    for k, t in rows:
        if t is not None:
            s = int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // 300 * 300
            for w in (s - 600, s - 300, s):
                want[(w, k)] = want.get((w, k), 0) + 1
    assert got == want
    with pytest.raises(ValueError):
        PN.sliding_counts(panes, ["k"], 700, 300)


def test_sql_functions_equal_the_columns(spark):
    names = register(spark)
    assert register(spark) == names  # again
    rows = [("abc/1 2²<x>", "a=1"), ("", "' or 1 union"), (None, None), ("/admin", "x"), ("aaaa", "<Script>"), ("a../etc", "zz"), ("ü\t é", "q" * 9)]
    df = spark.createDataFrame(rows, "u string, a string")
    out = spark.sql("SELECT gw_entropy(u) AS e, gw_class_entropy(u) AS c, gw_threat_class(u, a) AS t FROM {df}", df=df)
    want = df.select(X.shannon_entropy("u").alias("e"), X.class_entropy("u").alias("c"), X.classify_threat("u", "a", X.shannon_entropy("a")).alias("t"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    r = spark.sql("SELECT gw_ip_long('10.0.0.1') AS v, gw_in_cidr('10.1.2.3', '10.1.0.0', 16) AS y, gw_in_cidr('10.2.2.3', '10.1.0.0', 16) AS n, gw_ip_long('x') AS z").first()
    assert tuple(r) == (167772161, True, False, None)
