"""Distributed exact quantiles and chunked prefix scans against NumPy/pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatewatch.operators.quantiles import exact_quantiles, rank_values
from gatewatch.operators.scans import prefix_scan, islands


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 6000
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = np.round(rng.normal(size=n), 2)  # many ties
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_exact_quantiles_grouped(skewed):
    pdf, df = skewed
    probs = {"p0": 0.0, "p05": 0.05, "q25": 0.25, "med": 0.5, "q75": 0.75, "p1": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(sub["v"], p * 100), abs=1e-12)


def test_exact_quantiles_partition_independent(spark, skewed):
    pdf, df = skewed
    a = exact_quantiles(df.repartition(3), "v", {"m": 0.37}).first()["m"]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    b = exact_quantiles(df.repartition(11), "v", {"m": 0.37}).first()["m"]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b == pytest.approx(np.percentile(pdf["v"], 37))


def test_rank_lookup(skewed):
    pdf, df = skewed
    got = rank_values(df, "id", lambda n: {"c": (F.floor(n * 0.6), F.floor(n * 0.6), F.lit(0.0))}).first()["c"]
    assert got == sorted(pdf["id"])[int(len(pdf) * 0.6)]


def test_order_bits_sort_as_the_values(spark):
    from gatewatch.operators.quantiles import order_bits
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64), rng.normal(size=500),
                        2.0 ** np.arange(-1074, 1024), -(2.0 ** np.arange(-1074, 1024)), np.nextafter(2.0 ** np.arange(-1000, 1000), 0),
                        [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]])
    v = v[~np.isnan(v)]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    df = order_bits(df, "v", "k")
    got = np.array([(r["v"], r["k"]) for r in df.collect()], dtype=[("v", "f8"), ("k", "i8")])
    raw = np.abs(got["v"]).view(np.int64)
    assert (got["k"] == np.where(got["v"] < 0, -raw, raw)).all()
    nan = order_bits(spark.createDataFrame([(float("nan"),)], "v double"), "v", "k").first()["k"]
    assert nan > got["k"].max()


@pytest.mark.parametrize("local", [0, 300, 1 << 16])
def test_quantiles_of_wide_and_dense_values(spark, monkeypatch, local):
    monkeypatch.setattr("gatewatch.operators.quantiles.LOCAL_ROWS", local)
    rng = np.random.default_rng(12)
    n = 4000
    v = np.where(rng.random(n) < .5, 1 + rng.integers(0, 40, n) * 2.0**-52, 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n))
    g = np.where(rng.random(n) < .34, None, rng.choice(["a", "b"], n))
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame([(x, float(y), "c") for x, y in zip(g, v)] + [("a", None, "c"), ("empty", None, "c")], "g string, v double, _k string")
    probs = {f"p{i}": float(p) for i, p in enumerate([0, .01, .25, .4999, .5, .75, .999, 1])}
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    assert set(got) == {None, "a", "b"}
    for k, sub in [(x, pdf[pdf["g"].isna()] if x is None else pdf[pdf["g"] == x]) for x in got]:
        s = np.sort(sub["v"])
        for name, p in probs.items():
            h = (len(s) - 1) * p
            lo, hi = int(np.floor(h)), int(np.ceil(h))
            assert got[k][name] == (s[lo] if s[lo] == s[hi] else s[lo] + (h - lo) * (s[hi] - s[lo]))
    assert exact_quantiles(df.limit(0), "v", probs, by=["g"]).count() == 0


def test_ranks_of_whole_numbers_and_times(spark):
    ids = list(range(-500, 4500, 7))
    df = spark.createDataFrame([(i,) for i in ids], "i long").withColumn("t", F.timestamp_seconds("i"))
    at = lambda n: {"x": (F.floor(n * 0.3), F.floor(n * 0.3), F.lit(0.0))}
    k = int(len(ids) * 0.3)
    assert rank_values(df, "i", at).first()["x"] == ids[k]
    from gatewatch.operators.quantiles import select_ranks
    got = select_ranks(df, "t", lambda n: F.array(F.struct(F.lit(k).cast("long").alias("pos")))).first()["_value"]
    assert got.timestamp() == ids[k]


def test_selection_shuffles_counts_not_rows(spark, skewed):
    _, df = skewed
    import gatewatch.operators.quantiles as Q
    assert "materialize" not in open(Q.__file__).read()
    rows = Q.order_bits(df.select(F.lit(0).alias("_all"), F.col("v").alias("_v")), "_v", "_k")
    plan = rows.groupBy("_all", F.shiftright("_k", 48)).agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning" not in plan


def test_prefix_scan_matches_single_pass(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(["x", "y", "z"], n))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5 * 86400, n), unit="s")
    sig = rng.choice([np.nan, 0, 1], n, p=[0.7, 0.1, 0.2])
    pdf = pd.DataFrame({"k": key, "ts": ts, "id": np.arange(n), "x": rng.integers(0, 5, n), "sig": sig})
    df = spark.createDataFrame(pdf).withColumn("sig", F.when(~F.isnan("sig"), F.col("sig").cast("int")))
    out = prefix_scan(df, ["k"], ["ts", "id"], F.date_trunc("day", "ts"),
                      {"run": ("sum", F.col("x").cast("long")), "last": ("last", F.col("sig"))}).toPandas()
    exp = pdf.sort_values(["k", "ts", "id"]).copy()
    exp["run"] = exp.groupby("k")["x"].cumsum()
    exp["last"] = exp.groupby("k")["sig"].ffill()
    m = out.merge(exp[["id", "run", "last"]], on="id", suffixes=("", "_e"))
    assert (m["run"] == m["run_e"]).all()
    assert ((m["last"].isna() & m["last_e"].isna()) | (m["last"] == m["last_e"])).all()


def test_islands(spark):
    pdf = pd.DataFrame({"k": ["a"] * 8 + ["b"] * 3, "id": range(11),
                        "f": [0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0]})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["id"] * 3600, unit="s")
    df = spark.createDataFrame(pdf)
    e = islands(df, ["k"], ["ts", "id"], "f", "ts", F.date_trunc("day", "ts")).toPandas()
    assert sorted(zip(e["k"], e["n_rows"])) == [("a", 1), ("a", 1), ("a", 2), ("b", 2)]


def test_range_chunks_match_day_buckets(spark):
    """Regression: the latch over range chunks (stored chunk ids) equals the
    latch over day buckets, with extra columns pruned differently per branch."""
    from gatewatch.operators import risk as RK
    from gatewatch.operators.scans import day_bucket
    from gatewatch.plans import q_windows as QW
    c = QW._clocked(spark, "/root/testdata/sf0.01").withColumn("extra", F.col("raw_score") * 2)
    a = RK.premitigation(c, ["ip"], ["event_ts", "row_id"], None).select("row_id", "premit_on", "trigger", "extra")
    b = RK.premitigation(c, ["ip"], ["event_ts", "row_id"], day_bucket("event_ts")).select(
        "row_id", "premit_on", "trigger", "extra")
    assert sorted(a.collect()) == sorted(b.collect())


def test_approx_quantiles_close(skewed):
    from gatewatch.operators.quantiles import approx_quantiles
    pdf, df = skewed
    got = {r["g"]: r for r in approx_quantiles(df, "v", {"q25": 0.25, "med": 0.5}, by=["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        vals = np.sort(sub["v"].to_numpy())
        for name, p in (("q25", 0.25), ("med", 0.5)):
            rank = np.searchsorted(vals, got[g][name], side="left") / len(vals)
            assert abs(rank - p) < 0.01


def test_range_partitions_follow_input_size(spark):
    """Small inputs are not scattered over the shuffle setting (plan
    statistics are read without running the plan)."""
    from gatewatch.session import range_partitions
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        n = range_partitions(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert 1 <= n <= spark.sparkContext.defaultParallelism


def test_range_partitions_read_size_suffixes_and_are_not_capped(spark):
    from gatewatch.session import range_partitions
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    conf = "spark.sql.files.maxPartitionBytes"
    prev = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "256m")
        small = range_partitions(ev)
        spark.conf.set(conf, "4k")
        assert range_partitions(ev) > int(spark.conf.get("spark.sql.shuffle.partitions")) >= small
    finally:
        spark.conf.set(conf, prev)
