"""Column helpers: codes, IPs, headers, time parts, risk mapping, decisions."""

import math

import pytest
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import codes as C
from gatewatch.operators import federated as FD
from gatewatch.operators import forest as FR
from gatewatch.operators import risk as RK


def test_ipv4_and_cidr(spark):
    df = spark.createDataFrame([("10.0.1.2",), ("255.255.255.255",), ("1.2.3",), ("a.b.c.d",), ("1.2.3.256",), (None,)],
                               "ip string")
    got = [r["v"] for r in df.select(C.ipv4_to_long("ip").alias("v")).collect()]
    assert got == [167772418, 4294967295, None, None, None, None]
    assert df.select(C.ip_to_cidr32("ip").alias("c")).first()["c"] == "10.0.1.2/32"


def test_codes_and_header(spark):
    hdr = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame([("KR", [("Host", "h"), ("CloudFront-Viewer-Country", "US")]),
                                ("ZZ", [("host", "h")]), (None, None)], f"c string, headers {hdr}")
    out = df.select(C.country_code("c").alias("cc"),
                    C.header_value("headers", K.VIEWER_COUNTRY_HEADER, K.UNKNOWN_COUNTRY).alias("v"),
                    C.edge_country_code(C.header_value("headers", K.VIEWER_COUNTRY_HEADER, "XX"),
                                        K.COUNTRY_CODES).alias("e")).collect()
    assert [r["cc"] for r in out] == [0, 99, 99]
    assert [r["v"] for r in out] == ["US", "XX", "XX"]
    assert [r["e"] for r in out] == [2.0, 3.0, 3.0]
    r = spark.createDataFrame([("AWS-AWSManagedRulesSQLiRuleSet",), ("x",)], "r string") \
        .select(C.rule_code("r").alias("c")).collect()
    assert [x["c"] for x in r] == [0, 999]


def test_kst_weight_and_c(spark):
    df = spark.sql("SELECT explode(sequence(0, 23)) AS h").select(
        F.col("h"), F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("h"), F.lit(0), F.lit(0)).alias("ts"))
    got = {r["h"]: r["w"] for r in df.select("h", C.kst_hour_weight("ts").alias("w")).collect()}
    for h, w in got.items():
        k = (h + 9) % 24
        assert w == (1.0 if 9 <= k <= 18 else 0.6 if 19 <= k <= 23 else 0.2)
    cs = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 256)], "n int").select(C.c_factor("n").alias("c")).collect()
    want = [0.0, 0.0, 1.0, 2 * (math.log(2) + 0.5772156649) - 4 / 3, 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256]
    assert [r["c"] for r in cs] == pytest.approx(want)
    assert FR.c_factor(256) == pytest.approx(want[-1])


def test_risk_phase_ladder(spark):
    df = spark.createDataFrame([(t,) for t in (0.0, 49.9, 50.0, 89.9, 90.0, 103.1, 103.3, 116.5, 170.0, 500.0)], "t double")
    out = df.select("t", RK.scenario_phase("t").alias("m"), RK.mitigation_ladder("t").alias("l")).collect()
    assert [r["m"] for r in out] == ["NORMAL", "NORMAL", "PREDICT", "PREDICT", "PREMITIGATE", "PREMITIGATE",
                                     "PREMITIGATE", "PREMITIGATE", "STABILIZE", "STABILIZE"]
    assert [r["l"] for r in out] == [0, 0, 0, 0, 1, 1, 2, 3, 3, 3]
    s = spark.createDataFrame([(v,) for v in (-0.2, -0.1, 0.0, 0.1)], "s double")
    r = [x["r"] for x in s.select(RK.risk_from_score("s", threshold=-0.1, lo=-0.2, hi=0.1).alias("r")).collect()]
    assert r == [100.0, 70.0, 35.0, 0.0]


def test_edge_decisions(spark):
    df = spark.createDataFrame([(None,), (-0.5,), (-0.05,)], "score double")
    a = [r["a"] for r in df.select(FR.edge_action("score", "offset", offset=-0.1).alias("a")).collect()]
    b = [r["a"] for r in df.select(FR.edge_action("score", "fixed_threshold", fixed_threshold=-0.1).alias("a")).collect()]
    assert a == ["FAIL_OPEN", "BLOCK", "ALLOW"] and b == ["FAIL_OPEN", "BLOCK", "ALLOW"]
    d = spark.createDataFrame([(-0.00004,), (0.12345,)], "decision double").select(
        *[v.alias(k) for k, v in FR.decision_label().items()]).collect()
    assert [(r["anomaly"], r["score_r4"]) for r in d] == [(1, -0.0), (0, 0.1235)]


def test_quotas_half_even(spark):
    params = spark.createDataFrame([("a", 600, 100, -0.5), ("b", 250, 100, -0.4), ("c", 150, 100, -0.3)],
                                   "node_id string, n_samples long, n_trees int, offset double")
    q = {r["node_id"]: r for r in FD.quotas(params).collect()}
    # round_half_even(100 * w * 3): 180 -> capped 100, 75, 45
    assert (q["a"]["k"], q["b"]["k"], q["c"]["k"]) == (100, 75, 45)
    assert q["a"]["global_offset"] == pytest.approx((-0.5 * 600 - 0.4 * 250 - 0.3 * 150) / 1000)
    tie = spark.createDataFrame([("x", 1, 5, 0.0), ("y", 1, 5, 0.0), ("z", 2, 5, 0.0), ("w", 4, 5, 0.0)],
                                "node_id string, n_samples long, n_trees int, offset double")
    k = {r["node_id"]: r["k"] for r in FD.quotas(tie).collect()}
    assert k["x"] == 2  # 5 * 1/8 * 4 = 2.5 -> 2 (half to even)


def test_position_split(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 + 3).alias("row_id"))
    sizes = {r["node"]: r["count"] for r in FD.position_split(df, "row_id", [0.6, 0.25, 0.15]).groupBy("node").count().collect()}
    assert sizes == {1: 600, 2: 250, 3: 150}


def test_edge_frame(spark):
    from gatewatch.operators.features import EDGE_FEATURES, edge_frame
    hdr = "array<struct<name:string,value:string>>"
    df = spark.createDataFrame([("/api/users", [("CloudFront-Viewer-Country", "NL")]), ("/", [])],
                               f"uri string, headers {hdr}")
    out = edge_frame(df, {"KR": 0, "NL": 1, "US": 2}).select(*EDGE_FEATURES).collect()
    assert [r["country_code"] for r in out] == [1.0, 3.0]  # unseen / missing header -> max + 1
    assert [r["uri_len"] for r in out] == [10.0, 1.0]
    assert out[0]["uri_entropy"] == pytest.approx(2.921928, abs=1e-6)
    h = -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))  # entropy of '0b0'
    assert all(r["rule_code"] == 0.0 and r["rule_entropy"] == pytest.approx(h) for r in out)


def test_severity_by_rule(spark):
    from gatewatch.sources import files as FS
    f = spark.createDataFrame([("r1", "HIGH"), ("r1", "LOW"), ("r2", "HIGH"), ("r2", "HIGH")],
                              "rule_id string, severity string")
    got = {r["rule_id"]: (r["CRITICAL"], r["HIGH"], r["MEDIUM"], r["LOW"]) for r in FS.severity_by_rule(f).collect()}
    assert got == {"r1": (0, 1, 0, 1), "r2": (0, 2, 0, 0)}
