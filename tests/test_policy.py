"""Policy replay order, scope-down, IP / CIDR membership, filters."""

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.operators import policy as P
from gatewatch.operators import response as RS


def _reqs(spark):
    rows = [
        (1, "US", "/x", "", "10.0.0.1"),                  # geo first
        (2, "KR", "/x", "id=1 OR 1=1 union", "10.0.9.9"),  # blocked IP beats SQLi
        (3, "KR", "/api", "q=1; DROP TABLE t", "10.0.5.5"),  # SQLi
        (4, "KR", "/ADMIN/x", "q=1; DROP TABLE t", "10.0.5.5"),  # scope-down: skip SQLi
        (5, "KR", "/api", "q=1; select", "10.0.0.2"),     # trusted range: skip SQLi
        (6, "KR", "/api", "q=<svg onload=1>", "10.0.5.5"),  # common rules
        (7, "KR", "/health/x", "q=<svg onload=1>", "10.0.5.5"),  # scope-down common
        (8, "KR", "/api", "", "10.0.2.77"),               # reputation
        (9, "KR", "/api", "", "10.0.5.5"),                # default
    ]
    df = spark.createDataFrame(rows, "row_id long, country string, uri string, args string, ip string")
    block = spark.createDataFrame([("10.0.9.9",)], "ip string")
    return P.ip_member_flag(df, "ip", block, "ip", flag="blocked")


def test_replay_priorities(spark):
    r = _reqs(spark)
    rules = P.waf_rules("country", "blocked", "uri", "args", "ip", trusted=["10.0.0.0/30"],
                        reputation=["10.0.2.0/24"])
    got = {x["row_id"]: (x["terminatingruleid"], x["action"]) for x in P.replay(r, rules).collect()}
    assert got[1] == (K.RULE_GEO, "BLOCK")
    assert got[2] == (K.RULE_AI_BLOCK, "BLOCK")
    assert got[3] == (K.RULE_SQLI, "BLOCK")
    assert got[4] == (K.RULE_DEFAULT, "ALLOW")
    assert got[5] == (K.RULE_DEFAULT, "ALLOW")
    assert got[6] == (K.RULE_COMMON, "BLOCK")
    assert got[7] == (K.RULE_DEFAULT, "ALLOW")
    assert got[8] == (K.RULE_REPUTATION, "BLOCK")
    assert got[9] == (K.RULE_DEFAULT, "ALLOW")


def test_cidr_literal_and_table_agree(spark):
    ips = [f"10.0.{a}.{b}" for a in range(0, 4) for b in (0, 1, 2, 3, 16, 31, 32, 128, 255)]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "row_id long, ip string")
    cidrs = ["10.0.0.0/30", "10.0.1.128/25", "10.0.3.16/28", "10.0.2.255/32"]
    a = {r["row_id"]: r["m"] for r in df.select("row_id", P.in_cidrs("ip", cidrs).alias("m")).collect()}
    table = spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    b = {r["row_id"]: r["m"] for r in P.cidr_member_flag(df, "ip", table, [30, 25, 28, 32], flag="m").collect()}
    import ipaddress
    want = {i: any(ipaddress.ip_address(ip) in ipaddress.ip_network(c) for c in cidrs) for i, ip in enumerate(ips)}
    assert a == want and b == want


def test_event_pattern_and_log_filter(spark):
    rows = [("aws.config", "Config Rules Compliance Change", '{"newEvaluationResult": {"complianceType": "NON_COMPLIANT"}}'),
            ("aws.config", "Config Rules Compliance Change", '{"newEvaluationResult": {"complianceType": "COMPLIANT"}}'),
            ("aws.wafv2", "Config Rules Compliance Change", '{"newEvaluationResult": {"complianceType": "NON_COMPLIANT"}}')]
    df = spark.createDataFrame(rows, "source string, `detail-type` string, detail string")
    assert df.filter(P.match_pattern(df, K.CONFIG_EVENT_PATTERN, json_col="detail")).count() == 1
    logs = spark.createDataFrame([("ALLOW",), ("BLOCK",), ("COUNT",), (None,)], "action string")
    assert logs.transform(lambda d: P.log_filter(d, [("KEEP", ["BLOCK"], "MEETS_ANY")], "KEEP")).count() == 4
    assert logs.transform(lambda d: P.log_filter(d, [("DROP", ["ALLOW"], "MEETS_ANY")], "KEEP")).count() == 3


def test_blocklist_upsert(spark):
    cur = spark.createDataFrame([("10.0.0.1/32", None, 3)], "cidr string, first_seen timestamp, hits long")
    top = spark.createDataFrame([("10.0.0.1", 5), ("10.0.0.2", 4), ("unknown", 9), ("", 1)], "ip string, cnt long")
    out = RS.upsert(cur, RS.block_candidates(top))
    assert sorted(r["cidr"] for r in out.collect()) == ["10.0.0.1/32", "10.0.0.2/32"]


def test_day_partition_and_today_filter(spark):
    import datetime
    from gatewatch.operators import dashboards as D
    p = D.day_partition(datetime.date(2024, 1, 5))
    assert p == {"year": "2024", "month": "01", "day": "05"}
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    one = D.top_anomalous_ip(sc, **p).collect()
    per_day = {(r["year"], r["month"], r["day"]): (r["ip"], r["cnt"]) for r in D.top_anomalous_ip_per_day(sc).collect()}
    assert [(r["ip"], r["cnt"]) for r in one] == ([per_day[("2024", "01", "05")]] if ("2024", "01", "05") in per_day else [])


def test_cidr_table_lengths_come_from_the_table(spark):
    ips = ["10.0.0.7", "10.9.9.9", "11.0.0.200", "11.0.0.100", "12.0.0.1", "bad", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "row_id long, ip string")
    table = spark.createDataFrame([("10.0.0.0/24",), ("11.0.0.128/25",), ("12.0.0.1/32",), ("10.0.0.0/24",), (None,)], "cidr string")
    got = {r["row_id"]: r["m"] for r in P.cidr_member_flag(df, "ip", table, flag="m").collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
    wide = spark.createDataFrame([("10.0.0.0/8",)], "cidr string")
    assert {r["row_id"] for r in P.cidr_member_flag(df, "ip", wide, flag="m").collect() if r["m"]} == {0, 1}


def test_random_sample_is_not_the_smallest_id(spark):
    from gatewatch.operators.response import sample_one
    drawn = {sample_one(spark.range(1000), "id", seed=k).first()[0] for k in range(8)}
    assert len(drawn) > 4 and drawn != {0}


def test_cidr_sets_of_any_size(spark):
    """Overlapping, nested, touching, /0 and /32 entries against brute force."""
    import ipaddress
    import random

    from pyspark.sql import functions as F

    from gatewatch.operators import policy as P
    rng = random.Random(5)
    near = lambda: f"10.{rng.choice([1, 2])}.{rng.randrange(4)}.{rng.randrange(256)}"
    nets = [f"{near()}/{rng.choice([32, 32, 31, 30, 28, 25, 24, 23, 22])}" for _ in range(300)] + ["10.7.0.0/16", "10.8.0.0/13", "192.168.0.0/17", "172.16.0.1"]
    ips = [near() for _ in range(400)] + ["10.7.255.255", "10.15.3.4", "10.16.0.0", "192.168.127.255", "192.168.128.0", "172.16.0.1", "255.255.255.255", "0.0.0.0"]
    bad = ["10.1.0.0/33", "nonsense", "10.1.0.0/-1", None, ""]

    def check(cidrs):
        held = [ipaddress.ip_network(c, strict=False) for c in cidrs]
        df = spark.createDataFrame([(i, x, True, 1) for i, x in enumerate(ips)] + [(-1, None, True, 1), (-2, "x", True, 1)], "id int, ip string, in_set boolean, _h0 int")
        table = spark.createDataFrame([(c,) for c in [*cidrs, *cidrs[:9], *bad]], "cidr string")
        out = P.cidr_member_flag(df, "ip", table)
        assert sorted(out.columns) == sorted(df.columns)
        got = {r["id"]: r["in_set"] for r in out.collect()}
        assert got == {i: any(ipaddress.ip_address(x) in n for n in held) for i, x in enumerate(ips)} | {-1: False, -2: False}
        return out, table
    out, table = check(nets)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    runs = P.cidr_intervals(table).orderBy("lo").collect()
    assert all(a["hi"] + 1 < b["lo"] or a["bucket"] != b["bucket"] for a, b in zip(runs, runs[1:]))
    check([*nets, "0.0.0.0/0"])
    check(["10.1.0.0/24", "10.1.1.0/24", "10.1.0.128/25"])
    only = P.cidr_member_flag(spark.createDataFrame([("10.7.1.1",), ("172.16.0.1",)], "ip string"), "ip", table, prefix_lengths=[32])
    assert [r["in_set"] for r in only.orderBy("ip").collect()] == [False, True]
    assert P.cidr_intervals(table.where(F.lit(False))).count() == 0
