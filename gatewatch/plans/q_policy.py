"""Policy replay, membership joins, event patterns, log filter, block list."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import text as X
from gatewatch.functions.codes import ipv4_to_long
from gatewatch.operators import dashboards as D
from gatewatch.operators import policy as P
from gatewatch.operators import response as RS
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import SCORED, WAF, restore_args_sql, with_
from gatewatch.sources.adapters import scored_events, waf_logs

TRUSTED = ["10.0.0.0/30", "10.0.1.128/25"]
REPUTATION = ["10.0.2.0/24", "10.0.3.16/28"]


def _ipv_sql(ip):
    return " + ".join(f"CAST(split_part({ip}, '.', {i + 1}) AS BIGINT) * {m}"
                      for i, m in enumerate([16777216, 65536, 256, 1]))


def _in_cidrs_sql(ip, cidrs):
    by = defaultdict(set)
    for c in cidrs:
        p, net = P.parse_cidr(c)
        by[p].add(net)
    if not by:
        return "FALSE"
    v = f"({_ipv_sql(ip)})"
    return "(" + " OR ".join(f"(({v} >> {32 - p}) IN ({', '.join(str(n) for n in sorted(ns))}))"
                             for p, ns in sorted(by.items())) + ")"


def _any_sql(expr, words):
    return "(" + " OR ".join(f"contains(lower(coalesce({expr}, '')), '{w}')" for w in words) + ")"


def _starts_sql(expr, prefixes):
    return "(" + " OR ".join(f"starts_with(lower(coalesce({expr}, '')), '{p}')" for p in prefixes) + ")"


TOP_SQL = """, top AS (SELECT ip FROM (
  SELECT ip, row_number() OVER (PARTITION BY year, month, day ORDER BY COUNT(*) DESC, ip) AS rk
  FROM scored WHERE anomaly = 1 GROUP BY year, month, day, ip) t WHERE rk = 1)
, bl AS (SELECT DISTINCT ip FROM top)"""

REQ_SQL = f""", req AS (SELECT w.row_id, w.country, w.uri, w.client_ip,
       {restore_args_sql('w.terminatingruleid', 'w.row_id')} AS args, bl.ip IS NOT NULL AS blocked
  FROM waf w LEFT JOIN bl ON w.client_ip = bl.ip)"""


def _waf_case(kind):
    geo = "coalesce(country, '') NOT IN ('KR')"
    sqli = f"NOT {_starts_sql('uri', ['/admin/'])} AND NOT {_in_cidrs_sql('client_ip', TRUSTED)} AND {_any_sql('args', K.THREAT_SQL_WORDS)}"
    common = f"NOT {_starts_sql('uri', ['/health', '/metrics'])} AND ({_any_sql('args', K.THREAT_XSS_MARKS)} OR {_any_sql('uri', ['../'])})"
    rep = _in_cidrs_sql("client_ip", REPUTATION)
    if kind == "rule":
        return (f"CASE WHEN {geo} THEN '{K.RULE_GEO}' WHEN blocked THEN '{K.RULE_AI_BLOCK}' "
                f"WHEN {sqli} THEN '{K.RULE_SQLI}' WHEN {common} THEN '{K.RULE_COMMON}' "
                f"WHEN {rep} THEN '{K.RULE_REPUTATION}' ELSE '{K.RULE_DEFAULT}' END")
    return f"CASE WHEN {geo} OR blocked OR ({sqli}) OR ({common}) OR {rep} THEN 'BLOCK' ELSE 'ALLOW' END"


def _requests(spark, sf):
    """Requests with restored query strings and the AI block-list flag."""
    ev = table(spark, sf, "events")
    w = waf_logs(ev).select("row_id", F.col("httprequest.country").alias("country"),
                            F.col("httprequest.uri").alias("uri"), F.col("httprequest.clientip").alias("client_ip"),
                            X.restore_args("terminatingruleid", "row_id").alias("args"))
    top = D.top_anomalous_ip_per_day(scored_events(ev))
    return P.ip_member_flag(w, "client_ip", top, "ip", flag="blocked")


@query("policy_replay", with_(WAF, SCORED) + TOP_SQL + REQ_SQL + f"""
SELECT row_id, {_waf_case('rule')} AS terminatingruleid, {_waf_case('action')} AS action FROM req""")
def policy_replay(spark, sf):
    """Replay the priority-ordered web ACL (geo, AI block list, SQLi with
    /admin/ + trusted-range scope-down, common rules with /health /metrics
    scope-down, IP reputation; default allow) over every request."""
    r = _requests(spark, sf)
    rules = P.waf_rules("country", "blocked", "uri", "args", "client_ip", TRUSTED, REPUTATION)
    return P.replay(r, rules).select("row_id", "terminatingruleid", "action")


@query("scope_down", with_(WAF, SCORED) + TOP_SQL + REQ_SQL + f"""
SELECT {_starts_sql('uri', ['/admin/'])} AS admin_path, {_in_cidrs_sql('client_ip', TRUSTED)} AS trusted_ip,
       {_starts_sql('uri', ['/health', '/metrics'])} AS internal_path,
       {_any_sql('args', K.THREAT_SQL_WORDS)} AS sqli_match, COUNT(*) AS n
FROM req GROUP BY 1, 2, 3, 4""")
def scope_down(spark, sf):
    """How many requests each scope-down (admin path, trusted range, internal
    path) exempts, split by whether the SQLi predicate matched."""
    r = _requests(spark, sf)
    return (r.groupBy(P.lower_starts("uri", ["/admin/"]).alias("admin_path"),
                      P.in_cidrs("client_ip", TRUSTED).alias("trusted_ip"),
                      P.lower_starts("uri", ["/health", "/metrics"]).alias("internal_path"),
                      P.contains_any("args", K.THREAT_SQL_WORDS).alias("sqli_match"))
            .agg(F.count(F.lit(1)).alias("n")))


def _edge_case(kind):
    geo = "coalesce(country, '') NOT IN ('KR')"
    common = f"({_any_sql('args', K.THREAT_XSS_MARKS)} OR {_any_sql('uri', ['../'])})"
    sqli = _any_sql("args", K.THREAT_SQL_WORDS)
    rep = _in_cidrs_sql("client_ip", REPUTATION)
    if kind == "rule":
        return (f"CASE WHEN {geo} THEN 'GeoRestriction-KR-Only' WHEN {common} THEN '{K.RULE_COMMON}' "
                f"WHEN {sqli} THEN '{K.RULE_SQLI}' WHEN {rep} THEN '{K.RULE_REPUTATION}' ELSE '{K.RULE_DEFAULT}' END")
    return f"CASE WHEN {geo} OR {common} OR {sqli} OR {rep} THEN 'BLOCK' ELSE 'ALLOW' END"


@query("edge_policy", with_(WAF, SCORED) + TOP_SQL + REQ_SQL + f"""
SELECT {_edge_case('rule')} AS terminatingruleid, {_edge_case('action')} AS action, COUNT(*) AS n
FROM req GROUP BY 1, 2""")
def edge_policy(spark, sf):
    """Edge ACL replay (country whitelist, common, SQLi, reputation), counts per outcome."""
    r = _requests(spark, sf)
    rules = P.edge_rules("country", "uri", "args", "client_ip", REPUTATION)
    return P.replay(r, rules).groupBy("terminatingruleid", "action").agg(F.count(F.lit(1)).alias("n"))


CONFIG_SQL = f"""cfg AS (SELECT event_id AS row_id, 'aws.config' AS source,
       'Config Rules Compliance Change' AS "detail-type",
       [{', '.join("'" + r + "'" for r in K.CONFIG_RULE_NAMES)}][(user_id % {len(K.CONFIG_RULE_NAMES)}) + 1] AS rule_name,
       CASE WHEN event_type IN ('error', 'signup') THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS compliance
  FROM events)"""


def _config_events(spark, sf):
    """``events`` as compliance-change events (stand-in: rule by user, error
    and signup rows non-compliant) with the nested detail as JSON text."""
    ev = table(spark, sf, "events")
    names = F.array(*[F.lit(n) for n in K.CONFIG_RULE_NAMES])
    rule = F.element_at(names, (F.pmod(F.col("user_id"), F.lit(len(K.CONFIG_RULE_NAMES))) + 1).cast("int"))
    comp = F.when(F.col("event_type").isin("error", "signup"), F.lit("NON_COMPLIANT")).otherwise(F.lit("COMPLIANT"))
    detail = F.to_json(F.struct(rule.alias("configRuleName"),
                                F.struct(comp.alias("complianceType")).alias("newEvaluationResult")))
    return ev.select(F.col("event_id").alias("row_id"), F.lit("aws.config").alias("source"),
                     F.lit("Config Rules Compliance Change").alias("detail-type"), detail.alias("detail"))


@query("event_pattern", with_(CONFIG_SQL) + """
SELECT row_id, rule_name FROM cfg
WHERE source IN ('aws.config') AND "detail-type" IN ('Config Rules Compliance Change')
  AND compliance IN ('NON_COMPLIANT')""")
def event_pattern(spark, sf):
    """Event-pattern filter (source, detail-type, nested complianceType) over
    compliance events; matched events with their rule name."""
    cfg = _config_events(spark, sf)
    m = P.match_pattern(cfg, K.CONFIG_EVENT_PATTERN, json_col="detail")
    return cfg.filter(m).select("row_id", F.get_json_object("detail", "$.configRuleName").alias("rule_name"))


@query("compliance_rollup", with_(CONFIG_SQL) + """
SELECT regexp_extract(rule_name, 'isms-(\\d+-\\d+)', 1) AS control, COUNT(*) AS violations,
       COUNT(DISTINCT rule_name) AS rules
FROM cfg WHERE source = 'aws.config' AND "detail-type" = 'Config Rules Compliance Change'
  AND compliance = 'NON_COMPLIANT' GROUP BY 1""")
def compliance_rollup(spark, sf):
    """Non-compliant events per control id (taken from the rule name)."""
    cfg = _config_events(spark, sf)
    m = cfg.filter(P.match_pattern(cfg, K.CONFIG_EVENT_PATTERN, json_col="detail"))
    rn = F.get_json_object("detail", "$.configRuleName")
    return (m.groupBy(F.regexp_extract(rn, r"isms-(\d+-\d+)", 1).alias("control"))
            .agg(F.count(F.lit(1)).alias("violations"), F.countDistinct(rn).alias("rules")))


LOG_FILTERS = [("DROP", ["ALLOW"], "MEETS_ANY"), ("KEEP", ["BLOCK", "COUNT"], "MEETS_ANY")]


@query("log_filter", with_(WAF) + """
SELECT action, terminatingruleid AS rule, COUNT(*) AS kept FROM waf
WHERE CASE WHEN action = 'ALLOW' THEN 'DROP' WHEN action = 'BLOCK' OR action = 'COUNT' THEN 'KEEP'
           ELSE 'DROP' END = 'KEEP'
GROUP BY 1, 2""")
def log_filter(spark, sf):
    """Logging filter (drop ALLOW, keep BLOCK/COUNT, default drop); kept rows per action and rule."""
    w = waf_logs(table(spark, sf, "events"))
    kept = P.log_filter(w, LOG_FILTERS, default="DROP")
    return kept.groupBy("action", F.col("terminatingruleid").alias("rule")).agg(F.count(F.lit(1)).alias("kept"))


@query("blocklist_pass", with_(WAF, SCORED) + TOP_SQL + """
SELECT w.row_id, w.client_ip, CASE WHEN bl.ip IS NULL THEN 'PASS' ELSE '403' END AS status
FROM waf w LEFT JOIN bl ON w.client_ip = bl.ip""")
def blocklist_pass(spark, sf):
    """Exact-IP block list (daily top anomalous IPs) applied to every request: 403 or pass."""
    ev = table(spark, sf, "events")
    w = waf_logs(ev).select("row_id", F.col("httprequest.clientip").alias("client_ip"))
    top = D.top_anomalous_ip_per_day(scored_events(ev))
    f = P.ip_member_flag(w, "client_ip", top, "ip", flag="blocked")
    return f.select("row_id", "client_ip", F.when(F.col("blocked"), F.lit("403")).otherwise(F.lit("PASS")).alias("status"))


@query("cidr_trusted", with_(WAF, SCORED) + TOP_SQL + f"""
, cand AS (SELECT DISTINCT concat(ip, '/32') AS cidr FROM top)
SELECT w.row_id, {_in_cidrs_sql('w.client_ip', TRUSTED)} AS trusted,
       EXISTS (SELECT 1 FROM cand WHERE cand.cidr = concat(w.client_ip, '/32')) AS in_block_cidrs
FROM waf w""")
def cidr_trusted(spark, sf):
    """CIDR membership: literal trusted ranges (InSet per prefix length) and
    the data-derived /32 block table (equi-join on prefix and network)."""
    ev = table(spark, sf, "events")
    w = waf_logs(ev).select("row_id", F.col("httprequest.clientip").alias("client_ip"))
    w = w.withColumn("trusted", P.in_cidrs("client_ip", TRUSTED))
    cidrs = RS.block_candidates(D.top_anomalous_ip_per_day(scored_events(ev))).select("cidr")
    f = P.cidr_member_flag(w, "client_ip", cidrs, flag="in_block_cidrs")
    return f.select("row_id", "trusted", "in_block_cidrs")


@query("cidr_nested", with_(WAF) + """
, c AS (SELECT concat(client_ip, '/', CAST(CASE WHEN row_id % 97 = 0 THEN 32 WHEN row_id % 89 = 0 THEN 30 WHEN row_id % 701 = 0 THEN 25
                                                WHEN row_id % 1999 = 0 THEN 23 END AS VARCHAR)) AS cidr, client_ip,
               CASE WHEN row_id % 97 = 0 THEN 32 WHEN row_id % 89 = 0 THEN 30 WHEN row_id % 701 = 0 THEN 25 WHEN row_id % 1999 = 0 THEN 23 END AS plen FROM waf)
, k AS (SELECT DISTINCT plen, (""" + _ipv_sql("client_ip") + """) >> (32 - plen) AS net FROM c WHERE plen IS NOT NULL)
, a AS (SELECT DISTINCT client_ip, """ + _ipv_sql("client_ip") + """ AS v FROM waf)
SELECT row_id, client_ip, client_ip IN (SELECT client_ip FROM a JOIN k ON (a.v >> (32 - k.plen)) = k.net) AS in_set FROM waf""")
def cidr_nested(spark, sf):
    """Requests inside a derived CIDR table of overlapping and nested entries
    (/32 to /23): disjoint intervals per /16 bucket, one equi-join."""
    w = waf_logs(table(spark, sf, "events")).select("row_id", F.col("httprequest.clientip").alias("client_ip"))
    r = F.col("row_id")
    plen = F.when(r % 97 == 0, 32).when(r % 89 == 0, 30).when(r % 701 == 0, 25).when(r % 1999 == 0, 23)
    cidrs = w.where(plen.isNotNull()).select(F.concat_ws("/", "client_ip", plen.cast("string")).alias("cidr")).distinct()
    return P.cidr_member_flag(w, "client_ip", cidrs)


@query("blocklist_append", with_(SCORED) + """
, daily AS (SELECT year, month, day, ip, cnt, first_ts FROM (
  SELECT year, month, day, ip, COUNT(*) AS cnt, min(event_ts) AS first_ts,
         row_number() OVER (PARTITION BY year, month, day ORDER BY COUNT(*) DESC, ip) AS rk
  FROM scored WHERE anomaly = 1 GROUP BY year, month, day, ip) t WHERE rk = 1)
, cur AS (SELECT concat(ip, '/32') AS cidr, min(first_ts) AS first_seen, sum(cnt) AS hits
          FROM daily WHERE day <= '10' AND coalesce(ip, '') NOT IN ('', 'unknown') GROUP BY 1)
, inc AS (SELECT concat(ip, '/32') AS cidr, min(first_ts) AS first_seen, sum(cnt) AS hits
          FROM daily WHERE coalesce(ip, '') NOT IN ('', 'unknown') GROUP BY 1)
SELECT cidr, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, CAST(hits AS BIGINT) AS hits, 'existing' AS origin FROM cur
UNION ALL
SELECT cidr, strftime(first_seen, '%Y-%m-%d %H:%M:%S'), CAST(hits AS BIGINT), 'appended' FROM inc
WHERE cidr NOT IN (SELECT cidr FROM cur)""")
def blocklist_append(spark, sf):
    """Block-list upsert: the list built from days 1-10 plus the absent /32
    entries of all days (left anti join, de-duplicated)."""
    sc = scored_events(table(spark, sf, "events"))
    counts = (sc.filter(F.col("anomaly") == 1).groupBy("year", "month", "day", "ip")
              .agg(F.count(F.lit(1)).alias("cnt"), F.min("event_ts").alias("first_ts")))
    daily = D.top_per_group(counts, ["year", "month", "day"], "cnt", "ip", extra=["first_ts"])
    cur = RS.block_candidates(daily.filter(F.col("day") <= "10"), ts="first_ts")
    inc = RS.block_candidates(daily, ts="first_ts")
    out = RS.upsert(cur.withColumn("origin", F.lit("existing")), inc.withColumn("origin", F.lit("appended")))
    return out.select("cidr", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
                      "hits", "origin")


@query("defense_signals", with_(SCORED) + """
, b AS (SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS bs, ip FROM scored
        WHERE anomaly = 1 AND coalesce(ip, '') NOT IN ('', 'unknown'))
SELECT strftime(bs, '%Y-%m-%d %H:%M:%S') AS bucket_start, ip, 'DefenseSignal' AS metric, COUNT(*) AS signals
FROM b GROUP BY ROLLUP (bs, ip) HAVING bs IS NOT NULL""")
def defense_signals(spark, sf):
    """Defense-signal points (one per anomalous request) per 5-minute bucket
    and IP, plus the overall count per bucket."""
    sc = scored_events(table(spark, sf, "events")).filter((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    return RS.defense_signals(sc, "event_ts")


@query("ip_codes", with_(WAF) + f"""
SELECT row_id, client_ip, {_ipv_sql('client_ip')} AS ip_long, concat(client_ip, '/32') AS cidr FROM waf""")
def ip_codes(spark, sf):
    """IPv4 text -> bigint and -> /32 CIDR text for every request."""
    from gatewatch.functions.codes import ip_to_cidr32
    w = waf_logs(table(spark, sf, "events")).select("row_id", F.col("httprequest.clientip").alias("client_ip"))
    return w.select("row_id", "client_ip", ipv4_to_long("client_ip").alias("ip_long"),
                    ip_to_cidr32("client_ip").alias("cidr"))
