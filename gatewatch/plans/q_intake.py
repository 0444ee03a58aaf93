"""Log intake, edge decision, daily report, nested reports, sinks, and the
evaluation and analysis jobs with a model in them."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch import constants as K
from gatewatch.functions import text as X
from gatewatch.operators import dashboards as D
from gatewatch.operators import forest as FR
from gatewatch.operators import policy as P
from gatewatch.operators import response as RS
from gatewatch.operators import stats as S
from gatewatch.operators.features import add_codes, add_entropy_features, edge_frame
from gatewatch.operators.scans import first_per_key
from gatewatch.plans.q_model import _case_tree
from gatewatch.plans.q_policy import CONFIG_SQL, _config_events
from gatewatch.plans.q_stats import _r6, eval_sql
from gatewatch.plans.q_text import _threat_sql
from gatewatch.plans.registry import REGISTRY, query, table
from gatewatch.plans.sqlviews import SCORED, WAF, entropy_sql, restore_args_sql, with_
from gatewatch.session import materialize, scratch_path
from gatewatch.sources import files as FS
from gatewatch.sources import projection as PJ
from gatewatch.sources import waflogs as WL
from gatewatch.sources.adapters import scored_events, stand_in_ip, waf_logs


# ------------------------------------------------------------------ log intake
def _delivered(spark, sf):
    """Stand-in delivery: every log record as a JSON line under
    yyyy/mm/dd/hh/, the lines of some rows cut in half."""
    w = waf_logs(table(spark, sf, "events"))
    js = F.to_json(F.struct(*[f.name for f in WL.WAF_SCHEMA.fields]))
    cut = F.when(F.col("row_id") % 13 == 0, F.expr("substr(j, 1, length(j) div 2)")).otherwise(F.col("j"))
    out = scratch_path(spark, "landing/delivery")
    WL.deliver(w.withColumn("j", js).select(cut.alias("value"), *WL.PARTITIONS), out)
    return out


@query("log_intake", with_(WAF) + """
SELECT year, month, day, COUNT(*) AS lines, CAST(sum(CASE WHEN row_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN row_id % 13 <> 0 AND action = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS blocks
FROM waf WHERE year = '2024' AND month = '01' AND day BETWEEN '03' AND '20' AND hour BETWEEN '06' AND '11'
GROUP BY 1, 2, 3""")
def log_intake(spark, sf):
    """Raw JSON lines under yyyy/mm/dd/hh/ read through the projected folder
    range (days 3-20, hours 6-11) with partition columns from the path; lines,
    malformed lines and blocks per day."""
    glob = WL.projected_glob(_delivered(spark, sf), WL.projected_values("enum", ["2024"]), WL.projected_values("enum", ["01"]),
                             WL.projected_values("integer", (3, 20)), WL.projected_values("integer", (6, 11)))
    logs = WL.read_json_logs(spark, glob)
    bad = F.col("_corrupt_record").isNotNull() & F.col("timestamp").isNull()
    return logs.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(bad.cast("long")).alias("malformed"),
        F.sum(F.coalesce(F.col("action") == "BLOCK", F.lit(False)).cast("long")).alias("blocks"))


@query("log_lines", with_(WAF) + """
SELECT year, month, day, COUNT(*) AS lines, CAST(sum(CASE WHEN row_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed FROM waf GROUP BY 1, 2, 3""")
def log_lines(spark, sf):
    """Delivered lines and malformed lines per day, over all folders."""
    logs = WL.read_json_logs(spark, f"{_delivered(spark, sf)}/*/*/*/*/")
    return WL.count_malformed(logs, WL.PARTITIONS[:3]).withColumnRenamed("rows", "lines")


@query("projected_hours", with_(WAF) + """
SELECT year, month, day, hour, COUNT(*) AS lines, CAST(sum(CASE WHEN row_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN row_id % 13 <> 0 AND action = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS blocks
FROM waf GROUP BY 1, 2, 3, 4""")
def projected_hours(spark, sf):
    """Lines, malformed lines and blocks of every delivered folder, read
    through the projecting source over the whole calendar."""
    logs = PJ.read_projected_logs(spark, _delivered(spark, sf), {"year": (2023, 2025), "month": (1, 12), "day": (1, 31), "hour": (0, 23)}, {"year": 4})
    out = WL.count_malformed(logs.withColumn("block", F.coalesce(F.col("action") == "BLOCK", F.lit(False)).cast("long")), WL.PARTITIONS, F.sum("block").alias("blocks"))
    return out.withColumnRenamed("rows", "lines")


@query("landed_day_hours", with_(WAF) + """
SELECT strftime(date_trunc('hour', make_timestamp(ts_ms * 1000)), '%Y-%m-%d %H:%M:%S') AS block_hour,
       terminatingruleid AS rule, COUNT(*) AS cnt
FROM waf WHERE action = 'BLOCK' AND row_id % 13 <> 0 AND year = '2024' AND month = '01' AND day = '05' GROUP BY 1, 2""")
def landed_day_hours(spark, sf):
    """Delivered lines of days 4-6 -> valid rows -> landed Parquet; blocks per
    hour and rule of one day, whose predicate prunes the other partitions."""
    glob = WL.projected_glob(_delivered(spark, sf), ["2024"], ["01"], WL.projected_values("integer", (4, 6)),
                             WL.projected_values("integer", (0, 23)))
    out = scratch_path(spark, "landing/valid")
    WL.land(WL.valid_logs(WL.read_json_logs(spark, glob)).drop("_corrupt_record"), out)
    return D.hourly_rule(WL.read_landed(spark, out), year="2024", month="01", day="05")


REPORT_DATES = [dt.date(2024, 1, 9), dt.date(2024, 1, 30), dt.date(2030, 2, 3)]


@query("daily_report", with_(SCORED) + """
, d AS (SELECT unnest(['2024-01-09', '2024-01-30', '2030-02-03']) AS run_day)
, c AS (SELECT concat_ws('-', year, month, day) AS run_day, ip, COUNT(*) AS cnt FROM scored WHERE anomaly = 1 GROUP BY 1, 2)
, t AS (SELECT *, row_number() OVER (PARTITION BY run_day ORDER BY cnt DESC, ip) AS rk FROM c)
SELECT d.run_day, CASE WHEN t.cnt IS NULL THEN 'no_data' ELSE 'ok' END AS status, t.ip, t.cnt
FROM d LEFT JOIN t ON d.run_day = t.run_day AND t.rk = 1""")
def daily_report(spark, sf):
    """The daily analyzer for three run dates: top anomalous IP of that day's
    partition, or ``no_data``."""
    sc = scored_events(table(spark, sf, "events"))
    out = None
    for day in REPORT_DATES:
        one = D.daily_report(sc, day)
        out = one if out is None else out.unionByName(one)
    return out


# --------------------------------------------------------------- edge decision
EDGE_OFFSET, EDGE_THRESHOLD = -0.46, -0.5


# a fixed 4-tree forest over three features (length, path entropy, a second entropy)
FOREST_PSI = 64
FOREST = [
    # tree, node, left, right, feature, threshold, n_node_samples
    (0, 0, 1, 2, 2, 2.0, 64), (0, 1, 3, 4, 0, 16.0, 56), (0, 2, 5, 6, 2, 4.2, 8), (0, 3, -1, -1, -2, -2.0, 30),
    (0, 4, -1, -1, -2, -2.0, 26), (0, 5, -1, -1, -2, -2.0, 5), (0, 6, -1, -1, -2, -2.0, 3),
    (1, 0, 1, 2, 0, 13.0, 64), (1, 1, -1, -1, -2, -2.0, 4), (1, 2, 3, 4, 1, 3.0, 60), (1, 3, -1, -1, -2, -2.0, 20),
    (1, 4, 5, 6, 1, 3.4, 40), (1, 5, -1, -1, -2, -2.0, 24), (1, 6, -1, -1, -2, -2.0, 16),
    (2, 0, 1, 2, 1, 3.6, 64), (2, 1, 3, 4, 2, 4.0, 54), (2, 2, -1, -1, -2, -2.0, 10), (2, 3, -1, -1, -2, -2.0, 48),
    (2, 4, -1, -1, -2, -2.0, 6),
    (3, 0, 1, 2, 2, 3.9, 64), (3, 1, 3, 4, 0, 19.0, 54), (3, 2, -1, -1, -2, -2.0, 10), (3, 3, -1, -1, -2, -2.0, 40),
    (3, 4, -1, -1, -2, -2.0, 14),
]


def _forest_pdf() -> pd.DataFrame:
    cols = ["tree_id", "node_id", "left", "right", "feature", "threshold", "n_node_samples"]
    return pd.DataFrame(FOREST, columns=cols).assign(forest_id="fixed")


def _score_sql(feats: list[str]) -> str:
    trees = sorted({g[0] for g in FOREST})
    hs = " + ".join(_case_tree([g for g in FOREST if g[0] == t], feats) for t in trees)
    return f"round(-pow(2.0, -(({hs}) / {len(trees)}) / {FR.c_factor(FOREST_PSI)}), 9)"


def _fixed_forest(features: list[str]) -> FR.Forest:
    return FR.Forest(nodes=None, features=features, max_samples=FOREST_PSI, n_trees=4)


@query("edge_decision", with_(WAF) + f"""
, r AS (SELECT row_id, CASE WHEN row_id % 17 = 0 THEN NULL ELSE uri END AS uri FROM waf)
, f AS (SELECT row_id, uri, CAST(length(uri) AS DOUBLE) AS uri_len, {entropy_sql('uri')} AS uri_entropy FROM r)
, s AS (SELECT row_id, CASE WHEN uri IS NOT NULL THEN {_score_sql(['uri_len', 'uri_entropy', '0.9182958340544896'])} END AS score FROM f)
SELECT row_id, CASE WHEN score IS NULL THEN 'FAIL_OPEN' WHEN score - ({EDGE_OFFSET}) < 0 THEN 'BLOCK' ELSE 'ALLOW' END AS action_offset,
       CASE WHEN score IS NULL THEN 'FAIL_OPEN' WHEN score < {EDGE_THRESHOLD} THEN 'BLOCK' ELSE 'ALLOW' END AS action_fixed,
       CASE WHEN score - ({EDGE_OFFSET}) < 0 THEN 1 WHEN score IS NOT NULL THEN 0 END AS anomaly,
       round(score - ({EDGE_OFFSET}), 4) AS score_r4
FROM s""")
def edge_decision(spark, sf):
    """Edge feature set (viewer-country header, URI length and entropy), score
    of a fixed forest, BLOCK / ALLOW / FAIL_OPEN in both threshold modes and
    the scoring API's {anomaly, score}. Stand-in: some requests have no URI,
    which cannot be scored."""
    w = waf_logs(table(spark, sf, "events"))
    uri = F.when(F.col("row_id") % 17 != 0, F.col("httprequest.uri"))
    req = w.select("row_id", uri.alias("uri"), F.col("httprequest.headers").alias("headers"))
    scored = FR.score(edge_frame(req, K.COUNTRY_CODES), _fixed_forest(["uri_len", "uri_entropy", "rule_entropy"]), nodes_pdf=_forest_pdf())
    scored = scored.withColumn("score", F.round("score", 9))
    out = scored.withColumn("decision", F.col("score") - F.lit(EDGE_OFFSET))
    api = FR.decision_label("decision")
    return out.select("row_id", FR.edge_action("score", "offset", offset=EDGE_OFFSET).alias("action_offset"),
                      FR.edge_action("score", "fixed_threshold", fixed_threshold=EDGE_THRESHOLD).alias("action_fixed"),
                      api["anomaly"].alias("anomaly"), api["score_r4"].alias("score_r4"))


# ------------------------------------------------------- evaluation and analysis
CONTAMINATION, TOLERANCE = 0.25, 0.10
MODEL_SQL = with_(WAF) + f"""
, a AS (SELECT row_id, terminatingruleid, action, uri, {restore_args_sql('terminatingruleid', 'row_id')} AS request_args FROM waf)
, f AS (SELECT *, CAST(length(uri) AS DOUBLE) AS uri_len, {entropy_sql('uri')} AS path_entropy,
               {entropy_sql('request_args')} AS args_entropy FROM a)
, s AS (SELECT *, {_score_sql(['uri_len', 'path_entropy', 'args_entropy'])} AS score FROM f)
, m AS (SELECT *, CASE WHEN score - (SELECT quantile_cont(score, {CONTAMINATION}) FROM s) < 0 THEN -1 ELSE 1 END AS prediction FROM s)
"""


def _predicted(spark, sf):
    """Log rows with restored args, features, a fixed forest's score, and the
    prediction at the exact contamination quantile."""
    w = waf_logs(table(spark, sf, "events"))
    flat = w.select("row_id", "terminatingruleid", "action", F.col("httprequest.country").alias("country"),
                    F.col("httprequest.uri").alias("uri"),
                    X.restore_args("terminatingruleid", "row_id").alias("request_args"))
    feats = add_entropy_features(add_codes(flat))
    scored = FR.score(feats, _fixed_forest(["uri_len", "path_entropy", "args_entropy"]), nodes_pdf=_forest_pdf())
    scored = materialize(scored.withColumn("score", F.round("score", 9)), "predicted")
    return FR.threshold(scored, CONTAMINATION)[0]


@query("eval_model", MODEL_SQL + eval_sql("CASE WHEN prediction = -1 THEN 1 ELSE 0 END", "m"))
def eval_model(spark, sf):
    """Evaluation job with the model in it: features, fixed forest, prediction
    at contamination 0.25, -1/1 -> 1/0, counts, confusion, metrics."""
    p = _predicted(spark, sf).withColumn("y_pred", S.prediction_flag("prediction"))
    return _r6(S.eval_summary(p, "y_pred", geo_rule=K.RULE_GEO), ["precision", "recall", "f1_score", "fpr"])


BAR = "=" * 70
TITLE = "AI Security Threat Analysis Report"
ANALYSIS_SQL = MODEL_SQL + f"""
, r AS (SELECT avg(CASE WHEN prediction = -1 THEN 1.0 ELSE 0.0 END) AS rate, COUNT(*) AS n FROM m)
, t AS (SELECT *, abs(rate - {CONTAMINATION}) > {TOLERANCE} AS trig,
               (n - 1) * greatest({K.SENTINEL_MIN_C}, least({K.SENTINEL_MAX_C}, rate)) AS h FROM r)
, o AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS rk FROM m)
, v AS (SELECT max(CASE WHEN rk = floor(h) THEN score END) AS lo, max(CASE WHEN rk = ceil(h) THEN score END) AS hi FROM o, t)
, p AS (SELECT m.*, CASE WHEN trig THEN score < lo + (h - floor(h)) * (hi - lo) ELSE prediction = -1 END AS flagged FROM m, t, v)
, y AS (SELECT row_id, uri, round(path_entropy, 6) AS pe, round(args_entropy, 6) AS ae,
               {_threat_sql('uri', 'request_args', 'args_entropy')} AS type FROM p WHERE flagged)
, ysample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY row_id) AS rn FROM y) q
              WHERE rn = 1 ORDER BY ae DESC, type LIMIT 12)
, nsample AS (SELECT * FROM (SELECT row_id, uri, round(path_entropy, 6) AS pe, round(args_entropy, 6) AS ae,
                             row_number() OVER (PARTITION BY uri ORDER BY row_id) AS rn FROM p WHERE NOT flagged) q
              WHERE rn = 1 ORDER BY row_id LIMIT 8)
, counts AS (SELECT type, COUNT(*) AS cnt FROM y GROUP BY type)
SELECT 0 AS sec, CAST(0 AS BIGINT) AS ln, '{BAR}' AS value
UNION ALL SELECT 0, 1, '{TITLE}'
UNION ALL SELECT 0, 2, '{BAR}'
UNION ALL SELECT 1, 0, '[sentinel]'
UNION ALL SELECT 1, 1, concat_ws('  ', CASE WHEN trig THEN 're_threshold' ELSE 'pass_through' END,
                                 concat(CAST(round(round(rate, 4) * 100, 1) AS VARCHAR), '%')) FROM t
UNION ALL SELECT 2, 0, '[normal URI sample]'
UNION ALL SELECT 2, row_number() OVER (ORDER BY row_id), concat_ws('  ', uri, CAST(pe AS VARCHAR), CAST(ae AS VARCHAR)) FROM nsample
UNION ALL SELECT 3, 0, '[anomaly sample]'
UNION ALL SELECT 3, row_number() OVER (ORDER BY ae DESC, type), concat_ws('  ', type, uri, CAST(ae AS VARCHAR)) FROM ysample
UNION ALL SELECT 4, 0, '[detections per type]'
UNION ALL SELECT 4, row_number() OVER (ORDER BY cnt DESC, type), concat_ws('  ', type, CAST(cnt AS VARCHAR)) FROM counts"""


@query("model_analysis", ANALYSIS_SQL)
def model_analysis(spark, sf):
    """Analysis job with the model in it: args restored, fixed forest scored,
    contamination sentinel, flagged rows classified; the report holds the
    sentinel line, the first 8 normal paths in row order, the first flagged
    row per type (top 12 by args entropy) and the counts per type."""
    final, report = S.sentinel(_predicted(spark, sf), "score", "prediction", CONTAMINATION, TOLERANCE)
    rows = materialize(final.select("row_id", "uri", "final_prediction", F.round("path_entropy", 6).alias("pe"),
                                    F.round("args_entropy", 6).alias("ae"),
                                    X.classify_threat("uri", "request_args", "args_entropy").alias("type")), "analysed")
    normals = first_per_key(rows.filter("final_prediction = 1"), ["uri"], "row_id", ["row_id", "pe", "ae"])
    flagged = rows.filter("final_prediction = -1")
    sample = first_per_key(flagged, ["type"], "row_id", ["uri", "ae"]).orderBy(F.desc("ae"), "type").limit(12)
    rate = F.concat(F.round(F.col("actual_anomaly_rate") * 100, 1).cast("string"), F.lit("%"))
    lines = FS.report_lines(TITLE, [
        ("sentinel", report.select("action", rate.alias("rate"))),
        ("normal URI sample", normals.orderBy("row_id").limit(8).select("uri", "pe", "ae")),
        ("anomaly sample", sample.select("type", "uri", "ae")),
        ("detections per type", D.value_counts(flagged, "type"))])
    FS.write_text(lines, scratch_path(spark, "reports/model_analysis"))
    return lines


# ------------------------------------------------------------- nested reports
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
FINDING = ("results array<struct<rule_id:string,severity:string,description:string,links:array<string>,status:int,"
           "location:struct<filename:string,start_line:int,end_line:int>>>")
FINDINGS_SQL = """WITH f AS (SELECT concat('rule-', CAST(l_suppkey % 23 AS VARCHAR)) AS rule_id,
       ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][(l_partkey % 4) + 1] AS severity, l_linestatus = 'F' AS passed,
       CAST(l_linenumber AS BIGINT) AS start_line FROM lineitem)
"""


def _findings(spark, sf):
    """Stand-in scan reports, one JSON document per order with its lines as
    the nested results; written as JSON lines and flattened from the files."""
    li = table(spark, sf, "lineitem")
    finding = F.struct(
        F.concat(F.lit("rule-"), (F.col("l_suppkey") % 23).cast("string")).alias("rule_id"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("severity"),
        F.lit("finding").alias("description"), F.array(F.lit("https://docs.example/rule")).alias("links"),
        (F.col("l_linestatus") == "F").cast("int").alias("status"),
        F.struct(F.lit("main.tf").alias("filename"), F.col("l_linenumber").cast("int").alias("start_line"),
                 F.col("l_linenumber").cast("int").alias("end_line")).alias("location"))
    out = scratch_path(spark, "landing/findings")
    li.groupBy("l_orderkey").agg(F.collect_list(finding).alias("results")).select("results").write.json(out)
    return FS.flatten_findings(spark, out, multi_line=False, schema=FINDING)


@query("findings_severity", FINDINGS_SQL + """
SELECT severity, COUNT(*) AS findings, CAST(sum(CASE WHEN passed THEN 0 ELSE 1 END) AS BIGINT) AS failed,
       sum(start_line)::BIGINT AS lines, COUNT(*) AS linked FROM f GROUP BY severity""")
def findings_severity(spark, sf):
    """Nested scan reports flattened: findings, failed ones, line numbers and
    linked findings per severity."""
    f = materialize(_findings(spark, sf), "findings")
    extra = f.groupBy("severity").agg(F.sum("start_line").alias("lines"), F.count("link").alias("linked"))
    return FS.severity_rollup(f).join(extra, "severity")


@query("findings_by_rule", FINDINGS_SQL + "SELECT rule_id, " + ", ".join(
    f"COUNT(*) FILTER (severity = '{s}') AS \"{s}\"" for s in SEVERITIES) + " FROM f GROUP BY rule_id")
def findings_by_rule(spark, sf):
    """Findings per rule, one column per severity, from the nested reports."""
    return FS.severity_by_rule(_findings(spark, sf), SEVERITIES)


@query("api_log_scan", """
SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
       CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, COUNT(*) AS n,
       CAST(sum(user_id) AS BIGINT) AS bytes FROM events WHERE event_id % 19 <> 0 GROUP BY 1, 2""")
def api_log_scan(spark, sf):
    """API access log written as JSON lines, some cut, read with the string
    schema; requests and bytes per method and status of the lines that parse."""
    ev = table(spark, sf, "events")
    rec = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("requestId"), stand_in_ip("user_id").alias("ip"),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss").alias("requestTime"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET")).alias("httpMethod"),
        F.concat(F.lit("/"), F.col("event_type")).alias("resourcePath"),
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("status"),
        F.lit("HTTP/1.1").alias("protocol"), F.col("user_id").cast("string").alias("responseLength")))
    cut = F.when(F.col("event_id") % 19 == 0, F.expr("substr(j, 1, length(j) div 2)")).otherwise(F.col("j"))
    out = scratch_path(spark, "landing/api_logs")
    ev.withColumn("j", rec).select(cut.alias("value")).write.text(out)
    logs = FS.read_api_logs(spark, out).filter(F.col("requestId").isNotNull() & F.col("responseLength").isNotNull())
    return logs.groupBy(F.col("httpMethod").alias("method"), "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("responseLength").cast("long")).alias("bytes"))


@query("metrics_document", f"""SELECT s.*, (SELECT COUNT(*) FROM events WHERE event_type = 'error') AS sqli_rows
FROM ({REGISTRY['contamination_sweep'].sql}) s""")
def metrics_document(spark, sf):
    """Nested metrics document: the sweep as an array of experiments and the
    evaluation groups as a map, written as one JSON object and read back."""
    sweep = REGISTRY["contamination_sweep"].build(spark, sf)
    sweep = sweep.select("contamination", *[c for c in sweep.columns if c != "contamination"])
    groups = scored_events(table(spark, sf, "events")).groupBy(S.eval_group().alias("grp")).agg(F.count(F.lit(1)).alias("rows"))
    out = scratch_path(spark, "landing/metrics_document")
    FS.write_metrics_document(sweep, groups, "grp", out)
    back = FS.read_metrics_document(spark, out, sweep.schema, T.StructType([T.StructField("rows", T.LongType())]))
    return back.withColumn("sqli_rows", F.col("groups")[K.GROUP_SQLI]["rows"]).drop("groups")


# ----------------------------------------------------------------------- sinks
@query("signal_sink", with_(WAF) + f"""
SELECT '{K.DEFENSE_METRIC}' AS metric, client_ip AS attack_ip, 'Count' AS unit, CAST(COUNT(*) AS DOUBLE) AS value
FROM waf WHERE action = 'BLOCK' GROUP BY client_ip""")
def signal_sink(spark, sf):
    """One defense-signal point per block, appended in two runs (first and
    second half of the month) to one table; the table's sum per IP."""
    w = waf_logs(table(spark, sf, "events"))
    b = D.blocked(w).select("event_ts", "day", F.col("httprequest.clientip").alias("ip"))
    out = scratch_path(spark, "sinks/defense_signals")
    for half in (F.col("day") <= "15", F.col("day") > "15"):
        FS.append_table(RS.signal_points(b.filter(half), "event_ts"), out)
    return spark.read.parquet(out).groupBy("metric", "attack_ip", "unit").agg(F.sum("value").alias("value"))


@query("alert_fanout", with_(CONFIG_SQL) + """
SELECT row_id, 'compliance' AS topic, "detail-type" AS subject, rule_name AS message FROM cfg WHERE compliance = 'NON_COMPLIANT'""")
def alert_fanout(spark, sf):
    """Events matching the compliance pattern appended to the alert table with
    topic, subject and message, read back from it."""
    cfg = _config_events(spark, sf)
    hit = cfg.filter(P.match_pattern(cfg, K.CONFIG_EVENT_PATTERN, json_col="detail"))
    out = scratch_path(spark, "sinks/alerts")
    FS.append_table(hit.select("row_id", F.lit("compliance").alias("topic"), F.col("`detail-type`").alias("subject"),
                               F.get_json_object("detail", "$.configRuleName").alias("message")), out)
    return spark.read.parquet(out)
