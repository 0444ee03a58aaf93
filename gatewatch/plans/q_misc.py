"""Unions, nested/JSON access, source round trips, budget, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import codes as C
from gatewatch.functions import text as X
from gatewatch.operators import dashboards as D
from gatewatch.operators import stats as S
from gatewatch.operators.features import spread
from gatewatch.operators.scans import first_per_key
from gatewatch.plans.registry import REGISTRY, query, table
from gatewatch.plans.sqlviews import SCORED, WAF, with_
from gatewatch.session import materialize, scratch_path
from gatewatch.sources import files as FS
from gatewatch.sources import waflogs as WL
from gatewatch.sources.adapters import doc_requests, scored_events, waf_logs, web_requests


@query("mix_union", with_(WAF) + """
SELECT row_id, 'attack' AS source, terminatingruleid AS rule, CAST(NULL AS DOUBLE) AS uri_len, client_ip
FROM waf WHERE action = 'BLOCK'
UNION ALL
SELECT row_id, 'normal', NULL, CAST(length(uri) AS DOUBLE), NULL FROM waf WHERE action = 'ALLOW'""")
def mix_union(spark, sf):
    """Union by name of attack rows and normal rows with different columns
    (missing columns become null)."""
    w = waf_logs(table(spark, sf, "events"))
    attack = w.filter(F.col("action") == "BLOCK").select(
        "row_id", F.lit("attack").alias("source"), F.col("terminatingruleid").alias("rule"),
        F.col("httprequest.clientip").alias("client_ip"))
    normal = w.filter(F.col("action") == "ALLOW").select(
        "row_id", F.lit("normal").alias("source"), X.text_length("httprequest.uri").cast("double").alias("uri_len"))
    return attack.unionByName(normal, allowMissingColumns=True)


@query("json_props", with_(WAF) + """
SELECT w.row_id, w.country AS viewer_country, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
       CASE WHEN w.terminatingruleid LIKE 'AWS-%' THEN w.terminatingruleid END AS group_rule
FROM waf w JOIN events e ON w.row_id = e.event_id""")
def json_props(spark, sf):
    """Nested access: viewer-country header (array of name/value structs),
    JSON property k, first rule-group id; every row."""
    ev = table(spark, sf, "events")
    logs = waf_logs(ev.select("*", F.get_json_object("props", "$.k").cast("long").alias("k")), keep=["k"])
    return logs.select(
        "row_id", C.header_value("httprequest.headers", K.VIEWER_COUNTRY_HEADER, K.UNKNOWN_COUNTRY).alias("viewer_country"),
        F.try_element_at("rulegrouplist", F.lit(1))["rulegroupid"].alias("group_rule"), "k")


@query("waf_json_roundtrip", REGISTRY["rule_blocks"].sql)
def waf_json_roundtrip(spark, sf):
    """Land the logs as JSON partitioned by year/month/day/hour, read them
    back with the explicit nested schema and string partition columns, and
    answer the blocks-per-rule dashboard from the files."""
    w = waf_logs(table(spark, sf, "events")).drop("row_id", "event_ts")
    out = scratch_path(spark, "landing/waf_json")
    WL.land(w, out, fmt="json")
    back = WL.read_landed(spark, out, fmt="json")
    return D.rule_blocks(back)


@query("scored_roundtrip", with_(SCORED) + """
SELECT year, month, day, COUNT(*) AS n, CAST(sum(anomaly) AS BIGINT) AS anomalies FROM scored
WHERE year = '2024' AND month = '01' GROUP BY 1, 2, 3""")
def scored_roundtrip(spark, sf):
    """Scored-event sink (JSON, year/month/day folders) and scan with
    partition predicates (string partition values), counts per day."""
    sc = scored_events(table(spark, sf, "events")).select(
        "event_time", F.lit("NORMAL").alias("mode"), "ip", "pred_risk", F.col("pred_risk").alias("obs_risk"),
        F.lit(0).alias("premit_on"), F.lit(0).alias("mitigation_level"), "anomaly", "raw_score",
        "year", "month", "day")
    out = scratch_path(spark, "landing/scored")
    FS.write_scored(sc, out, mode="overwrite")
    back = FS.read_scored(spark, out, year="2024", month="01")
    return back.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"),
                                                    F.sum("anomaly").cast("long").alias("anomalies"))


@query("csv_roundtrip", with_(WAF) + """
SELECT terminatingruleid, CAST(coalesce(CASE country WHEN 'KR' THEN 0 WHEN 'NL' THEN 1 WHEN 'US' THEN 2 END, 99) AS INTEGER) AS country_code,
       COUNT(*) AS n, CAST(sum(length(uri)) AS BIGINT) AS uri_len_sum
FROM waf GROUP BY 1, 2""")
def csv_roundtrip(spark, sf):
    """Flat log CSV sink with header and the typed CSV scan back; rows per
    rule and country code."""
    w = waf_logs(table(spark, sf, "events"))
    flat = w.select(F.date_format("event_ts", "mm:ss.S").alias("event_time"),
                    F.col("httprequest.clientip").alias("source_ip"),
                    F.col("httprequest.country").alias("source_country"),
                    F.col("httprequest.uri").alias("request_uri"), "terminatingruleid", "action",
                    C.country_code("httprequest.country").cast("int").alias("country_code"),
                    C.rule_code("terminatingruleid").cast("int").alias("rule_code"),
                    X.text_length("httprequest.uri").cast("int").alias("uri_len"))
    out = scratch_path(spark, "landing/csv")
    FS.write_csv(flat, out)
    back = FS.read_csv(spark, out, FS.WAF_FLAT_SCHEMA)
    return back.groupBy("terminatingruleid", "country_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("uri_len").cast("long").alias("uri_len_sum"))


@query("metrics_roundtrip", REGISTRY["before_after"].sql)
def metrics_roundtrip(spark, sf):
    """Evaluation metrics written as a one-object-per-line JSON (flat) and
    read back as the metrics table."""
    sc = scored_events(table(spark, sf, "events"))
    m = S.eval_summary(sc.withColumn("y_pred", F.col("anomaly")), "y_pred", geo_rule=K.RULE_GEO)
    m = m.withColumns({c: F.round(F.col(c), 6) for c in ("precision", "recall", "f1_score", "fpr")})
    out = scratch_path(spark, "landing/metrics")
    FS.write_metrics(m, out, flat=True)
    return FS.read_metrics(spark, out).select(*m.columns)


BUDGET_LIMIT = 50_000_000.0


@query("budget_alert", f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 6) AS cost,
       round(sum(o_totalprice) * 100.0 / {BUDGET_LIMIT}, 6) AS pct_of_limit,
       sum(o_totalprice) * 100.0 / {BUDGET_LIMIT} > {K.BUDGET_ALERT_PCT} AS alert
FROM orders GROUP BY 1""")
def budget_alert(spark, sf):
    """Monthly spend (order totals) against a limit; alert above 80 %."""
    o = table(spark, sf, "orders")
    g = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("c"))
    pct = F.col("c") * 100.0 / F.lit(BUDGET_LIMIT)
    return g.select("month", F.round("c", 6).alias("cost"), F.round(pct, 6).alias("pct_of_limit"),
                    (pct > K.BUDGET_ALERT_PCT).alias("alert"))



def _report_sql():
    from gatewatch.plans.q_text import _threat_sql
    from gatewatch.plans.sqlviews import DOCREQ, WEB, entropy_sql
    bar = "=" * 70
    return with_(WEB, DOCREQ) + f"""
, normals AS (SELECT row_id, request_uri, round({entropy_sql('request_uri')}, 6) AS pe,
                     round({entropy_sql('request_args')}, 6) AS ae
              FROM (SELECT *, row_number() OVER (PARTITION BY request_uri ORDER BY row_id) AS rn FROM web) t
              WHERE rn = 1 ORDER BY row_id LIMIT 8)
, typed AS (SELECT row_id, request_uri, round({entropy_sql('request_args')}, 6) AS args_entropy,
                   {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} AS type FROM docreq)
, sample AS (SELECT type, request_uri, args_entropy
             FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY row_id) AS rn FROM typed) t
             WHERE rn = 1 ORDER BY args_entropy DESC, type LIMIT 12)
, counts AS (SELECT type, COUNT(*) AS cnt FROM typed GROUP BY type)
SELECT 0 AS sec, CAST(0 AS BIGINT) AS ln, '{bar}' AS value
UNION ALL SELECT 0, 1, 'AI Security Threat Analysis Report'
UNION ALL SELECT 0, 2, '{bar}'
UNION ALL SELECT 1, 0, '[normal URI sample]'
UNION ALL SELECT 1, row_number() OVER (ORDER BY row_id),
                 concat_ws('  ', request_uri, CAST(pe AS VARCHAR), CAST(ae AS VARCHAR)) FROM normals
UNION ALL SELECT 2, 0, '[anomaly sample]'
UNION ALL SELECT 2, row_number() OVER (ORDER BY args_entropy DESC, type),
                 concat_ws('  ', type, request_uri, CAST(args_entropy AS VARCHAR)) FROM sample
UNION ALL SELECT 3, 0, '[detections per type]'
UNION ALL SELECT 3, row_number() OVER (ORDER BY cnt DESC, type), concat_ws('  ', type, CAST(cnt AS VARCHAR))
FROM counts"""


@query("analysis_report", _report_sql())
def analysis_report(spark, sf):
    """Threat analysis report as text lines: normal-URI sample (first per
    path, the 8 first rows), anomaly sample (first per type, top 12 by entropy), counts per
    type; also written as a text file."""
    w = spread(web_requests(table(spark, sf, "pages")))
    normals = first_per_key(w, ["request_uri"], "row_id", ["row_id", "request_args"]).orderBy("row_id").limit(8).select(
        "request_uri", F.round(X.shannon_entropy("request_uri"), 6).alias("path_entropy"),
        F.round(X.shannon_entropy("request_args"), 6).alias("args_entropy"))
    d = spread(doc_requests(table(spark, sf, "documents")))
    ent = X.shannon_entropy("request_args")
    typed = materialize(d.select("row_id", "request_uri", F.round(ent, 6).alias("args_entropy"),
                                 X.classify_threat("request_uri", "request_args", ent).alias("type")), "typed_docs")
    sample = first_per_key(typed, ["type"], "row_id", ["request_uri", "args_entropy"]).orderBy(
        F.desc("args_entropy"), "type").limit(12)
    counts = D.value_counts(typed, "type")
    lines = FS.report_lines("AI Security Threat Analysis Report",
                            [("normal URI sample", normals), ("anomaly sample", sample), ("detections per type", counts)])
    FS.write_text(lines, scratch_path(spark, "reports/analysis"))
    return lines
