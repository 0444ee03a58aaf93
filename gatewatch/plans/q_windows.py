"""Order-dependent queries: first row per key, top-k sample, risk mapping,
scenario phases, pre-mitigation latch, running counters, episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import codes as C
from gatewatch.functions import text as X
from gatewatch.operators import risk as RK
from gatewatch.operators.features import spread
from gatewatch.operators.scans import first_per_key, islands, prefix_scan
from gatewatch.plans.q_text import _threat_sql
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import DOCREQ, SCORED, WEB, entropy_sql, with_
from gatewatch.sources.adapters import doc_requests, scored_events, web_requests

CYCLE = float(sum(d for _, d in K.SCENARIO))


@query("first_per_key", with_(WEB) + f"""
SELECT request_uri, row_id, round({entropy_sql('request_uri')}, 6) AS path_entropy,
       round({entropy_sql('request_args')}, 6) AS args_entropy
FROM (SELECT *, row_number() OVER (PARTITION BY request_uri ORDER BY row_id) AS rn FROM web) t WHERE rn = 1""")
def first_per_key_q(spark, sf):
    """drop_duplicates(request_uri) keeping the first page by id, with its entropies."""
    w = web_requests(table(spark, sf, "pages"))
    f = first_per_key(w, ["request_uri"], "row_id", ["row_id", "request_args"])
    return f.select("request_uri", "row_id", X.round6(X.shannon_entropy("request_uri")).alias("path_entropy"),
                    X.round6(X.shannon_entropy("request_args")).alias("args_entropy"))


@query("entropy_top12", with_(DOCREQ) + f"""
, typed AS (SELECT row_id, request_uri, round({entropy_sql('request_args')}, 6) AS args_entropy,
                   {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} AS threat_type FROM docreq)
SELECT threat_type, row_id, request_uri, args_entropy FROM (
  SELECT *, row_number() OVER (PARTITION BY threat_type ORDER BY row_id) AS rn FROM typed) t
WHERE rn = 1 ORDER BY args_entropy DESC, row_id LIMIT 12""")
def entropy_top12(spark, sf):
    """Anomaly sample: first document per threat type, top 12 by query-string entropy."""
    d = spread(doc_requests(table(spark, sf, "documents")))
    ent = X.shannon_entropy("request_args")
    typed = d.select("row_id", "request_uri", X.round6(ent).alias("args_entropy"),
                     X.classify_threat("request_uri", "request_args", ent).alias("threat_type"))
    first = first_per_key(typed, ["threat_type"], "row_id", ["row_id", "request_uri", "args_entropy"])
    return first.orderBy(F.desc("args_entropy"), "row_id").limit(12)


def _bounds_sql():
    return """, b AS (SELECT quantile_cont(raw_score, 0.05) AS thr, min(raw_score) AS lo, max(raw_score) AS hi FROM scored)"""


RISK_SQL = """CASE WHEN raw_score >= thr
     THEN (1 - (raw_score - thr) / (CASE WHEN hi - thr = 0 THEN 1.0 ELSE hi - thr END)) * 70
     ELSE 100 - ((raw_score - lo) / (CASE WHEN thr - lo = 0 THEN 1.0 ELSE thr - lo END)) * 30 END"""


def _scored(spark, sf):
    return scored_events(table(spark, sf, "events"))


@query("risk_map", with_(SCORED) + _bounds_sql() + f"""
SELECT row_id, round({RISK_SQL}, 6) AS obs_risk FROM scored, b""")
def risk_map(spark, sf):
    """Score -> 0..100 observed risk around the exact 5th-percentile threshold."""
    sc = _scored(spark, sf)
    b = RK.score_bounds(sc, "raw_score")
    return sc.select("row_id", F.round(RK.risk_from_score("raw_score", b["threshold"], b["min"], b["max"],
                                                          digits=None), 6).alias("obs_risk"))


T_SQL = f"(CAST(epoch_us(event_ts) % {int(CYCLE * 1_000_000)} AS DOUBLE) / 1000000.0)"


def _mode_sql(t):
    acc, parts = 0.0, []
    for name, dur in K.SCENARIO:
        acc += dur
        parts.append(f"WHEN {t} < {acc} THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE '{K.SCENARIO[-1][0]}' END"


def _ladder_sql(t):
    a, b = K.MITIGATION_STEPS
    s, span = K.MITIGATION_START, K.MITIGATION_SPAN
    return f"CASE WHEN {t} < {s} THEN 0 WHEN {t} < {s + span * a} THEN 1 WHEN {t} < {s + span * b} THEN 2 ELSE 3 END"


def _clocked(spark, sf):
    sc = _scored(spark, sf).withColumn("t", RK.scenario_clock("event_ts", CYCLE))
    return sc.withColumn("mode", RK.scenario_phase("t"))


@query("mitigation", with_(SCORED) + f"""
SELECT row_id, round({T_SQL}, 6) AS t, {_mode_sql(T_SQL)} AS mode, {_ladder_sql(T_SQL)} AS ladder_level FROM scored""")
def mitigation(spark, sf):
    """Scenario clock -> phase (half-open lookup, past end = last) and the
    time-based mitigation ladder for every scored event."""
    c = _clocked(spark, sf)
    return c.select("row_id", F.round("t", 6).alias("t"), "mode", RK.mitigation_ladder("t").alias("ladder_level"))


#: What the latch reads; a scan stores no other column.
LATCH_COLS = ["row_id", "ip", "event_ts", "pred_risk", "mode", "t"]

LATCH_SQL = with_(SCORED) + _bounds_sql() + f"""
, c AS (SELECT *, {T_SQL} AS t FROM scored)
, m AS (SELECT *, {_mode_sql('t')} AS mode,
               CASE WHEN {_mode_sql('t')} = 'STABILIZE' AND t > {K.LATCH_RESET_AFTER} THEN 0
                    WHEN pred_risk >= {K.PRED_THRESHOLD} THEN 1 END AS sig FROM c)
, l AS (SELECT *,
          coalesce(last_value(sig IGNORE NULLS) OVER w, 0) AS premit_on,
          sum(CASE WHEN pred_risk >= {K.PRED_THRESHOLD} THEN 1 ELSE 0 END) OVER w AS sets
        FROM m WINDOW w AS (PARTITION BY ip ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
, z AS (SELECT *, CASE WHEN premit_on = 1 THEN {_ladder_sql('t')} ELSE 0 END AS mitigation_level,
               {RISK_SQL} AS obs FROM l, b)
"""


@query("premit_latch", LATCH_SQL + f"""
SELECT row_id, ip, mode, CAST(premit_on AS INTEGER) AS premit_on,
       CASE WHEN pred_risk >= {K.PRED_THRESHOLD} AND sets = 1 THEN 1 ELSE 0 END AS trigger,
       mitigation_level,
       round(greatest(0.0, least(100.0, CASE WHEN mode = 'ATTACK_ATTEMPT' AND premit_on = 1 AND mitigation_level = 3
                                   THEN least(obs, {K.OBS_RISK_CAP}) ELSE obs END)), 6) AS obs_risk
FROM z""")
def premit_latch(spark, sf):
    """Pre-mitigation latch per IP over time (set at risk >= 70, reset in late
    STABILIZE, reset wins), first trigger, gated mitigation level and the
    capped observed risk — via the two-phase chunked scan."""
    c = _clocked(spark, sf)
    b = RK.score_bounds(c, "raw_score")
    c = c.withColumn("obs_risk", RK.risk_from_score("raw_score", b["threshold"], b["min"], b["max"], digits=None))
    lat = RK.premitigation(c.select(*LATCH_COLS, "obs_risk"), ["ip"], ["event_ts", "row_id"], None)
    return lat.select("row_id", "ip", "mode", "premit_on", "trigger", "mitigation_level",
                      F.round(RK.capped_obs_risk(), 6).alias("obs_risk"))


@query("running_counters", with_(SCORED) + """
SELECT row_id, ip,
  CAST(sum(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS blocked_total,
  CAST(sum(CASE WHEN action = 'ALLOW' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS passed_total,
  CAST(sum(anomaly) OVER w AS BIGINT) AS anomalies_total
FROM scored WINDOW w AS (PARTITION BY ip ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_counters(spark, sf):
    """Monotone counters per IP (blocked, passed, anomalies) as running totals."""
    sc = _scored(spark, sf)
    out = prefix_scan(sc.select("row_id", "ip", "event_ts", "action", "anomaly"), ["ip"], ["event_ts", "row_id"], None, {
        "blocked_total": ("sum", (F.col("action") == "BLOCK").cast("long")),
        "passed_total": ("sum", (F.col("action") == "ALLOW").cast("long")),
        "anomalies_total": ("sum", F.col("anomaly").cast("long")),
    })
    return out.select("row_id", "ip", "blocked_total", "passed_total", "anomalies_total")


@query("episodes", with_(SCORED) + """
, z AS (SELECT *, sum(CASE WHEN anomaly = 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY ip ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
        FROM scored)
SELECT ip, strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') AS end_ts,
       COUNT(*) AS n_rows, CAST(epoch_us(max(event_ts)) - epoch_us(min(event_ts)) AS DOUBLE) / 1e6 AS duration_s
FROM z WHERE anomaly = 1 GROUP BY ip, isl""")
def episodes(spark, sf):
    """Anomaly episodes per IP (gaps and islands): start, end, rows, duration."""
    sc = _scored(spark, sf)
    e = islands(sc.select("row_id", "ip", "event_ts", "anomaly"), ["ip"], ["event_ts", "row_id"], "anomaly", "event_ts", None)
    dur = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return e.select("ip", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"),
                    F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"), "n_rows",
                    dur.cast("double").alias("duration_s"))


HORIZON_S = 86_400


@query("incident_lags", with_(SCORED) + f"""
, z AS (SELECT *, sum(CASE WHEN anomaly = 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY ip ORDER BY event_ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM scored)
, e AS (SELECT ip, min(event_ts) AS start_ts FROM z WHERE anomaly = 1 GROUP BY ip, isl)
, d AS (SELECT e.ip, e.start_ts, (SELECT min(b.event_ts) FROM scored b WHERE b.ip = e.ip AND b.action = 'BLOCK' AND b.anomaly = 0
          AND b.event_ts >= e.start_ts AND b.event_ts <= e.start_ts + INTERVAL {HORIZON_S} SECOND) AS detect_ts FROM e)
, listed AS (SELECT ip, date_trunc('day', max(event_ts)) + INTERVAL 1 DAY AS listed_ts FROM scored WHERE anomaly = 1
             GROUP BY ip, year, month, day HAVING count(*) >= 2)
, r AS (SELECT d.*, (SELECT min(l.listed_ts) FROM listed l WHERE l.ip = d.ip AND l.listed_ts >= d.detect_ts
          AND l.listed_ts <= d.detect_ts + INTERVAL {HORIZON_S} SECOND) AS listed_ts FROM d)
, s AS (SELECT strftime(start_ts, '%Y-%m-%d') AS day, CAST(epoch_us(detect_ts) - epoch_us(start_ts) AS DOUBLE) / 1e6 AS ttd,
               CAST(epoch_us(listed_ts) - epoch_us(detect_ts) AS DOUBLE) / 1e6 AS ttr FROM r)
SELECT day, count(*) AS incidents, count(ttd) AS detected, count(ttr) AS answered, round(avg(ttd), 6) AS mttd_s, round(max(ttd), 6) AS worst_ttd_s,
       round(avg(ttr), 6) AS mttr_s, round(max(ttr), 6) AS worst_ttr_s FROM s GROUP BY day""")
def incident_lags(spark, sf):
    """Per day of start: anomaly episodes, mean and worst time to detect (the
    address's first request that a rule blocks) and to respond (its entry in
    the list of addresses with two anomalies on a day, made when the day is over)."""
    from gatewatch.operators import incidents as I
    sc = _scored(spark, sf).select("row_id", "ip", "event_ts", "anomaly", "action", "year", "month", "day")
    starts = islands(sc, ["ip"], ["event_ts", "row_id"], "anomaly", "event_ts", None).select("ip", "start_ts")
    blocked = sc.where("action = 'BLOCK' AND anomaly = 0").select("ip", "event_ts")
    days = ["year", "month", "day"]
    counts = sc.where("anomaly = 1").groupBy(*days, "ip").agg(F.count(F.lit(1)).alias("cnt"), F.max("event_ts").alias("last_ts"))
    listed = counts.where("cnt >= 2").select("ip", (F.date_trunc("day", F.col("last_ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).cast(sc.schema["event_ts"].dataType).alias("listed_ts"))
    found = I.next_event(starts, blocked, "ip", "start_ts", "event_ts", "detect_ts", HORIZON_S)
    found = I.next_event(found, listed, "ip", "detect_ts", "listed_ts", "answer_ts", HORIZON_S)
    s = I.lag_summary(found, F.date_format("start_ts", "yyyy-MM-dd").alias("day"), "start_ts", "detect_ts", "answer_ts")
    return s.select("day", "incidents", "detected", "answered", *[F.round(c, 6).alias(c) for c in ("mttd_s", "worst_ttd_s", "mttr_s", "worst_ttr_s")])


@query("false_positives", with_(SCORED) + _bounds_sql() + f"""
SELECT year, month, day, CAST(sum(CASE WHEN {_mode_sql(T_SQL)} = 'NORMAL' AND raw_score < thr THEN 1 ELSE 0 END) AS BIGINT) AS false_positives,
       CAST(sum(CASE WHEN {_mode_sql(T_SQL)} = 'NORMAL' THEN 1 ELSE 0 END) AS BIGINT) AS normal_rows
FROM scored, b GROUP BY 1, 2, 3""")
def false_positives(spark, sf):
    """Per day: rows in the NORMAL phase scored below the threshold (false positives)."""
    c = _clocked(spark, sf)
    b = RK.score_bounds(c, "raw_score")
    normal = F.col("mode") == "NORMAL"
    return c.groupBy("year", "month", "day").agg(
        F.sum((normal & (F.col("raw_score") < F.lit(b["threshold"]))).cast("long")).alias("false_positives"),
        F.sum(normal.cast("long")).alias("normal_rows"))


def _band_sql(h):
    parts = " ".join(f"WHEN {h} >= {lo} AND {h} <= {hi} THEN {w}" for lo, hi, w in K.HOUR_BANDS)
    return f"CASE {parts} ELSE {K.HOUR_BAND_ELSE} END"


@query("expected_load", f"""
SELECT hour_kst, weight, COUNT(*) AS n_events, round(COUNT(*) * weight, 6) AS expected_requests
FROM (SELECT CAST((hour(ts) + {K.KST_OFFSET_HOURS}) % 24 AS INTEGER) AS hour_kst,
             CAST({_band_sql(f'(hour(ts) + {K.KST_OFFSET_HOURS}) % 24')} AS DOUBLE) AS weight FROM events) t
GROUP BY 1, 2""")
def expected_load(spark, sf):
    """Events per Korea-time hour with the traffic weight of its band."""
    ev = table(spark, sf, "events")
    h = F.pmod(F.hour("ts") + K.KST_OFFSET_HOURS, F.lit(24)).cast("int")
    g = ev.groupBy(h.alias("hour_kst"), C.kst_hour_weight("ts").alias("weight")).agg(F.count(F.lit(1)).alias("n_events"))
    return g.withColumn("expected_requests", F.round(F.col("n_events") * F.col("weight"), 6))


@query("premit_alerts", LATCH_SQL + """
SELECT ip, COUNT(*) AS count, max(mitigation_level) AS mitigation_level,
       'AI Risk' AS reason FROM z WHERE mitigation_level >= 1 GROUP BY ip""")
def premit_alerts(spark, sf):
    """Preventer hand-off: rows past the mitigation gate (level >= 1) as
    alerts per IP with their highest level."""
    from gatewatch.operators import response as RS
    c = _clocked(spark, sf)
    lat = RK.premitigation(c.select(*LATCH_COLS), ["ip"], ["event_ts", "row_id"], None)
    return (RS.mitigation_gate(lat).groupBy("ip")
            .agg(F.count(F.lit(1)).alias("count"), F.max("mitigation_level").alias("mitigation_level"))
            .withColumn("reason", F.lit("AI Risk")))


@query("mean_entropy", with_(WEB) + f"""
SELECT round(avg({entropy_sql('request_uri')}), 6) AS mean_uri_entropy, COUNT(*) AS n FROM web""")
def mean_entropy(spark, sf):
    """Mean URI (path) entropy over all pages."""
    w = spread(web_requests(table(spark, sf, "pages")))
    return w.agg(F.round(F.avg(X.shannon_entropy("request_uri")), 6).alias("mean_uri_entropy"),
                 F.count(F.lit(1)).alias("n"))


@query("anomaly_rate", with_(SCORED) + """
SELECT CAST(sum(CASE WHEN raw_score < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_anomaly, COUNT(*) AS n,
       round(avg(CASE WHEN raw_score < 0 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate,
       round(avg(CASE WHEN raw_score < 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS anomaly_rate_pct
FROM scored""")
def anomaly_rate(spark, sf):
    """Anomaly count and rate of the -1/1 predictions (decision < 0), also in percent."""
    from gatewatch.operators import stats as S
    sc = _scored(spark, sf).withColumn("prediction", F.when(F.col("raw_score") < 0, -1).otherwise(1))
    r = S.as_percent(S.anomaly_rate(sc), ["anomaly_rate"])
    return r.select("n_anomaly", "n", F.round("anomaly_rate", 6).alias("anomaly_rate"),
                    F.round("anomaly_rate_pct", 6).alias("anomaly_rate_pct"))


@query("random_sample", with_(SCORED) + """
SELECT row_id, ip, pred_risk, raw_score FROM scored
ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 1""")
def random_sample(spark, sf):
    """One scored event drawn reproducibly (seeded hash order) over the whole table."""
    from gatewatch.operators import response as RS
    return RS.sample_one(_scored(spark, sf), "row_id").select("row_id", "ip", "pred_risk", "raw_score")
