"""Score statistics, evaluation metrics, sentinel, sweep and scaler queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions import text as X
from gatewatch.operators import stats as S
from gatewatch.operators.features import add_codes, spread
from gatewatch.operators.forest import standardize
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import DOCREQ, SCORED, WAF, entropy_sql, with_
from gatewatch.plans.q_text import _threat_sql
from gatewatch.sources.adapters import doc_requests, scored_events, waf_logs

GROUP_SQL = (f"CASE WHEN terminatingruleid = '{K.RULE_SQLI}' THEN '{K.GROUP_SQLI}' "
             f"WHEN action IS NULL THEN '{K.GROUP_SENTINEL}' ELSE '{K.GROUP_OTHER}' END")
CONTAMINATION = 0.25


def _scored(spark, sf):
    return scored_events(table(spark, sf, "events")).withColumn("grp", S.eval_group())


def _r6(df, cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


@query("group_stats", with_(SCORED) + f"""
, off AS (SELECT quantile_cont(raw_score, {CONTAMINATION}) AS o FROM scored)
SELECT {GROUP_SQL} AS grp, COUNT(*) AS count, round(avg(raw_score), 6) AS mean,
       round(stddev_samp(raw_score), 6) AS std,
       round(quantile_cont(raw_score, 0.25), 6) AS q25, round(quantile_cont(raw_score, 0.5), 6) AS median,
       round(quantile_cont(raw_score, 0.75), 6) AS q75,
       CAST(sum(CASE WHEN raw_score < o THEN 1 ELSE 0 END) AS BIGINT) AS flagged_as_anomaly,
       round(avg(CASE WHEN raw_score < o THEN 1.0 ELSE 0.0 END) * 100, 6) AS flagged_pct
FROM scored, off GROUP BY 1""")
def group_stats(spark, sf):
    """Per evaluation group: count, mean, sample std, exact quartiles, flagged
    count and % at the 0.25-contamination offset."""
    sc = _scored(spark, sf)
    off = S.offset_for(sc, "raw_score", CONTAMINATION)
    return _r6(S.group_stats(sc, "raw_score", "grp", off),
               ["mean", "std", "q25", "median", "q75", "flagged_pct"])


@query("iqr_flag", with_(SCORED) + """
SELECT round(min(raw_score), 6) AS min_score, round(max(raw_score), 6) AS max_score,
       round(avg(raw_score), 6) AS mean_score, COUNT(*) AS n,
       round(quantile_cont(raw_score, 0.05), 6) AS q05, round(quantile_cont(raw_score, 0.25), 6) AS q25,
       round(quantile_cont(raw_score, 0.75), 6) AS q75,
       round(quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25), 6) AS iqr,
       round(quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25), 4) < 0.05 AS stability_warning
FROM scored""")
def iqr_flag(spark, sf):
    """Score min/max/mean, exact q05/q25/q75, IQR and the IQR < 0.05 stability flag."""
    out = S.score_summary(_scored(spark, sf), "raw_score")
    return _r6(out, ["min_score", "max_score", "mean_score", "q05", "q25", "q75", "iqr"])


def _hist_sql():
    parts = []
    for b in K.SCORE_HISTOGRAM_BOUNDS:
        parts.append(f"SELECT '{repr(float(b))}' AS le, CAST(sum(CASE WHEN raw_score <= {b} THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM scored")
    parts.append("SELECT '+Inf' AS le, CAST(count(raw_score) AS DOUBLE) AS value FROM scored")
    parts.append("SELECT '_count' AS le, CAST(count(raw_score) AS DOUBLE) AS value FROM scored")
    parts.append("SELECT '_sum' AS le, round(sum(raw_score), 6) AS value FROM scored")
    return "\nUNION ALL ".join(parts)


@query("le_histogram", with_(SCORED) + _hist_sql())
def le_histogram(spark, sf):
    """Cumulative score histogram with the fixed 'le' bounds, +Inf, _count, _sum."""
    return _r6(S.le_histogram(_scored(spark, sf), "raw_score"), ["value"])


@query("group_profile", with_(WAF) + f"""
SELECT grp, array_to_string(list_sort(list_distinct(list(country_code))), ',') AS country_code_values,
       array_to_string(list_sort(list_distinct(list(rule_code))), ',') AS rule_code_values,
       min(uri_len) AS len_min, max(uri_len) AS len_max, COUNT(*) AS count
FROM (SELECT {GROUP_SQL} AS grp,
             CAST(coalesce(CASE country WHEN 'KR' THEN 0 WHEN 'NL' THEN 1 WHEN 'US' THEN 2 END, 99) AS BIGINT) AS country_code,
             CAST(coalesce(CASE terminatingruleid WHEN '{K.RULE_SQLI}' THEN 0 WHEN '{K.GEO_RULE_IN_LABELS}' THEN 1
                  WHEN '{K.RULE_DEFAULT}' THEN 2 END, 999) AS BIGINT) AS rule_code,
             CAST(length(uri) AS DOUBLE) AS uri_len FROM waf) t
GROUP BY grp""")
def group_profile(spark, sf):
    """Per evaluation group: distinct country/rule codes, min/max URI length, rows."""
    w = waf_logs(table(spark, sf, "events"))
    flat = w.select("terminatingruleid", "action", F.col("httprequest.country").alias("country"),
                    F.col("httprequest.uri").alias("uri"))
    coded = add_codes(flat).withColumn("grp", S.eval_group())
    return S.group_profile(coded, "grp", ["country_code", "rule_code"], "uri_len")


def _doc_pred():
    return (f"CASE WHEN {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} "
            f"<> '{K.THREAT_FALLBACK}' THEN 1 ELSE 0 END")


def _doc_eval(spark, sf):
    d = spread(doc_requests(table(spark, sf, "documents")))
    pred = (X.classify_threat("request_uri", "request_args", X.shannon_entropy("request_args"))
            != F.lit(K.THREAT_FALLBACK)).cast("int")
    scored = d.select(F.col("row_id").alias("doc_id"), pred.alias("y_pred"))
    lab = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y_true"))
    return lab.join(scored, "doc_id", "inner")


DOC_EVAL_SQL = with_(DOCREQ) + f"""
, pred AS (SELECT row_id AS doc_id, {_doc_pred()} AS y_pred FROM docreq)
, ev AS (SELECT l.doc_id, l.toxic AS y_true, p.y_pred FROM labels l JOIN pred p ON l.doc_id = p.doc_id)
, c AS (SELECT CAST(sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
               CAST(sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
               CAST(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM ev)
"""


@query("confusion", DOC_EVAL_SQL + "SELECT tn, fp, fn, tp FROM c")
def confusion(spark, sf):
    """TN/FP/FN/TP of the threat classifier (flagged = not the fallback type)
    against the toxic label, labels joined to documents."""
    return S.confusion(_doc_eval(spark, sf), "y_true", "y_pred")


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


PRF_SQL = (f"round({_div('tp', 'tp + fp')}, 6) AS precision, round({_div('tp', 'tp + fn')}, 6) AS recall, "
           f"round({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_score, round({_div('fp', 'fp + tn')}, 6) AS fpr")


@query("prf_metrics", DOC_EVAL_SQL + f"SELECT tn, fp, fn, tp, {PRF_SQL} FROM c")
def prf_metrics(spark, sf):
    """Precision / recall / F1 / FPR (zero denominators give 0) of the doc evaluation."""
    return _r6(S.prf(S.confusion(_doc_eval(spark, sf), "y_true", "y_pred")),
               ["precision", "recall", "f1_score", "fpr"])


def eval_sql(pred: str, src: str) -> str:
    """The evaluation summary of ``src`` with the 0/1 prediction ``pred``."""
    return f"""
, d AS (SELECT terminatingruleid = '{K.RULE_SQLI}' AS is_sqli, terminatingruleid = '{K.RULE_GEO}' AS is_geoblock,
               CASE WHEN terminatingruleid = '{K.RULE_SQLI}' THEN 1 ELSE 0 END AS y_true, {pred} AS y_pred, action FROM {src})
, c AS (SELECT COUNT(*) AS n_total, CAST(sum(CAST(is_sqli AS INT)) AS BIGINT) AS n_sqli,
               CAST(sum(CAST(is_geoblock AS INT)) AS BIGINT) AS n_geoblock,
               CAST(sum(CASE WHEN action = 'ALLOW' THEN 1 ELSE 0 END) AS BIGINT) AS n_normal,
               CAST(sum(CASE WHEN NOT is_geoblock THEN 1 ELSE 0 END) AS BIGINT) AS n_eval,
               CAST(sum(CASE WHEN NOT is_geoblock AND y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
               CAST(sum(CASE WHEN NOT is_geoblock AND y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN NOT is_geoblock AND y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
               CAST(sum(CASE WHEN NOT is_geoblock AND y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
               CAST(sum(CASE WHEN is_geoblock AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS geoblock_ai_flagged,
               CAST(sum(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_ai_flagged FROM d)
SELECT *, {PRF_SQL}, n_sqli AS before_waf_detections, n_sqli + fp AS after_waf_ai_detections,
       fp AS after_ai_additional_detections FROM c"""


@query("before_after", with_(SCORED) + eval_sql("anomaly", "scored"))
def before_after(spark, sf):
    """Evaluation job: data-set counts, confusion on non-geo rows (SQLi = attack,
    anomaly flag = prediction), metrics, geo rows flagged, before/after counts."""
    sc = scored_events(table(spark, sf, "events"))
    out = S.eval_summary(sc.withColumn("y_pred", F.col("anomaly")), "y_pred", geo_rule=K.RULE_GEO)
    return _r6(out, ["precision", "recall", "f1_score", "fpr"])


def _sentinel_sql(expected):
    tol, lo, hi = K.SENTINEL_TOLERANCE, K.SENTINEL_MIN_C, K.SENTINEL_MAX_C
    return with_(SCORED) + f"""
, s AS (SELECT raw_score, CASE WHEN raw_score < 0 THEN -1 ELSE 1 END AS pred FROM scored)
, r AS (SELECT avg(CASE WHEN pred = -1 THEN 1.0 ELSE 0.0 END) AS rate, COUNT(*) AS n FROM s)
, c AS (SELECT rate, n, greatest({lo}, least({hi}, rate)) AS cl, (n - 1) * greatest({lo}, least({hi}, rate)) AS h FROM r)
, o AS (SELECT raw_score, row_number() OVER (ORDER BY raw_score) - 1 AS rk FROM s)
, t0 AS (SELECT max(CASE WHEN rk = floor(h) THEN raw_score END) AS lo_v,
               max(CASE WHEN rk = ceil(h) THEN raw_score END) AS hi_v, any_value(h) AS hh FROM o, c)
, t AS (SELECT lo_v + (hh - floor(hh)) * (hi_v - lo_v) AS thr FROM t0)
, a AS (SELECT avg(CASE WHEN raw_score < thr THEN 1.0 ELSE 0.0 END) AS adj FROM s, t)
SELECT CAST({expected} AS DOUBLE) AS expected_contamination, round(rate, 4) AS actual_anomaly_rate,
       abs(rate - {expected}) > {tol} AS sentinel_triggered,
       CASE WHEN abs(rate - {expected}) > {tol} THEN 're_threshold' ELSE 'pass_through' END AS action,
       CASE WHEN abs(rate - {expected}) > {tol} THEN round(cl, 4) END AS clamped_contamination,
       CASE WHEN abs(rate - {expected}) > {tol} THEN round(adj, 4) END AS adjusted_anomaly_rate,
       CASE WHEN abs(rate - {expected}) > {tol} THEN round(thr, 6) END AS threshold_score
FROM c, t, a"""


def _sentinel(spark, sf, expected):
    sc = _scored(spark, sf).withColumn("pred", F.when(F.col("raw_score") < 0, -1).otherwise(1))
    _, report = S.sentinel(sc, "raw_score", "pred", expected)
    return report


@query("sentinel_pass", _sentinel_sql(0.05))
def sentinel_pass(spark, sf):
    """Contamination sentinel with expected 0.05: rate within tolerance -> pass_through."""
    return _sentinel(spark, sf, 0.05)


@query("sentinel_rethreshold", _sentinel_sql(0.25))
def sentinel_rethreshold(spark, sf):
    """Contamination sentinel with expected 0.25: re-threshold at the clamped
    rate's exact quantile; report rate, clamp, adjusted rate, threshold."""
    return _sentinel(spark, sf, 0.25)


def _sweep_sql():
    rows = " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS contamination" for c in K.CONTAMINATION_SWEEP)
    lo, hi = K.RECOMMEND_PCT_RANGE
    offs = ", ".join(f"quantile_cont(raw_score, {c}) AS o{i}" for i, c in enumerate(K.CONTAMINATION_SWEEP))
    pick = " ".join(f"WHEN {c} THEN o{i}" for i, c in enumerate(K.CONTAMINATION_SWEEP))
    return with_(SCORED) + f"""
, g AS (SELECT raw_score, {GROUP_SQL} AS grp FROM scored)
, q AS (SELECT {offs}, quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25) AS iqr,
               avg(raw_score) AS m, avg(CASE WHEN grp = 'SQLi' THEN raw_score END) AS ms,
               avg(CASE WHEN grp = 'other' THEN raw_score END) AS mo, COUNT(*) AS n FROM g)
, cs AS (SELECT contamination, CASE contamination {pick} END AS off, iqr, m, ms, mo, n FROM ({rows}) v, q)
, r AS (SELECT cs.contamination, cs.off, cs.iqr, cs.m, cs.ms, cs.mo, cs.n,
               (SELECT COUNT(*) FROM g WHERE g.raw_score < cs.off) AS nf FROM cs)
, x AS (SELECT contamination, round(off, 6) AS "offset", CAST(nf AS BIGINT) AS n_flagged,
               round(nf * 100.0 / n, 6) AS flagged_pct, round(m - off, 6) AS score_mean,
               round(ms - off, 6) AS sqli_mean, round(mo - off, 6) AS other_mean,
               round(iqr, 6) AS score_iqr, round(iqr, 4) < {K.STABILITY_IQR_LIMIT} AS stability_warning,
               round(ms - off, 4) < round(mo - off, 4) AND round(nf * 100.0 / n, 1) BETWEEN {lo} AND {hi} AS ok FROM r)
SELECT contamination, "offset", n_flagged, flagged_pct, score_mean, sqli_mean, other_mean, score_iqr,
       stability_warning,
       contamination = coalesce((SELECT min(contamination) FROM x WHERE ok), {K.RECOMMENDED_DEFAULT}) AS recommended
FROM x"""


@query("contamination_sweep", _sweep_sql())
def contamination_sweep(spark, sf):
    """Sweep contamination .05-.30 over one fitted score column: offsets,
    flagged counts and %, mean decisions, IQR, recommended value."""
    out = S.contamination_sweep(_scored(spark, sf), "raw_score", "grp")
    return _r6(out, ["offset", "flagged_pct", "score_mean", "sqli_mean", "other_mean", "score_iqr"])


SCALER_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scaler", """
WITH s AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in SCALER_COLS) + """ FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, """ + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in SCALER_COLS) + """
FROM lineitem, s""")
def scaler(spark, sf):
    """Standardise lineitem's numeric columns: (x - mean) / population std (0 -> 1)."""
    li = table(spark, sf, "lineitem")
    z, _ = standardize(li, SCALER_COLS)
    return z.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"),
                    *[F.round(F.col(c), 6).alias(f"z_{c}") for c in SCALER_COLS])
