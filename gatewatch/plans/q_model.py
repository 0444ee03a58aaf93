"""Model queries: golden forest scoring, fit + score + threshold, the
4-feature URI model, federated merge, quotas, offsets, export parity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gatewatch.functions import text as X
from gatewatch.operators import federated as FD
from gatewatch.operators import forest as FR
from gatewatch.operators.features import TRAIN_FEATURES, URI4_FEATURES, spread, training_frame, uri4_frame
from gatewatch import constants as K
from gatewatch.plans.forest_sql import forest_sql, scaled_sql, scores_sql
from gatewatch.plans.q_text import _keywords_sql, _special_sql
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import SCORED, WAF, WEB, entropy_sql, restore_args_sql, with_
from gatewatch.sources import models as MS
from gatewatch.operators.quantiles import exact_quantiles
from gatewatch.session import materialize
from gatewatch.sources.adapters import waf_logs, web_requests

# a fixed 3-tree forest over (uri_len, path_entropy), psi = 10
GOLDEN = [
    # tree, node, left, right, feature, threshold, n_node_samples
    (0, 0, 1, 2, 0, 20.0, 10), (0, 1, 3, 4, 1, 3.5, 8), (0, 2, -1, -1, -2, -2.0, 2),
    (0, 3, -1, -1, -2, -2.0, 5), (0, 4, -1, -1, -2, -2.0, 3),
    (1, 0, 1, 2, 1, 3.0, 10), (1, 1, -1, -1, -2, -2.0, 1), (1, 2, 3, 4, 0, 30.0, 9),
    (1, 3, -1, -1, -2, -2.0, 6), (1, 4, -1, -1, -2, -2.0, 3),
    (2, 0, 1, 2, 0, 15.0, 10), (2, 1, -1, -1, -2, -2.0, 4), (2, 2, -1, -1, -2, -2.0, 6),
]
GOLDEN_PSI = 10


def _golden_pdf():
    return pd.DataFrame(GOLDEN, columns=["tree_id", "node_id", "left", "right", "feature", "threshold",
                                         "n_node_samples"]).assign(forest_id="golden")


def _case_tree(tree_rows, feats, node=0, depth=0):
    r = {n[1]: n for n in tree_rows}[node]
    if r[2] < 0:
        return repr(depth + FR.c_factor(r[6]))
    return (f"(CASE WHEN {feats[r[4]]} <= {r[5]} THEN {_case_tree(tree_rows, feats, r[2], depth + 1)} "
            f"ELSE {_case_tree(tree_rows, feats, r[3], depth + 1)} END)")


def _golden_sql():
    feats = ["uri_len", "path_entropy"]
    trees = sorted({g[0] for g in GOLDEN})
    hs = " + ".join(_case_tree([g for g in GOLDEN if g[0] == t], feats) for t in trees)
    return with_(WEB) + f"""
, f AS (SELECT row_id, CAST(length(request_uri) AS DOUBLE) AS uri_len, {entropy_sql('request_uri')} AS path_entropy FROM web)
SELECT row_id, round(-pow(2.0, -(({hs}) / {len(trees)}) / {FR.c_factor(GOLDEN_PSI)}), 6) AS score FROM f"""


@query("golden_forest_score", _golden_sql())
def golden_forest_score(spark, sf):
    """Score every page with a fixed 3-tree forest (Arrow UDF walk of the
    node arrays) — checked exactly against nested CASE in SQL."""
    w = web_requests(table(spark, sf, "pages"))
    f = w.select("row_id", X.text_length("request_uri").cast("double").alias("uri_len"),
                 X.shannon_entropy("request_uri").alias("path_entropy"))
    forest = FR.Forest(nodes=None, features=["uri_len", "path_entropy"], max_samples=GOLDEN_PSI, n_trees=3)
    return FR.score(f, forest, nodes_pdf=_golden_pdf()).select("row_id", F.round("score", 6).alias("score"))


def _waf_training(spark, sf):
    w = waf_logs(table(spark, sf, "events"))
    flat = w.select("row_id", "terminatingruleid", "action", F.col("httprequest.country").alias("country"),
                    F.col("httprequest.uri").alias("uri"))
    return training_frame(spread(flat))


def _codes_sql(expr, codes, default):
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in codes.items())
    return f"CAST(coalesce(CASE {expr} {whens} END, {default}) AS DOUBLE)"


TRAIN_SQL = with_(WAF) + f"""
, train AS (SELECT row_id, {_codes_sql('country', K.COUNTRY_CODES, K.COUNTRY_CODE_ELSE)} AS country_code,
    {_codes_sql('terminatingruleid', K.RULE_CODES, K.RULE_CODE_ELSE)} AS rule_code,
    CAST(length(uri) AS DOUBLE) AS uri_len, {entropy_sql('uri')} AS path_entropy,
    {entropy_sql(restore_args_sql('terminatingruleid', 'row_id'))} AS args_entropy FROM waf)"""
URI4_SQL = with_(WEB) + f"""
, uri4 AS (SELECT row_id, CAST(length(request_uri) AS DOUBLE) AS uri_length,
    CAST({_special_sql('request_uri')} AS DOUBLE) AS special_chars,
    CAST({_keywords_sql('request_uri')} AS DOUBLE) AS risk_keyword, {entropy_sql('request_uri')} AS uri_entropy FROM web)"""
FULL_PSI = "greatest(16, CAST(floor(n * 0.6) AS BIGINT))"
FULL_TREES = "least(200 + greatest(0, (100 - n) * 2), 500)"
FIT_SQL = (TRAIN_SQL + scaled_sql("train", TRAIN_FEATURES)
           + forest_sql(len(TRAIN_FEATURES), int(0.7 * len(TRAIN_FEATURES)), FULL_PSI, FULL_TREES) + scores_sql(0.25))
FIT4_SQL = (URI4_SQL + scaled_sql("uri4", URI4_FEATURES, scale=False)
            + forest_sql(len(URI4_FEATURES), len(URI4_FEATURES), "least(256, n)", "100", levels=8) + scores_sql(0.15))


def fit_score(df, features, contamination, n_trees=None, max_samples=None, max_features=1.0, seed=42,
              scale=True, hyper=True):
    df = materialize(df, "features")
    if scale:
        scaled, scaler = FR.standardize(df, features)
        n = scaler["n"]
    else:
        scaled, scaler, n = df, None, df.count()
    hp = FR.safe_hyperparams(n) if hyper else {}
    forest = FR.fit(scaled, features, n_trees=n_trees or hp.get("n_estimators", 100),
                    max_samples=max_samples or hp.get("max_samples"),
                    max_features=hp.get("max_features", max_features), seed=seed, n_rows=n)
    nodes_pdf = FR.driver_nodes(forest)
    scored = materialize(FR.score(scaled, forest, nodes_pdf=nodes_pdf), "scores")
    out, off = FR.threshold(scored, contamination)
    forest.offset = off
    return out, forest, nodes_pdf, scaler


@query("forest_fit_score", FIT_SQL + """
SELECT row_id, round(score, 6) AS score, round(score - off, 6) AS decision,
       CAST(CASE WHEN score - off < 0 THEN -1 ELSE 1 END AS INTEGER) AS prediction FROM scored, off""")
def forest_fit_score(spark, sf):
    """Train the 5-feature forest on all log rows (standardise, size-dependent
    hyper-parameters, 70 % features per tree, contamination 0.25), score
    every row, threshold at the exact 0.25-quantile."""
    df = _waf_training(spark, sf)
    out, _, _, _ = fit_score(df, TRAIN_FEATURES, 0.25)
    return out.select("row_id", F.round("score", 6).alias("score"), F.round("decision", 6).alias("decision"),
                      "prediction")


@query("forest_4feature", FIT4_SQL + """
SELECT row_id, round(score, 6) AS score, CAST(CASE WHEN score - off < 0 THEN -1 ELSE 1 END AS INTEGER) AS prediction
FROM scored, off""")
def forest_4feature(spark, sf):
    """4-feature URI model (length, specials, keywords, entropy; 100 trees,
    psi = min(256, n), contamination 0.15) fitted and applied to every page."""
    w = uri4_frame(spread(web_requests(table(spark, sf, "pages"))))
    out, _, _, _ = fit_score(w, URI4_FEATURES, 0.15, n_trees=100, scale=False, hyper=False)
    return out.select("row_id", F.round("score", 6).alias("score"), "prediction")


@query("plot_bins", FIT4_SQL + """
SELECT CAST(floor(uri_length / 10) * 10 AS BIGINT) AS len_bin, floor(uri_entropy * 4) / 4 AS entropy_bin,
       CAST(CASE WHEN score - off < 0 THEN -1 ELSE 1 END AS INTEGER) AS prediction, COUNT(*) AS n
FROM uri4 JOIN scored USING (row_id), off GROUP BY ALL""")
def plot_bins(spark, sf):
    """Scatter data of the 4-feature model as 2-D bins: URI length x entropy x prediction."""
    w = uri4_frame(spread(web_requests(table(spark, sf, "pages"))))
    out, _, _, _ = fit_score(w, URI4_FEATURES, 0.15, n_trees=100, scale=False, hyper=False)
    return (out.groupBy((F.floor(F.col("uri_length") / 10) * 10).alias("len_bin"),
                        (F.floor(F.col("uri_entropy") * 4) / 4).alias("entropy_bin"), "prediction")
            .agg(F.count(F.lit(1)).alias("n")))


FED_FRACTIONS = [0.60, 0.25, 0.15]


FED_FIT_SQL = TRAIN_SQL + scaled_sql("train", TRAIN_FEATURES) + """
, rk AS (SELECT * EXCLUDE (forest), row_number() OVER (ORDER BY row_id) - 1 AS rk, COUNT(*) OVER () AS total FROM scaled)
, parts AS MATERIALIZED (SELECT * EXCLUDE (rk, total),
    CASE WHEN rk < floor(total * 0.6) THEN '1' WHEN rk < floor(total * 0.85) THEN '2' ELSE '3' END AS forest FROM rk)
""" + forest_sql(len(TRAIN_FEATURES), len(TRAIN_FEATURES), FULL_PSI, "100", src="parts") + scores_sql(0.15) + """
, quota AS (SELECT forest, least(100, greatest(1, round_even(100 * n * 1.0 / sum(n) OVER () * COUNT(*) OVER (), 0))) AS k FROM off)
, picked AS (SELECT forest, tree FROM (SELECT forest, tree, k, row_number() OVER (PARTITION BY forest
    ORDER BY md5(concat('42:', forest, ':m:', tree)), tree) AS r FROM tr JOIN quota USING (forest)) WHERE r <= k)
, merged AS (SELECT vid, -pow(2.0, -(CAST(sum(h) AS DOUBLE) / (1e12 * COUNT(*))) / (SELECT c_psi FROM prm WHERE forest = '1')) AS score
  FROM path JOIN picked USING (forest, tree) GROUP BY vid)
, goff AS (SELECT sum(off * n) / sum(n) AS off FROM off)
SELECT row_id, CAST(forest AS INTEGER) AS node, round(score, 6) AS score,
       CAST(CASE WHEN score - off < 0 THEN -1 ELSE 1 END AS INTEGER) AS prediction
FROM vrow JOIN merged USING (vid), goff"""


@query("fedavg_merge", FED_FIT_SQL)
def fedavg_merge(spark, sf):
    """Federated merge: split the log rows 60/25/15 by position, fit one
    forest per node on its own rows (contamination .15), merge trees in
    proportion to node size with the weighted offset, score all rows."""
    df = materialize(_waf_training(spark, sf), "features")
    scaled, _ = FR.standardize(df, TRAIN_FEATURES)
    split = materialize(FD.position_split(scaled, "row_id", FED_FRACTIONS), "fed_split")
    sizes = {r["node"]: r["n"] for r in split.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one job fits every node's forest (each on its own rows only)
    forests = FR.fit_many(split, TRAIN_FEATURES, "node",
                          {str(k): (n, FR.safe_hyperparams(n)["max_samples"], 100) for k, n in sizes.items()}, seed=42)
    scored_parts = None
    for node, f in forests.items():
        part = FR.score(split.filter(F.col("node") == int(node)), f)
        scored_parts = part if scored_parts is None else scored_parts.unionByName(part)
    scored_nodes = materialize(scored_parts.select("node", "score"), "fed_node_scores")
    offs = {str(r["node"]): r["off"] for r in
            exact_quantiles(scored_nodes, "score", {"off": 0.15}, by=["node"]).collect()}
    rows = [(k, int(sizes[int(k)]), 100, float(offs[k]), len(TRAIN_FEATURES)) for k in sorted(forests)]
    params = spark.createDataFrame(rows, "node_id string, n_samples long, n_trees int, offset double, n_features int")
    FD.validate_compatibility(params)
    merged = FD.merge(forests, params)
    scored = FR.score(split, merged.forest)
    out, _ = FR.threshold(scored, 0.15, offset=merged.offset)
    return out.select("row_id", "node", F.round("score", 6).alias("score"), "prediction")


FED_SQL = with_(SCORED) + """
, r AS (SELECT row_id, raw_score, row_number() OVER (ORDER BY row_id) - 1 AS rk, COUNT(*) OVER () AS n FROM scored)
, s AS (SELECT row_id, raw_score, CASE WHEN rk < floor(n * 0.6) THEN 1 WHEN rk < floor(n * 0.85) THEN 2 ELSE 3 END AS node FROM r)
, p AS (SELECT CAST(node AS VARCHAR) AS node_id, COUNT(*) AS n_samples, quantile_cont(raw_score, 0.15) AS "offset",
               100 AS n_trees FROM s GROUP BY node)
, q AS (SELECT *, n_samples * 1.0 / sum(n_samples) OVER () AS weight, CAST(sum(n_samples) OVER () AS BIGINT) AS total_samples,
               sum("offset" * n_samples) OVER () / sum(n_samples) OVER () AS global_offset,
               COUNT(*) OVER () AS nodes FROM p)
"""


def _fed_params(spark, sf):
    from gatewatch.operators.quantiles import exact_quantiles
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(table(spark, sf, "events"))
    split = FD.position_split(sc, "row_id", FED_FRACTIONS)
    off = exact_quantiles(split, "raw_score", {"offset": 0.15}, by=["node"])
    cnt = split.groupBy("node").agg(F.count(F.lit(1)).alias("n_samples"))
    return (cnt.join(off, "node")
            .select(F.col("node").cast("string").alias("node_id"), "n_samples", "offset",
                    F.lit(100).alias("n_trees")))


@query("fedavg_offset", FED_SQL + """
SELECT node_id, n_samples, round(weight, 6) AS weight, round("offset", 6) AS "offset",
       round(global_offset, 6) AS global_offset, total_samples FROM q""")
def fedavg_offset(spark, sf):
    """Sample-weighted mean of per-node offsets (0.15-quantile of each node's
    scores) for the 60/25/15 position split; node weights."""
    q = FD.quotas(_fed_params(spark, sf))
    return q.select("node_id", "n_samples", F.round("weight", 6).alias("weight"),
                    F.round("offset", 6).alias("offset"), F.round("global_offset", 6).alias("global_offset"),
                    "total_samples")


@query("tree_quota", FED_SQL + """
SELECT node_id, n_samples, CAST(least(n_trees, greatest(1, round_even(n_trees * weight * nodes, 0))) AS BIGINT) AS k
FROM q""")
def tree_quota(spark, sf):
    """Trees each node contributes: min(T, max(1, round_half_even(T * w * nodes)))."""
    q = FD.quotas(_fed_params(spark, sf))
    return q.select("node_id", "n_samples", F.col("k").cast("long").alias("k"))


@query("model_parity", """
SELECT CAST(0 AS DOUBLE) AS max_abs_diff, COUNT(*) AS n_rows, CAST(10 AS INTEGER) AS exported_trees FROM pages""")
def model_parity(spark, sf):
    """Export parity: fit a forest on the URI features, save the node table
    and metadata (parquet + JSON export), load them back, score every page
    with the loaded model (Arrow UDF) and with a native SQL expression
    compiled from the node table; report the maximum absolute difference to 9
    digits."""
    w = uri4_frame(spread(web_requests(table(spark, sf, "pages"))))
    out, forest, pdf, _ = fit_score(w, URI4_FEATURES, 0.15, n_trees=10, max_samples=64, scale=False, hyper=False)
    path = MS.save_forest(spark, forest, pdf, model_id="parity")
    loaded, meta = MS.load_forest(spark, path, "parity")
    lpdf = FR.collect_nodes(loaded)
    a = FR.score(w, loaded, out="s_udf", nodes_pdf=lpdf)
    b = a.withColumn("s_expr", MS.native_score_expr(lpdf, loaded.features, loaded.max_samples))
    js = MS.export_json(loaded.nodes, meta)
    return b.agg(F.round(F.max(F.abs(F.col("s_udf") - F.col("s_expr"))), 9).alias("max_abs_diff"),
                 F.count(F.lit(1)).alias("n_rows"),
                 F.lit(js.count()).alias("exported_trees"))
