"""Score statistics and evaluation metrics.

All aggregates are single-pass conditional sums (map-side partial aggregation);
quantiles go through ``gatewatch.operators.quantiles`` (exact, distributed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.operators.quantiles import exact_quantiles, quantile_scalars


def eval_group(rule: str = "terminatingruleid", action: str = "action",
               sqli_rule: str = K.RULE_SQLI) -> Column:
    """3-way evaluation group: SQLi rule / null action (sentinel rows) / other."""
    return (F.when(F.col(rule) == F.lit(sqli_rule), F.lit(K.GROUP_SQLI))
            .when(F.col(action).isNull(), F.lit(K.GROUP_SENTINEL))
            .otherwise(F.lit(K.GROUP_OTHER)))


def labels(rule: str = "terminatingruleid", geo_rule: str = K.GEO_RULE_IN_LABELS,
           sqli_rule: str = K.RULE_SQLI) -> dict[str, Column]:
    """is_sqli, is_geoblock and y_true (= is_sqli as int)."""
    is_sqli = F.coalesce(F.col(rule) == F.lit(sqli_rule), F.lit(False))
    return {"is_sqli": is_sqli,
            "is_geoblock": F.coalesce(F.col(rule) == F.lit(geo_rule), F.lit(False)),
            "y_true": is_sqli.cast("int")}


def prediction_flag(pred: str = "prediction") -> Column:
    """-1/1 model output -> 1/0 flag."""
    return (F.col(pred) == -1).cast("int")


def offset_for(scores: DataFrame, score: str, contamination: float) -> float:
    """Decision offset: the contamination-quantile of the scores."""
    return quantile_scalars(scores, score, {"q": contamination})["q"]


def group_stats(scores: DataFrame, score: str, group: str, offset: float) -> DataFrame:
    """Per group: count, mean, sample std, q25/median/q75, flagged count and %."""
    base = scores.withColumn("_flag", (F.col(score) < F.lit(offset)).cast("int"))
    agg = base.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.sum("_flag").cast("long").alias("flagged_as_anomaly"),
        (F.avg("_flag") * 100.0).alias("flagged_pct"))
    q = exact_quantiles(base, score, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by=[group])
    return agg.join(q, on=group, how="left")


def group_profile(df: DataFrame, group: str, codes: list[str], length: str) -> DataFrame:
    """Per group: sorted distinct codes (small code domains), min/max length, count."""
    aggs = [F.array_join(F.sort_array(F.collect_set(F.col(c).cast("long"))), ",").alias(f"{c}_values")
            for c in codes]
    return df.groupBy(group).agg(*aggs, F.min(length).alias("len_min"), F.max(length).alias("len_max"),
                                 F.count(F.lit(1)).alias("count"))


def confusion(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """TN / FP / FN / TP in one pass."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg(
        F.sum(((t == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((t == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((t == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((t == 1) & (p == 1)).cast("long")).alias("tp"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def prf_columns() -> dict[str, Column]:
    """Precision, recall, F1, FPR over columns tp/fp/fn/tn; zero denominators -> 0."""
    tp, fp, fn, tn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn", "tn"))
    return {"precision": _safe_div(tp, tp + fp), "recall": _safe_div(tp, tp + fn),
            "f1_score": _safe_div(2 * tp, 2 * tp + fp + fn), "fpr": _safe_div(fp, fp + tn)}


def prf(conf: DataFrame) -> DataFrame:
    return conf.withColumns(prf_columns())


def eval_summary(df: DataFrame, y_pred: str = "y_pred", geo_rule: str = K.GEO_RULE_IN_LABELS) -> DataFrame:
    """Data-set counts, confusion on the non-geo rows, metrics and the
    before/after comparison (rule-only detections vs rule + model)."""
    L = labels(geo_rule=geo_rule)
    d = df.withColumns(L)
    ev = ~F.col("is_geoblock")
    t, p = F.col("y_true"), F.col(y_pred)
    agg = d.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.sum(F.col("is_sqli").cast("long")).alias("n_sqli"),
        F.sum(F.col("is_geoblock").cast("long")).alias("n_geoblock"),
        F.sum((F.col("action") == "ALLOW").cast("long")).alias("n_normal"),
        F.sum(ev.cast("long")).alias("n_eval"),
        F.sum((ev & (t == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum((ev & (t == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum((ev & (t == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum((ev & (t == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum((F.col("is_geoblock") & (p == 1)).cast("long")).alias("geoblock_ai_flagged"),
        F.sum((p == 1).cast("long")).alias("n_ai_flagged"))
    return agg.withColumns(prf_columns()).withColumns({
        "before_waf_detections": F.col("n_sqli"),
        "after_waf_ai_detections": F.col("n_sqli") + F.col("fp"),
        "after_ai_additional_detections": F.col("fp"),
    })


def anomaly_rate(df: DataFrame, pred: str = "prediction") -> DataFrame:
    return df.agg(F.sum((F.col(pred) == -1).cast("long")).alias("n_anomaly"),
                  F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(pred) == -1).cast("double")).alias("anomaly_rate"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """min / max / mean, exact q05/q25/q75, IQR and the stability flag."""
    q = quantile_scalars(df, score, {"q05": 0.05, "q25": 0.25, "q75": 0.75})
    iqr = q["q75"] - q["q25"]
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                  F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"),
                  *[F.lit(v).cast("double").alias(k) for k, v in q.items()],
                  F.lit(iqr).cast("double").alias("iqr"),
                  F.lit(round(iqr, 4) < K.STABILITY_IQR_LIMIT).alias("stability_warning"))


def le_histogram(df: DataFrame, score: str, bounds: list[float] = K.SCORE_HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative 'le' buckets (+Inf), plus _sum and _count rows, long form."""
    s = F.col(score)
    cols = [F.sum((s <= F.lit(b)).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.agg(*cols, F.count(s).alias("binf"), F.sum(s).alias("ssum"))
    items = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"b{i}").cast("double").alias("value"))
             for i, b in enumerate(bounds)]
    items.append(F.struct(F.lit("+Inf").alias("le"), F.col("binf").cast("double").alias("value")))
    items.append(F.struct(F.lit("_count").alias("le"), F.col("binf").cast("double").alias("value")))
    items.append(F.struct(F.lit("_sum").alias("le"), F.col("ssum").cast("double").alias("value")))
    return wide.select(F.explode(F.array(*items)).alias("x")).select("x.le", "x.value")


def sentinel(df: DataFrame, score: str, pred: str, expected: float,
             tolerance: float = K.SENTINEL_TOLERANCE, min_c: float = K.SENTINEL_MIN_C,
             max_c: float = K.SENTINEL_MAX_C) -> tuple[DataFrame, DataFrame]:
    """Contamination sentinel: keep the model's predictions when the anomaly
    rate is within tolerance of the expected contamination, else re-threshold
    at the clamped rate's exact quantile. Returns (rows with final
    prediction, one-row report)."""
    row = df.agg(F.avg((F.col(pred) == -1).cast("double")).alias("r")).first()
    rate = float(row["r"] or 0.0)
    if abs(rate - expected) <= tolerance:
        out = df.withColumn("final_prediction", F.col(pred))
        report = df.sparkSession.range(1).select(
            F.lit(float(expected)).alias("expected_contamination"),
            F.round(F.lit(None if row["r"] is None else rate).cast("double"), 4).alias("actual_anomaly_rate"),
            F.lit(False).alias("sentinel_triggered"),
            F.lit("pass_through").alias("action"),
            F.lit(None).cast("double").alias("clamped_contamination"),
            F.lit(None).cast("double").alias("adjusted_anomaly_rate"),
            F.lit(None).cast("double").alias("threshold_score"))
        return out, report
    clamped = max(min_c, min(max_c, rate))
    thr = quantile_scalars(df, score, {"t": clamped})["t"]
    out = df.withColumn("final_prediction", F.when(F.col(score) < F.lit(thr), F.lit(-1)).otherwise(F.lit(1)))
    adj = out.agg(F.avg((F.col("final_prediction") == -1).cast("double")).alias("a"))
    report = adj.select(
        F.lit(float(expected)).alias("expected_contamination"),
        F.lit(round(rate, 4)).alias("actual_anomaly_rate"),
        F.lit(True).alias("sentinel_triggered"),
        F.lit("re_threshold").alias("action"),
        F.lit(round(clamped, 4)).cast("double").alias("clamped_contamination"),
        F.round(F.col("a"), 4).alias("adjusted_anomaly_rate"),
        F.lit(round(float(thr), 6)).cast("double").alias("threshold_score"))
    return out, report


def contamination_sweep(df: DataFrame, score: str, group: str, contams: list[float] = K.CONTAMINATION_SWEEP,
                        sqli_group: str = K.GROUP_SQLI, other_group: str = K.GROUP_OTHER) -> DataFrame:
    """For each contamination c: offset = c-quantile of the scores, decision =
    score - offset, flagged = decision < 0; counts, % flagged, IQR, mean
    decision and per-group mean decision; plus the recommended c (first one
    with SQLi mean < other mean and 20-30 % flagged, else 0.25).

    The model is fitted once (same seed gives the same trees, only the
    offset moves), so the sweep is one quantile pass plus one aggregation
    pass with a conditional count per c — no cross join."""
    probs = {f"c{i}": c for i, c in enumerate(contams)}
    probs.update({"q25": 0.25, "q75": 0.75})
    q = quantile_scalars(df, score, probs)
    s, g = F.col(score), F.col(group)
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"),
            F.avg(F.when(g == sqli_group, s)).alias("mean_sqli"),
            F.avg(F.when(g == other_group, s)).alias("mean_other")]
    aggs += [F.sum((s < F.lit(q[f"c{i}"])).cast("long")).alias(f"f{i}") for i in range(len(contams))]
    wide = df.agg(*aggs)
    iqr = q["q75"] - q["q25"]
    items = [F.struct(F.lit(float(c)).alias("contamination"), F.lit(float(q[f"c{i}"])).alias("offset"),
                      F.col(f"f{i}").alias("n_flagged"),
                      (F.col(f"f{i}") * 100.0 / F.col("n")).alias("flagged_pct"),
                      (F.col("mean") - F.lit(q[f"c{i}"])).alias("score_mean"),
                      (F.col("mean_sqli") - F.lit(q[f"c{i}"])).alias("sqli_mean"),
                      (F.col("mean_other") - F.lit(q[f"c{i}"])).alias("other_mean"))
             for i, c in enumerate(contams)]
    long = wide.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    long = long.withColumns({"score_iqr": F.lit(float(iqr)), "stability_warning": F.lit(round(iqr, 4) < K.STABILITY_IQR_LIMIT)})
    return recommend(long)


def recommend(sweep: DataFrame) -> DataFrame:
    """Mark the recommended contamination, compared on the reported figures
    (means to 4 digits, % to 1): the first (smallest) one whose SQLi mean
    decision is below the other group's and whose flagged share is within
    20-30 %; 0.25 when none qualifies. ``sweep`` has one row per
    contamination value (a handful of rows)."""
    from pyspark.sql import Window
    lo, hi = K.RECOMMEND_PCT_RANGE
    pct = F.round("flagged_pct", 1)
    ok = (F.round("sqli_mean", 4) < F.round("other_mean", 4)) & (pct >= lo) & (pct <= hi)
    w = Window.partitionBy()  # one row per swept value: a tiny table
    first_ok = F.min(F.when(ok, F.col("contamination"))).over(w)
    rec = F.coalesce(first_ok, F.lit(K.RECOMMENDED_DEFAULT))
    return sweep.withColumn("recommended", F.col("contamination") == rec)


def weighted_offset(nodes: DataFrame, offset: str = "offset", n: str = "n_samples") -> DataFrame:
    """sum(offset * n) / sum(n) and each node's weight n / sum(n)."""
    from pyspark.sql import Window
    w = Window.partitionBy()  # one row per node: a tiny table
    tot = F.sum(n).over(w)
    return nodes.withColumns({"weight": F.col(n) / tot,
                              "global_offset": F.sum(F.col(offset) * F.col(n)).over(w) / tot,
                              "total_samples": tot})


def as_percent(df: DataFrame, cols: list[str]) -> DataFrame:
    """Panel scaling: ratio columns times 100 (``<name>_pct``)."""
    return df.withColumns({f"{c}_pct": F.col(c) * 100.0 for c in cols})
