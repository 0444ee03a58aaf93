"""Golden arithmetic from the published results."""

import pytest
from pyspark.sql import functions as F

from gatewatch.operators import stats as S


def test_prf_golden(spark):
    conf = spark.createDataFrame([(100, 227, 0, 1173)], "tp long, fp long, fn long, tn long")
    r = S.prf(conf).first()
    assert round(r["precision"], 4) == 0.3058
    assert round(r["recall"], 4) == 1.0
    assert round(r["f1_score"], 4) == 0.4684
    assert round(r["fpr"], 4) == 0.1621


def test_prf_zero_division(spark):
    r = S.prf(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, fn long, tn long")).first()
    assert (r["precision"], r["recall"], r["f1_score"], r["fpr"]) == (0.0, 0.0, 0.0, 0.0)


def test_sweep_recommendation_golden(spark):
    # published sweep: contamination, flagged %, SQLi mean, geo-block mean
    rows = [(0.05, 4.4, -0.0009, 0.1195), (0.10, 8.3, -0.0322, 0.0882), (0.15, 13.6, -0.0636, 0.0568),
            (0.20, 18.2, -0.0776, 0.0428), (0.25, 23.7, -0.098, 0.0224), (0.30, 25.8, -0.1043, 0.0161)]
    df = spark.createDataFrame(rows, "contamination double, flagged_pct double, sqli_mean double, other_mean double")
    rec = [r["contamination"] for r in S.recommend(df).filter("recommended").collect()]
    assert rec == [0.25]
    assert 362 + 45 + 20 == 427  # type counts add up to n_flagged at 0.25


def test_sentinel_pass_through(spark):
    # 23.7 % flagged vs expected 0.25 +- 0.10 -> pass_through
    n, k = 1800, 427
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") < k, -1).otherwise(1).alias("pred"),
                               (F.col("id") / n).alias("score"))
    _, rep = S.sentinel(df, "score", "pred", expected=0.25)
    r = rep.first()
    assert r["action"] == "pass_through" and r["actual_anomaly_rate"] == 0.2372


def test_sentinel_rethreshold(spark):
    n = 1000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") < 20, -1).otherwise(1).alias("pred"),
                               (F.col("id").cast("double")).alias("score"))
    out, rep = S.sentinel(df, "score", "pred", expected=0.25)
    r = rep.first()
    assert r["action"] == "re_threshold" and r["clamped_contamination"] == 0.02
    assert r["threshold_score"] == pytest.approx(0.02 * 999)
    assert out.filter("final_prediction = -1").count() == 20


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(x / 100.0,) for x in range(-40, 41)], "s double")
    h = {r["le"]: r["value"] for r in S.le_histogram(df, "s").collect()}
    assert h["-0.3"] == 11 and h["0.0"] == 41 and h["+Inf"] == 81 and h["_count"] == 81
