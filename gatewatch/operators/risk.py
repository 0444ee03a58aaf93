"""Risk mapping, scenario phases, mitigation ladder, pre-mitigation latch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.operators.quantiles import quantile_scalars
from gatewatch.operators.scans import prefix_scan


def score_bounds(df: DataFrame, score: str, pct: float = K.THRESHOLD_PERCENTILE) -> dict:
    """Threshold (exact pct-th percentile), min and max of the scores."""
    q = quantile_scalars(df, score, {"thr": pct / 100.0})
    row = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    return {"threshold": q["thr"], "min": row["lo"], "max": row["hi"]}


def risk_from_score(score, threshold: float, lo: float, hi: float, digits: int | None = 2) -> Column:
    """Score -> 0..100 risk: at/above the threshold 0-70 (higher score, lower
    risk), below it 70-100; zero denominators become 1."""
    s = (F.col(score) if isinstance(score, str) else score).cast("double")
    d_hi = (hi - threshold) if (hi - threshold) != 0 else 1.0
    d_lo = (threshold - lo) if (threshold - lo) != 0 else 1.0
    normal = (F.lit(1.0) - (s - F.lit(threshold)) / F.lit(d_hi)) * 70.0
    anomal = F.lit(100.0) - ((s - F.lit(lo)) / F.lit(d_lo)) * 30.0
    r = F.when(s >= F.lit(threshold), normal).otherwise(anomal)
    return F.bround(r, digits) if digits is not None else r


def scenario_phase(t, scenario: Sequence[tuple[str, float]] = K.SCENARIO) -> Column:
    """Elapsed seconds -> phase (half-open intervals; past the end = last)."""
    x = F.col(t) if isinstance(t, str) else t
    acc, out = 0.0, None
    for name, dur in scenario:
        acc += dur
        out = F.when(x < acc, F.lit(name)) if out is None else out.when(x < acc, F.lit(name))
    return out.otherwise(F.lit(scenario[-1][0]))


def mitigation_ladder(t) -> Column:
    x = F.col(t) if isinstance(t, str) else t
    a, b = K.MITIGATION_STEPS
    s, span = K.MITIGATION_START, K.MITIGATION_SPAN
    return (F.when(x < s, 0).when(x < s + span * a, 1).when(x < s + span * b, 2).otherwise(3))


def scenario_clock(ts: str, cycle_seconds: float | None = None) -> Column:
    """Seconds since the start of the current scenario cycle (the scenario
    restarts every ``cycle_seconds``, default its total length)."""
    cyc = cycle_seconds or float(sum(d for _, d in K.SCENARIO))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.pmod(micros, F.lit(int(cyc * 1_000_000))).cast("double") / 1_000_000.0


def premitigation(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None,
                  risk: str = "pred_risk", mode: str = "mode", t: str = "t",
                  threshold: float = K.PRED_THRESHOLD, reset_after: float = K.LATCH_RESET_AFTER,
                  carry: DataFrame | None = None, sets: str | None = None) -> DataFrame:
    """Latch per key: ON when risk >= threshold, OFF in STABILIZE after
    ``reset_after`` seconds (reset wins on the same row), else hold; starts
    OFF. ``trigger`` marks the first ON ever per key. Adds premit_on,
    trigger, mitigation_level, and the running number of ONs as ``sets``.
    ``carry`` (key, premit_on, sets) is the state that earlier rows left."""
    set_ = F.col(risk) >= F.lit(threshold)
    reset = (F.col(mode) == "STABILIZE") & (F.col(t) > F.lit(reset_after))
    signal = F.when(reset, F.lit(0)).when(set_, F.lit(1))
    out = prefix_scan(df, key, order, bucket, {
        "_state": ("last", signal),
        "_sets": ("sum", set_.cast("long")),
    }, initial=carry.select(*key, F.col("premit_on").alias("_state"), F.col("sets").alias("_sets")) if carry is not None else None)
    on = F.coalesce(F.col("_state"), F.lit(0))
    if sets:
        out = out.withColumn(sets, F.col("_sets"))
    return out.withColumns({
        "premit_on": on.cast("int"),
        "trigger": (set_ & (F.col("_sets") == 1)).cast("int"),
        "mitigation_level": F.when(on == 1, mitigation_ladder(t)).otherwise(F.lit(0)),
    }).drop("_state", "_sets")


def capped_obs_risk(obs: str = "obs_risk", mode: str = "mode", on: str = "premit_on",
                    level: str = "mitigation_level") -> Column:
    """Observed risk capped at 75 while the attack is met at full mitigation;
    clamped to 0..100."""
    cap = (F.col(mode) == "ATTACK_ATTEMPT") & (F.col(on) == 1) & (F.col(level) == 3)
    r = F.when(cap, F.least(F.col(obs), F.lit(K.OBS_RISK_CAP))).otherwise(F.col(obs))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), r))
