"""Stored sketches: distinct addresses and score quantiles of any time range
without reading the rows again.

Per hour one row holds an HLL sketch of the addresses and a KLL sketch of the
scores (a few KB each). The table grows with the hours, not with the rows; a
day, a week or any range is a merge of its hours, and merges combine map-side.
An estimate's relative error is bounded by the sketch size: about
1.04 / sqrt(2^lg_k) for distinct counts (0.8 % at lg_k 14) and about 1.7 / k in
rank for quantiles (0.4 % at k 400). The exact passes are
``dashboards.distinct_anomalous_ips`` and ``quantiles.exact_quantiles``.

Null addresses and null scores are not counted; an hour without any of a kind
has an empty sketch. Bitmaps count distinct whole-number codes exactly: one
4 KB bitmap per 32,768 codes that occur, instead of a set per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 400


def hourly_sketches(df: DataFrame, ts: str, key: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(hour, by.., n, keys, quantiles) per hour: rows and both sketches."""
    return df.groupBy(F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"hll_sketch_agg(`{key}`, {LG_K})").alias("keys"),
        F.expr(f"kll_sketch_agg_double(cast(`{value}` AS double), {KLL_K})").alias("quantiles"))


def merge_sketches(sketches: DataFrame, by: Sequence) -> DataFrame:
    """Sketches of coarser groups (columns or names), from finer ones."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.expr("hll_union_agg(keys)").alias("keys"),
                                     F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"))


def read_sketches(merged: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``merged`` with ``n_keys`` (estimate) and one column per probability."""
    cols = {nm: F.expr(f"kll_sketch_get_quantile_double(quantiles, cast({p} AS double))") for nm, p in probs.items()}
    return merged.withColumns({"n_keys": F.expr("hll_sketch_estimate(keys)"), **cols}).drop("keys", "quantiles")


def distinct_codes(df: DataFrame, group: str, code: str) -> DataFrame:
    """(group, n_codes, low, high): distinct whole-number codes per group, by
    bitmaps per (group, bucket of 32,768 codes). Null codes are not counted."""
    d = df.where(F.col(code).isNotNull()).select(F.col(group), F.col(code).cast("long").alias("__c"))
    maps = d.groupBy(group, F.bitmap_bucket_number("__c").alias("__b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__c")).alias("__m"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi"))
    return maps.groupBy(group).agg(F.sum(F.bitmap_count("__m")).alias("n_codes"), F.min("__lo").alias("low"), F.max("__hi").alias("high"))
