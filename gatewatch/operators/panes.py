"""Sliding windows by panes: a row is counted once, in the pane of its slide;
a window sums the panes that it covers. Per row the work is that of a tumbling
window, whatever the overlap; only pane counts are repeated per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pane_counts(df: DataFrame, ts: str, keys: Sequence[str], slide_s: int) -> DataFrame:
    """(pane, keys.., n): rows per slide; ``pane`` is its start in epoch seconds.
    Rows without a time are left out."""
    start = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slide_s * 1_000_000)).cast("long") * slide_s
    return df.where(F.col(ts).isNotNull()).groupBy(start.alias("pane"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(panes: DataFrame, keys: Sequence[str], width_s: int, slide_s: int) -> DataFrame:
    """(window_start, keys.., n) of the windows of ``width_s`` seconds that start
    at every multiple of ``slide_s``, from pane counts (one row per pane and
    key, or several to be summed). Windows without rows are absent."""
    if width_s % slide_s:
        raise ValueError("the width must be a multiple of the slide")
    first = F.explode(F.sequence(F.col("pane") - (width_s - slide_s), F.col("pane"), F.lit(slide_s).cast("long")))
    rows = panes.select(first.alias("window_start"), *keys, "n")
    return rows.groupBy("window_start", *keys).agg(F.sum("n").alias("n"))
