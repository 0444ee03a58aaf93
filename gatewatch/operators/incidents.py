"""Incident lags: how long until an incident is detected, and answered.

``next_event`` finds, for every start of a key, the first event at or after it
(a forward as-of join) in one ordered scan over starts and events together:
time runs backwards, so the last event seen is the next one. The scan is cut
into chunks (``operators.scans``), so a key with many incidents and many events
is neither one task nor a join of all its starts with all its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.operators.scans import prefix_scan
from gatewatch.session import materialize


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """Seconds from ``a`` to ``b`` (timestamps), null if either is."""
    micros = [F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) for c in (a, b)]
    return (micros[1] - micros[0]).cast("double") / 1e6


def next_event(starts: DataFrame, events: DataFrame, key: str, at: str, event_at: str, out: str, horizon_s: float | None = None) -> DataFrame:
    """``starts`` with ``out``: the time of the first of the key's ``events`` at or
    after ``at``, null if there is none within ``horizon_s`` seconds. Starts
    with a null key or time have none. Equal starts stay separate rows."""
    kind = starts.schema[at].dataType
    s = materialize(starts.withColumn("__start", F.monotonically_increasing_id()), "incident-starts")  # ids are used twice
    when = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    rows = s.select(F.col(key).alias("__key"), when(at).alias("__back"), F.lit(1).alias("__kind"), "__start", F.lit(None).cast(kind).alias("__ts"))
    rows = rows.unionByName(events.where(F.col(key).isNotNull() & F.col(event_at).isNotNull()).select(
        F.col(key).alias("__key"), when(event_at).alias("__back"), F.lit(0).alias("__kind"), F.monotonically_increasing_id().alias("__start"),
        F.col(event_at).cast(kind).alias("__ts")))
    seen = prefix_scan(rows, ["__key"], ["__back", "__kind", "__start"], None, {"__next": ("last", F.col("__ts"))})
    seen = seen.where("__kind = 1").select("__start", "__next")
    joined = s.join(seen, "__start").drop("__start")
    found = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("__next"))
    if horizon_s is not None:
        found = F.when(seconds_between(at, "__next") <= horizon_s, found)
    return joined.withColumn(out, found).drop("__next")


def lag_summary(incidents: DataFrame, by: Column, start: str, detected: str, answered: str) -> DataFrame:
    """Per group: incidents, how many were detected and answered, mean and worst
    seconds from start to detection and from detection to answer."""
    d = incidents.select(by, seconds_between(start, detected).alias("_d"), seconds_between(detected, answered).alias("_a"))
    g = d.columns[0]
    return d.groupBy(g).agg(
        F.count(F.lit(1)).alias("incidents"), F.count("_d").alias("detected"), F.count("_a").alias("answered"),
        F.avg("_d").alias("mttd_s"), F.max("_d").alias("worst_ttd_s"), F.avg("_a").alias("mttr_s"), F.max("_a").alias("worst_ttr_s"))
