"""Dashboard queries over WAF access logs (blocks by rule, type, country,
hour, client) and over scored events (top anomalous IP, distinct IPs).

Every aggregate is a plain ``groupBy`` so Spark plans a partial (map-side)
aggregate before the shuffle; a hot rule, country or IP only adds rows to a
partial buffer, never a whole group to one task. Top-k uses
``orderBy(...).limit(k)`` which plans as TakeOrderedAndProject (per-partition
top-k, then a k-row merge). Every ordering carries tie-break keys so results
are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch import constants as K


def blocked(logs: DataFrame, year: str | None = None, month: str | None = None,
            day: str | None = None) -> DataFrame:
    """action = 'BLOCK' plus optional partition predicates (string equality,
    pruned at the scan when the logs are a partitioned table)."""
    out = logs.filter(F.col("action") == "BLOCK")
    for name, val in (("year", year), ("month", month), ("day", day)):
        if val is not None:
            out = out.filter(F.col(name) == F.lit(val))
    return out


def attack_type(rule) -> F.Column:
    """Ordered CASE over the terminating rule id; first match wins."""
    r = F.col(rule) if isinstance(rule, str) else rule
    out = None
    for kind, pat, label in K.ATTACK_TYPE_RULES:
        cond = r.like(pat) if kind == "like" else (r == F.lit(pat))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(K.ATTACK_TYPE_ELSE))


def rule_blocks(logs: DataFrame, **part) -> DataFrame:
    return (blocked(logs, **part)
            .groupBy(F.col("terminatingruleid").alias("rule"))
            .agg(F.count(F.lit(1)).alias("block_count"))
            .orderBy(F.desc("block_count"), F.asc("rule")))


def attack_types(logs: DataFrame, **part) -> DataFrame:
    return (blocked(logs, **part)
            .groupBy(attack_type("terminatingruleid").alias("attack_type"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("attack_type")))


def country_top(logs: DataFrame, k: int = 30, **part) -> DataFrame:
    return (blocked(logs, **part)
            .groupBy(F.col("httprequest.country").alias("country"))
            .agg(F.count(F.lit(1)).alias("block_count"))
            .orderBy(F.desc("block_count"), F.asc_nulls_last("country"))
            .limit(k))


def hourly_rule(logs: DataFrame, **part) -> DataFrame:
    """Blocks per UTC hour (from epoch-millisecond timestamps) and rule."""
    hour = F.date_trunc("hour", F.timestamp_millis(F.col("timestamp")))
    return (blocked(logs, **part)
            .groupBy(F.date_format(hour, "yyyy-MM-dd HH:mm:ss").alias("block_hour"),
                     F.col("terminatingruleid").alias("rule"))
            .agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy("block_hour", "rule"))


def top_clients(logs: DataFrame, k: int = 10, **part) -> DataFrame:
    return (blocked(logs, **part)
            .groupBy(F.col("httprequest.clientip").alias("client_ip"),
                     F.col("httprequest.country").alias("country"),
                     F.col("terminatingruleid").alias("rule"))
            .agg(F.count(F.lit(1)).alias("hit_count"))
            .orderBy(F.desc("hit_count"), "client_ip", "country", "rule")
            .limit(k))


def day_partition(run_date) -> dict:
    """The zero-padded year / month / day partition values of a run date
    (the analyzer's "today"); the date is an argument so runs repeat."""
    return {"year": f"{run_date.year:04d}", "month": f"{run_date.month:02d}", "day": f"{run_date.day:02d}"}


def top_anomalous_ip(scored: DataFrame, year: str, month: str, day: str) -> DataFrame:
    """The IP with most anomalies in one day partition (0 or 1 row);
    ties go to the smallest IP text."""
    return (scored.filter((F.col("anomaly") == 1) & (F.col("year") == year)
                          & (F.col("month") == month) & (F.col("day") == day))
            .groupBy("ip").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc("ip")).limit(1))


def daily_report(scored: DataFrame, run_date) -> DataFrame:
    """One row for the run date's partition: the top anomalous IP with status
    ``ok``, or ``no_data`` when the day has no anomaly."""
    part = day_partition(run_date)
    top = top_anomalous_ip(scored, **part)
    return top.agg(F.max("ip").alias("ip"), F.max("cnt").alias("cnt")).select(
        F.lit("-".join(part.values())).alias("run_day"),
        F.when(F.col("cnt").isNull(), F.lit("no_data")).otherwise(F.lit("ok")).alias("status"), "ip", "cnt")


def top_per_group(df: DataFrame, group: list[str], count: str, key: str, extra: list[str] = ()) -> DataFrame:
    """Top-1 row per group by ``count`` desc, ties to the smallest ``key``,
    as a ``min_by`` aggregate over (-count, key): it combines map-side, so a
    group with millions of candidate keys is never sorted in one task."""
    pick = F.struct(F.col(key).alias("_key"), F.col(count).alias("_cnt"), *[F.col(c) for c in extra])
    order = F.struct((-F.col(count)).alias("_neg"), F.col(key).alias("_k"))
    return (df.groupBy(*group).agg(F.min_by(pick, order).alias("_top"))
            .select(*group, F.col("_top._key").alias(key), F.col("_top._cnt").alias(count),
                    *[F.col(f"_top.{c}").alias(c) for c in extra]))


def top_anomalous_ip_per_day(scored: DataFrame) -> DataFrame:
    """The daily report for every day at once: count per (day, ip), then the
    top IP of each day (both steps are partial aggregates)."""
    counts = (scored.filter(F.col("anomaly") == 1)
              .groupBy("year", "month", "day", "ip").agg(F.count(F.lit(1)).alias("cnt")))
    return top_per_group(counts, ["year", "month", "day"], "cnt", "ip")


def distinct_anomalous_ips(scored: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct anomalous IPs per day (exact, or HyperLogLog++ when approx)."""
    agg = (F.approx_count_distinct("ip") if approx else F.countDistinct("ip")).alias("n_ips")
    return (scored.filter(F.col("anomaly") == 1)
            .groupBy("year", "month", "day").agg(agg, F.count(F.lit(1)).alias("n_anomalies")))


def value_counts(df: DataFrame, col: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc(col))
