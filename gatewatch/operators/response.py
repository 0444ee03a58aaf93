"""Detect-and-respond: block-list candidates, insert-if-absent append,
defense signals and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.functions.codes import ip_to_cidr32


def valid_ip(ip: str = "ip"):
    """Skip empty / unknown addresses."""
    return ~F.coalesce(F.col(ip), F.lit("")).isin("", "unknown")


def block_candidates(top_ips: DataFrame, ts: str | None = None) -> DataFrame:
    """Top attacking IPs -> /32 entries (cidr, first_seen, hits)."""
    t = F.col(ts) if ts else F.current_timestamp()
    return (top_ips.filter(valid_ip("ip"))
            .groupBy(ip_to_cidr32("ip").alias("cidr"))
            .agg(F.min(t).alias("first_seen"), F.sum("cnt").cast("long").alias("hits")))


def append_absent(current: DataFrame, incoming: DataFrame, key: str = "cidr") -> DataFrame:
    """Insert-if-absent: rows of ``incoming`` whose key is not in ``current``
    (left anti join), de-duplicated on the key (earliest first_seen wins)."""
    new = incoming.join(current.select(key), key, "left_anti")
    cols = [c for c in new.columns if c != key]
    first = F.min_by(F.struct(*[F.col(c) for c in cols]),
                     F.struct(F.col("first_seen").isNull(), F.col("first_seen")))
    return new.groupBy(key).agg(first.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(current: DataFrame, incoming: DataFrame, key: str = "cidr") -> DataFrame:
    """The block list after appending the absent entries."""
    return current.unionByName(append_absent(current, incoming, key), allowMissingColumns=True)


def defense_signals(blocks: DataFrame, ts: str, ip: str = "ip", width: str = "5 minutes") -> DataFrame:
    """One metric point per block, counted per time bucket and IP, plus an
    overall row per bucket (ip = null) from the same rollup."""
    b = blocks.select(F.window(F.col(ts), width).alias("w"), F.col(ip).alias("ip"))
    return (b.rollup("w", "ip").agg(F.count(F.lit(1)).alias("signals"))
            .filter(F.col("w").isNotNull())
            .select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("bucket_start"),
                    "ip", F.lit(K.DEFENSE_METRIC).alias("metric"), "signals"))


def signal_points(blocks: DataFrame, ts: str, ip: str = "ip") -> DataFrame:
    """One metric point per block: name, AttackIP dimension, value 1, Count."""
    return blocks.select(F.col(ts).alias("ts"), F.lit(K.DEFENSE_METRIC).alias("metric"), F.col(ip).alias("attack_ip"),
                         F.lit(1.0).alias("value"), F.lit("Count").alias("unit"))


def alerts(rows: DataFrame, ts: str, ip: str = "ip", count: str = "cnt",
           reason: str = K.ALERT_MESSAGE, level: str | None = None, keep: list | None = None) -> DataFrame:
    """The single alert schema: ts, ip, count, reason, mitigation_level."""
    return rows.select(*(keep or []), F.col(ts).alias("ts"), F.col(ip).alias("ip"), F.col(count).cast("long").alias("count"),
                       F.lit(reason).alias("reason"),
                       (F.col(level) if level else F.lit(None)).cast("int").alias("mitigation_level"))


def mitigation_gate(df: DataFrame, level: str = "mitigation_level") -> DataFrame:
    """Only rows at mitigation level >= 1 reach the preventer."""
    return df.filter(F.col(level) >= 1)


def seeded_order(key, seed: int = 42):
    """A reproducible pseudo-random order that any SQL engine computes alike:
    the md5 of seed and key."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")).cast("binary"))


def sample_one(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row drawn at random but reproducibly: the smallest seeded
    pseudo-random value of the key (a per-partition top-1, then a 1-row
    merge)."""
    return df.orderBy(seeded_order(key, seed), F.col(key)).limit(1)
