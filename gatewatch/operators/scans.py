"""Ordered scans per key (running sums, latches, islands) that stay parallel
when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to
one task. Here the scan is done in two phases:

1. rows are cut into chunks and each chunk is scanned locally with a window.
   The default chunk is a range partition of (key, order): its bounds come
   from a sample, so a key holding a third of all rows is split into
   balanced pieces whatever its time span. The chunk id is written with the
   rows to the shared folder once, so both phases read the same assignment
   (range bounds are sampled per exchange and may differ between two
   exchanges of the same data). A time bucket (e.g. the day) can be given
   instead: deterministic, no extra write, one shuffle less, balanced when
   hot keys span many buckets;
2. one summary row per (key, bucket) — the bucket's sum or last non-null
   value — is prefix-combined over the buckets of the key (a small table:
   one row per key-bucket), giving each bucket its carry-in;
3. the carry-in joins back on (key, bucket); the scanned rows are already
   hash-partitioned on those columns, so only the small side moves.

Both operations are associative (sum; last non-null), so the result is the
same as the single-window scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_scan(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column | None,
                values: dict[str, tuple[str, Column]], partitions: int | None = None,
                initial: DataFrame | None = None) -> DataFrame:
    """Add one column per entry of ``values``: name -> (kind, expr), kind
    'sum' (running sum, inclusive) or 'last' (last non-null so far, inclusive).
    Rows are ordered by ``order`` (which must be unique within a key).
    ``bucket`` None = range-partition chunks (balanced under any skew).
    ``initial`` (key columns + one per name; one row per key) is what an
    earlier scan ended with, carried into every chunk of its key."""
    key, order = list(key), list(order)
    if bucket is None:
        from gatewatch.session import materialize
        from gatewatch.session import range_partitions
        n = partitions or range_partitions(df)
        d = materialize(df.repartitionByRange(n, *key, *order).withColumn("_bk", F.spark_partition_id()),
                        "scan_chunks")
    else:
        d = df.withColumn("_bk", bucket)
    tmp = {name: f"_x_{i}" for i, name in enumerate(values)}
    d = d.withColumns({tmp[n]: expr for n, (kind, expr) in values.items()})
    w_loc = Window.partitionBy(*key, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for n, (kind, _) in values.items():
        x = F.col(tmp[n])
        local[f"_l_{tmp[n]}"] = F.sum(x).over(w_loc) if kind == "sum" else F.last(x, ignorenulls=True).over(w_loc)
    scanned = d.withColumns(local)

    ordkey = F.struct(*[F.col(c) for c in order])
    aggs = []
    for n, (kind, _) in values.items():
        x = F.col(tmp[n])
        if kind == "sum":
            aggs.append(F.sum(x).alias(f"_s_{tmp[n]}"))
        else:
            aggs.append(F.max_by(x, F.when(x.isNotNull(), ordkey)).alias(f"_s_{tmp[n]}"))
    summary = d.groupBy(*key, "_bk").agg(*aggs)
    if initial is not None:  # a null chunk sorts before all others
        start = initial.select(*key, F.lit(None).cast(summary.schema["_bk"].dataType).alias("_bk"),
                               *[F.col(n).alias(f"_s_{tmp[n]}") for n in values])
        summary = summary.unionByName(start)
    w_prev = Window.partitionBy(*key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for n, (kind, _) in values.items():
        s = F.col(f"_s_{tmp[n]}")
        c = F.sum(s).over(w_prev) if kind == "sum" else F.last(s, ignorenulls=True).over(w_prev)
        carry_cols.append(c.alias(f"_c_{tmp[n]}"))
    gk = [f"_k{i}" for i in range(len(key))]
    carry = summary.select(*[F.col(k).alias(g) for k, g in zip(key, gk)], F.col("_bk").alias("_cbk"), *carry_cols)

    cond = None
    for k, g in zip(key, gk):
        c = scanned[k].eqNullSafe(carry[g])
        cond = c if cond is None else cond & c
    cond = (scanned["_bk"] == carry["_cbk"]) if cond is None else cond & (scanned["_bk"] == carry["_cbk"])
    joined = scanned.join(carry, cond, "left")
    outs = {}
    for n, (kind, _) in values.items():
        loc, car = F.col(f"_l_{tmp[n]}"), F.col(f"_c_{tmp[n]}")
        outs[n] = (F.coalesce(car, F.lit(0)) + F.coalesce(loc, F.lit(0))) if kind == "sum" else F.coalesce(loc, car)
    drop = ["_bk", "_cbk", *gk] + list(tmp.values()) + [f"_l_{t}" for t in tmp.values()] + \
        [f"_c_{t}" for t in tmp.values()]
    return joined.withColumns(outs).drop(*drop)


def day_bucket(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts).cast("timestamp"))


def first_per_key(df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """drop_duplicates(key) keeping the first row by ``order``: a min_by
    aggregate, which combines map-side (a hot key is reduced before the
    shuffle, unlike a row_number window)."""
    s = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*key).agg(F.min_by(s, F.col(order)).alias("_first"))
            .select(*key, "_first.*"))


def islands(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: str, ts: str,
            bucket: Column | None = None) -> DataFrame:
    """Episodes = maximal runs of flag = 1 per key. A row's island id is the
    running count of flag = 0 rows before it (prefix_scan), so each run shares
    one id; runs then aggregate with partial aggregation."""
    s = prefix_scan(df, key, order, bucket, {"_zeros": ("sum", (F.col(flag) == 0).cast("long"))})
    return (s.filter(F.col(flag) == 1)
            .groupBy(*key, "_zeros")
            .agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_rows"))
            .drop("_zeros"))
