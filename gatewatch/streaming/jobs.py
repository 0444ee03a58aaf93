"""Structured Streaming jobs.

Every job reads new files once (file source + checkpoint = exactly-once file
log), keeps its state and checkpoints under the shared checkpoint folder,
and lands results with ``foreachBatch`` into folders named by batch id, so a
replayed batch overwrites its own output (idempotent sinks).

* hourly_counts   — blocks per (hour window, rule), watermark, update mode
* latch           — pre-mitigation latch per IP in event time, late rows aside
* respond         — running (day, ip) anomaly counts -> top IP per day ->
                    alerts + insert-if-absent /32 block list
* score_stream    — live scoring with a broadcast forest + edge decision
* signals         — defense signals per 5-minute window and IP
* signal_panes    — the panes that sliding windows are summed from
* sessions        — anomaly sessions per IP (session_window)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch import constants as K
from gatewatch.operators import dashboards as D
from gatewatch.operators import response as RS
from gatewatch.operators import risk as RK
from gatewatch.operators.versioned import VersionedSet
from gatewatch.session import materialize, scratch_path
from gatewatch.streaming.state import KeyedState, batch_ids, remove_batches

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, folder: str, name: str, fmt: str = "parquet",
                max_files: int | None = None, schema=None) -> DataFrame:
    """New files named ``name`` (glob) under ``folder``, each read once."""
    if schema is None:
        schema = spark.read.format(fmt).load(f"{folder.rstrip('/')}/{name}").schema
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def job_paths(spark: SparkSession, name: str, root: str | None) -> tuple[str, str]:
    """(checkpoint, output folder) of a streaming job. With ``root`` both are
    stable, so a rerun resumes from the checkpoint and each new file is
    processed once across runs; without it a fresh scratch pair is used
    (a self-contained run over everything available)."""
    if root:
        return f"{root.rstrip('/')}/_checkpoint", f"{root.rstrip('/')}/out"
    base = scratch_path(spark, f"streams/{name}")
    return f"{base}/_checkpoint", f"{base}/out"


def run_available(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None],
                  output_mode: str = "append", spark: SparkSession | None = None,
                  state_partitions: int | None = None, checkpoint: str | None = None) -> str:
    """Process everything available now, then stop. Returns the checkpoint.

    Stateful operators keep their partition count and state store for the
    life of the checkpoint, and AQE does not re-plan them, so both are set
    when the query starts: ``state_partitions`` or the cluster's parallelism,
    and the RocksDB state store (state off the JVM heap, on local disk, with
    changes checkpointed to the shared folder) unless the session already
    names a provider. The caller's settings are restored after the start."""
    spark = spark or df.sparkSession
    ckpt = checkpoint or scratch_path(spark, f"streams/{name}")
    key = "spark.sql.shuffle.partitions"
    prov = "spark.sql.streaming.stateStore.providerClass"
    prev, prev_prov = spark.conf.get(key), spark.conf.get(prov, None)
    spark.conf.set(key, str(state_partitions or spark.sparkContext.defaultParallelism))
    if not prev_prov or "HDFSBackedStateStoreProvider" in prev_prov:
        spark.conf.set(prov, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (df.writeStream.outputMode(output_mode).foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, prev)
        if prev_prov:
            spark.conf.set(prov, prev_prov)
        else:
            spark.conf.unset(prov)
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return ckpt


def batch_folder_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to ``out/batch_id=N`` (overwrite = idempotent)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return sink


def landed(spark: SparkSession, out: str, schema, before: int | None = None, newest: bool = False) -> DataFrame:
    """The batches landed under ``out`` (those with an id under ``before``, or
    the newest of them); empty only when nothing has been landed. Any other failure is raised."""
    ids = [i for i in batch_ids(spark, out) if before is None or i < before]
    if not ids:
        if schema is None:
            raise FileNotFoundError(f"nothing landed in {out}")
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("batch_id", F.lit(0))
    if newest:
        ids = ids[-1:]
    return spark.read.option("basePath", out).parquet(*[f"{out}/batch_id={i}" for i in ids])


def latest_by_key(spark: SparkSession, out: str, key: list[str], schema=None, before: int | None = None) -> DataFrame:
    """Current value per key of an update-mode result landed by batch."""
    df = landed(spark, out, schema, before)
    cols = [c for c in df.columns if c not in key and c != "batch_id"]
    latest = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v"))
    return latest.select(*key, "_v.*")


# ------------------------------------------------------------ hourly counts
def hourly_counts(spark: SparkSession, events: DataFrame, watermark: str = WATERMARK,
                  root: str | None = None) -> DataFrame:
    """Blocks per (hour window, rule) from a stream of raw events."""
    from gatewatch.sources.adapters import waf_logs
    w = waf_logs(events)
    b = D.blocked(w).select(F.timestamp_millis("timestamp").alias("ts"), F.col("terminatingruleid").alias("rule"))
    agg = (b.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour").alias("w"), "rule")
           .agg(F.count(F.lit(1)).alias("cnt")))
    ckpt, out = job_paths(spark, "hourly", root)
    flat = agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("block_hour"), "rule", "cnt")
    run_available(flat, "hourly", batch_folder_sink(out), output_mode="update", checkpoint=ckpt)
    return latest_by_key(spark, out, ["block_hour", "rule"])


# -------------------------------------------------------------------- latch
LATCH_STATE = "ip string, premit_on int, sets long"
LATCH_INPUT = "row_id long, ip string, event_ts timestamp_ntz, pred_risk double, mode string, t double"
LATCH_ORDER = ["event_ts", "row_id"]


def _latched(rows: DataFrame, carry: DataFrame) -> DataFrame:
    lat = RK.premitigation(rows, ["ip"], LATCH_ORDER, None, carry=carry, sets="sets")
    return lat.select("row_id", "ip", "event_ts", "mode", "premit_on", "trigger", "mitigation_level", "sets")


def latch(spark: SparkSession, events: DataFrame, cycle: float | None = None, root: str | None = None,
          delay: str = WATERMARK) -> DataFrame:
    """Pre-mitigation latch per IP over a stream, in event time.

    A row is held until the watermark (the latest event time seen, less
    ``delay``) has passed it, so files that come out of order within the delay
    give the answer of the batch latch. A micro-batch scans the rows that the
    watermark has released, in (event time, id) order and in chunks (an IP's
    rows are split over tasks), from the state (last value, number of ONs) that
    the rows before left for these IPs; it writes the state of these IPs only.
    Rows that come after the watermark has passed them, or have no time, are
    left out and kept aside (``late_rows``). A replayed batch reads what the
    batches before it left and overwrites its own folders.

    The result has the released rows and, as things stand, the rows still held;
    with a stable ``root`` a later run may still change the latter."""
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(events).withColumn("t", RK.scenario_clock("event_ts", cycle))
    sc = sc.withColumn("mode", RK.scenario_phase("t")).select("row_id", "ip", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "pred_risk", "mode", "t")
    ckpt, base = job_paths(spark, "latch", root)
    out, held_dir, mark_dir, late_dir = (f"{base}/{x}" for x in ("rows", "held", "mark", "late"))
    state = KeyedState(spark, f"{base}/state", ["ip"], LATCH_STATE)

    def sink(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        new = materialize(batch, "latch_batch")
        before = landed(s, mark_dir, "mark timestamp_ntz", batch_id, newest=True).agg(F.max("mark").cast("string")).first()[0]
        ts, mark = F.col("event_ts"), F.lit(before).cast("timestamp_ntz")
        on_time = ts.isNotNull() & F.coalesce(ts >= mark, F.lit(True))
        new.where(~on_time).write.mode("overwrite").parquet(f"{late_dir}/batch_id={batch_id}")
        seen = F.greatest(mark, F.expr(f"max(event_ts) - INTERVAL {delay}")).alias("mark")
        new.agg(seen).write.mode("overwrite").parquet(f"{mark_dir}/batch_id={batch_id}")
        after = s.read.parquet(f"{mark_dir}/batch_id={batch_id}").select(F.col("mark").cast("string")).first()[0]
        held = landed(s, held_dir, LATCH_INPUT, batch_id, newest=True).drop("batch_id")
        pool = materialize(held.unionByName(new.where(on_time)), "latch_pool")
        free = F.coalesce(ts < F.lit(after).cast("timestamp_ntz"), F.lit(False))
        pool.where(~free).write.mode("overwrite").parquet(f"{held_dir}/batch_id={batch_id}")
        ready = pool.where(free)
        carry = state.read(batch_id).join(ready.select("ip").distinct(), "ip", "left_semi")
        _latched(ready, carry).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        done = s.read.parquet(f"{out}/batch_id={batch_id}").where("ip IS NOT NULL")
        last = done.groupBy("ip").agg(F.max_by(F.struct("premit_on", "sets"), F.struct(*LATCH_ORDER)).alias("_v"))
        state.write(last.select("ip", "_v.*"), batch_id)
        for folder in (held_dir, mark_dir):  # the batch before is needed for a replay
            remove_batches(s, folder, batch_id - 2)

    run_available(sc, "latch", sink, output_mode="append", checkpoint=ckpt)
    done = landed(spark, out, "row_id long, ip string, event_ts timestamp_ntz, mode string, premit_on int, trigger int, "
                  "mitigation_level int, sets long").drop("batch_id")
    held = landed(spark, held_dir, LATCH_INPUT, newest=True).drop("batch_id")
    carry = state.read().join(held.select("ip").distinct(), "ip", "left_semi")
    return done.unionByName(_latched(held, carry)).drop("event_ts", "sets")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that a latch job under ``root`` left out, with their batch_id."""
    return landed(spark, f"{job_paths(spark, 'latch', root)[1]}/late", LATCH_INPUT)


# ------------------------------------------------------------------ respond
def block_list(spark: SparkSession, root: str) -> VersionedSet:
    return VersionedSet(spark, root, "cidr", "cidr string, first_seen timestamp_ntz, hits long")


def respond(spark: SparkSession, events: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Detect-and-respond loop. A streaming count per (day, ip) of anomalies
    lives in the aggregation state (one row per day and IP); update mode
    hands each micro-batch the (day, ip) rows whose counts changed. Counts
    only grow, so a day's top IP after the batch is the best of its previous
    top and the batch's updated rows. The sink reads the tops as the batches
    before left them, writes those of the touched days, their alerts, and
    commits the absent /32 entries to the versioned block list (other writers
    may extend it too). A batch reads only what came before it and overwrites
    its own folders, and its commit is named by its id, so a replay changes
    nothing. Returns (block list, alerts)."""
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(events).filter((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    counts = sc.groupBy("year", "month", "day", "ip").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("event_ts").alias("first_ts"))
    ckpt, out = job_paths(spark, "respond", root)
    top_dir, alert_dir = f"{out}/top", f"{out}/alerts"
    days = ["year", "month", "day"]
    tops = KeyedState(spark, f"{out}/tops", days, "year string, month string, day string, ip string, cnt long, first_ts timestamp_ntz")
    block = block_list(spark, f"{out}/blocklist")

    def sink(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        # only batches before this one: a replayed batch must not read its own rows
        prev = tops.read(batch_id)
        touched = batch.select(*days).distinct()
        cand = prev.join(touched, days, "left_semi").select(*days, "ip", "cnt", "first_ts") \
            .unionByName(batch.select(*days, "ip", "cnt", "first_ts"))
        top = D.top_per_group(cand, days, "cnt", "ip", extra=["first_ts"])
        top.write.mode("overwrite").parquet(f"{top_dir}/batch_id={batch_id}")
        top = s.read.parquet(f"{top_dir}/batch_id={batch_id}")
        RS.alerts(top, "first_ts", "ip", "cnt", keep=[F.concat_ws("-", *days).alias("day_key")]) \
            .write.mode("overwrite").parquet(f"{alert_dir}/batch_id={batch_id}")
        tops.write(top, batch_id)
        block.append_absent(RS.block_candidates(top, ts="first_ts"), ("respond", batch_id))

    run_available(counts, "respond", sink, output_mode="update", checkpoint=ckpt)
    return block.read(), latest_by_key(spark, alert_dir, ["day_key"])


# -------------------------------------------------------------- live scoring
def score_stream(spark: SparkSession, events: DataFrame, forest, nodes_pdf, scaler: dict,
                 offset: float, root: str | None = None) -> DataFrame:
    """Score each new request with the broadcast forest; BLOCK / ALLOW /
    FAIL_OPEN by the offset decision. Scoring runs per micro-batch inside
    ``foreachBatch``: the batch is a static frame there, so a thin batch (one
    small file = one partition) is spread over the task slots before the
    CPU-heavy Arrow UDF, and a large one is left as it is."""
    from gatewatch.operators import forest as FR
    from gatewatch.operators.features import spread, training_frame
    from gatewatch.sources.adapters import waf_logs
    w = waf_logs(events).select("row_id", "terminatingruleid", "action", F.col("httprequest.country").alias("country"),
                                F.col("httprequest.uri").alias("uri"), F.col("httprequest.clientip").alias("ip"))
    feats = FR.apply_scaler(training_frame(w), scaler).select("row_id", "ip", *scaler["features"])
    ckpt, folder = job_paths(spark, "scores", root)

    def sink(batch: DataFrame, batch_id: int) -> None:
        scored = FR.score(spread(batch), forest, nodes_pdf=nodes_pdf)
        out = scored.select("row_id", "ip", F.round("score", 6).alias("score"),
                            FR.edge_action("score", "offset", offset=offset).alias("edge_action"))
        out.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    run_available(feats, "scores", sink, output_mode="append", checkpoint=ckpt)
    return spark.read.parquet(folder).drop("batch_id")


# ------------------------------------------------------------------ signals
def signals(spark: SparkSession, events: DataFrame, width: str = "5 minutes",
            watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(events).filter((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    sc = sc.withColumn("ts", F.col("event_ts").cast("timestamp"))
    agg = (sc.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "ip")
           .agg(F.count(F.lit(1)).alias("signals")))
    flat = agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bucket_start"), "ip",
                      F.lit(K.DEFENSE_METRIC).alias("metric"), "signals")
    ckpt, out = job_paths(spark, "signals", root)
    run_available(flat, "signals", batch_folder_sink(out), output_mode="update", checkpoint=ckpt)
    return latest_by_key(spark, out, ["bucket_start", "ip"])


def signal_panes(spark: SparkSession, events: DataFrame, slide_s: int, watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    """(pane, ip, n): anomalous requests per slide and address, one state row per
    pane and address; sliding windows are sums of panes (``operators.panes``)."""
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(events).filter((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    sc = sc.withColumn("ts", F.col("event_ts").cast("timestamp"))
    agg = (sc.withWatermark("ts", watermark).groupBy(F.window("ts", f"{slide_s} seconds").alias("w"), "ip")
           .agg(F.count(F.lit(1)).alias("n")))
    flat = agg.select(F.unix_seconds("w.start").alias("pane"), "ip", "n")
    ckpt, out = job_paths(spark, "panes", root)
    run_available(flat, "panes", batch_folder_sink(out), output_mode="update", checkpoint=ckpt)
    return latest_by_key(spark, out, ["pane", "ip"])


# ----------------------------------------------------------------- sessions
def sessions(spark: SparkSession, events: DataFrame, gap: str = "30 minutes",
             watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    """Anomaly sessions per IP: anomalous requests closer than ``gap`` join
    one session (session_window); start, end and size per session."""
    from gatewatch.sources.adapters import scored_events
    sc = scored_events(events).filter(F.col("anomaly") == 1).withColumn("ts", F.col("event_ts").cast("timestamp"))
    agg = (sc.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "ip")
           .agg(F.count(F.lit(1)).alias("n_rows")))
    flat = agg.select("ip", F.date_format("s.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
                      F.date_format("s.end", "yyyy-MM-dd HH:mm:ss").alias("session_end"), "n_rows")
    ckpt, out = job_paths(spark, "sessions", root)
    # append mode: a session is emitted once the watermark passes its end
    run_available(flat, "sessions", batch_folder_sink(out), output_mode="append", checkpoint=ckpt)
    return landed(spark, out, "ip string, session_start string, session_end string, n_rows long").drop("batch_id")
