"""Streaming queries: each runs a Structured Streaming job over the events
files (availableNow trigger, checkpoint under the shared folder) and returns
the landed result; where SQL can express it the oracle is the batch SQL, so
stream = batch is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewatch.operators.features import TRAIN_FEATURES
from gatewatch.plans import q_dashboards, q_windows  # noqa: F401 (registers hourly_rule first)
from gatewatch.plans.q_model import FIT_SQL, _waf_training
from gatewatch.plans.registry import query, REGISTRY, table
from gatewatch.plans.sqlviews import SCORED, with_
from gatewatch.session import scratch_path
from gatewatch.streaming import jobs as J


def _events(spark, sf):
    return J.file_stream(spark, sf, "events.parquet")


@query("stream_hourly", REGISTRY["hourly_rule"].sql)
def stream_hourly(spark, sf):
    """Hourly blocks per rule as a watermarked streaming aggregation (update
    mode, landed per batch); equals the batch dashboard."""
    return J.hourly_counts(spark, _events(spark, sf))


@query("stream_latch", q_windows.LATCH_SQL + """
SELECT row_id, ip, mode, CAST(premit_on AS INTEGER) AS premit_on,
       CASE WHEN pred_risk >= 70 AND sets = 1 THEN 1 ELSE 0 END AS trigger, mitigation_level FROM z""")
def stream_latch(spark, sf):
    """Pre-mitigation latch per IP, state carried between micro-batches; equals the batch latch."""
    return J.latch(spark, _events(spark, sf))


LATE_DELAY = "6 hours"
#: Deliveries of ``stream_late_latch``: days 1-16 without every 40th row, the rest.
_LATCH_REST = q_windows.LATCH_SQL[len(with_(SCORED)):]


@query("stream_late_latch", with_(SCORED.replace("scored AS (", "all_scored AS (", 1)) + f"""
, f AS (SELECT *, CASE WHEN day <= '16' AND row_id % 40 <> 0 THEN 0 ELSE 1 END AS k FROM all_scored)
, m AS (SELECT k, max(max(event_ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {LATE_DELAY} AS mark FROM f GROUP BY k)
, t AS (SELECT f.*, coalesce(event_ts < mark, FALSE) AS late FROM f JOIN m USING (k))
, scored AS (SELECT * EXCLUDE (k, late) FROM t WHERE NOT late)
""" + _LATCH_REST.replace(", m AS (", ", mm AS (").replace("FROM m WINDOW", "FROM mm WINDOW") + """
SELECT row_id, ip, FALSE AS late, CAST(premit_on AS INTEGER) AS premit_on,
       CASE WHEN pred_risk >= 70 AND sets = 1 THEN 1 ELSE 0 END AS trigger, mitigation_level FROM z
UNION ALL SELECT row_id, ip, TRUE, NULL, NULL, NULL FROM t WHERE late""")
def stream_late_latch(spark, sf):
    """The latch over two deliveries out of order: rows within the delay give
    the batch latch over all on-time rows, those beyond it are set aside."""
    ev = table(spark, sf, "events")
    k = F.when((F.dayofmonth("ts") <= 16) & (F.col("event_id") % 40 != 0), 0).otherwise(1)
    base = scratch_path(spark, "streams/deliveries")
    schema = ev.schema
    out = None
    for i in range(2):
        ev.where(k == i).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        out = J.latch(spark, stream, root=f"{base}/job", delay=LATE_DELAY)
    late = J.late_rows(spark, f"{base}/job").select("row_id", "ip", F.lit(True).alias("late"), *[F.lit(None).cast("int").alias(c) for c in ("premit_on", "trigger", "mitigation_level")])
    return out.select("row_id", "ip", F.lit(False).alias("late"), "premit_on", "trigger", "mitigation_level").unionByName(late)


DAILY_TOP = with_(SCORED) + """
, daily AS (SELECT year, month, day, ip, cnt, first_ts FROM (
  SELECT year, month, day, ip, COUNT(*) AS cnt, min(event_ts) AS first_ts,
         row_number() OVER (PARTITION BY year, month, day ORDER BY COUNT(*) DESC, ip) AS rk
  FROM scored WHERE anomaly = 1 AND coalesce(ip, '') NOT IN ('', 'unknown')
  GROUP BY year, month, day, ip) t WHERE rk = 1)
"""


@query("stream_blocklist", DAILY_TOP + """
SELECT concat(ip, '/32') AS cidr, strftime(min(first_ts), '%Y-%m-%d %H:%M:%S') AS first_seen,
       CAST(sum(cnt) AS BIGINT) AS hits FROM daily GROUP BY 1""")
def stream_blocklist(spark, sf):
    """Detect-and-respond stream: running anomaly counts per (day, ip), top
    IP per touched day, insert-if-absent /32 block list."""
    block, _ = J.respond(spark, _events(spark, sf))
    return block.select("cidr", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "hits")


COMMIT_DAYS = (("01", "10"), ("05", "20"), ("01", "31"))


@query("blocklist_commits", DAILY_TOP + ", ".join([""] + [f"""c{i} AS (SELECT concat(ip, '/32') AS cidr, min(first_ts) AS first_seen, CAST(sum(cnt) AS BIGINT) AS hits
  FROM daily WHERE day BETWEEN '{a}' AND '{b}' GROUP BY 1)""" for i, (a, b) in enumerate(COMMIT_DAYS)]) + """
, every AS (SELECT 1 AS version, * FROM c0 UNION ALL SELECT 2, * FROM c1 UNION ALL SELECT 3, * FROM c2)
SELECT cidr, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, hits, version FROM every
QUALIFY row_number() OVER (PARTITION BY cidr ORDER BY version) = 1""")
def blocklist_commits(spark, sf):
    """Versioned block list: three overlapping commits of the days' top
    addresses, each entry with the version that brought it."""
    from gatewatch.operators import dashboards as D
    from gatewatch.operators import response as RS
    from gatewatch.sources.adapters import scored_events
    days = ["year", "month", "day"]
    sc = scored_events(table(spark, sf, "events")).where((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    counts = sc.groupBy(*days, "ip").agg(F.count(F.lit(1)).alias("cnt"), F.min("event_ts").cast("timestamp_ntz").alias("first_ts"))
    daily = D.top_per_group(counts, days, "cnt", "ip", extra=["first_ts"])
    block = J.block_list(spark, scratch_path(spark, "blocklists/days"))
    versions = [block.append_absent(RS.block_candidates(daily.where(F.col("day").between(a, b)), ts="first_ts"), ("days", i))
                for i, (a, b) in enumerate(COMMIT_DAYS)]
    parts = [block.read(v).withColumn("version", F.lit(v)) for v in versions]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = rows.groupBy("cidr").agg(F.min_by(F.struct("first_seen", "hits", "version"), "version").alias("r")).select("cidr", "r.*")
    return first.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


@query("stream_alerts", DAILY_TOP + """
SELECT concat_ws('-', year, month, day) AS day_key, ip, CAST(cnt AS BIGINT) AS count,
       'AI-based Anomaly Detected' AS reason FROM daily""")
def stream_alerts(spark, sf):
    """Alerts (ts, ip, count, reason) for the top anomalous IP of each day, from the stream."""
    _, alerts = J.respond(spark, _events(spark, sf))
    return alerts.select("day_key", "ip", "count", "reason")


@query("stream_signals", with_(SCORED) + """
, b AS (SELECT time_bucket(INTERVAL 5 MINUTE, event_ts) AS bs, ip FROM scored
        WHERE anomaly = 1 AND coalesce(ip, '') NOT IN ('', 'unknown'))
SELECT strftime(bs, '%Y-%m-%d %H:%M:%S') AS bucket_start, ip, 'DefenseSignal' AS metric, COUNT(*) AS signals
FROM b GROUP BY bs, ip""")
def stream_signals(spark, sf):
    """Defense signals per 5-minute window and IP from the stream."""
    return J.signals(spark, _events(spark, sf))


@query("stream_sessions", with_(SCORED) + """
, a AS (SELECT ip, event_ts, CASE WHEN lag(event_ts) OVER (PARTITION BY ip ORDER BY event_ts) IS NULL
                 OR event_ts >= lag(event_ts) OVER (PARTITION BY ip ORDER BY event_ts) + INTERVAL 30 MINUTE
               THEN 1 ELSE 0 END AS new_s FROM scored WHERE anomaly = 1)
, s AS (SELECT *, sum(new_s) OVER (PARTITION BY ip ORDER BY event_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM a)
, g AS (SELECT ip, min(event_ts) AS st, max(event_ts) + INTERVAL 30 MINUTE AS en, COUNT(*) AS n_rows
        FROM s GROUP BY ip, sid)
, wm AS (SELECT max(event_ts) - INTERVAL 10 MINUTE AS wmark FROM scored WHERE anomaly = 1)
SELECT ip, strftime(st, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(en, '%Y-%m-%d %H:%M:%S') AS session_end,
       n_rows
FROM g, wm WHERE en <= wmark""")
def stream_sessions(spark, sf):
    """Anomaly sessions per IP (30-minute gap) with session_window in a stream;
    append mode emits the sessions the final watermark (max event time - 10
    minutes) has closed."""
    return J.sessions(spark, _events(spark, sf))


@query("stream_score", FIT_SQL + """
SELECT row_id, ip, round(score, 6) AS score, CASE WHEN score - off < 0 THEN 'BLOCK' ELSE 'ALLOW' END AS edge_action
FROM scored JOIN (SELECT row_id, client_ip AS ip FROM waf) USING (row_id), off""")
def stream_score(spark, sf):
    """Live scoring: fit the forest on the landed logs, then score each new
    request in the stream and decide BLOCK / ALLOW / FAIL_OPEN."""
    from gatewatch.plans.q_model import fit_score
    df = _waf_training(spark, sf)
    _, forest, pdf, scaler = fit_score(df, TRAIN_FEATURES, 0.25)
    return J.score_stream(spark, _events(spark, sf), forest, pdf, scaler, forest.offset)
