"""Stored sketches, sliding windows, code bitmaps, SQL functions, the URI-only
data set."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.functions import text as X
from gatewatch.functions.sql import register
from gatewatch.operators import panes as PN
from gatewatch.operators import response as RS
from gatewatch.operators import sketches as SK
from gatewatch.operators.features import spread
from gatewatch.plans.q_text import _class_entropy_sql, _threat_sql
from gatewatch.plans.registry import query, table
from gatewatch.plans.sqlviews import SCORED, WAF, WEB, entropy_sql, with_
from gatewatch.session import scratch_path
from gatewatch.sources import files as FS
from gatewatch.sources.adapters import scored_events, waf_logs, web_requests
from gatewatch.streaming import jobs as J

#: Bounds of the sketches' errors, four standard errors and more.
DISTINCT_ERROR, RANK_ERROR = 0.04, 0.03


@query("sketch_days", with_(SCORED) + """
SELECT strftime(event_ts, '%Y-%m-%d') AS day, COUNT(*) AS n, COUNT(DISTINCT ip) AS n_ips, TRUE AS distinct_within, TRUE AS median_within
FROM scored GROUP BY 1""")
def sketch_days(spark, sf):
    """Hourly HLL and KLL sketches stored as a table and merged per day, beside
    the exact counts: the estimates lie within their error bounds."""
    sc = scored_events(table(spark, sf, "events")).select("event_ts", "ip", "raw_score")
    out = scratch_path(spark, "sketches/hours")
    SK.hourly_sketches(sc, "event_ts", "ip", "raw_score").write.parquet(out)
    day = F.date_format("hour", "yyyy-MM-dd").alias("day")
    est = SK.read_sketches(SK.merge_sketches(spark.read.parquet(out), [day]), {"median": 0.5})
    exact = sc.groupBy(F.date_format("event_ts", "yyyy-MM-dd").alias("day"), "ip").agg(F.count(F.lit(1)).alias("c"))
    exact = exact.groupBy("day").agg(F.count("ip").alias("n_ips"), F.sum("c").alias("rows"))
    days = est.join(exact, "day")
    under = sc.select(F.date_format("event_ts", "yyyy-MM-dd").alias("day"), "raw_score").join(days.select("day", "median"), "day").groupBy("day").agg(
        F.avg((F.col("raw_score") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("raw_score") <= F.col("median")).cast("double")).alias("upto"))
    near = (F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)
    return days.join(under, "day").select("day", "n", "n_ips", (F.abs(F.col("n_keys") - F.col("n_ips")) <= 1 + DISTINCT_ERROR * F.col("n_ips")).alias("distinct_within"),
                                          near.alias("median_within"))


WIDTH_S, SLIDE_S = 900, 300
SLIDING_SQL = with_(SCORED) + f"""
, p AS (SELECT CAST(floor(epoch_us(event_ts) / {SLIDE_S * 1_000_000}) AS BIGINT) * {SLIDE_S} AS pane, ip FROM scored
        WHERE anomaly = 1 AND coalesce(ip, '') NOT IN ('', 'unknown'))
SELECT strftime(make_timestamp((pane - s) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start, ip, COUNT(*) AS signals
FROM p, (SELECT unnest(range(0, {WIDTH_S}, {SLIDE_S})) AS s) GROUP BY 1, 2"""


def _windows(panes):
    w = PN.sliding_counts(panes, ["ip"], WIDTH_S, SLIDE_S)
    return w.select(F.date_format(F.timestamp_seconds("window_start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "ip", F.col("n").alias("signals"))


@query("sliding_signals", SLIDING_SQL)
def sliding_signals(spark, sf):
    """Defense signals per address over 15-minute windows every 5 minutes, from
    one count per row and pane."""
    sc = scored_events(table(spark, sf, "events")).where((F.col("anomaly") == 1) & RS.valid_ip("ip"))
    return _windows(PN.pane_counts(sc, "event_ts", ["ip"], SLIDE_S))


@query("stream_sliding", SLIDING_SQL)
def stream_sliding(spark, sf):
    """The sliding windows from a stream: its state holds one count per pane and
    address, windows are combined from the landed panes."""
    return _windows(J.signal_panes(spark, J.file_stream(spark, sf, "events.parquet"), SLIDE_S))


@query("code_counts", with_(WAF) + """
SELECT terminatingruleid AS rule, COUNT(DISTINCT user_id) AS n_codes, min(user_id) AS low, max(user_id) AS high FROM waf GROUP BY 1""")
def code_counts(spark, sf):
    """Distinct client codes per rule, exactly, by bitmaps."""
    w = waf_logs(table(spark, sf, "events"), keep=["user_id"])
    return SK.distinct_codes(w.withColumnRenamed("terminatingruleid", "rule"), "rule", "user_id")


@query("sql_functions", with_(WEB) + f"""
SELECT row_id, round({entropy_sql('request_uri')}, 6) AS path_entropy, round({_class_entropy_sql('request_uri')}, 6) AS class_entropy,
       {_threat_sql('request_uri', 'request_args', entropy_sql('request_args'))} AS threat FROM web""")
def sql_functions(spark, sf):
    """Entropy, class entropy and threat class called as SQL functions."""
    register(spark)
    return spark.sql("""SELECT row_id, round(gw_entropy(request_uri), 6) AS path_entropy, round(gw_class_entropy(request_uri), 6) AS class_entropy,
                               gw_threat_class(request_uri, request_args) AS threat FROM {web}""", web=spread(web_requests(table(spark, sf, "pages"))))


@query("uri_only", with_(WEB) + f"""
SELECT request_uri, COUNT(*) AS n, round({entropy_sql('request_uri')}, 6) AS path_entropy, CAST(length(request_uri) AS BIGINT) AS uri_len
FROM web WHERE request_uri <> '' GROUP BY request_uri""")
def uri_only(spark, sf):
    """A data set of request paths alone, written and read as one-column CSV:
    rows, entropy and length per path (an empty field is null and left out)."""
    out = scratch_path(spark, "landing/uris")
    FS.write_csv(web_requests(table(spark, sf, "pages")).select("request_uri"), out)
    uris = FS.read_csv(spark, out, T.StructType([T.StructField("request_uri", T.StringType())])).where("request_uri IS NOT NULL")
    return uris.groupBy("request_uri").agg(F.count(F.lit(1)).alias("n")).select(
        "request_uri", "n", X.round6(X.shannon_entropy("request_uri")).alias("path_entropy"), X.text_length("request_uri").alias("uri_len"))
