"""Other sources and sinks: scored events (date-partitioned JSON), CSV with
header, metrics JSON (nested and flat), scan reports (nested -> flat), API
access logs, text reports, append-only sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORED_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("pred_risk", T.DoubleType()),
    T.StructField("obs_risk", T.DoubleType()),
    T.StructField("premit_on", T.IntegerType()),
    T.StructField("mitigation_level", T.IntegerType()),
    T.StructField("anomaly", T.IntegerType()),
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("year", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("day", T.StringType()),
])

WAF_FLAT_SCHEMA = T.StructType([
    T.StructField("event_time", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("source_country", T.StringType()),
    T.StructField("request_uri", T.StringType()),
    T.StructField("terminatingruleid", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("country_code", T.IntegerType()),
    T.StructField("rule_code", T.IntegerType()),
    T.StructField("uri_len", T.IntegerType()),
])

API_LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in (
    "requestId", "ip", "requestTime", "httpMethod", "resourcePath", "status", "protocol", "responseLength")])

FINDINGS_FLAT_COLUMNS = ["file", "start_line", "end_line", "rule_id", "severity", "description", "link", "passed"]


# ----------------------------------------------------------- scored events
def write_scored(df: DataFrame, root: str, mode: str = "append") -> None:
    """Scored-event sink: JSON under year=/month=/day= folders."""
    df.write.mode(mode).partitionBy("year", "month", "day").json(root)


def read_scored(spark: SparkSession, root: str, year: str | None = None, month: str | None = None,
                day: str | None = None) -> DataFrame:
    """Scored events with string partition columns; partition predicates
    become PartitionFilters (only the matching folders are read)."""
    df = spark.read.schema(SCORED_SCHEMA).json(root)
    for k, v in (("year", year), ("month", month), ("day", day)):
        if v is not None:
            df = df.filter(F.col(k) == F.lit(v))
    return df


# ----------------------------------------------------------------------- CSV
def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; empty fields are null."""
    r = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------- metrics
def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line (flat metrics)."""
    return spark.read.json(path)


def write_metrics(df: DataFrame, path: str, flat: bool = False) -> None:
    """Metrics sink; the flat variant keeps only scalar columns."""
    if flat:
        keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df = df.select(*keep)
    df.coalesce(1).write.mode("overwrite").json(path)


def write_metrics_document(experiments: DataFrame, groups: DataFrame, key: str, path: str) -> None:
    """Nested metrics sink: one JSON document with the ``experiments`` array
    and a ``groups`` map. Both inputs are reports of a handful of rows."""
    e = experiments.agg(F.array_sort(F.collect_list(F.struct(*experiments.columns))).alias("experiments"))
    vals = F.struct(*[c for c in groups.columns if c != key])
    g = groups.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), vals))).alias("groups"))
    both = e.unionByName(g, allowMissingColumns=True)
    doc = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("experiments", "groups")])
    doc.coalesce(1).write.mode("overwrite").json(path)


def read_metrics_document(spark: SparkSession, path: str, experiment: T.StructType, group: T.StructType) -> DataFrame:
    """The nested document back, one row per experiment plus the group map."""
    schema = T.StructType([T.StructField("experiments", T.ArrayType(experiment)),
                           T.StructField("groups", T.MapType(T.StringType(), group))])
    return spark.read.schema(schema).json(path).select(F.explode("experiments").alias("e"), "groups").select("e.*", "groups")


# -------------------------------------------------------------- scan reports
def flatten_findings(spark: SparkSession, path: str, multi_line: bool = True, schema=None) -> DataFrame:
    """Nested scan reports (``results`` arrays) -> flat rows. A report is one
    multi-line document per file, or one document per line (splittable)."""
    r = spark.read.option("multiLine", multi_line)
    raw = (r.schema(schema) if schema else r).json(path)
    r = raw.select(F.explode("results").alias("r"))
    return r.select(
        F.col("r.location.filename").alias("file"),
        F.col("r.location.start_line").cast("int").alias("start_line"),
        F.col("r.location.end_line").cast("int").alias("end_line"),
        F.col("r.rule_id").alias("rule_id"),
        F.col("r.severity").alias("severity"),
        F.col("r.description").alias("description"),
        F.try_element_at(F.col("r.links"), F.lit(1)).alias("link"),
        (F.col("r.status") == 1).alias("passed"),
    )


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings and failed findings per severity."""
    return findings.groupBy("severity").agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum((~F.coalesce(F.col("passed"), F.lit(False))).cast("long")).alias("failed"))


def severity_by_rule(findings: DataFrame, levels=("CRITICAL", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Findings per rule, one column per severity (fixed pivot values, so no
    extra pass to discover them)."""
    return findings.groupBy("rule_id").pivot("severity", list(levels)).count().na.fill(0)


# ------------------------------------------------------------ API access logs
def read_api_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(API_LOG_SCHEMA).json(path)


# --------------------------------------------------------------- text report
def report_lines(title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """A text report as one DataFrame of lines: a title, then each section's
    header and its rows rendered with ``concat_ws``. Section frames are small
    by construction (samples, counts); ordering is kept with a line number."""
    spark = sections[0][1].sparkSession
    parts = [spark.createDataFrame([(0, 0, "=" * 70), (0, 1, title), (0, 2, "=" * 70)],
                                   "sec int, ln long, value string")]
    from pyspark.sql import Window
    for i, (header, df) in enumerate(sections, start=1):
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
        body = df.select(F.concat_ws("  ", *cols).alias("value"), F.monotonically_increasing_id().alias("_o"))
        # line numbers 1..k in the section's order (sections are small: samples, counts)
        body = body.withColumn("ln", F.row_number().over(Window.orderBy("_o")).cast("long")) \
            .withColumn("sec", F.lit(i))
        head = spark.createDataFrame([(i, 0, f"[{header}]")], "sec int, ln long, value string")
        parts.append(head)
        parts.append(body.select("sec", "ln", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_text(lines: DataFrame, path: str) -> None:
    lines.orderBy("sec", "ln").select("value").coalesce(1).write.mode("overwrite").text(path)


# ------------------------------------------------------------- append sinks
def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only sink (defense signals, alerts)."""
    df.write.mode("append").format(fmt).save(path)
