"""WAF access logs: the nested JSON schema, tolerant reads, path partitions.

* ``WAF_SCHEMA`` is the access-log DDL as a Spark schema (explicit, so no
  inference pass over 100 TB of JSON).
* Malformed lines do not fail the read (PERMISSIVE); they become all-null
  rows and their raw text lands in ``_corrupt_record`` so they can be counted.
* Logs laid out as ``.../yyyy/mm/dd/hh/`` (not Hive style) get their
  year/month/day/hour string columns from the file path.
* ``projected_glob`` enumerates legal partition values (enum, integer range,
  zero-padded) into one path glob, so only those folders are listed.
* ``land`` writes the logs as a Hive-partitioned Parquet table, after which
  partition predicates prune at planning time and nested fields are pruned
  by the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.sources.adapters import HEADER, RULE_GROUP

WAF_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("formatversion", T.IntegerType()),
    T.StructField("webaclid", T.StringType()),
    T.StructField("terminatingruleid", T.StringType()),
    T.StructField("terminatingruletype", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("httpsourcename", T.StringType()),
    T.StructField("httpsourceid", T.StringType()),
    T.StructField("httprequest", T.StructType([
        T.StructField("clientip", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("args", T.StringType()),
        T.StructField("httpmethod", T.StringType()),
        T.StructField("httpversion", T.StringType()),
        T.StructField("headers", T.ArrayType(HEADER)),
    ])),
    T.StructField("rulegrouplist", T.ArrayType(RULE_GROUP)),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
])
PARTITIONS = ["year", "month", "day", "hour"]
_PATH_RE = r"/(\d{4})/(\d{2})/(\d{2})/(\d{2})/"


def read_json_logs(spark: SparkSession, paths, with_corrupt: bool = True,
                   path_partitions: bool = True) -> DataFrame:
    """Read WAF JSON lines; malformed lines -> null row (+ raw text)."""
    schema = WAF_SCHEMA
    if with_corrupt:
        schema = T.StructType(WAF_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(paths))
    if path_partitions:
        fp = F.col("_metadata.file_path")
        df = df.withColumns({p: F.regexp_extract(fp, _PATH_RE, i + 1) for i, p in enumerate(PARTITIONS)})
    return df


def count_malformed(df: DataFrame, by: list[str] | None = None, *more: Column) -> DataFrame:
    """Rows and malformed lines (and ``more`` aggregates), in all or per group (raw text kept, parsed fields null). The
    parsed ``timestamp`` is referenced too: Spark refuses queries that read
    only the corrupt-record column of raw JSON."""
    bad = F.col("_corrupt_record").isNotNull() & F.col("timestamp").isNull()
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("malformed"), *more)


def valid_logs(df: DataFrame) -> DataFrame:
    """Rows that parsed (no corrupt text, a timestamp present)."""
    return df.filter(F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull())


def projected_values(kind: str, spec, digits: int = 2) -> list[str]:
    """Partition projection: 'enum' -> the listed values; 'integer' -> the
    range lo..hi zero-padded to ``digits``."""
    if kind == "enum":
        return [str(v) for v in spec]
    lo, hi = spec
    return [str(v).zfill(digits) for v in range(int(lo), int(hi) + 1)]


def projected_glob(root: str, years: list[str], months: list[str], days: list[str], hours: list[str]) -> str:
    """One Hadoop glob over the projected folders ``root/yyyy/mm/dd/hh/``."""
    def alt(vs):
        return "{" + ",".join(vs) + "}" if len(vs) > 1 else vs[0]
    return f"{root.rstrip('/')}/{alt(years)}/{alt(months)}/{alt(days)}/{alt(hours)}/"


def land(df: DataFrame, out: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    """Write logs as a Hive-partitioned table (year/month/day/hour strings).

    Rows are first range-partitioned on (partition columns, timestamp): each
    task then writes a few contiguous hour folders (not one file per task per
    hour), and a hot hour is split across tasks by the sampled bounds."""
    from gatewatch.session import range_partitions
    n = partitions or range_partitions(df)
    (df.repartitionByRange(n, *PARTITIONS, "timestamp")
     .write.mode("overwrite").partitionBy(*PARTITIONS).format(fmt).save(out))


def deliver(lines: DataFrame, out: str) -> None:
    """Raw text lines (``value`` + partition columns) under
    ``out/yyyy/mm/dd/hh/``, the layout of a log delivery: Spark writes
    ``year=yyyy/...`` folders, which are then renamed on the file system (one
    rename per folder; the data are not touched)."""
    lines.repartition(*PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).text(out)
    spark = lines.sparkSession
    hpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = hpath(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    level = [out.rstrip("/")]
    for part in PARTITIONS:
        nxt = []
        for folder in level:
            for st in fs.listStatus(hpath(folder)):
                name = st.getPath().getName()
                if name.startswith(part + "="):
                    to = f"{folder}/{name.split('=', 1)[1]}"
                    if not fs.rename(st.getPath(), hpath(to)):
                        raise OSError(f"could not rename to {to}")
                    nxt.append(to)
        level = nxt


def read_landed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a landed table keeping the partition values as strings ('05'
    stays '05'): the partition columns are declared in the schema."""
    schema = T.StructType(WAF_SCHEMA.fields + [T.StructField(p, T.StringType()) for p in PARTITIONS])
    return spark.read.format(fmt).schema(schema).load(path)
