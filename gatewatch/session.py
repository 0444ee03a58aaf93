"""Session helpers.

The cluster names a shared folder in ``spark.checkpoint.dir``; every job that
cuts lineage or keeps streaming state writes below it. Only when the setting
is absent (local tests) do we create a scratch folder ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "gatewatch",
              shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("GATEWATCH_MASTER")
    parts = shuffle_partitions or int(os.environ.get("GATEWATCH_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GATEWATCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    # spark-submit hands its master to the JVM as a system property; only a
    # plain Python start without one runs locally
    if master or ("PYSPARK_GATEWAY_PORT" not in os.environ and "SPARK_MASTER" not in os.environ
                  and SparkSession.getActiveSession() is None):
        builder = builder.master(master or "local[8]")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, streaming state and landed tables.

    Reads ``spark.checkpoint.dir`` from the session. A scratch folder is made
    only where it is unset and the master is local (local runs and tests): on
    a cluster a folder of one machine is not shared, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gatewatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where an expensive frame (features, model scores) feeds several
    jobs (counts, quantile sampling, joins): it is computed once, the lineage
    is cut, and a lost executor does not force recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{name}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Send the gatewatch package to the executors' Python workers once per
    session, so Arrow UDFs and grouped-map functions import it wherever the
    job was launched from. The zip is built in memory and written to the
    shared folder through the Hadoop FileSystem API (works for local, HDFS or
    object-store URIs), then added with ``addPyFile``."""
    import hashlib
    import io
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    files = []
    for root, _, names in os.walk(pkg_dir):
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(root, n))
    h = hashlib.sha1()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(files):
            with open(f, "rb") as fh:
                data = fh.read()
            h.update(f.encode() + data)
            z.writestr(os.path.join("gatewatch", os.path.relpath(f, pkg_dir)), data)
    target = f"{checkpoint_dir(spark)}/pkg/gatewatch-{h.hexdigest()[:12]}.zip"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        tmp = jvm.org.apache.hadoop.fs.Path(target + f".{uuid.uuid4().hex[:6]}.part")
        out = fs.create(tmp, True)
        out.write(bytearray(buf.getvalue()))
        out.close()
        if not fs.rename(tmp, path) and not fs.exists(path):
            raise OSError(f"could not publish {target}")
    sc.addPyFile(target)
    _SHIPPED.add(key)


def plan_bytes(df) -> int | None:
    """The optimizer's size estimate of ``df`` (no job runs); None if unknown."""
    try:
        v = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return v if isinstance(v, int) else int(v.toString())  # py4j may already convert BigInt
    except Exception:  # noqa: BLE001 - no statistics
        return None


def partition_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number (it may say 256m)."""
    return max(1, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        str(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m"))))


def range_partitions(df) -> int:
    """Partitions for an explicit range repartition (AQE does not coalesce
    those): the optimizer's size estimate / maxPartitionBytes, and at least the
    smaller of the shuffle setting and the cluster's parallelism, so small
    inputs stay small and large ones are not held to the setting. Uses plan statistics only: asking ``df.rdd``
    for its partitions would run the upstream shuffle stages under AQE."""
    spark = df.sparkSession
    conf = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    if size is None or size >= 1 << 62:  # no estimate (a frame over an RDD): the setting
        return conf
    return max(min(conf, spark.sparkContext.defaultParallelism), -(-size // partition_bytes(spark)), 1)
