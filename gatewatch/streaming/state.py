"""Keyed state of ``foreachBatch`` jobs: the latest row per key, kept as small
deltas by batch with a full table now and then.

A batch writes the rows that changed, not the whole state. Every ``every``
batches the deltas are merged into a full table, and what only older batches
could need is removed. A batch reads what the batches before it left and
overwrites its own folders, so a replayed batch gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the ``batch_id=N`` folders, in order; none if there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(x.split("=")[1]) for x in found if x.startswith("batch_id="))


def remove_batches(spark: SparkSession, folder: str, upto: int) -> None:
    """Remove the folders of batches up to ``upto``."""
    for i in batch_ids(spark, folder):
        if i <= upto:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id={i}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class KeyedState:
    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str, every: int = 16):
        self.spark, self.key, self.schema, self.every = spark, key, schema, every
        self.full, self.delta = f"{folder}/full", f"{folder}/delta"

    def read(self, before: int | None = None, full_before: int | None = None) -> DataFrame:
        """State after the batches with an id under ``before`` (null: all), from
        a full table under ``full_before``."""
        under = lambda ids, limit: [i for i in ids if limit is None or i < limit]
        base = under(batch_ids(self.spark, self.full), before if full_before is None else full_before)[-1:]
        newer = [i for i in under(batch_ids(self.spark, self.delta), before) if not base or i > base[0]]
        folders = [(self.full, i) for i in base] + [(self.delta, i) for i in newer]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        frames = [self.spark.read.parquet(f"{f}/batch_id={i}").withColumn("_g", F.lit(i)) for f, i in folders]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        if len(folders) == 1:
            return rows.drop("_g")
        cols = [c for c in rows.columns if c not in self.key and c != "_g"]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*cols), "_g").alias("_v")).select(*self.key, "_v.*")

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """Rows of ``changed`` (one per key) replace those of their keys."""
        changed.write.mode("overwrite").parquet(f"{self.delta}/batch_id={batch_id}")
        if batch_id % self.every == self.every - 1:
            kept = [i for i in batch_ids(self.spark, self.full) if i < batch_id][-1:]
            self.read(batch_id + 1, batch_id).write.mode("overwrite").parquet(f"{self.full}/batch_id={batch_id}")
            if kept:  # a replay of this batch still needs the full table before it
                remove_batches(self.spark, self.full, kept[0] - 1)
                remove_batches(self.spark, self.delta, kept[0])
