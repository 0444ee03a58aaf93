"""Sharding by extendible hashing.

A row's bucket is a prefix of its hash. Buckets whose rows exceed the byte
limit split on one more bit, others stay, until every bucket fits. The
directory maps fixed-length hash prefixes (cells) to buckets, as several
cells may point to one bucket. It is built from a map-side-combined
aggregate of bytes per cell: the first pass looks at as many bits as the
total suggests, later passes only at cells still too large, four bits more
each time. Only the directory, about as many rows as shards times a small
factor, is joined back; AQE broadcasts it when it is measured to be small.

A bucket of one row, or of rows that agree in all 60 hash bits (equal id and
text), cannot split and may exceed the limit; ``shard_bytes`` shows it. Null
texts have zero bytes; a null id hashes like an empty one. Input columns are
all kept, internal ones carry a ``__shard`` prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.common import materialize

HASH_BITS = 60
STEP_BITS = 4
#: Byte limit of a shard. Small enough that the test tables fill many shards.
MAX_SHARD_BYTES = 1 << 20


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 over id and text, as a non-negative long."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def cell(h: Column, bits: int) -> Column:
    return F.shiftright(h, HASH_BITS - bits)


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """[(bits, cells)] from rows (h, bytes). cells: ``cell`` of that many bits,
    the ``depth`` of its bucket, the bucket's ``bytes`` and ``docs``."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    base, bits = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + 2))
    out, rest = [], sizes
    while True:
        shift = HASH_BITS - bits
        cells = rest.groupBy(F.shiftright("h", shift).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        depths = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth"))
        prefix = F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")
        sums = depths.groupBy("depth", prefix).agg(F.sum("bytes").alias("b"), F.sum("docs").alias("n"))
        fits = (F.col("b") <= limit) | (F.col("n") == 1)
        if bits == HASH_BITS:
            fits = fits | (F.col("depth") == bits)
        leaves = (depths.select("cell", "depth", prefix).join(sums, ["depth", "prefix"])
                  .groupBy("cell").agg(F.min(F.when(fits, F.struct("depth", "b", "n"))).alias("leaf")))
        leaves = materialize(leaves, "shard-directory")
        out.append((bits, leaves.where("leaf IS NOT NULL").select(
            "cell", F.col("leaf.depth").alias("depth"), F.col("leaf.b").alias("bytes"), F.col("leaf.n").alias("docs"))))
        wide = leaves.where("leaf IS NULL").select("cell")
        if bits == HASH_BITS or wide.isEmpty():
            return out
        rest = rest.withColumn("cell", F.shiftright("h", shift)).join(wide, "cell", "left_semi").drop("cell")
        base, bits = bits, min(HASH_BITS, bits + STEP_BITS)


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  limit: int = MAX_SHARD_BYTES) -> DataFrame:
    """All columns of ``df`` plus ``shard`` ('s' and the bits of its prefix),
    ``shard_bytes`` and ``shard_docs``; columns of ``df`` with these names are
    replaced. Names that begin ``__shard_`` are taken."""
    h = hash_of(F.col(id_col), F.col(text_col))
    sizes = materialize(df.select(h.alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")),
                        "shard-sizes")
    out = df.withColumn("__shard_h", h)
    found = []
    for k, (bits, cells) in enumerate(directory(sizes, limit)):
        entry = f"__shard_{k}"
        cells = cells.select(F.col("cell").alias(f"__shard_c{k}"), F.struct("depth", "bytes", "docs").alias(entry))
        out = out.join(cells, cell(F.col("__shard_h"), bits) == F.col(f"__shard_c{k}"), "left")
        found.append(entry)
    leaf = F.coalesce(*[F.col(x) for x in found])
    depth = leaf["depth"]
    bits = F.expr(f"shiftright(__shard_h, {HASH_BITS} - coalesce({', '.join(found)}).depth)")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "shard_bytes", "shard_docs")],
        F.when(depth == 0, F.lit("s")).otherwise(F.concat(F.lit("s"), F.lpad(F.bin(bits), depth, "0"))).alias("shard"),
        leaf["bytes"].alias("shard_bytes"), leaf["docs"].alias("shard_docs"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in one task, bounded by the
    byte limit."""
    assigned.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
