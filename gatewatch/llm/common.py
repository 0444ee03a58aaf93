"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.session import checkpoint_dir, materialize, ship_package  # noqa: F401

#: Arrow batches sent to Python are bounded by bytes, not only by rows, so a
#: run of very long texts does not pile up in one worker.
ARROW_BATCH_BYTES = "4m"

#: White space of the word contracts: space and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
NON_SPACE = "[^\\x20\\x09-\\x0D]+"

#: Bytes of a token: digits, letters (lower-cased) and all non-ASCII bytes;
#: every other byte is a separator.
TOKEN_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256))


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for the tasks, and the Arrow batch bound."""
    checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased word tokens of one text as UTF-8 bytes (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(TOKEN_BYTES).split() if text else []


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def key_of(col: Column) -> Column:
    """A nullable value as a non-null join key."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), col.cast("string")))


#: Rows times bytes up to which a table may be broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, array: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Hint a broadcast only after counting the rows of a stored or cheap
    table (and the items of its ``array`` column, if it has one); beyond the
    bound the join shuffles, with the same result."""
    items = F.coalesce(F.sum(F.size(array)), F.lit(0)) if array else F.lit(0)
    n, held = df.agg(F.count(F.lit(1)), items).first()
    return F.broadcast(df) if n * (row_bytes + 32) + held * item_bytes <= BROADCAST_BYTES else df
