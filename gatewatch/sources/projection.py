"""Partition projection as a data source: the folders of a log table are
computed from the declared value ranges, never listed by the planner.

``register(spark)`` adds the format ``projected_lines``. Its options are
``path`` (the table's root, any URI that pyarrow opens), ``keys`` (partition
columns in path order, default year, month, day, hour) and, per key, either
``<key>.enum`` (``a,b,c``) or ``<key>.range`` (``lo,hi``) with ``<key>.digits``
(2 unless given). Rows are the lines of every file below the folders, with the
keys as strings; names that start with ``_`` or ``.`` are not data.

Filters on the keys (``=``, ``IN``, ``<``, ``<=``, ``>``, ``>=``) are pushed
down and cut the value lists before a folder is named; any others stay with
Spark. Tasks get FOLDERS_PER_TASK neighbouring folders each, and one more
split per ``splits`` (files dealt by a hash of their names), so a hot hour can
be spread. A task lists its own folders, reads line blocks as Arrow batches,
and holds one block at a time; a lost task reads its folders again. Absent
folders and empty files have no rows, a value outside its range is never read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
                                    LessThan, LessThanOrEqual)

from gatewatch.session import ship_package
from gatewatch.sources.waflogs import PARTITIONS, WAF_SCHEMA, projected_values

FORMAT = "projected_lines"
FOLDERS_PER_TASK = 64
BLOCK_BYTES = 4 << 20

_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
          LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class Folders(InputPartition):
    """Key values of some folders, and which share of their files to read."""

    values: list[tuple[str, ...]]
    split: int = 0


def _keys(options) -> list[str]:
    return [k.strip() for k in options.get("keys", ",".join(PARTITIONS)).split(",")]


class ProjectedReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.keys = _keys(options)
        self.splits = int(options.get("splits", "1"))
        self.values = {}
        for k in self.keys:
            listed, span = options.get(f"{k}.enum"), options.get(f"{k}.range")
            if not (listed or span):
                raise ValueError(f"declare the values of {k}: {k}.enum or {k}.range")
            self.values[k] = (projected_values("enum", listed.split(",")) if listed
                              else projected_values("integer", span.split(","), int(options.get(f"{k}.digits", "2"))))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            test, key = _TESTS.get(type(f)), getattr(f, "attribute", ("",))
            if test and len(key) == 1 and key[0] in self.values:
                self.values[key[0]] = [x for x in self.values[key[0]] if test(x, f.value)]
            else:
                yield f

    def partitions(self):
        """Folders in path order, in groups; nothing is listed here."""
        # one empty partition where the filters leave no folder: Spark needs one
        named = itertools.product(*[self.values[k] for k in self.keys])
        groups = list(iter(lambda: list(itertools.islice(named, FOLDERS_PER_TASK)), [])) or [[]]
        return [Folders(g, s) for g in groups for s in range(self.splits)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        names = ["value", *self.keys]
        system, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        for values in partition.values:
            found = system.get_file_info(fs.FileSelector("/".join([root, *values]), allow_not_found=True))
            for info in sorted(found, key=lambda x: x.path):
                if not info.is_file or info.base_name[0] in "_." or zlib.crc32(info.base_name.encode()) % self.splits != partition.split:
                    continue
                with system.open_input_stream(info.path) as stream:
                    for lines in line_blocks(stream):
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), *[pa.array([v] * n, pa.string()) for v in values]], names=names)


def line_blocks(stream, size: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The lines of a stream, block by block; bytes that are no UTF-8 are
    replaced, the line end may be missing after the last line."""
    rest = []
    while block := stream.read(size):
        cut = block.rfind(b"\n") + 1
        if not cut:
            rest.append(block)
            continue
        yield [x.rstrip(b"\r").decode("utf-8", "replace") for x in b"".join([*rest, block[:cut - 1]]).split(b"\n")]
        rest = [block[cut:]] if cut < len(block) else []
    if rest:
        yield [b"".join(rest).rstrip(b"\r").decode("utf-8", "replace")]


class ProjectedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in ("value", *_keys(self.options))])

    def reader(self, schema: T.StructType) -> ProjectedReader:
        return ProjectedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProjectedLines)


def read_projected_logs(spark: SparkSession, root: str, values: dict[str, list[str] | tuple[int, int]], digits: dict[str, int] | None = None,
                        splits: int = 1) -> DataFrame:
    """WAF logs of a projected table: WAF_SCHEMA, ``_corrupt_record`` (the text
    of a malformed line) and the keys. ``values``: per key, in path order, a
    list of values or a (lo, hi) range. Blank lines are no records. JSON is
    parsed in the JVM."""
    register(spark)
    reader = spark.read.format(FORMAT).option("keys", ",".join(values)).option("splits", splits)
    for k, v in values.items():
        reader = reader.option(f"{k}.range" if isinstance(v, tuple) else f"{k}.enum", ",".join(map(str, v))).option(f"{k}.digits", (digits or {}).get(k, 2))
    schema = T.StructType([*WAF_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = reader.load(root).where(F.length(F.trim("value")) > 0)
    whole = F.col("r._corrupt_record").isNull()  # from_json keeps what came before the fault, the file reader does not
    return lines.select(parsed.alias("r"), *values).select(*[F.when(whole, F.col(f"r.{c}")).alias(c) for c in WAF_SCHEMA.names], "r._corrupt_record", *values)
