"""WARC writing and reading with boundary-chain verification.

Writing: one WARC/1.1 record per page, written by Spark's text writer (record
separator CR LF), so archives go to any store Spark writes to, without a
shuffle beyond the one that finds equal payloads. Of pages with equal payloads
the smallest page_id is the response, the others are revisits of it.

Reading: archives are read in splits, cut at every occurrence of the magic
``WARC/1.1`` CR LF. Byte offsets are running sums of piece lengths inside a
split plus the splits before it. Each piece is a candidate record: its header
gives a Content-Length and so the offset of its successor. Which candidates
are records is decided by pointer jumping from the start of each file: the
reached set and the pointers' reach both double per round, so a file of n
records takes log2(n) rounds, whatever the payloads hold. Candidates that are
not reached are magic inside payloads; they are joined back to the record
they lie in. Only offsets and headers are shuffled in the rounds.

Null html is an empty payload; a null page_id is written empty and read back
as null, after all others in order. Repeated rows (same page_id and payload)
that are smallest are all responses. Extra columns are ignored. Empty input
gives an empty archive and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewatch.llm.common import broadcast_if_small, materialize

VERSION = "WARC/1.1"
MAGIC = VERSION + "\r\n"
DATE = "2026-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0
#: Bounds the rounds of the reader (log2 of it) and the size of a file.
RECORDS_PER_FILE = 2048
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed: RFC 4648


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 (160 bits: 32 letters, no padding)."""
    hexa = F.sha1(data)
    letters = []
    for k in range(4):
        v = F.conv(F.substring(hexa, 10 * k + 1, 10), 16, 10).cast("long")
        for s in range(35, -1, -5):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*letters)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One ``value`` (a record without its last CR LF) per page."""
    body = F.coalesce(F.col("html"), F.lit(""))
    one = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("body"),
                       F.octet_length(body).alias("bytes"), sha1_base32(body.cast("binary")).alias("digest"))
    first = (pages.select("page_id", F.octet_length(body).alias("bytes"), sha1_base32(body.cast("binary")).alias("_d"))
             .where(F.col("bytes") >= min_bytes).groupBy("_d").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("_d", "_first"))
    first = broadcast_if_small(materialize(first, "warc-repeated"), 64)  # else pages are shuffled by digest
    one = one.join(first, (F.col("digest") == F.col("_d")) & (F.col("bytes") >= min_bytes), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace("url", "[\\r\\n]", " ")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))), line("WARC-Target-URI", url), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("_first"))),
                                 line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"))
    return one.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")), F.lit("\r\n")).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    (records(pages, min_bytes).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .mode("overwrite").text(path))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, k, piece): the files cut before every magic, ``k`` in
    order inside a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("k"), F.col("value").alias("piece"))


def with_offsets(stored: DataFrame) -> DataFrame:
    """Adds ``off``, the byte offset of the magic before each piece, to rows
    with file, split, k and len: lengths so far in the split, plus the splits
    before it. What lies before a file's first magic is no record."""
    n = len(MAGIC)
    inside = Window.partitionBy("file", "split").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored.groupBy("file", "split").agg(F.sum(F.col("len") + n).alias("sum"))
    splits = splits.select("file", "split", F.coalesce(F.sum("sum").over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (stored.withColumn("within", F.coalesce(F.sum(F.col("len") + n).over(inside), F.lit(0)))
            .join(splits, ["file", "split"]).withColumn("off", F.col("base") + F.col("within") - n)
            .where("off >= 0").drop("base", "within"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece: file, off, header fields, ``to`` (the successor's
    offset by Content-Length) and the payload's digest when the whole payload
    lies in the piece."""
    p = pieces(spark, path)
    field = lambda name: F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), f"\r\n{name}: ([^\r\n]*)", 1)
    rows = p.select("file", "split", "k", F.octet_length("piece").cast("long").alias("len"),
                    F.substring_index("piece", "\r\n\r\n", 1).alias("head"), F.col("piece").cast("binary").alias("raw"))
    rows = rows.select("*", F.octet_length("head").cast("long").alias("hlen"), field("Content-Length").alias("c"))
    rows = rows.withColumn("clen", F.expr("try_cast(nullif(c, '') as bigint)"))
    whole = (F.col("clen") >= 0) & (F.col("hlen") + 4 + F.col("clen") + 4 <= F.col("len"))
    rows = rows.select(
        "file", "split", "k", "len", "hlen", "clen", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"),
        field("WARC-Refers-To").alias("ref"), field("WARC-Payload-Digest").alias("stated"),
        F.when(whole, sha1_base32(F.substring(F.col("raw"), F.col("hlen").cast("int") + 5, F.col("clen").cast("int")))).alias("digest"))
    placed = with_offsets(materialize(rows, "warc-pieces"))
    to = F.col("off") + len(MAGIC) + F.col("hlen") + 4 + F.col("clen") + 4
    return placed.select("file", "off", "hlen", "clen", "type", "id", "ref", "stated", "digest", F.when(F.col("clen") >= 0, to).alias("to"))


def reachable(cands: DataFrame) -> DataFrame:
    """(file, off) of the records reached from offset 0, by pointer jumping."""
    edges = materialize(cands.select("file", "off", "to", (F.col("off") == 0).alias("hit")), "warc-chain")
    while True:
        reached = edges.where("hit").select(F.col("file").alias("_f"), F.col("to").alias("_o"), F.lit(True).alias("_hit")).where("_o IS NOT NULL")
        ahead = edges.select(F.col("file").alias("_g"), F.col("off").alias("_p"), F.col("to").alias("_to"))
        new = (edges.join(reached, (F.col("file") == F.col("_f")) & (F.col("off") == F.col("_o")), "left")
               .join(ahead, (F.col("file") == F.col("_g")) & (F.col("to") == F.col("_p")), "left")
               .select("file", "off", F.col("_to").alias("to"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
        edges = materialize(new, "warc-chain")
        if edges.where("hit AND to IS NOT NULL").isEmpty():
            return edges.where("hit").select("file", "off")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: file, off, type, id, ref, stated digest,
    payload_bytes and payload_digest as read."""
    cands = materialize(candidates(spark, path), "warc-candidates")
    hits = reachable(cands).select(F.col("file").alias("_f"), F.col("off").alias("_o"))
    recs = materialize(cands.join(hits, (F.col("file") == F.col("_f")) & (F.col("off") == F.col("_o"))).drop("_f", "_o"), "warc-records")
    done = recs.where("digest IS NOT NULL")
    cut = recs.where("digest IS NULL")  # payload holds the magic: join its pieces
    span = materialize(cut.select("file", F.col("off").alias("rec"), "hlen", "clen"), "warc-cut")
    # pieces of the files that hold a cut record; a file is bounded by its record count
    last = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = pieces(spark, path).join(span.select("file").distinct(), "file", "left_semi")
    text = with_offsets(text.withColumn("len", F.octet_length("piece").cast("long")))
    text = (text.join(hits, (F.col("file") == F.col("_f")) & (F.col("off") == F.col("_o")), "left")
            .withColumn("rec", F.last(F.when(F.col("_o").isNotNull(), F.col("off")), True).over(last)))
    joined = text.join(span, ["file", "rec"]).groupBy("file", "rec", "hlen", "clen").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("off", "piece"))), lambda x: x["piece"]), MAGIC).alias("all"))
    body = joined.select("file", F.col("rec").alias("off"), sha1_base32(F.substring(
        F.col("all").cast("binary"), F.col("hlen").cast("int") + 5, F.col("clen").cast("int"))).alias("digest"))
    mended = cut.drop("digest").join(body, ["file", "off"], "left")
    out = done.unionByName(mended)
    return out.select("file", "off", "type", "id", "ref", F.substring("stated", 6, 32).alias("stated"),
                      F.col("clen").alias("payload_bytes"), F.col("digest").alias("payload_digest"))


def page_of(record: Column) -> Column:
    return F.nullif(F.regexp_extract(record, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page: the full payload's size and digest (a revisit's from the
    response it refers to), type and refers_to."""
    recs = read_warc(spark, path)
    rows = recs.select(page_of(F.col("id")).alias("page_id"), "type", page_of(F.col("ref")).alias("refers_to"), "stated", "payload_bytes", "payload_digest")
    seen = rows.where("type = 'response'").groupBy(F.col("payload_digest").alias("_d")).agg(F.max("payload_bytes").alias("_n"))
    rows = rows.join(seen, (F.col("type") == "revisit") & (F.col("stated") == F.col("_d")), "left")
    return rows.select("page_id", F.coalesce(F.when(F.col("type") == "revisit", F.col("_n")), F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       F.when(F.col("type") == "revisit", F.col("stated")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                       F.col("type").alias("record_type"), "refers_to")
