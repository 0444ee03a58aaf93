"""Line dedup by content-defined chunks of lines.

Only lines with a word count; blank ones are neither hashed nor compared. A
hash rolls over the hashes of WINDOW neighbouring lines. Wherever a stretch of
lines holds more than PASSAGE_WORDS words (and WINDOW lines), the place of its
smallest rolling hash is a boundary: the stretch alone decides, so boundaries
shift along with the text, and every passage of that size has the same ones
wherever it stands. At each boundary a chunk of WINDOW lines begins. A chunk
that occurs again anywhere is compared byte by byte with its first occurrence
(smallest id, then text digest, then line), then extended to both sides, line
by line, as long as the lines there are the same bytes. A copy's neighbours
further out than PASSAGE_WORDS words have a chunk of their own, so extending
that far joins the chunks of a passage without a gap.

The matched lines of every later copy go, with blank lines between them. The
lines of a first occurrence that others are compared with stay (unless both
lie inside one match with an earlier place), so no chunk is torn apart in the
place where it is kept. So every later copy of a
passage of WINDOW lines and more than PASSAGE_WORDS words goes whole, but for
such lines; of a shorter one, if its boundary falls alike. A line that repeats
without its neighbours stays, and the text of a removed line always stays at
an earlier place.

Steps: one pass emits (chunk hash, document, line); a map-side-combined
aggregate finds repeated hashes and each one's first occurrence; the lines of
those only, and the few around them, are read from the documents that hold
them and compared by a join that AQE splits when a chunk is in very many
documents; a document's removed lines become runs and are joined back to it.

Null texts stay null, empty ones empty; both have no chunk. Rows equal in id
and text are one document and are treated alike. Extra columns pass through;
internal ones begin ``__ld_``.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import broadcast_if_small, materialize, prepare

WINDOW = 2
PASSAGE_WORDS = 16
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def worded_lines(text: str | None) -> tuple[list[int], list[bytes], list[int]]:
    """Number, bytes and word count of the lines that have a word."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n") if text else []
    n = [len(x.split()) for x in lines]
    at = [k for k, m in enumerate(n) if m]
    return at, [lines[k] for k in at], [n[k] for k in at]


def rolling(lines: list[bytes]) -> list[int]:
    """The hash of every WINDOW neighbouring lines, rolled over line hashes."""
    each = [zlib.crc32(x) + 1 for x in lines]
    top, h, out = pow(BASE, WINDOW, 1 << 64), 0, []
    for k, x in enumerate(each):
        h = (h * BASE + x - (each[k - WINDOW] * top if k >= WINDOW else 0)) & MASK
        if k >= WINDOW - 1:
            out.append(((h ^ (h >> 31)) * BASE & MASK) >> 16)
    return out


def boundaries(lines: list[bytes], words: list[int], passage_words: int = PASSAGE_WORDS) -> list[int]:
    """Where chunks begin: the place of the smallest rolling hash (the first
    of equals) of every shortest stretch over ``passage_words``."""
    roll, out, end, held = rolling(lines), set(), 0, 0
    for a in range(len(roll)):
        while end < len(lines) and (held <= passage_words or end < a + WINDOW):
            held += words[end]
            end += 1
        if held <= passage_words or end < a + WINDOW:
            break
        out.add(min(range(a, end - WINDOW + 1), key=roll.__getitem__))
        held -= words[a]
    return sorted(out)


def around(words: list[int], at: int, passage_words: int = PASSAGE_WORDS) -> tuple[int, int]:
    """How many lines before and after the chunk at ``at`` are within
    ``passage_words`` words of it."""
    left, held = at, 0
    while left > 0 and held + words[left - 1] <= passage_words:
        left -= 1
        held += words[left]
    end = right = at + WINDOW
    held = 0
    while right < len(words) and held + words[right] <= passage_words:
        held += words[right]
        right += 1
    return at - left, right - end


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(c, F.lit(""))))


def removals(docs: DataFrame, id_col="doc_id", text_col="text", passage_words: int = PASSAGE_WORDS, digest_bytes: int = 16) -> DataFrame:
    """(id, d, gone): documents with lines to remove; gone is an array of
    (first line, lines)."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("d"), F.col(text_col).alias("t")).where("t IS NOT NULL")

    def narrow(batches):
        for batch in batches:
            at, h, line = [], [], []
            for k, t in enumerate(batch.column(2).to_pylist()):
                place, lines, words = worded_lines(t)
                for a in boundaries(lines, words, passage_words):
                    at.append(k), line.append(place[a])
                    h.append(hashlib.blake2b(b"\n".join(lines[a:a + WINDOW]), digest_size=digest_bytes).digest())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32())], names=["h", "id", "d", "line"])

    id_type = src.schema["id"].dataType
    found = src.mapInArrow(narrow, T.StructType().add("h", "binary").add("id", id_type).add("d", "binary").add("line", "integer"))
    # two places or more: a repeated row is one document
    place = F.struct("id", "d", "line")
    first = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT first <=> last")
    first = materialize(first.select("h", "first"), "lines-repeated")

    hits = materialize(found.join(broadcast_if_small(first, 64), "h").withColumn(
        "is_first", F.struct("id", "d", "line").eqNullSafe(F.col("first"))).select("h", "id", "d", "line", "is_first").distinct(), "lines-hits")
    want = hits.groupBy(F.col("id").alias("wi"), F.col("d").alias("wd")).agg(F.collect_list(F.struct("line", "h", "is_first")).alias("want"))

    def bodies(batches):
        for batch in batches:
            at, rows = [], []
            for k, (t, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                place, lines, words = worded_lines(t)
                number = {x: a for a, x in enumerate(place)}
                for x in want:
                    a = number[x["line"]]
                    b = a + WINDOW
                    before, after = around(words, a, passage_words)
                    at.append(k)
                    rows.append({"h": x["h"], "is_first": x["is_first"], "body": b"\n".join(lines[a:b]),
                                 "before": lines[a - before:a][::-1], "after": lines[b:b + after], "place": place[a - before:b + after], "own": before})
            at, made = pa.array(at, pa.int64()), pa.RecordBatch.from_pylist(rows, made_schema)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *made.columns], names=["id", "d", *made_schema.names])

    made_schema = pa.schema([("h", pa.binary()), ("is_first", pa.bool_()), ("body", pa.binary()), ("before", pa.list_(pa.binary())),
                             ("after", pa.list_(pa.binary())), ("place", pa.list_(pa.int32())), ("own", pa.int32())])
    lists = T.ArrayType(T.BinaryType())
    held = src.join(want, F.col("id").eqNullSafe(F.col("wi")) & (F.col("d") == F.col("wd"))).select("id", "d", "t", "want")
    text = materialize(held.mapInArrow(bodies, T.StructType().add("id", id_type).add("d", "binary").add("h", "binary").add("is_first", "boolean").add("body", "binary")
                                       .add("before", lists).add("after", lists).add("place", T.ArrayType(T.IntegerType())).add("own", "integer")), "lines-chunks")
    keeper = text.where("is_first").select("h", F.struct("body", "before", "after").alias("kept")).dropDuplicates(["h"])
    # lines alike from the chunk outwards: up to the first pair that differs
    alike = lambda side: f"array_position(zip_with({side}, kept.{side}, (x, y) -> x <=> y), false)"
    reach = lambda side: F.expr(f"CAST(if({alike(side)} = 0, size({side}), {alike(side)} - 1) AS int)")
    copies = (text.where("NOT is_first").join(keeper, "h").where("body = kept.body")
              .select("id", "d", "place", F.expr("own").alias("o"), reach("before").alias("l"), reach("after").alias("r"))
              .select("id", "d", F.expr(f"slice(place, o - l + 1, l + r + {WINDOW})").alias("gone"), F.lit(None).alias("safe")))
    firsts = text.where("is_first").select("id", "d", F.lit(None).alias("gone"), F.expr(f"slice(place, own + 1, {WINDOW})").alias("safe"))
    # two neighbouring lines as one number; those inside one match need no keeping
    pairs = lambda c: F.expr(f"transform(sequence(0, size({c}) - 2), k -> {c}[k] * 4294967296L + {c}[k + 1])")
    both = copies.unionByName(firsts).select("id", "d", *[f(c) for c in ("gone", "safe") for f in (
        lambda c: F.expr(f"IF({c} IS NOT NULL, struct({c}[0] AS a, element_at({c}, -1) AS b), NULL)").alias(c),
        lambda c: F.when(F.col(c).isNotNull(), pairs(c)).alias(f"{c}_pairs"))])
    every = lambda c: F.flatten(F.collect_set(c))
    span = lambda a, b: F.sequence(a.cast("int"), b.cast("int"))
    gone = (both.groupBy("id", "d").agg(F.flatten(F.transform(F.collect_set("gone"), lambda x: span(x["a"], x["b"]))).alias("s"),
                                        F.array_except(every("safe_pairs"), every("gone_pairs")).alias("safe"))
            .select("id", "d", F.sort_array(F.array_except("s", F.flatten(F.transform("safe", lambda x: span(F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))))))).alias("s"))
            .where("size(s) > 0"))
    # neighbouring lines are one run
    return gone.select("id", "d", F.expr("""zip_with(
        filter(s, (x, k) -> k = 0 OR x - s[k - 1] > 1),
        filter(s, (x, k) -> k = size(s) - 1 OR s[k + 1] - x > 1),
        (a, b) -> named_struct('line', a, 'n', b + 1 - a))""").alias("gone"))


def drop_repeated_chunks(docs: DataFrame, id_col="doc_id", text_col="text", passage_words: int = PASSAGE_WORDS, digest_bytes: int = 16) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus ``__ld_lines``,
    ``__ld_removed_lines`` and ``__ld_removed_chunks`` (runs of removed lines)."""
    gone = materialize(removals(docs, id_col, text_col, passage_words, digest_bytes).select(F.col("id").alias("__ld_i"), F.col("d").alias("__ld_d"), F.col("gone").alias("__ld_gone")), "lines-gone")
    t = F.col(text_col)
    out = docs.withColumn("__ld_k", _digest(t)).join(
        broadcast_if_small(gone, 64, "__ld_gone", 24), F.col(id_col).eqNullSafe(F.col("__ld_i")) & (F.col("__ld_k") == F.col("__ld_d")) & t.isNotNull(), "left")
    lines = F.split(t, "\n")
    # keep what lies between the removed runs, each run bounds the next
    clean = F.expr(f"""CASE WHEN __ld_gone IS NULL THEN `{text_col}` ELSE array_join(flatten(transform(
        sequence(0, size(__ld_gone)), k -> slice(__ld_l,
            if(k = 0, 1, __ld_gone[k - 1].line + __ld_gone[k - 1].n + 1),
            if(k = size(__ld_gone), size(__ld_l), __ld_gone[k].line) - if(k = 0, 0, __ld_gone[k - 1].line + __ld_gone[k - 1].n)))), '\\n') END""")
    out = out.withColumn("__ld_l", lines)
    removed = F.coalesce(F.aggregate("__ld_gone", F.lit(0), lambda z, x: z + x["n"]), F.lit(0)).cast("long")
    return out.select(*[F.col(f"`{c}`") if c != text_col else clean.alias(c) for c in docs.columns],
                      F.coalesce(F.size("__ld_l"), F.lit(0)).cast("long").alias("__ld_lines"), removed.alias("__ld_removed_lines"),
                      F.coalesce(F.size("__ld_gone"), F.lit(0)).cast("long").alias("__ld_removed_chunks"))
