"""Registered queries of the training-data operators and their SQL.

``QUERIES`` maps a name to (builder, DuckDB SQL or None). A query applies its
operator to whole tables and derives the columns of its contract.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm import (
    chat,
    decontam,
    langid,
    line_dedup,
    minhash,
    mixing,
    ngram_join,
    periodic,
    quality,
    sharding,
    toxicity,
    variants,
    warc,
)
from gatewatch.llm.common import NON_SPACE, materialize, source_table
from gatewatch.session import scratch_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks removed from all documents."""
    out = line_dedup.drop_repeated_chunks(source_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_removed_lines").alias("removed_lines"),
                      F.col("__ld_removed_chunks").alias("removed_chunks"), F.col("text").alias("clean_text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, trained on all documents."""
    return langid.identify(source_table(spark, sf_dir, "pages"), source_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    blocks = decontam.test_blocks(source_table(spark, sf_dir, "benchmark"))
    found = decontam.scan(source_table(spark, sf_dir, "documents"), blocks, keep=["doc_id"])
    return found.select("doc_id", *[F.col(f"__dc_{c}").alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


OP3_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM items WHERE len(ws) > 0)),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
hits AS (SELECT rid, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid)
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets."""
    return mixing.mix_report(source_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted and read back."""
    extra = spark.sql("""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    rows = source_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = materialize(chat.format_trees(chat.chain(rows), unique=True), "chat-formatted")
    back = chat.read_back(made)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_length(c: str) -> str:
    return f"2 * length({c}) - length(translate({c}, '\\<[]', ''))"


OP5_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum({len(chat.OPEN) + 2 + len(chat.CLOSE)} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(source_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.hex("class_key")).alias("class_key"), "class_id", "class_size", F.col("texts").alias("class_texts"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path = scratch_path(spark, "warc/pages")
    warc.write_warc(source_table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def _base32_sql(hexa: str) -> str:
    return " || ".join(f"substr('{warc.BASE32}', CAST((((CAST('0x' || substr({hexa}, {10 * k + 1}, 10) AS BIGINT)) >> {s}) & 31) + 1 AS INTEGER), 1)"
                       for k in range(4) for s in range(35, -1, -5))


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_base32_sql('h')} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.assign_shards(source_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


OP8_SQL = f"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
d AS (SELECT rid, doc_id, bytes, k AS depth, h >> CAST({sharding.HASH_BITS} - k AS BIGINT) AS p FROM r, range(0, {sharding.HASH_BITS} + 1) AS t(k)),
b AS (SELECT depth, p, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM d GROUP BY depth, p),
f AS (SELECT rid, doc_id, depth, p, shard_bytes, shard_docs, row_number() OVER (PARTITION BY rid ORDER BY depth) AS o
      FROM d JOIN b USING (depth, p) WHERE shard_bytes <= {sharding.MAX_SHARD_BYTES} OR shard_docs = 1 OR depth = {sharding.HASH_BITS})
SELECT doc_id, CASE WHEN depth = 0 THEN 's' ELSE 's' || lpad(bin(p), CAST(depth AS INTEGER), '0') END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs
FROM f WHERE o = 1
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents."""
    return quality.quality(source_table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
x AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM x) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(ws, 'string_agg', '')) AS BIGINT) AS wc,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in quality.STOP_WORDS)}))) AS n_stop,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
             len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shout_words,
             len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_ellipsis_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
n AS (SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({quality.compiled_sql()}) AS kept FROM n
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = source_table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, source_table(spark, sf_dir, "labels"))
    s = F.col("__tox_score")
    return toxicity.score(docs, machine, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Texts of the contract: where crc32(doc_id) divides by ten, the words from
    a on repeat the p words from a on. A null doc_id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("(" + NON_SPACE + ")"), F.lit(1)))
    d = docs.withColumn("__h", h).withColumn("__w", words)
    n, g = F.size("__w"), F.floor(F.col("__h") / 10)
    d = d.withColumn("__a", F.when(n > 0, g % n).cast("int"))
    d = d.withColumn("__p", (1 + F.floor((n - F.col("__a")) / (3 + g % 8))).cast("int"))
    left = n - F.col("__a")
    part = F.slice("__w", F.col("__a") + 1, F.col("__p"))
    tail = F.slice(F.flatten(F.array_repeat(part, F.ceil(left / F.col("__p")).cast("int"))), F.lit(1), left)
    made = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), tail), " ")
    return d.withColumn("text", F.coalesce(F.when(F.col("__a").isNotNull(), made), F.col("text"))).drop("__h", "__w", "__a", "__p")


def _crc_table() -> list[int]:
    """CRC-32 of every byte (reflected polynomial EDB88320), by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text of code points under 256."""
    points = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    step = f"xor(s >> 8, ({_crc_table()}::BIGINT[])[CAST(xor(s, CAST(b AS BIGINT)) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce(list_transform({points}, lambda x: CAST(x AS BIGINT)), lambda s, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.find_runs(with_periodic_tails(docs)).select("doc_id", *periodic.digest_columns())


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             coalesce({_crc32_sql("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
e AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS g8 FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g8) AS p FROM e),
t AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM p),
w AS (SELECT rid, i, ws[i + 1] AS w FROM (SELECT rid, ws, unnest(range(0, n)) AS i FROM t)),
-- stretches of words that come four times in the text, then in the stretch
f1 AS (SELECT rid, i, w, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS s FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM w) WHERE c >= 4),
f2 AS (SELECT rid, s, i, w, i - row_number() OVER (PARTITION BY rid, s ORDER BY i) AS s2 FROM (SELECT *, count(*) OVER (PARTITION BY rid, s, w) AS c FROM f1) WHERE c >= 4),
f3 AS (SELECT rid, s, s2, i, w, count(*) OVER (PARTITION BY rid, s, s2) AS m FROM f2),
eq AS (SELECT x.rid, x.i, y.i - x.i AS q FROM f3 x JOIN f3 y ON x.rid = y.rid AND x.s = y.s AND x.s2 = y.s2 AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.m WHERE x.m >= 6),
isl AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM eq) GROUP BY rid, q, k),
runs AS (SELECT rid, start, length, min(q) AS period FROM isl WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length),
top AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS o FROM runs),
said AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS s FROM w ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(said.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM t LEFT JOIN said USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN (SELECT * FROM top WHERE o = 1) USING (rid)
"""


def one_deleted(key: str, word: str) -> str:
    """The contract's spelling of a lower-cased run: in one of 199 cases a code
    point is missing."""
    h = zlib.crc32(f"{key}:{word}".encode("utf-8", "surrogatepass"))
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    words = variants.count_words(source_table(spark, sf_dir, "documents"), spelled=one_deleted)
    return variants.group_variants(words)


OP12_SQL = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
c AS (SELECT w, n, length(w) AS m, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w)),
s AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % m) || substr(w, h % m + 2) ELSE w END AS word FROM c),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
del AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
one AS (SELECT DISTINCT del.word AS x, v.word AS y FROM del JOIN v ON del.d = v.word),
near AS (SELECT x, y FROM one UNION SELECT y, x FROM one UNION SELECT a.word, b.word FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word),
best AS (SELECT x, y, ny, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY ny DESC, encode(y)) AS o
         FROM (SELECT near.*, v.n AS ny FROM near JOIN v ON near.y = v.word)),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN ny >= 5 * n THEN y END AS form, CASE WHEN ny >= 5 * n THEN ny END AS form_n
      FROM v LEFT JOIN (SELECT * FROM best WHERE o = 1) ON x = word),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f z ON z.word = up.root AND z.form IS NULL
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share their four-word shingles."""
    out = ngram_join.link_documents(source_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
k AS (SELECT rid, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS key FROM s GROUP BY rid),
u AS (SELECT key, min(rid) AS rid, any_value(n) AS n FROM k GROUP BY key),
su AS (SELECT s.rid, g, n FROM s JOIN u USING (rid)),
l AS (SELECT x.rid AS x, y.rid AS y FROM su x JOIN su y ON x.g = y.g AND x.rid < y.rid AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
      GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT rid AS x, rid AS y FROM u UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
lows AS (SELECT key, min(doc_id) AS low FROM k JOIN d USING (rid) GROUP BY key),
comp AS (SELECT ux.key, min(lows.low) AS component_id FROM reach JOIN u ux ON ux.rid = reach.x JOIN u uy ON uy.rid = reach.y JOIN lows ON lows.key = uy.key GROUP BY ux.key)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, CASE WHEN k.n IS NULL THEN d.doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN k USING (rid) LEFT JOIN comp USING (key)
"""


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, None),
    "op2_language_id": (op2_language_id, None),
    "op3_decontamination": (op3_decontamination, OP3_SQL),
    "op4_mixing": (op4_mixing, None),
    "op5_chat_format": (op5_chat_format, OP5_SQL),
    "op6_near_dedup": (op6_near_dedup, None),
    "op7_warc": (op7_warc, OP7_SQL),
    "op8_sharding": (op8_sharding, OP8_SQL),
    "op9_quality_rules": (op9_quality_rules, OP9_SQL),
    "op10_toxicity": (op10_toxicity, None),
    "op11_periodic_runs": (op11_periodic_runs, OP11_SQL),
    "op12_spelling_variants": (op12_spelling_variants, OP12_SQL),
    "op13_ngram_join": (op13_ngram_join, OP13_SQL),
}
