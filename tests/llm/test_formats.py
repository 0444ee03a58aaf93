"""Chat formatting, WARC, sharding, quality rules."""
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from gatewatch.llm import chat as C
from gatewatch.llm import quality as Q
from gatewatch.llm import queries
from gatewatch.llm import sharding as S
from gatewatch.llm import warc as W
from gatewatch.session import scratch_path

MSG = "tree long, node long, parent long, role string, text string, score double"


def test_reply_tree_paths_and_ranks(spark):
    m = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", "c", 1.0),
                               (1, 5, 4, "assistant", "</s>\\l<[x]", 0.0), (2, 1, None, "user", "solo", 0.0), (3, 7, 99, "user", "orphan", 0.0)], MSG)
    out = C.read_back(C.format_trees(m)).collect()
    got = {(r["tree"], r["rank"]): [(t["role"], t["text"]) for t in r["turns"]] for r in out}
    assert got == {(1, 1): [("user", "q"), ("assistant", "b"), ("user", "c"), ("assistant", "</s>\\l<[x]")], (1, 2): [("user", "q"), ("assistant", "a")],
                   (2, 1): [("user", "solo")], (3, 1): [("user", "orphan")]}
    assert {(r["tree"], r["rank"]): r["loss_text"] for r in out}[(1, 1)] == "b</s>\\l<[x]"
    assert {(r["tree"], r["rank"]) for r in C.format_trees(m, top=1).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert C.format_trees(m.limit(0)).count() == 0


def test_long_and_odd_conversations(spark):
    rows = [(5, k, "user" if k % 2 else "assistant", f"é{k}<s>[") for k in range(70)] + [(6, 0, None, None), (6, 1, "assistant", ""), (6, 1, "assistant", ""), (None, 0, "user", "x" * 100_000), (7, None, "a]\nb", "\\e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    got = {r["tree"]: r for r in C.read_back(C.format_trees(C.chain(df))).collect()}
    assert [(t["role"], t["text"]) for t in got[5]["turns"]] == [(r[2], r[3]) for r in rows[:70]]
    assert got[5]["loss_text"] == "".join(r[3] for r in rows[:70] if r[2] == "assistant")
    assert [(t["role"], t["text"]) for t in got[6]["turns"]] == [("", ""), ("assistant", ""), ("assistant", "")]
    assert [tuple(t) for t in got[7]["turns"]] == [("a]\nb", "\\e")] and len(got[None]["turns"][0]["text"]) == 100_000


def test_warc_round_trip_with_magic_in_payloads(spark):
    evil = "<p>WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
    rows = [(k, f"http://x/{k}", f"page {k}" * k, "c") for k in range(40)] + [(50, None, None, "c"), (51, "u\r\nWARC-Type: x", "", "c"), (60, "u", evil, "c"), (61, "u", evil, "c"),
            (62, "u", "ü" + evil * 3, "c"), (None, "u", "null id", "c"), (70, "u", "twice", "c"), (70, "u", "twice", "c"), (71, "u", "twice", "c"), (80, "u", "z" * 300_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    import base64
    first = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, i), i) if i is not None else first.get(b)
    for least in (0, 50):
        path = scratch_path(spark, "warc-test")
        W.write_warc(pages, path, least)
        want = Counter((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if i == first[b] or len(b) < least else ("revisit", first[b])))
                       for i, _, h, _ in rows for b in [(h or "").encode()])
        assert Counter(tuple(r) for r in W.read_pages(spark, path).collect()) == want
    path = scratch_path(spark, "warc-test")
    W.write_warc(pages.limit(0), path)
    assert W.read_pages(spark, path).count() == 0


def test_warc_splits_inside_files(spark):
    rows = [(k, "u", f"{k} " * 3000) for k in range(60)]
    path = scratch_path(spark, "warc-test")
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        got = {r["page_id"]: r["payload_bytes"] for r in W.read_pages(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {k: len(t) for k, _, t in rows}


def test_shards_fit_and_split_only_when_needed(spark):
    rows = [(k, "y" * (k % 97)) for k in range(500)] + [(600, None), (None, "q"), (7, "y" * 7), (601, "w" * 5000)] + [(900, "same" * 50)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bytes", F.lit(1)).withColumn("shard_h", F.lit(2))
    got = S.assign_shards(docs, limit=600).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += len(r["text"] or "")
    assert {(r["shard"], r["shard_bytes"]) for r in got} == set(sums.items())
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # prefix-free
    over = {s for s in sums if sums[s] > 600}
    assert {r["doc_id"] for r in got if r["shard"] in over} == {601, 900}
    parents = {s[:-1] for s in names if s != "s"}
    assert all(sum(n for s, n in sums.items() if s.startswith(p)) > 600 for p in parents)
    assert S.assign_shards(docs.limit(0)).count() == 0
    path = scratch_path(spark, "shards")
    S.write_shards(S.assign_shards(docs, limit=600), path)
    assert spark.read.parquet(path).count() == len(rows)


def _repeat_words(w):
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    return len({p for i, x in enumerate(g) if c[x] > 1 for p in (i, i + 1, i + 2)})


def test_quality_counts(spark):
    texts = [None, "", " \n\t ", "a b c", "a b c a b c", "x x x x", "ä#b $c\n\nä#b $c\n - x...", "one two three four " * 30, " ".join(f"w{k} the" for k in range(5000)), "a\x0bb\x0cc d　e"]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)] + [(3, "a b c", 9), (None, "a b c", 9)], "doc_id long, text string, n_words long")
    got = Q.quality(df, ["doc_id"]).collect()
    assert len(got) == len(texts) + 2
    import re
    for r in got:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else "a b c") or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), _repeat_words(w))
        failed = len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert [r["doc_id"] for r in got if r["kept"]] == [8]
    assert Q.quality(df.limit(0), ["doc_id"]).count() == 0


def test_queries_against_sql(spark):
    from gatewatch.testing import compare, duck, type_mismatches
    con = duck("/root/testdata/sf0.001")
    for name, (build, sql) in queries.QUERIES.items():
        if sql:
            df = build(spark, "/root/testdata/sf0.001")
            rel = con.sql(sql)
            assert type_mismatches(df.dtypes, rel) == [], name
            assert compare(df.toPandas(), rel.df()) == [], name
