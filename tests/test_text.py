"""Text features against golden values and a plain-Python reference."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import text as X

GOLDEN_ENTROPY = {
    "/profile": 3.0, "/favicon.ico": 3.084963, "/api/users": 2.921928, "/": 0.0,
    "/api/v1/users": 3.180833, "/checkout": 2.947703, "/products/1": 3.277613, "/products/3": 3.277613,
    "id=1' UNION SELECT username,password FROM users--": 4.661056,
    "id=1' AND 1=CONVERT(int,@@version)--": 4.648956,
}


def py_entropy(s):
    if not s:
        return 0.0
    n = len(s)
    return -sum((c / n) * math.log2(c / n) for c in Counter(s).values())


def py_class_entropy(s):
    if not s:
        return 0.0
    n = len(s)
    cls = [sum(c.isalpha() for c in s), sum(c.isdigit() for c in s),
           sum(1 for c in s if not c.isalnum() and c not in (" ", "\t")), sum(c in (" ", "\t") for c in s)]
    ps = [v / n for v in cls if v > 0]
    return -sum(p * math.log2(p) for p in ps) if ps else 0.0


def test_golden_entropy(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN_ENTROPY], "s string")
    got = {r["s"]: r["h"] for r in df.select("s", F.round(X.shannon_entropy("s"), 6).alias("h")).collect()}
    assert got == GOLDEN_ENTROPY


def test_entropy_edge_cases(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("aaaa",), ("ééab",), ("日本日本語",)], "s string")
    rows = df.select("s", X.shannon_entropy("s").alias("h")).collect()
    for r in rows:
        assert r["h"] == pytest.approx(py_entropy(r["s"] or ""), abs=1e-12)
        assert math.copysign(1.0, r["h"]) == 1.0  # never -0.0


def test_entropy_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = d.select("text", X.shannon_entropy("text").alias("h"), X.class_entropy("text").alias("c")).collect()
    for r in got:
        assert r["h"] == pytest.approx(py_entropy(r["text"] or ""), abs=1e-9)
        assert r["c"] == pytest.approx(py_class_entropy(r["text"] or ""), abs=1e-9)


def test_rule_code_entropy(spark):
    df = spark.createDataFrame([(c,) for c in [0, 1, 2, 999, 9001, -5]], "c long")
    for r in df.select("c", X.rule_code_entropy("c").alias("h")).collect():
        assert r["h"] == pytest.approx(py_entropy(bin(r["c"])), abs=1e-12)


def test_classifier_goldens(spark):
    rows = [("/", "id=1' UNION SELECT username,password FROM users--", "SQL Injection"),
            ("/", "id=1' AND 1=CONVERT(int,@@version)--", "Encoded Payload Attack"),
            ("/", "", "GeoBlock / Rule Anomaly"),
            ("/", "q=<svg onload=alert(1)>", "XSS Attempt"),
            ("/admin/login", "", "Admin Access Try"),
            ("/../../etc/passwd", "", "Path Traversal")]
    df = spark.createDataFrame(rows, "uri string, args string, want string")
    out = df.select("want", X.classify_threat("uri", "args", X.shannon_entropy("args")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def test_uri_features_and_scanner(spark):
    uris = ["/index.php?id=<script>alert(1)</script>", "/a/b", "/../../etc/passwd", "/cgi-bin/x.pl", "/x?a=(1)&b=[2]"]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    out = df.select("u", X.special_char_count("u").alias("sp"), X.risk_keyword_count("u").alias("kw"),
                    X.scanner_label("u").alias("lab"), X.text_length("u").alias("n")).collect()
    import re
    pat = r'[<>{}\[\]\(\)\*&%$\!\?]'
    kws = ['script', 'select', 'union', 'drop', 'admin', 'etc/passwd', '../']
    scan = ['etc/passwd', 'bin/sh', 'script', 'union', 'select', '.pl', 'alert(', 'eval-stdin']
    for r in out:
        u = r["u"]
        assert r["sp"] == len(re.findall(pat, u))
        assert r["kw"] == sum(1 for w in kws if w in u.lower())
        assert r["lab"] == int(any(p in u.lower() for p in scan) or len(re.findall(pat, u.lower())) > 3)
        assert r["n"] == len(u)


def test_restore_args_is_partition_independent(spark):
    df = spark.range(0, 200).select(F.col("id").alias("row_id"),
                                    F.when(F.col("id") % 3 == 0, "AWS-AWSManagedRulesSQLiRuleSet")
                                    .when(F.col("id") % 3 == 1, "XSS-rule").otherwise("other").alias("rule"))
    a = sorted(df.select("row_id", X.restore_args("rule", "row_id").alias("a")).collect())
    b = sorted(df.repartition(7).select("row_id", X.restore_args("rule", "row_id").alias("a")).collect())
    assert a == b
    assert {r["a"] for r in a if r["row_id"] % 3 == 2} == {""}


def test_entropy_by_counts_equals_default(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    d = d.unionByName(spark.createDataFrame([(None,), ("",), ("a",), ("abab",), ("ééab",)], "text string"))
    bad = d.select(F.round(X.shannon_entropy("text"), 9).alias("a"),
                   F.round(X.shannon_entropy_counts("text"), 9).alias("b")).filter("a != b").count()
    assert bad == 0


def test_class_entropy_counts_every_digit(spark):
    import math
    u = "a²③४9b-"
    classes = [sum(c.isalpha() for c in u), sum(c.isdigit() for c in u), sum(not c.isalnum() and c not in " \t" for c in u)]
    want = -sum(k / len(u) * math.log2(k / len(u)) for k in classes if k)
    got = spark.createDataFrame([(u,)], "u string").select(X.class_entropy("u")).first()[0]
    assert classes == [2, 4, 1] and abs(got - want) < 1e-12


def test_batch_counts_dense_sorted_and_in_pieces(monkeypatch):
    import random

    import pyarrow as pa

    from gatewatch.functions import codepoints as CP
    rng = random.Random(11)
    texts = [None, "", "a", "aaaa", "  \t1²Ⅷ٣é", "<>" * 50] + [
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x4E00, 0x9000)])) for _ in range(rng.randrange(0, 400)))
        for _ in range(60)]
    raw = pa.array([t if t is None else t.encode() for t in texts], pa.binary())
    want = [(py_entropy(t or ""), py_class_entropy(t or "")) for t in texts]
    for chars, dense in ((1 << 20, 8), (1 << 20, 0), (100, 8), (1, 0)):
        monkeypatch.setattr(CP, "CHARS", chars)
        monkeypatch.setattr(CP, "DENSE", dense)
        got = zip(CP.entropies(raw).to_pylist(), CP.class_entropies(raw).to_pylist())
        assert [pytest.approx(w, abs=1e-9) for w in want] == list(got)
    assert len(CP.entropies(raw.slice(0, 0))) == 0 and CP.entropies(pa.array([b"\xff\xffa"], pa.binary())).to_pylist()[0] > 0


def test_a_text_is_counted_once_in_one_pass(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    ent = X.shannon_entropy("t")
    plan = df.select(ent.alias("e"), X.class_entropy("t").alias("c"), X.classify_threat("t", "t", ent).alias("k"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("entropies(cast(") - text.count("class_entropies(cast(") == 1
    assert "lambda" not in text and "regexp_replace" not in text
