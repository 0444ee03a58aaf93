import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatewatch.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, h string"


def _docs(spark, n=300):
    rows = [(k, " ".join(["w"] * (1 + (k * 37) % 90)), f"s{k % 5}" if k % 3 else "s0", "x", "y") for k in range(n)]
    rows += [(1000, None, "s1", "x", "y"), (1001, "", None, "x", "y"), (1002, "a b c", None, "x", "y"), (None, "d e", "s2", "x", "y"),
             (7, rows[7][1], rows[7][2], "x", "y")]  # nulls, empties, a repeated row, clashing names
    return spark.createDataFrame(rows, SCHEMA)


def _targets(sizes):
    """The contract's rule, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)


@pytest.fixture(params=[(1 << 16, 1 << 21), (256, 700)])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", request.param[0])
    monkeypatch.setattr(M, "SHARD_WORDS", request.param[1])
    monkeypatch.setattr(M, "GROUP", 4)
    return request.param


def test_report(spark, small_blocks):
    got = M.mix_report(_docs(spark)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = _targets(dict(sizes))
    assert len(got) == 305
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-9) for r in mine)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(3, 0.02 * want[s])
    assert sorted(map(str, got)) == sorted(map(str, M.mix_report(_docs(spark)).collect()))


def test_documents_agree_with_report(spark, small_blocks):
    docs = _docs(spark)
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    want = Counter()
    for r, d in zip(sorted(M.mix_report(docs).collect(), key=lambda r: (str(r["doc_id"]), r["size"])),
                    sorted(docs.collect(), key=lambda r: (str(r["doc_id"]), len((r["text"] or "").split())))):
        if r["taken"]:
            want[(d["doc_id"], d["text"])] += r["taken"] // r["size"]
    assert got == want


def test_split_tree_is_exact(spark):
    counts = {"a": 1000, "b": 77, "c": 3, "d": 0, "e": 5000}
    df = spark.createDataFrame([(k, v) for k, v in counts.items()], "sk string, draws long")
    for shards in (1, 2, 7, 64):
        q = M.split_tree(df, shards).collect()
        total = sum(counts.values())
        for s, n in counts.items():
            assert sum(r["quota"] for r in q if r["sk"] == s) == n
        for k in range(shards):
            assert sum(r["quota"] for r in q if r["shard"] == k) == total * (k + 1) // shards - total * k // shards
        assert all(r["quota"] >= 0 for r in q)


def test_hypergeometric_matches_its_distribution(spark):
    big, kind, draw, n = 50, 20, 15, 20_000
    x = M.hypergeometric_sql(f"{big}L", f"{kind}L", f"{draw}L", "u")
    got = Counter(r[0] for r in spark.range(n).select(((F.col("id") + 0.5) / n).alias("u")).select(F.expr(x)).collect())
    for k in range(16):
        p = math.comb(kind, k) * math.comb(big - kind, draw - k) / math.comb(big, draw)
        assert abs(got.get(k, 0) / n - p) < 2e-4
    edge = spark.sql(f"SELECT {M.hypergeometric_sql('10L', '10L', '4L', '0.3D')} a, {M.hypergeometric_sql('10L', '0L', '4L', '0.3D')} b, {M.hypergeometric_sql('0L', '0L', '0L', '0.3D')} c")
    assert tuple(edge.first()) == (4, 0, 0)


def test_owners_are_disjoint_and_complete(spark, small_blocks):
    plan = M.plan_mix(M.materialize(M.narrow(_docs(spark)), "t"))
    draws = {r["sk"]: r["draws"] for r in plan.sources.collect()}
    owner = [(r["sk"], r["draw"]) for r in plan.owner.collect()]
    assert sorted(owner) == sorted((s, k) for s, n in draws.items() for k in range(n))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_report(empty).count() == 0 and M.mix_documents(empty).count() == 0
