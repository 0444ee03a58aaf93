"""Cycles, repeated nodes, clashing names, empty and null tables."""
import pytest

import corpus_pipeline
from gatewatch.llm import chat as C
from gatewatch.llm import minhash as M
from gatewatch.llm import sharding as S

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_cycles_and_repeated_nodes(spark):
    rows = [(1, 1, None, "user", "a", 1.0), (1, 2, 1, "assistant", "b", 1.0), (1, 3, 2, "user", "c", 1.0), (1, 3, 2, "user", "c", 1.0), (1, 3, 9, "x", "z", 1.0),
            (2, 1, 1, "user", "self", 0.0), (2, 2, 1, "user", "below a cycle", 0.0),
            (3, 1, 2, "user", "p", 0.0), (3, 2, 1, "user", "q", 0.0), (3, 3, 7, "user", "root, parent missing", 0.0), (3, 4, 3, "assistant", None, None),
            (4, 1, None, "user", "alone", 0.0), (5, None, None, "user", "no node", 0.0)]
    rows += [(6, k, k - 1 if k else None, "user", str(k), 0.0) for k in range(40)]
    got = {(r["tree"], r["leaf"]): [t["text"] for t in r["turns"]] for r in C.read_back(C.format_trees(
        spark.createDataFrame([(t, n, p, r, x or "", s) for t, n, p, r, x, s in rows], MESSAGES))).collect()}
    assert got == {(1, 3): ["a", "b", "c"], (3, 4): ["root, parent missing", ""], (4, 1): ["alone"], (6, 39): [str(k) for k in range(40)]}
    assert C.format_trees(spark.createDataFrame([], MESSAGES)).count() == 0
    only = spark.createDataFrame([r for r in rows if r[0] == 2], MESSAGES)
    assert C.format_trees(only).count() == 0


def test_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, 7, 8, "own"), (2, text, 7, 8, "own"), (3, "other words here", 7, 8, "own"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d long, _n long, shard string")
    kept = M.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    out = S.assign_shards(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_d", "_n", "shard", "shard_bytes", "shard_docs"])
    assert all(r["shard"].startswith("s") for r in out.collect()) and out.where("shard = 'own'").count() == 0


@pytest.mark.parametrize("n", [0, 6])
def test_pipeline_stages_on_hard_tables(spark, tmp_path, n):
    """Every stage on an empty table, and on nulls, repeats and extra columns."""
    rows = [(1, "fine words " * 30, "en", "a", 1, "x"), (1, "fine words " * 30, "en", "a", 1, "x"), (2, None, None, None, None, None), (None, "", "en", None, 0, "x"),
            (3, "z" * 50_000, "en", "b", 50_000, "x"), (4, "short", "en", "b", 5, "x")][:n]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)][:n], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some benchmark words")][:n], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:5] == corpus_pipeline.COLUMNS and (docs.count() > 0) == (n > 0)
