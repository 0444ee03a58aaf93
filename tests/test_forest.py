"""Isolation forest: exact scoring of a fixed forest, fitted-forest properties."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import forest as FR
from gatewatch.plans.q_model import GOLDEN, GOLDEN_PSI, _golden_pdf


def c(n):
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def ref_score(x):
    trees = {}
    for t, nid, l, r, f, th, ns in GOLDEN:
        trees.setdefault(t, {})[nid] = (l, r, f, th, ns)
    hs = []
    for t in trees.values():
        node, d = 0, 0
        while t[node][0] != -1:
            l, r, f, th, _ = t[node]
            node = l if x[f] <= th else r
            d += 1
        hs.append(d + c(t[node][4]))
    return -(2.0 ** (-(sum(hs) / len(hs)) / c(GOLDEN_PSI)))


def test_golden_forest_exact(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.uniform(0, 40, 300), "b": rng.uniform(0, 5, 300)})
    df = spark.createDataFrame(pdf)
    forest = FR.Forest(nodes=None, features=["a", "b"], max_samples=GOLDEN_PSI, n_trees=3)
    out = FR.score(df, forest, nodes_pdf=_golden_pdf()).toPandas()
    for a, b, s in zip(out["a"], out["b"], out["score"]):
        assert s == pytest.approx(ref_score([a, b]), abs=1e-12)


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(1)
    n = 3000
    X = rng.normal(size=(n, 3))
    X[:5] += 8.0  # five far outliers
    pdf = pd.DataFrame(X, columns=["x", "y", "z"]).assign(row_id=np.arange(n))
    return spark.createDataFrame(pdf)


def test_fitted_properties(spark, blob):
    f = FR.fit(blob, ["x", "y", "z"], n_trees=50, max_samples=256, seed=3)
    pdf = FR.collect_nodes(f)
    assert pdf.groupby("tree_id").size().max() <= 2 * 256
    scored = FR.score(blob, f, nodes_pdf=pdf)
    out, off = FR.threshold(scored, 0.1)
    res = out.toPandas()
    assert ((res["score"] > -1) & (res["score"] < 0)).all()
    outl = res[res["row_id"] < 5]["score"].max()
    assert outl < res[res["row_id"] >= 5]["score"].quantile(0.01)
    assert abs((res["prediction"] == -1).mean() - 0.1) < 0.01


def test_fit_partition_independent(spark, blob):
    a = FR.fit(blob, ["x", "y", "z"], n_trees=20, max_samples=128, seed=5)
    pa = FR.collect_nodes(a).sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = FR.fit(blob.repartition(13), ["x", "y", "z"], n_trees=20, max_samples=128, seed=5)
    pb = FR.collect_nodes(b).sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    pd.testing.assert_frame_equal(pa, pb)


def test_tree_samples_exact_size(spark, blob):
    v = FR.weighted_rows(blob, "row_id", ["x", "y", "z"])
    s = FR.tree_samples(v, {"": (3000, 100, 30)}, 9)
    sizes = [r["n"] for r in s.groupBy("tree_id").agg(F.sum("_w").alias("n")).collect()]
    assert len(sizes) == 30 and set(sizes) == {100}


def _drawn(pieces, need, seed, forest, tree):
    """Rows taken of every piece (v, k, rows), row by row."""
    taken, level = dict.fromkeys(((v, k) for v, k, _ in pieces), 0), 0
    rows = [(v, k) for v, k, n in pieces for _ in range(n)]
    while rows and len(rows) > need:
        draws, slot = [], {}
        for v, k in rows:
            i = slot[v, k] = slot.get((v, k), -1) + 1
            draws.append((hashlib.md5(f"{seed}:{forest}:s:{tree}:{v}:{k}:{level}".encode()).hexdigest()[i], v, k))
        cut = sorted(draws)[need - 1][0]
        for d, v, k in draws:
            taken[v, k] += d < cut
        need -= sum(d < cut for d, _, _ in draws)
        rows, level = [(v, k) for d, v, k in draws if d == cut], level + 1
    for p in rows:
        taken[p] += 1
    return taken


def test_weighted_samples_against_rows(spark):
    """Two forests, a vector of a third of all rows, vectors of one row, a tree
    that takes all rows: the counts are those of drawing row by row."""
    sizes = {"a": [70, 1, 1, 33, 32, 64, 5, 1], "b": [40, 1, 2]}
    rows = [(f, 100 * j + i, float(j)) for f, w in sizes.items() for j, n in enumerate(w) for i in range(n)]
    df = spark.createDataFrame(rows, "f string, row_id long, x double")
    prm = {"a": (207, 124, 6), "b": (43, 50, 2)}
    got = FR.tree_samples(FR.weighted_rows(df, "row_id", ["x"], "f"), prm, 5)
    got = {tuple(r[:3]): r[3] for r in got.groupBy("forest_id", "tree_id", "x").agg(F.sum("_w")).collect()}
    want = {}
    for f, (n, psi, trees) in prm.items():
        pieces = [(100 * j, k, min(32, w - 32 * k)) for j, w in enumerate(sizes[f]) for k in range((w + 31) // 32)]
        for t in range(trees):
            for (v, _), c in _drawn(pieces, min(psi, n), 5, f, t).items():
                key = (f, t, v / 100)
                want[key] = want.get(key, 0) + c
    assert got == {k: c for k, c in want.items() if c}


def test_weighted_samples_are_hypergeometric(spark):
    """Mean and variance of a vector's count over trees: p w and
    p (1 - p) w (n - w) / (n - 1)."""
    w, n, psi, trees = [500, 300, 150, 50], 1000, 600, 600
    v = spark.createDataFrame([("", float(j), 10 * j, c) for j, c in enumerate(w)], "forest_id string, x double, _v long, _w long")
    s = FR.tree_samples(v, {"": (n, psi, trees)}, 11).groupBy("tree_id").pivot("x", [0.0, 1.0, 2.0, 3.0]).agg(F.sum("_w")).toPandas()
    p = psi / n
    for j, c in enumerate(w):
        x, var = s[str(float(j))].fillna(0), p * (1 - p) * c * (n - c) / (n - 1)
        assert abs(x.mean() - p * c) < 4 * math.sqrt(var / trees)
        assert 0.75 < x.var() / var < 1.3


def test_pieces_hold_every_row_once(spark):
    """Vectors around a piece and around the first step of a hot one's cut."""
    sizes = [1, 31, 32, 33, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 3_000_001]
    v = spark.createDataFrame([("", float(j), j, w) for j, w in enumerate(sizes)], "forest_id string, x double, _v long, _w long")
    got = FR._pieces(v).groupBy("_v").agg(F.sum("_open"), F.count("_k"), F.countDistinct("_k"), F.max("_k"), F.min("_open")).collect()
    assert {tuple(r) for r in got} == {(j, w, -(-w // 32), -(-w // 32), (w - 1) // 32, (w - 1) % 32 + 1) for j, w in enumerate(sizes)}


def test_sampling_without_rows(spark):
    none = spark.createDataFrame([], "row_id long, x double")
    assert FR.tree_samples(FR.weighted_rows(none, "row_id", ["x"]), {"": (0, 0, 3)}, 1).count() == 0
    assert FR.fit(none, ["x"], n_trees=2).nodes.count() == 0


def test_hyperparams():
    assert FR.safe_hyperparams(1800) == {"max_samples": 1080, "max_features": 0.7, "n_estimators": 200}
    assert FR.safe_hyperparams(50)["n_estimators"] == 300
    assert FR.safe_hyperparams(10)["max_samples"] == 16
    assert FR.safe_hyperparams(10 ** 9)["max_samples"] == 600_000_000


def test_missing_feature_fails_open(spark):
    from pyspark.sql import functions as F
    from gatewatch.operators import forest as FR
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    f = FR.fit(df, ["a", "b"], n_trees=5, max_samples=64, n_rows=300)
    holes = df.withColumn("a", F.when(F.col("row_id") > 0, F.col("a"))).filter("row_id < 3")
    out = FR.score(holes, f).withColumn("act", FR.edge_action("score", "offset", offset=0.0))
    got = {r["row_id"]: (r["score"] is None, r["act"]) for r in out.collect()}
    assert got[0] == (True, "FAIL_OPEN") and not got[1][0] and got[1][1] == "BLOCK"


def test_explicit_sample_size_and_bound(spark, blob, monkeypatch):
    f = FR.fit(blob, ["x", "y", "z"], n_trees=2, max_samples=2500, seed=1)
    assert f.max_samples == 2500
    monkeypatch.setattr(FR, "COLLECT_BYTES", 100)
    with pytest.raises(ValueError):
        FR.collect_nodes(f)


def _table(forest):
    return forest.nodes.toPandas().sort_values(["forest_id", "tree_id", "node_id"]).reset_index(drop=True)


def test_levels_equal_local_build(spark, blob):
    """Distributed levels and one-task trees make the same nodes; a tree's
    root holds exactly psi rows and every split's children add up."""
    kw = dict(n_trees=4, max_samples=1800, max_features=0.7, seed=7)
    a = _table(FR.fit(blob, ["x", "y", "z"], **kw))
    b = _table(FR.fit(blob, ["x", "y", "z"], local_rows=300, **kw))
    pd.testing.assert_frame_equal(a, b)
    size = {(r.tree_id, r.node_id): r.n_node_samples for r in a.itertuples()}
    assert all(size[t, 1] == 1800 for t in range(4))
    for r in a.itertuples():
        if r.left > 0:
            assert size[r.tree_id, r.left] + size[r.tree_id, r.right] == r.n_node_samples
            assert min(size[r.tree_id, r.left], size[r.tree_id, r.right]) > 0
    assert a["node_id"].max() < 2 ** (math.ceil(math.log2(1800)) + 1)
    assert all(a[a["tree_id"] == t]["feature"].loc[lambda f: f >= 0].nunique() <= 2 for t in range(4))


def test_equal_rows_and_one_hot_value(spark):
    df = spark.range(900).select(F.col("id").alias("row_id"),
                                 F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("a"))
    t = _table(FR.fit(df, ["a"], n_trees=3, max_samples=600, local_rows=20))
    u = _table(FR.fit(df, ["a"], n_trees=3, max_samples=600))
    pd.testing.assert_frame_equal(t, u)
    same = FR.fit(df.withColumn("a", F.lit(1.0)), ["a"], n_trees=2, max_samples=600)
    assert _table(same)["n_node_samples"].tolist() == [600, 600]


def test_score_by_join_equals_broadcast(spark, blob, monkeypatch):
    f = FR.fit(blob, ["x", "y", "z"], n_trees=3, max_samples=64, seed=2)
    rows = blob.limit(200).withColumn("x", F.when(F.col("row_id") != 4, F.col("x")))
    a = {r["row_id"]: r["score"] for r in FR.score(rows, f).collect()}
    monkeypatch.setattr(FR, "COLLECT_BYTES", 100)
    b = {r["row_id"]: r["score"] for r in FR.score(rows, f).collect()}
    assert a.keys() == b.keys() and a[4] is None and b[4] is None
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a if k != 4)


def test_digit_counts_per_batch_equal_the_drawn_digits(spark):
    v = spark.createDataFrame([("a", 0.5, 3, 70), ("a", 1.5, 9, 1), ("b", 0.5, 4, 33)], "forest_id string, _x0 double, _v long, _w long")
    pieces = FR._pieces(v)
    trees = spark.createDataFrame([("a", 0), ("a", 2), ("b", 1)], "forest_id string, tree_id int")
    each = pieces.join(trees, "forest_id")
    drawn = each.withColumn("_u", F.substring(
        FR._md5(7, F.col("forest_id"), "s", F.col("tree_id"), F.col("_v"), F.col("_k"), 2), F.lit(1), F.col("_open")))
    cols = [f"_n{x}" for x in FR.HEX]
    want = drawn.groupBy("forest_id", "tree_id").agg(*[F.sum(FR._digits(F.lit(x))).alias(c) for x, c in zip(FR.HEX, cols)])
    want = sorted(map(tuple, want.collect()))
    schema = "forest_id string, tree_id int, " + ", ".join(f"{c} long" for c in cols)
    for rows, named in ((pieces, {"a": [0, 2], "b": [1], "c": [5]}), (each, None)):
        got = rows.mapInArrow(FR._digit_counter(7, 2, named), schema).groupBy("forest_id", "tree_id").agg(*[F.sum(c).alias(c) for c in cols])
        assert sorted(map(tuple, got.collect())) == want
    assert [sum(r[2:]) for r in want] == [71, 71, 33]


def test_walk_of_uneven_trees_in_blocks():
    """Trees of different depth, children that do not lie side by side."""
    import pandas as pd
    rows = [(0, 1, -1, -1, -2, -2.0, 7), (1, 0, 1, 4, 0, 5.0, 9), (1, 1, 2, 3, 1, 2.0, 5), (1, 2, -1, -1, -2, -2.0, 3),
            (1, 3, -1, -1, -2, -2.0, 2), (1, 4, -1, -1, -2, -2.0, 4)]
    arr = FR.pack(pd.DataFrame(rows, columns=["tree_id", "node_id", "left", "right", "feature", "threshold", "n_node_samples"]))
    assert arr["depths"].tolist() == [0, 2]
    X = np.array([[5.0, 2.0], [5.0, 2.1], [5.1, 0.0], [-1.0, 9.0]])
    c = FR.c_factor
    want = [(c(7) + h) / 2 for h in (2 + c(3), 2 + c(2), 1 + c(4), 2 + c(2))]
    for block in (1, 3, 8192):
        assert np.allclose(FR.path_lengths(arr, X, block), want, atol=1e-11)
