"""Isolation forest on Spark (Liu, Ting, Zhou 2008): standardise, fit, score,
threshold.

Every random choice is an md5 of (seed, forest, what, tree, ...), so a fit is
the same under any partitioning, retry or engine.

Sample
  * equal rows are merged into one with a weight before any tree is drawn;
  * a tree takes exactly psi rows, those of smallest draw. A draw is a string
    of hex digits, and one md5 holds a digit for up to 32 equal rows, so digits
    are counted, not rows ranked: level by level, only the rows on the digit
    in which the cut falls are drawn for again;
  * a tree sees a subset of the features; rows equal in these merge further.
Build, level by level
  * one aggregate per level (rows, min and max per feature) over the nodes that
    hold more than ``LOCAL_ROWS`` distinct rows; their rows move to the child
    by a join, whose hot nodes are split by the skew join;
  * a node of at most ``LOCAL_ROWS`` is finished in one task with the same
    choices, so the parameter bounds a task's memory and changes no result;
  * the result is a stored node table (forest_id, tree_id, node_id [children
    2i, 2i+1], left, right, feature, threshold, n_node_samples).
Score
  * the nodes are counted first; up to ``COLLECT_BYTES`` they are broadcast and
    an Arrow ``pandas_udf`` walks all trees for a batch of rows, beyond it each
    level is a join of (row, tree) pairs with the node table;
  * path lengths are summed as whole numbers of 1e-12, so both ways and any
    order give the same score.
Threshold
  * offset = exact contamination-quantile of the scores (distributed),
    decision = score - offset, prediction = -1 when decision < 0.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch import constants as K
from gatewatch.operators.quantiles import quantile_scalars

NODE_SCHEMA = T.StructType([
    T.StructField("forest_id", T.StringType()),
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("left", T.LongType()),
    T.StructField("right", T.LongType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("n_node_samples", T.LongType()),
])
#: Most distinct rows of a node that one task finishes.
LOCAL_ROWS = 1 << 16
#: Digits of the features a fit sees: equal values must compare equal.
DIGITS = 9
_DRAW_BITS = 52
#: Digits of an md5, and so the rows that one md5 draws for.
HEX = "0123456789abcdef"
PIECE_ROWS = 32
_H_UNIT = 10 ** 12
#: A node's bytes on the driver, and the most that may be sent there.
NODE_BYTES = 48
COLLECT_BYTES = 256 << 20


def c_factor_np(n):
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    nb = n[big]
    out[big] = 2.0 * (np.log(nb - 1.0) + K.EULER_GAMMA) - 2.0 * (nb - 1.0) / nb
    return out


def c_factor(n: float) -> float:
    return float(c_factor_np([n])[0])


def safe_hyperparams(n_samples: int, base_trees: int = 200) -> dict:
    """Size-dependent parameters: psi = max(16, int(0.6 n)), trees =
    min(500, base + max(0, (100 - n) * 2)), 70 % of the features per tree."""
    return {"max_samples": max(16, int(n_samples * 0.6)),
            "max_features": 0.7,
            "n_estimators": min(base_trees + max(0, (100 - n_samples) * 2), 500)}


# ---------------------------------------------------------------- standardise
def standardize(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """(x - mean) / population std, a std of 0 becomes 1. One aggregate pass;
    the 2 x d statistics (and the row count) come back as the fitted scaler."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("n")).first()
    mean = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
    scale = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
    out = df.withColumns({c: (F.col(c) - F.lit(mean[i])) / F.lit(scale[i]) for i, c in enumerate(cols)})
    return out, {"features": list(cols), "mean": mean, "scale": scale, "n": int(row["n"])}


def apply_scaler(df: DataFrame, scaler: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(scaler["mean"][i])) / F.lit(scaler["scale"][i])
                           for i, c in enumerate(scaler["features"])})


# ---------------------------------------------------------------------- draws
def _md5(*parts) -> Column:
    """md5 of the parts joined by ':' (portable to other engines)."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols).cast("binary"))


def _draw(*parts) -> Column:
    return F.conv(F.substring(_md5(*parts), 1, _DRAW_BITS // 4), 16, 10).cast("long")


def _md5_py(*parts) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def tree_features(seed: int, forest: str, tree: int, d: int, k: int) -> list[bool]:
    """Which of the d features a tree sees: the k of smallest md5."""
    order = sorted(range(d), key=lambda j: _md5_py(seed, forest, "f", tree, j))
    return [j in order[:k] for j in range(d)]


# ------------------------------------------------------------------- sampling
def weighted_rows(df: DataFrame, row_id: str, xs: list[str], forest: str | None = None) -> DataFrame:
    """Equal rows of a forest as one: forest_id, ``xs``, _w rows, smallest row
    id _v. Everything a tree needs; the rows themselves are not read again."""
    fid = F.col(forest).cast("string") if forest else F.lit("")
    return (df.groupBy(fid.alias("forest_id"), *xs)
            .agg(F.min(F.col(row_id).cast("long")).alias("_v"), F.count(F.lit(1)).alias("_w")))


def _pieces(vectors: DataFrame) -> DataFrame:
    """A vector's _w rows as pieces (_k) of at most PIECE_ROWS rows (_open). A
    hot vector is cut in two steps, dealt anew between them, so that neither a
    task nor an array holds all its pieces."""
    step = PIECE_ROWS << 15
    cut = vectors.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_w") - 1) / step))).alias("_c"))
    first = F.col("_c") * (1 << 15)
    last = F.least(first + (1 << 15) - 1, F.floor((F.col("_w") - 1) / PIECE_ROWS))
    return (cut.repartition("_v", "_c").select("*", F.explode(F.sequence(first, last)).alias("_k"))
            .withColumn("_open", F.least(F.lit(PIECE_ROWS), F.col("_w") - F.col("_k") * PIECE_ROWS).cast("int"))
            .drop("_w", "_c"))


def _digits(digit: Column) -> Column:
    """How many rows of a piece drew ``digit``."""
    return F.octet_length("_u") - F.octet_length(F.replace("_u", digit, F.lit("")))


def _digit_counter(seed: int, level: int, trees: dict | None):
    """Arrow batches of pieces -> (forest_id, tree_id, digit counts) per batch.
    With ``trees`` = {forest_id: tree ids} every tree draws for every piece of
    its forest, else a piece names its tree."""
    def groups(batch):
        forest = np.array(batch.column("forest_id").to_pylist(), object)
        if trees is not None:
            for f in trees:
                at = np.flatnonzero(forest == f)
                yield from ((f, t, at) for t in (trees[f] if len(at) else ()))
            return
        tree = batch.column("tree_id").to_numpy()
        order = np.lexsort((tree, forest))
        new = np.flatnonzero((forest[order][1:] != forest[order][:-1]) | (tree[order][1:] != tree[order][:-1])) + 1
        yield from ((forest[at[0]], int(tree[at[0]]), at) for at in np.split(order, new))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [f"{v}:{k}:{level}".encode() for v, k in zip(batch.column("_v").to_pylist(), batch.column("_k").to_pylist())]
            rows = batch.column("_open").to_numpy()
            out, last = [], None
            for f, t, at in groups(batch):
                if at is not last:
                    own, last = [names[i] for i in at], at
                    open_ = np.flatnonzero((np.arange(PIECE_ROWS) < rows[at][:, None]).ravel())
                head = f"{seed}:{f}:s:{t}:".encode()
                drawn = np.frombuffer(b"".join([hashlib.md5(head + x).digest() for x in own]), np.uint8)
                digits = np.stack([drawn >> 4, drawn & 15], 1).ravel()
                out.append((f, t, np.bincount(digits[open_], minlength=len(HEX))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for f, _, _ in out], pa.string()), pa.array([t for _, t, _ in out], pa.int32()),
                     *[pa.array([int(c[x]) for _, _, c in out], pa.int64()) for x in range(len(HEX))]],
                    names=["forest_id", "tree_id", *[f"_n{x}" for x in HEX]])
    return run


def _cut(counts: list[int], need: int) -> tuple[int, int, bool]:
    """The digit in which the ``need``-th smallest row lies, how many rows of
    that digit are still needed, and whether those are all it has."""
    below = 0
    for d, c in enumerate(counts):
        if below + c >= need:
            return d, need - below, need - below == c
        below += c
    raise ValueError(f"{need} rows wanted of {below}")


def tree_samples(vectors: DataFrame, params: dict, seed: int) -> DataFrame:
    """(forest_id, tree_id, columns of ``vectors``, _w): every tree takes exactly
    min(psi, n) of its forest's n rows, each subset of rows being as likely as
    any other; _w counts the rows taken of a vector, so the counts of a tree are
    multivariate hypergeometric. ``params`` = {forest_id: (n, psi, trees)}.

    A row's draw is a string of hex digits; a tree takes the rows of smallest
    draws. One md5 gives the digit of a level for all open rows of a piece. Rows
    under the digit of the cut are taken, those over it are out, those on it
    stay open for the next level, a sixteenth of them. The cut needs 16 counts
    per tree, counted per batch of pieces and sent back. The work is pieces x trees, not rows x trees."""
    from gatewatch.operators.features import spread
    from gatewatch.session import materialize
    spark = vectors.sparkSession
    keys = ["forest_id", "tree_id"]
    need = {(k, t): min(psi, n) for k, (n, psi, trees) in params.items() for t in range(trees) if min(psi, n) > 0}
    values = [c for c in vectors.columns if c not in ("forest_id", "_v", "_w")]
    empty = vectors.limit(0).select("forest_id", F.lit(0).alias("tree_id"), *values, F.lit(0).cast("long").alias("_w"))
    if not need:
        return empty
    # one row per tree, bounded by the parameters
    trees = spark.createDataFrame(list(need), "forest_id string, tree_id int")
    pieces = spread(materialize(_pieces(vectors), "forest_pieces"))
    every: dict = {}
    for k, t in need:
        every.setdefault(k, []).append(t)
    state = pieces.join(F.broadcast(trees), "forest_id")
    schema = "forest_id string, tree_id int, " + ", ".join(f"_n{x} long" for x in HEX)
    taken, level = [], 0
    while need:
        drawn = state.withColumn("_u", F.substring(
            _md5(seed, F.col("forest_id"), "s", F.col("tree_id"), F.col("_v"), F.col("_k"), level), F.lit(1), F.col("_open")))
        counts = (state if level else pieces).select("forest_id", *(["tree_id"] if level else []), "_v", "_k", "_open")
        counted = (counts.mapInArrow(_digit_counter(seed, level, None if level else every), schema)
                   .groupBy(*keys).agg(*[F.sum(f"_n{x}").alias(f"_n{x}") for x in HEX]).collect())
        cuts, left = [], {}
        for r in counted:
            t = (r["forest_id"], r["tree_id"])
            digit, rest, whole = _cut([r[f"_n{x}"] for x in HEX], need[t])
            cuts.append((*t, HEX[:digit + whole], "-" if whole else HEX[digit]))
            if not whole:
                left[t] = rest
        cut = spark.createDataFrame(cuts, "forest_id string, tree_id int, _under string, _on string")
        drawn = drawn.join(F.broadcast(cut), keys)
        under = F.octet_length("_u") - F.octet_length(F.expr("translate(_u, _under, '')"))
        taken.append(drawn.select(*keys, *values, under.cast("long").alias("_w")).filter("_w > 0"))
        need = left
        if need:
            state = materialize(drawn.withColumn("_open", _digits(F.col("_on"))).filter("_open > 0").drop("_u", "_under", "_on"),
                                "forest_open")
        level += 1
    out = empty
    for t in taken:
        out = out.unionByName(t)
    return out


# ------------------------------------------------------------------ tree build
def _threshold(lo, hi, draw):
    """A cut in [lo, hi): both sides keep a row."""
    t = lo + draw / float(1 << _DRAW_BITS) * (hi - lo)
    return t if t < hi else lo


def build_node(X: np.ndarray, w: np.ndarray, root: int, max_depth: int, forest: str, tree: int, seed: int):
    """Node rows (node, left, right, feature, threshold, n) below ``root`` for
    the weighted distinct rows X; a node's feature and cut are md5 draws."""
    out = []
    stack = [(np.arange(X.shape[0]), root)]
    while stack:
        idx, node = stack.pop()
        n = int(w[idx].sum())
        feat, thr = -2, -2.0
        if len(idx) > 1 and node.bit_length() - 1 < max_depth:
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if usable.size:
                feat = int(min(usable, key=lambda j: _md5_py(seed, forest, "n", tree, node, j)))
                thr = float(_threshold(lo[feat], hi[feat],
                                       int(_md5_py(seed, forest, "t", tree, node)[:_DRAW_BITS // 4], 16)))
                go = sub[:, feat] <= thr
                stack.append((idx[~go], 2 * node + 1))
                stack.append((idx[go], 2 * node))
        inner = feat >= 0
        out.append((node, 2 * node if inner else -1, 2 * node + 1 if inner else -1, feat, thr, n))
    return out


def _finisher(d: int, seed: int):
    xs = [f"_x{j}" for j in range(d)]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        fid, tree = str(pdf["forest_id"].iloc[0]), int(pdf["tree_id"].iloc[0])
        rows = build_node(pdf[xs].to_numpy(dtype=np.float64), pdf["_w"].to_numpy(), int(pdf["_node"].iloc[0]),
                          int(pdf["_depth"].iloc[0]), fid, tree, seed)
        node, left, right, feat, thr, n = zip(*rows)
        return pd.DataFrame({"forest_id": fid, "tree_id": tree, "node_id": node, "left": left, "right": right,
                             "feature": feat, "threshold": thr, "n_node_samples": n})
    return fn


def grow(rows: DataFrame, d: int, seed: int, local_rows: int | None = None) -> DataFrame:
    """The stored node table of the trees over ``rows`` (forest_id, tree_id,
    _depth, _x0.., _w: weighted distinct rows)."""
    from gatewatch.session import materialize
    local_rows = local_rows or LOCAL_ROWS
    keys = ["forest_id", "tree_id", "_node"]
    node = F.col("_node")
    active = materialize(rows.withColumn("_node", F.lit(1).cast("long")), "forest_rows")
    parts, level = [], 0
    while True:
        big = (active.groupBy(*keys, "_depth")
               .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_n"),
                    *[f(f"_x{j}").alias(f"{n}{j}") for j in range(d) for f, n in ((F.min, "_lo"), (F.max, "_hi"))])
               .filter((F.col("_rows") > local_rows) & (F.lit(level) < F.col("_depth"))))
        cand = F.filter(F.array(*[F.struct(
            _md5(seed, F.col("forest_id"), "n", F.col("tree_id"), node, j).alias("m"), F.lit(j).alias("j"),
            F.col(f"_lo{j}").alias("lo"), F.col(f"_hi{j}").alias("hi")) for j in range(d)]),
            lambda c: c["hi"] > c["lo"])
        u = _draw(seed, F.col("forest_id"), "t", F.col("tree_id"), node).cast("double") / float(1 << _DRAW_BITS)
        c = F.col("_c")
        cut = c["lo"] + F.col("_u") * (c["hi"] - c["lo"])
        big = (big.withColumns({"_c": F.array_min(cand), "_u": u})
               .select(*keys, "_n", c["j"].alias("_f"), F.when(cut < c["hi"], cut).otherwise(c["lo"]).alias("_t")))
        big = materialize(big, "forest_splits")
        if big.isEmpty():
            break
        parts.append(big.select("forest_id", "tree_id", node.alias("node_id"), (node * 2).alias("left"),
                                (node * 2 + 1).alias("right"), F.col("_f").alias("feature"),
                                F.col("_t").alias("threshold"), F.col("_n").alias("n_node_samples")))
        x = F.element_at(F.array(*[F.col(f"_x{j}") for j in range(d)]), F.col("_f") + 1)
        active = materialize(
            active.join(big.drop("_n"), keys, "left")
            .withColumn("_node", F.when(F.col("_f").isNull(), node).otherwise(
                node * 2 + F.when(x <= F.col("_t"), 0).otherwise(1)))
            .drop("_f", "_t"), "forest_rows")
        level += 1
    # a node at the depth limit is a leaf, whatever its size
    full = F.length(F.bin("_node")) - 1 >= F.col("_depth")
    parts.append(active.filter(full).groupBy(*keys).agg(F.sum("_w").alias("n"))
                 .select("forest_id", "tree_id", node.alias("node_id"), F.lit(-1).cast("long").alias("left"),
                         F.lit(-1).cast("long").alias("right"), F.lit(-2).alias("feature"),
                         F.lit(-2.0).alias("threshold"), F.col("n").alias("n_node_samples")))
    nodes = active.filter(~full).groupBy(*keys).applyInPandas(_finisher(d, seed), schema=NODE_SCHEMA)
    for p in parts:
        nodes = nodes.unionByName(p)
    return materialize(nodes, "forest_nodes")


@dataclass
class Forest:
    nodes: DataFrame
    features: list[str]
    max_samples: int
    n_trees: int
    forest_ids: list[str] = field(default_factory=lambda: [""])
    offset: float | None = None


def _fit(df: DataFrame, features: list[str], prm: dict, max_features: float, seed: int, row_id: str,
         forest: str | None, local_rows: int | None) -> DataFrame:
    d = len(features)
    k = min(d, max(1, int(max_features * d)) if isinstance(max_features, float) else int(max_features))
    xs = [f"_x{j}" for j in range(d)]
    base = df.select(F.col(row_id).alias("_row"), *([F.col(forest).cast("string").alias("_forest")] if forest else []),
                     *[F.round(F.col(c).cast("double"), DIGITS).alias(x) for x, c in zip(xs, features)])
    samples = tree_samples(weighted_rows(base, "_row", xs, "_forest" if forest else None), prm, seed)
    trees = df.sparkSession.createDataFrame(
        [(f, t, max(1, math.ceil(math.log2(max(min(psi, n), 2)))), tree_features(seed, f, t, d, k))
         for f, (n, psi, n_trees) in prm.items() for t in range(n_trees)],
        "forest_id string, tree_id int, _depth int, _use array<boolean>")
    # a feature the tree does not see is constant: its rows merge
    seen = samples.join(F.broadcast(trees), ["forest_id", "tree_id"]).select(
        "forest_id", "tree_id", "_depth",
        *[F.when(F.col("_use")[j], F.col(x)).otherwise(F.lit(0.0)).alias(x) for j, x in enumerate(xs)], "_w")
    rows = seen.groupBy("forest_id", "tree_id", "_depth", *xs).agg(F.sum("_w").alias("_w"))
    return grow(rows, d, seed, local_rows)


def fit(df: DataFrame, features: list[str], n_trees: int = 200, max_samples: int | None = None,
        max_features: float = 1.0, seed: int = 42, row_id: str = "row_id", n_rows: int | None = None,
        local_rows: int | None = None) -> Forest:
    """Fit T isolation trees of psi = ``max_samples`` rows each (default
    min(256, n)); any size is honoured in full. Features must not be null.
    No rows, no nodes."""
    n = n_rows if n_rows is not None else df.count()
    psi = min(max_samples if max_samples else min(256, n), n)
    nodes = _fit(df, features, {"": (n, psi, n_trees)}, max_features, seed, row_id, None, local_rows)
    return Forest(nodes=nodes, features=features, max_samples=psi, n_trees=n_trees)


def fit_many(df: DataFrame, features: list[str], forest: str, params: dict, max_features: float = 1.0,
             seed: int = 42, row_id: str = "row_id", local_rows: int | None = None) -> dict[str, Forest]:
    """Fit one forest per value of ``forest`` in one pass; ``params`` = {value:
    (n_rows, max_samples, n_trees)}. The forests share one stored node table."""
    prm = {str(k): (n, min(psi, n), t) for k, (n, psi, t) in params.items()}
    nodes = _fit(df, features, prm, max_features, seed, row_id, forest, local_rows)
    return {k: Forest(nodes=nodes.filter(F.col("forest_id") == k), features=features, max_samples=prm[k][1],
                      n_trees=prm[k][2], forest_ids=[k]) for k in sorted(prm)}


# -------------------------------------------------------------------- scoring
def pack(nodes_pdf: pd.DataFrame) -> dict:
    """Node table -> flat arrays for the vectorised walk. Children become
    global indices and leaves point to themselves (feature 0, threshold
    +inf), so a fixed number of steps (the forest's depth) needs no mask."""
    p = nodes_pdf.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    trees = p["tree_id"].to_numpy()
    ids = p["node_id"].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, trees[1:] != trees[:-1]])
    left = p["left"].to_numpy(np.int64)
    right = p["right"].to_numpy(np.int64)
    leaf = left < 0
    left_g = np.arange(len(p), dtype=np.int64)
    right_g = left_g.copy()
    for s, e in zip(starts, np.r_[starts[1:], len(p)]):
        inner = np.flatnonzero(~leaf[s:e]) + s
        left_g[inner] = s + np.searchsorted(ids[s:e], left[inner])
        right_g[inner] = s + np.searchsorted(ids[s:e], right[inner])
    depth, frontier, level = np.zeros(len(p), np.int64), starts.astype(np.int64), 0
    of_tree = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
    depths = np.zeros(len(starts), np.int64)
    while frontier.size:
        depth[frontier] = level
        depths[of_tree[frontier]] = level
        frontier = frontier[~leaf[frontier]]
        frontier = np.concatenate([left_g[frontier], right_g[frontier]])
        level += 1
    h = np.rint(c_factor_np(p["n_node_samples"].to_numpy()) * _H_UNIT).astype(np.int64)
    return {"child": np.concatenate([right_g, left_g]),
            "feature": np.where(leaf, 0, p["feature"].to_numpy(np.int64)),
            "threshold": np.where(leaf, np.inf, p["threshold"].to_numpy(np.float64)),
            "length": depth * _H_UNIT + h, "roots": starts.astype(np.int64), "depths": depths,
            "max_depth": int(depths.max(initial=0))}


def path_lengths(arr: dict, X: np.ndarray, block: int = 8192) -> np.ndarray:
    """Mean path length E[h(x)] over all trees for each row of X: a block of
    rows walks one tree at a time, so that the rows' nodes and the tree stay in
    the processor's cache; a leaf holds its whole path length."""
    out = np.empty(X.shape[0])
    child, feat, thr, length = arr["child"], arr["feature"], arr["threshold"], arr["length"]
    n = len(feat)
    for s in range(0, X.shape[0], block):
        xs = np.ascontiguousarray(X[s:s + block])
        flat, m = xs.ravel(), xs.shape[0]
        row = np.arange(m) * xs.shape[1]
        total = np.zeros(m, np.int64)
        for root, depth in zip(arr["roots"].tolist(), arr["depths"].tolist()):
            node = np.full(m, root)
            for _ in range(depth):
                go_left = flat[row + feat[node]] <= thr[node]
                node = child[node + go_left * n]
            total += length[node]
        out[s:s + m] = total
    out /= float(_H_UNIT) * arr["roots"].size
    return out


def collect_nodes(forest: Forest) -> pd.DataFrame:
    """The node table on the driver, its rows counted before they are sent:
    at most T * 2psi by construction, and ``COLLECT_BYTES``."""
    pdf = driver_nodes(forest)
    if pdf is None:
        raise ValueError(f"the forest's nodes are over {COLLECT_BYTES} bytes; score(df, forest) joins them instead")
    return pdf


def driver_nodes(forest: Forest) -> pd.DataFrame | None:
    """The node table on the driver, or None where it is over ``COLLECT_BYTES``."""
    if forest.nodes.count() * NODE_BYTES > COLLECT_BYTES:
        return None
    return forest.nodes.toPandas()


def score(df: DataFrame, forest: Forest, out: str = "score", nodes_pdf: pd.DataFrame | None = None) -> DataFrame:
    """Append -2^(-E[h(x)]/c(psi)) (sklearn's score_samples) as ``out``.
    Without ``nodes_pdf`` the forest's stored nodes are counted: a large
    forest is joined level by level, with the same result."""
    spark = df.sparkSession
    pdf = nodes_pdf if nodes_pdf is not None else driver_nodes(forest)
    if pdf is None:
        return score_by_join(df, forest, out)
    arr = spark.sparkContext.broadcast(pack(pdf))
    cpsi = c_factor(forest.max_samples)
    d = len(forest.features)

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols]) if d else np.zeros((len(cols[0]), 0))
        h = path_lengths(arr.value, X)
        # a missing feature gives no score (the edge decision fails open)
        return pd.Series(-np.power(2.0, -h / cpsi)).where(~np.isnan(X).any(axis=1))

    return df.withColumn(out, _score(*[F.col(c).cast("double") for c in forest.features]))


def score_by_join(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """``score`` for a forest of any size: every (row, tree) pair joins its
    node, one stored step per level, until all pairs have met a leaf."""
    from gatewatch.functions.codes import c_factor as c_col
    from gatewatch.session import materialize
    spark = df.sparkSession
    nodes = forest.nodes.select("tree_id", "node_id", "left", "right", "feature", "threshold", "n_node_samples")
    # one row per tree: bounded by the parameters
    roots = [(r["tree_id"], r["root"]) for r in nodes.groupBy("tree_id").agg(F.min("node_id").alias("root")).collect()]
    base = materialize(df.withColumn("_uid", F.monotonically_increasing_id()), "score_rows")
    x = F.array(*[F.col(c).cast("double") for c in forest.features])
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v))
    tree = F.explode(F.array(*[F.struct(F.lit(t).alias("tree_id"), F.lit(r).cast("long").alias("node_id"))
                               for t, r in roots]))
    pairs = base.filter(whole).select("_uid", x.alias("_x"), tree.alias("_t")).select("_uid", "_x", "_t.*")
    found, level = None, 0
    while True:
        step = materialize(pairs.join(nodes, ["tree_id", "node_id"]), "score_step")
        h = F.round(c_col(F.col("n_node_samples")) * float(_H_UNIT), 0).cast("long") + F.lit(level * _H_UNIT)
        leaves = step.filter("left < 0").groupBy("_uid").agg(F.sum(h).alias("_h"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = step.filter("left >= 0")
        if inner.isEmpty():
            break
        go_left = F.element_at("_x", F.col("feature") + 1) <= F.col("threshold")
        pairs = inner.select("_uid", "_x", "tree_id",
                             F.when(go_left, F.col("left")).otherwise(F.col("right")).alias("node_id"))
        level += 1
    mean = F.sum("_h").cast("double") / (float(_H_UNIT) * len(roots))
    total = found.groupBy("_uid").agg((-F.pow(F.lit(2.0), -mean / F.lit(c_factor(forest.max_samples)))).alias(out))
    return base.join(total, "_uid", "left").drop("_uid")


def offset_of(scored: DataFrame, contamination: float, score_col: str = "score") -> float:
    """The decision offset of a scored frame (materialised once, then the
    exact quantile reads the stored scores)."""
    from gatewatch.session import materialize
    return quantile_scalars(materialize(scored.select(score_col), "offset_scores"), score_col,
                            {"q": contamination})["q"]


def threshold(scored: DataFrame, contamination: float, score_col: str = "score",
              offset: float | None = None) -> tuple[DataFrame, float]:
    """offset = exact contamination-quantile; decision and -1/1 prediction."""
    off = offset if offset is not None else quantile_scalars(scored, score_col, {"q": contamination})["q"]
    out = scored.withColumns({
        "decision": F.col(score_col) - F.lit(off),
        "prediction": F.when(F.col(score_col) - F.lit(off) < 0, F.lit(-1)).otherwise(F.lit(1)),
    })
    return out, off


def decision_label(decision: str = "decision") -> dict[str, Column]:
    """Scoring-API output: anomaly 1/0 and the score rounded to 4 digits."""
    return {"anomaly": (F.col(decision) < 0).cast("int"), "score_r4": F.round(F.col(decision), 4)}


def edge_action(score_col: str = "score", mode: str = "offset", fixed_threshold: float = -0.1,
                offset: float = 0.0) -> Column:
    """Edge decision: null score -> FAIL_OPEN; BLOCK when below the threshold
    (``offset`` mode: score - offset < 0; ``fixed_threshold`` mode: score < t)."""
    s = F.col(score_col)
    below = (s - F.lit(offset) < 0) if mode == "offset" else (s < F.lit(fixed_threshold))
    return F.when(s.isNull(), F.lit("FAIL_OPEN")).when(below, F.lit("BLOCK")).otherwise(F.lit("ALLOW"))
