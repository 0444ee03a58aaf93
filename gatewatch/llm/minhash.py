"""Near-duplicates by ProbMinHash.

A text is a weighted set: its five-word shingles (lower-cased words; all words
when there are fewer), each weighing 1 + log2 of its count, so that one shingle
repeated a thousand times does not drown the rest. Similarity is the probability Jaccard
index, J_P = sum over common i of 1 / sum_j max(x_j / x_i, y_j / y_i); for equal
weights it is the plain Jaccard index. Texts are linked at J_P >= 0.8, classes
are the connected components.

1. Signature: every shingle sends a Poisson process of arrivals, at the rate of
   its weight, to random registers; a register keeps the shingle that arrives
   first. Arrivals are made in rounds and a shingle stops once its next arrival
   is later than every register (early termination). Two texts agree in a
   register with probability J_P.
2. Equal texts are one node, grouped by digest.
3. Banding: BANDS x ROWS registers. At J_P = 0.8 a pair shares a band with
   probability 1 - (1 - 0.8^5)^24 = 0.9999.
4. Every bucket is compared with up to PIVOTS of its nodes (hash-chosen, the
   same in all of a group's buckets as far as possible, so few pairs are new);
   pairs are verified exactly.
5. Buckets whose nodes are not yet of one component are compared in full:
   nodes fall into blocks of about BLOCK, a task gets two blocks, skips pairs
   of one component and pairs whose first common band is another bucket,
   skips pairs whose signatures agree in too few registers (four standard
   deviations under 0.8), verifies the others exactly, and emits only the
   links that join components. So no link between different texts is lost
   beyond the stated odds, and no task or table holds a group's pairs.

Hot groups: copies collapse before the shuffle; buckets are met by
map-side-combined minima and by joins that AQE splits; blocks are salted.
Documents without words form classes by equal text only; null texts are equal
to each other. Null ids are allowed. A class carries its smallest id (null when
all are), which does not identify it: an id may occur with unrelated texts. Its
key is its smallest text digest. Repeated rows are copies. Extra columns are
ignored or passed through; only names that begin ``__near_`` are taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import TOKEN_BYTES, broadcast_if_small, materialize, prepare
from gatewatch.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
PIVOTS = 3
BLOCK = 256
SEED = 0x5EED
#: Fewest equal registers of a pair that may still reach the threshold.
LEAST_EQUAL = int(REGISTERS * THRESHOLD - 4 * (REGISTERS * THRESHOLD * (1 - THRESHOLD)) ** 0.5)

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_P, _P_INV)):
            t = np.full(size, base, _U)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=_U)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, from polynomial prefix sums over the bytes."""
    if not text:
        return np.empty(0, _U)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(TOKEN_BYTES), np.uint8)
    inside = b != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, _U)
    p, inv = _power_tables(len(b) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(b.astype(_U) * p[:len(b)], dtype=_U)])
    return _mix((sums[end] - sums[begin]) * inv[begin])


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, in order, and their weights."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, _U), np.empty(0)
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.full(n, _U(k))
    for j in range(k):
        h = (h ^ w[j:j + n]) * _P
        h ^= h >> _U(29)
    h, count = np.unique(_mix(h), return_counts=True)
    return h, 1 + np.log2(count)


def probminhash(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures of ``n`` texts at once (n x m): elements with their weights
    and the text that each belongs to."""
    reg, sig = np.full(n * m, np.inf), np.zeros(n * m, _U)
    time = np.zeros(len(hashes))
    live, step = np.arange(len(hashes)), 0
    with np.errstate(over="ignore"):
        while len(live):
            x = _mix(hashes[live] + _U((SEED + step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            u = ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time[live] -= np.log(u) / weights[live]
            to = owner[live] * m + ((_mix(x ^ _P) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            t = time[live]
            np.minimum.at(reg, to, t)
            won = t == reg[to]
            sig[to[won]] = hashes[live][won]
            latest = reg.reshape(n, m).max(1)
            live = live[t < latest[owner[live]]]
            step += 1
    return sig.reshape(n, m)


def signatures(texts: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Signatures, word presence and shingles of some texts."""
    sh = [shingles(t) for t in texts]
    sizes = np.array([len(h) for h, _ in sh], np.int64)
    owner = np.repeat(np.arange(len(sh)), sizes)
    cat = lambda k, kind: np.concatenate([s[k] for s in sh]) if len(sh) else np.empty(0, kind)
    return probminhash(cat(0, _U), cat(1, np.float64), owner, len(sh)), sizes > 0, sh


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band, distinct between bands."""
    with np.errstate(over="ignore"):
        s = sig.reshape(len(sig), BANDS, ROWS)
        h = np.broadcast_to(_mix(np.arange(1, BANDS + 1, dtype=_U) * _P), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            h = _mix((h ^ s[:, :, r]) * _P)
    return h.view(np.int64)


def probability_jaccard(x: tuple, y: tuple) -> float:
    """Exact J_P of two weighted sets (sorted hashes, weights)."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = x[1][i], y[1][j]
    sx, sy = float(x[1].sum()), float(y[1].sum())
    only_x = sx - a.sum()
    r = a / b
    order = np.argsort(r, kind="stable")
    a, b, r = a[order], b[order], r[order]
    # j with x_j / y_j >= x_i / y_i count x_j / x_i, the others y_j / y_i
    # (only in x: above all; only in y: below all)
    first = np.searchsorted(r, r, "left")
    ca, cb = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    above = ca[-1] - ca[first] + only_x
    below = cb[first] + sy - b.sum()
    return float((1.0 / (above / a + below / b)).sum())


# ---- Spark ------------------------------------------------------------------

def nodes_of(docs: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """rows (id, digest) and nodes (node, digest, rep_id, bands), one per
    distinct text; texts without words have no bands."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            keys, some = [], []
            texts = batch.column(2).to_pylist()
            for a in range(0, len(texts), 512):
                sig, has, _ = signatures(texts[a:a + 512])
                keys += [k if h else [] for k, h in zip(band_keys(sig).tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "bands"])

    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("digest"), F.coalesce(text_col, F.lit("")).alias("t"))
    schema = T.StructType([src.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    sigs = materialize(src.mapInArrow(run, schema), "near-signatures")
    nodes = sigs.groupBy("digest").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    return sigs.select("id", "digest"), nodes


def texts_of(docs: DataFrame, nodes: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(node, text), one row per node."""
    want = nodes.select("node", F.col("digest").alias("_d"), F.col("rep_id").alias("_r"))
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")))).alias("digest"), F.coalesce(text_col, F.lit("")).alias("t"))
    hit = src.join(broadcast_if_small(want, 32), (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_r")))
    return materialize(hit.select("node", F.col("t").alias("text")).dropDuplicates(["node"]), "near-texts")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) at or over the threshold, computed exactly."""
    a = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    b = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        last: dict = {}
        for batch in batches:
            keep = []
            for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                if x not in last:
                    if len(last) > 64:
                        last.clear()
                    last[x] = shingles(tx)
                keep.append(probability_jaccard(last[x], shingles(ty)) >= THRESHOLD)
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["x", "y"])

    return pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one pair of blocks of one bucket that join components."""
    bucket, i, j = group["bk"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
    group = group.sort_values("node")
    sig, _, sh = signatures(group["text"].tolist())
    keys = band_keys(sig)
    node, blk = group["node"].to_numpy(), group["blk"].to_numpy()
    names = {c: k for k, c in enumerate(pd.unique(group["comp"]))}
    root = list(range(len(names)))
    comp = [names[c] for c in group["comp"]]

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for p in range(len(node)):
        near = np.flatnonzero((sig[p + 1:] == sig[p]).sum(1) >= LEAST_EQUAL) + p + 1
        for q in near:
            if i != j and blk[p] == blk[q] or find(comp[p]) == find(comp[q]):
                continue
            if keys[p][np.argmax(keys[p] == keys[q])] != bucket:
                continue
            if probability_jaccard(sh[p], sh[q]) >= THRESHOLD:
                root[find(comp[p])] = find(comp[q])
                out.append((node[p], node[q]))
    return pd.DataFrame(out, columns=["x", "y"]).astype("int64")


def links(docs: DataFrame, nodes: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(node, comp) of the nodes that are linked to another text."""
    bands = nodes.select("node", F.explode("bands").alias("bk"))
    lows = [F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == k, F.col("node"))).alias(f"p{k}") for k in range(PIVOTS)]
    buckets = materialize(bands.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), *lows).where("n > 1"), "near-buckets")
    members = materialize(bands.join(buckets, "bk"), "near-members")
    pivot = members.select("node", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("p")).where("p IS NOT NULL AND p <> node")
    pairs = materialize(pivot.select(F.least("node", "p").alias("x"), F.greatest("node", "p").alias("y")).distinct(), "near-pairs")
    texts = texts_of(docs, nodes.join(members.select("node").distinct(), "node"), id_col, text_col)
    first = materialize(verify(pairs, texts), "near-links")
    label = components(first)
    # buckets of more than two nodes that are not of one component yet
    wide = members.where("n > 2").select("bk", "node", "n").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    wide = materialize(wide, "near-wide")
    mixed = wide.groupBy("bk").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bk")
    rest = wide.join(mixed, "bk", "left_semi").withColumn("nb", F.ceil(F.col("n") / BLOCK)).withColumn("blk", F.expr("pmod(xxhash64(node, bk), nb)"))
    rest = rest.withColumn("o", F.explode(F.expr("sequence(0L, nb - 1)"))).select(
        "bk", "node", "comp", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    rest = rest.join(texts, "node").select("bk", "i", "j", "blk", "node", "comp", "text")
    more = rest.groupBy("bk", "i", "j").applyInPandas(block_links, "x long, y long")
    more = materialize(more, "near-links")
    return components(first.unionByName(more))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, digest, class_key, class_id, class_size, texts) of every document;
    class_key is the smallest digest of the class and identifies it, class_id
    its smallest id."""
    rows, nodes = nodes_of(docs, id_col, text_col)
    label = links(docs, nodes, id_col, text_col)
    named = nodes.join(label, "node", "left").select("digest", "rep_id", "copies", F.coalesce("comp", "node").alias("comp"))
    named = materialize(named, "near-comps")
    classes = named.groupBy("comp").agg(F.min("digest").alias("class_key"), F.min("rep_id").alias("class_id"),
                                        F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    return rows.join(named.join(classes, "comp").select("digest", "class_key", "class_id", "class_size", "texts"), "digest").select(
        "id", "digest", "class_key", "class_id", "class_size", "texts")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One document of every class, the one with the smallest id (any before
    null), then the smallest digest; columns of ``docs``, whose names must not
    begin ``__near_``. Rows repeated with that id and text leave one."""
    found = near_duplicates(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("class_id")))
    keep = found.groupBy("class_key").agg(F.first("class_id").alias("__near_c"), F.min("digest").alias("__near_k"), F.count(F.lit(1)).alias("__near_n"))
    keep = materialize(keep.drop("class_key"), "near-keep")
    digest = F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))
    hit = docs.withColumn("__near_d", digest).join(
        broadcast_if_small(keep, 40), (F.col("__near_d") == F.col("__near_k")) & F.col(id_col).eqNullSafe(F.col("__near_c")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = hit.where("__near_n = 1").select(*cols)
    more = hit.where("__near_n > 1").dropDuplicates(["__near_d"]).select(*cols)  # a digest is in one class only
    return once.unionByName(more)
