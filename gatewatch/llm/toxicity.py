"""Toxicity: a factorization machine over hashed terms.

Terms (lower-cased words, and the first STEMS bytes of longer ones) are hashed
into buckets. One pass over all labelled
training documents counts, per bucket, how many toxic and other documents
hold it; buckets whose share differs clearly from the base rate (a z score
over ``MIN_Z``, the ``N_BUCKETS`` strongest) are the inputs. The machine

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

gives every input a weight and a factor vector, so a pair of terms can count
for more (or less) than the sum of both: an insult next to a group mention.
Counts cover all training documents. The machine itself is fitted on a
bounded sample of them, at most ``SAMPLE`` in the order of a hash of the id;
each is a short list of inputs, and equal lists are merged. Documents are
scored whole, in Arrow batches, without a shuffle.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2, and
never enter a score; nor do lang, source or doc_id. Null and empty texts have
no terms and get the base score. Repeated documents get equal scores; a
document labelled twice with both labels counts for both. Without labels
(or with one class) there are no inputs and the base rate is the score.
Input columns pass through untouched; added ones carry a ``__tox_`` prefix.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import broadcast_if_small, materialize, prepare, tokens

BITS = 20
STEMS = (5, 7)
N_BUCKETS = 256
MIN_Z = 4.0
MIN_DOCS = 5
SAMPLE = 20_000
FACTORS = 4
STEPS = 300
RATE = 0.05
L2 = 1e-3
SEED = 7
THRESHOLD = 0.3
HELD_OUT = 2


def buckets(text: str | None) -> set[int]:
    """Hashed terms of a text: its words and the beginnings of longer ones,
    so that inflected forms share a term."""
    mask, words = (1 << BITS) - 1, set(tokens(text))
    stems = {b"^" + w[:n] for w in words for n in STEMS if len(w) > n}
    return {zlib.crc32(w) & mask for w in words | stems}


def held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


@dataclass
class Machine:
    """index: input number by bucket (-1: none); w0, w, v: the machine."""

    names: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logit(self, inputs: list[int]) -> float:
        if not inputs:
            return self.w0
        s = self.v[inputs]
        return float(self.w0 + self.w[inputs].sum() + 0.5 * ((s.sum(0) ** 2).sum() - (s ** 2).sum()))

    def score(self, inputs: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(inputs), -30, 30))))


def fit_machine(x: list[list[int]], y: list[int], names, factors=FACTORS, steps=STEPS) -> Machine:
    """Logistic loss, L2, full-batch Adam; equal inputs are merged first."""
    n = len(names)
    merged: dict[tuple, list] = {}
    for a, b in zip(x, y):
        m = merged.setdefault(tuple(sorted(a)), [0, 0])
        m[0] += 1
        m[1] += b
    rows = sorted(merged)
    m = np.zeros((len(rows), n), np.float32)
    for k, a in enumerate(rows):
        m[k, list(a)] = 1
    count = np.array([merged[a][0] for a in rows], np.float64)
    share = np.array([merged[a][1] / merged[a][0] for a in rows])
    total = max(count.sum(), 1)
    base = (float((count * share).sum()) + 0.5) / (total + 1)
    rng = np.random.default_rng(SEED)
    p = [np.array([np.log(base / (1 - base))]), np.zeros(n), rng.normal(0, 0.05, (n, factors))]
    mom, sq = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        w0, w, v = p
        mv = m @ v
        z = w0[0] + m @ w + 0.5 * ((mv ** 2).sum(1) - (m @ (v ** 2)).sum(1))
        g = count / total * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - share)
        mg = m.T @ g
        grads = [np.array([g.sum()]), mg + L2 / max(n, 1) * w, m.T @ (g[:, None] * mv) - v * mg[:, None] + L2 * v]
        for k, d in enumerate(grads):
            mom[k] = 0.9 * mom[k] + 0.1 * d
            sq[k] = 0.999 * sq[k] + 0.001 * d * d
            p[k] = p[k] - RATE * (mom[k] / (1 - 0.9 ** step)) / (np.sqrt(sq[k] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(np.asarray(names, np.int64), float(p[0][0]), p[1], p[2])


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Machine:
    """Learn from the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("i")))
    train = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(broadcast_if_small(known, 16), "i").select("i", "t", "y")

    def hashed(batches):
        for batch in batches:
            found = [sorted(buckets(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["i", "y", "b"])

    id_type = train.schema["i"].dataType
    terms = materialize(train.mapInArrow(hashed, T.StructType().add("i", id_type).add("y", "integer").add("b", T.ArrayType(T.IntegerType()))), "tox-terms")
    total = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, pos = int(total[0]), int(total[1])
    names: list[int] = []
    if 0 < pos < n:
        rate = pos / n
        z = (F.col("p") - F.lit(rate) * F.col("n")) / F.sqrt(F.lit(rate * (1 - rate)) * F.col("n"))
        seen = terms.select(F.explode("b").alias("b"), "y").groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
        best = seen.where((F.col("n") >= MIN_DOCS) & (F.abs(z) >= MIN_Z)).orderBy(F.abs(z).desc(), "b").limit(N_BUCKETS)
        names = sorted(r["b"] for r in best.select("b").collect())
    index = {b: k for k, b in enumerate(names)}
    inputs = F.array_intersect("b", F.array(*[F.lit(b) for b in names])) if names else F.array().cast("array<int>")
    sample = (terms.select(inputs.alias("x"), "y", F.xxhash64(F.lit(SEED), "i").alias("h"), "i")
              .orderBy("h", "i", "y").limit(SAMPLE).select("x", "y").collect())
    return fit_machine([[index[b] for b in r["x"]] for r in sample], [r["y"] for r in sample], names)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) plus ``__tox_score``."""
    spark = docs.sparkSession
    prepare(spark)
    keep = docs.columns if keep is None else keep
    src = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])])
    shared = spark.sparkContext.broadcast(machine)  # N_BUCKETS inputs at most

    def run(batches):
        m = shared.value
        index = {int(b): k for k, b in enumerate(m.names)}
        known = index.keys()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            scores = [m.score([index[b] for b in sorted(buckets(t) & known)]) for t in texts]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=[*keep, "__tox_score"])

    return src.mapInArrow(run, T.StructType([*[f for f in src.schema.fields if f.name in keep], T.StructField("__tox_score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The documents scored under the threshold, columns of ``docs``."""
    return score(docs, machine, text_col).where(F.col("__tox_score") < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])
