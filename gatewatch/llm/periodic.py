"""Periodic runs of words, and texts with them collapsed.

A run is a maximal stretch of consecutive words with smallest period q whose
length is at least ``MIN_LENGTH`` words and ``MIN_EXPONENT`` periods. Every run
holds equal neighbouring Lyndon roots under one of the two orders of the words
(by rank, and by reversed rank), so the runs are read off the Lyndon arrays:

1. ``lyndon_groups`` is phase one of Baier's suffix sorter: suffixes grouped by
   first word, groups taken from the highest down, each member hands its
   context to the nearest suffix before it in a lower group. It ends with the
   suffixes grouped by their longest Lyndon prefix, so both the Lyndon array
   (context lengths) and the equality of roots (same group) come out directly.
   No suffix array is built.
2. Three equal neighbouring roots (i, i + q, i + 2q in one group, q the context
   length) begin a candidate; only the first root of a chain counts, so a run
   is met once per order.
3. A root is extended to both sides by longest common extensions of the words
   themselves; nothing is decided by hashes.

Words that occur fewer than ``MIN_EXPONENT`` times in a text cannot lie in a
run, so a text is first cut at them (and its stretches once more by their own
counts); grouping works on the stretches. The result is the same as on the
whole text.

A text is one row's work, in linear memory; rows go to tasks as they lie in the
input, nothing is shuffled. Null and empty texts have no words and no runs.
Repeated rows are treated alike. Ids are not read. Extra columns pass through;
results are ``__pr_*`` columns, which an input must not have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import prepare

MIN_LENGTH = 6
MIN_EXPONENT = 4

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
RESULTS = T.StructType([T.StructField("__pr_words", T.LongType()), T.StructField("__pr_runs", T.ArrayType(RUN)), T.StructField("__pr_text", T.StringType())])


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int]]:
    """(length, group) of every suffix: the length of its longest Lyndon
    prefix (a shorter text sorts first) and a number that two suffixes share
    if and only if those prefixes are equal."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)  # suffixes, group after group
    place, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        place[i] = k
        if s[i] != s[order[first]]:
            first = k
        group[i] = first
        size[first] += 1
    length, prev = [1] * n, [-1] * n
    end = n
    while end:
        g = group[order[end - 1]]
        members = sorted(order[g:end])
        context = length[members[0]]
        handed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            if p >= 0 and group[p] == g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                handed[p] = handed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in handed.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):  # the most repeats end up highest
            moved: dict[int, list[int]] = {}
            for p in by_count[c]:
                moved.setdefault(group[p], []).append(p)
            for old, ps in moved.items():
                for p in ps:  # to the end of the old group
                    size[old] -= 1
                    last, k = old + size[old], place[p]
                    other = order[last]
                    order[k], place[other] = other, k
                    order[last], place[p] = p, last
                new = old + size[old]
                size[new] = len(ps)
                for p in ps:
                    group[p] = new
                    length[p] += c * context
        end = g
    return length, group


def common_extension(s: np.ndarray, a: int, b: int, step: int) -> int:
    """Number of equal words from a and b (a < b) on, to the right (step 1) or,
    before them, to the left (step -1)."""
    found, width = 0, 16
    most = len(s) - b if step > 0 else a
    while found < most:
        width = min(2 * width, most - found)
        if step > 0:
            x, y = s[a + found:a + found + width], s[b + found:b + found + width]
        else:
            x, y = s[a - found - width:a - found][::-1], s[b - found - width:b - found][::-1]
        other = np.flatnonzero(x != y)
        if len(other):
            return found + int(other[0])
        found += width
    return found


def runs_of(s: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence of word numbers; the exponent
    must be at least 4, so that three full roots are certain."""
    found = set()
    top = int(s.max()) if len(s) else 0
    for ranks in (s, top - s):
        length, group = (np.array(x, np.int64) for x in lyndon_groups(ranks.tolist()))
        i = np.arange(len(s))
        i = i[i + 2 * length < len(s)]
        q = length[i]
        same = (group[i] == group[i + q]) & (group[i] == group[i + 2 * q])
        i, q = i[same], q[same]
        chain = (i >= q) & (group[i - np.minimum(i, q)] == group[i])
        for a, p in zip(i[~chain].tolist(), q[~chain].tolist()):
            start = a - common_extension(s, a, a + p, -1)
            n = a + p + common_extension(s, a, a + p, 1) - start
            if n >= max(min_length, exponent * p):
                found.add((start, n, p))
    return found


def _stretches(s: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Maximal stretches, of at least ``least`` words, of words that occur at
    least ``times`` times in s."""
    _, back, count = np.unique(s, return_inverse=True, return_counts=True)
    often = (count >= times)[back]
    edge = np.diff(np.concatenate([[False], often, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if y - x >= least]


def text_runs(words: list, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Runs of a text's words, by start, then period."""
    numbers: dict = {}
    s = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    if len(s) - len(numbers) < exponent - 1:  # no word comes often enough
        return found
    for a, b in _stretches(s, exponent, min_length):
        for c, d in _stretches(s[a:b], exponent, min_length):
            found += [(a + c + i, n, p) for i, n, p in runs_of(s[a + c:a + d], min_length, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that repeat a run's first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, n, p in runs:
        keep[start + p:start + n] = False
    return [words[k] for k in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with ``__pr_words`` (number of words), ``__pr_runs`` (its runs by
    start, then period) and ``__pr_text`` (kept words joined by one space)."""
    if exponent < 4:
        raise ValueError("an exponent under 4 does not ensure three full roots in every run")
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            n, runs, kept = [], [], []
            for value in batch.column(at):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                found = text_runs(words, min_length, exponent)
                n.append(len(words))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                kept.append(b" ".join(collapse(words, found)))
            more = [pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *RESULTS.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULTS.fields]))


def digest_columns() -> list:
    """Number of runs, the greatest run (ties: smallest start, then period) and
    the digests of all runs and of the collapsed text."""
    runs = F.col("__pr_runs")
    top = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    said = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    return [F.size(runs).cast("long").alias("n_runs"), top["start"].alias("start"), (-top["neg"]).alias("length"), top["period"].alias("period"),
            F.floor(-top["neg"] * 1000 / top["period"]).cast("long").alias("exponent_milli"),
            F.sha2(said, 256).alias("runs_sha256"), F.sha2("__pr_text", 256).alias("collapsed_sha256")]
