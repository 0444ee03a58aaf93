"""Spelling variants of words, grouped under their most frequent form.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. The join is one of asymmetric q-chunks: of two words the longer
(or either, at equal lengths) gives two disjoint chunks of half its length,
its beginning and its end; the other gives its positional grams of that
length. One edit leaves one of the two chunks as it is, at the same place if
the edit comes after it, and shifted by the difference in length, at most one,
if it comes before. So of all positional grams only those two places lie
within the shift that the join allows, and they are part of the join key. What
is left of both words beside the chunk is then verified by edit distance.

Hot chunks (endings such as ``-tion``): where both sides of a key have more
than ``HOT`` words, nothing is paired; the rests of its words, which still
differ by exactly one edit, are cut into chunks in the same way, and so on
until the groups are small or the rest is one code point. So pairs stay linear
in the words, and none is lost. Every round is a table in the shared folder.

Words are counted in the tasks that read the texts (a dictionary of at most
``HELD`` words, then partial counts are sent) and summed by Spark.

Null and empty texts have no words; repeated rows count repeatedly; a null id
reads as an empty one; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.common import materialize, prepare

#: Runs of letters, Latin-1 ones included.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FORM_TIMES = 5
#: Words of a join key, on its smaller side, up to which they are paired.
HOT = 32
#: Distinct words that a task counts before it sends partial counts.
HELD = 400_000


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, spelled: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points that occur
    at least ``min_count`` times; only A-Z are lower-cased. ``spelled`` may
    replace a row's word, given the row's id as text and the word."""
    prepare(docs.sparkSession)

    def run(batches):
        held: Counter = Counter()

        def sent():
            out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter = Counter()
                for w, n in Counter(LETTERS.findall(text or "")).items():
                    own[w.lower() if w.isascii() else w.translate(LOWER)] += n
                for w, n in own.items():
                    if spelled is not None:
                        w = spelled(key or "", w)
                    if len(w) >= min_length:
                        held[w] += n
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    parts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cut(side: DataFrame) -> DataFrame:
    """(word, m, key, rest) with each key extended by the two chunks, or by the
    grams at their places; m is the length of the rest on the chunk side."""
    q, own = F.floor(F.col("m") / 2).cast("int"), F.length("rest")
    first = F.struct(F.concat("key", F.lit("\t<"), F.substr("rest", F.lit(1), q)).alias("key"), F.substr("rest", q + 1, own - q).alias("rest"))
    last = F.struct(F.concat("key", F.lit("\t>"), F.substr("rest", own - q + 1, q)).alias("key"), F.substr("rest", F.lit(1), own - q).alias("rest"))
    return side.select("word", (F.col("m") - q).alias("m"), F.explode(F.array(first, last)).alias("c")).select("word", "m", "c.key", "c.rest")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(x, y), once per unordered pair of near words of ``words`` (distinct, of
    two code points at least)."""
    size = F.length("word")
    x = words.select("word", size.alias("m"), size.cast("string").alias("key"), F.col("word").alias("rest"))
    y = words.select("word", F.explode(F.array(size, size + 1)).alias("m"), F.col("word").alias("rest")).select(
        "word", "m", F.col("m").cast("string").alias("key"), "rest")
    found = None
    while True:
        x, y = materialize(_cut(x), "variants-chunks"), materialize(_cut(y), "variants-grams")
        sides = x.select("key", "m", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(y.select("key", "m", F.lit(0).alias("a"), F.lit(1).alias("b")))
        keys = sides.groupBy("key", "m").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0 AND b > 0")
        keys = materialize(keys.select("key", ((F.least("a", "b") > hot) & (F.col("m") > 1)).alias("hot")), "variants-keys")
        xs, calm = x.join(keys, "key"), y.select(F.col("word").alias("y"), F.col("key").alias("ky"), F.col("rest").alias("ry"))
        once = (F.length("rest") > F.length("ry")) | (F.col("word") < F.col("y"))
        near = xs.where("NOT hot").join(calm, (F.col("key") == F.col("ky")) & once & (F.levenshtein("rest", "ry", 1) == 1))
        near = near.select(F.col("word").alias("x"), "y")
        found = near if found is None else found.unionByName(near)
        again = keys.where("hot").select("key")
        if again.isEmpty():
            return materialize(found.distinct(), "variants-pairs")
        x, y = x.join(again, "key", "left_semi"), y.join(again, "key", "left_semi")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last one, by
    pointer jumping. A form is more frequent than its word, so no path closes."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        to = at.select(F.col("word").alias("via"), F.col("root").alias("to"))
        at = materialize(at.join(to, F.col("root") == F.col("via"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")),
                         "variants-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def group_variants(words: DataFrame, times: int = FORM_TIMES, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n;
    words distinct, of two code points at least). The form is the near word of
    largest n (ties: smallest in code-point order) if it is ``times`` as frequent."""
    words = materialize(words.select("word", "n"), "variants-words")
    pairs = near_pairs(words, hot)
    both = pairs.union(pairs.select("y", "x"))
    other = words.select(F.col("word").alias("y"), F.col("n").alias("ny"))
    near = both.join(other, "y").groupBy(F.col("x").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("ny")).alias("neg"), F.col("y").alias("y"))).alias("best"))
    often = -F.col("best.neg") >= times * F.col("n")
    named = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.y")).alias("form"), F.when(often, -F.col("best.neg")).alias("form_n"))
    named = materialize(named, "variants-forms")
    roots = last_forms(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
