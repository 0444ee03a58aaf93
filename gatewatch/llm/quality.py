"""Quality rules: one threshold table compiled into one Spark projection.

``RULES`` states every rule as (name, numerator, denominator, low, high); a
text passes a rule when ``low <= numerator / denominator <= high`` (an open
bound is None). The table is compiled into plain columns over one scan: no
user function, no shuffle, no join. The counts the ratios need are built-in
expressions; repeated three-word windows are found by sorting the hashes of
one text's windows, so the cost is n log n in the words of a text.

Null texts have no words and fail the length rule, as empty texts do. Repeated
rows get equal results. Other columns of the input are not read; output
columns are the ones named here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.common import SPACE, SPACE_CHARS

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages served.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on", "be", "by",
              "de", "la", "le", "les", "et", "en", "un", "une", "du", "des", "que", "qui", "dans", "pour",
              "der", "die", "das", "und", "ein", "eine", "zu", "den", "mit", "von", "nicht", "sich",
              "el", "los", "las", "del", "y", "se", "por", "con", "para", "al")


@dataclass(frozen=True)
class Rule:
    name: str
    top: str
    bottom: str | None
    low: float | None
    high: float | None


#: The threshold table. Columns are the metrics below; bottom None: a count.
RULES = (
    Rule("length", "n_words", None, 50, 200_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop", "n_words", 0.02, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("letter_words", "n_letter_words", "n_words", 0.6, None),
    Rule("shout_words", "n_shout_words", "n_words", None, 0.3),
)


def metrics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus the counts the rules use, one row per input row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(
        *[F.col(c) for c in keep],
        F.array_remove(F.split(t, SPACE), "").alias("_ws"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0).alias("_ls"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_ws")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get("_ws", i), F.get("_ws", i + 1), F.get("_ws", i + 2)).alias("h"),
                           i.alias("i"))))
    lines = F.size("_ls")
    words = lambda cond: F.size(F.filter("_ws", cond)).cast("long")
    rows = lambda cond: F.size(F.filter("_ls", cond)).cast("long")
    counted = base.select(
        *[F.col(c) for c in keep], "word_chars", "n_symbols",
        n.cast("long").alias("n_words"), lines.cast("long").alias("n_lines"),
        (lines - F.size(F.array_distinct("_ls"))).cast("long").alias("n_dup_lines"),
        words(lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop"),
        words(lambda w: w.rlike("\\p{L}")).alias("n_letter_words"),
        words(lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))).alias("n_shout_words"),
        rows(lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        rows(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
        F.sort_array(windows).alias("_s"),
    )
    same = lambda x, y: F.coalesce(y["h"] == x["h"], F.lit(False))
    repeated = F.filter("_s", lambda x, k: ((k > 0) & same(x, F.get("_s", k - 1))) | same(x, F.get("_s", k + 1)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return counted.select(
        *[c for c in counted.columns if c != "_s"],
        F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def compiled(rules=RULES) -> Column:
    """The table as one boolean expression; an empty denominator passes."""
    out = F.lit(True)
    for r in rules:
        if r.bottom is None:
            low, high, ok = F.col(r.top), F.col(r.top), F.lit(False)
        else:  # cross-multiplied: no division
            low = high = F.col(r.top).cast("double")
            ok = F.col(r.bottom) == 0
        scale = F.lit(1.0) if r.bottom is None else F.col(r.bottom).cast("double")
        test = F.lit(True)
        if r.low is not None:
            test = test & (low >= F.lit(float(r.low)) * scale)
        if r.high is not None:
            test = test & (high <= F.lit(float(r.high)) * scale)
        out = out & (ok | test)
    return out


def compiled_sql(rules=RULES) -> str:
    """The same expression as SQL text."""
    parts = []
    for r in rules:
        scale = "1.0" if r.bottom is None else f"CAST({r.bottom} AS DOUBLE)"
        tests = []
        if r.low is not None:
            tests.append(f"{r.top} >= CAST({float(r.low)} AS DOUBLE) * {scale}")
        if r.high is not None:
            tests.append(f"{r.top} <= CAST({float(r.high)} AS DOUBLE) * {scale}")
        ok = "FALSE" if r.bottom is None else f"{r.bottom} = 0"
        parts.append(f"({ok} OR ({' AND '.join(tests)}))")
    return " AND ".join(parts)


def quality(df: DataFrame, keep: list[str], text: str = "text", rules=RULES) -> DataFrame:
    """Metrics, ``base_failed`` (under 50 words, or over half of the words in
    repeated three-word windows) and ``kept``."""
    m = metrics(df, keep, text)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))
