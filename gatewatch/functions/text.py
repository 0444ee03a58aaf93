"""Text features of request paths, query strings and documents.

Lengths, counts, keywords and classifiers are native Spark expressions
(regexp_count, contains) inside whole-stage codegen. The entropies of whole
texts count characters by numpy over Arrow batches (``codepoints``).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch import constants as K
from gatewatch.functions import codepoints as CP


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shannon_entropy_counts(text) -> Column:
    """``shannon_entropy`` by counting every distinct character, cheap for
    short strings of few characters. Counts come from the length drop when one distinct character is removed,
    so the per-string cost is (#distinct chars) x (length), all JVM-side.
    ``abs`` keeps the single-character case at +0.0 rather than -0.0.
    """
    s = F.coalesce(_col(text), F.lit(""))
    n = F.char_length(s)
    chars = F.array_distinct(F.split(s, ""))
    probs = F.transform(
        chars, lambda ch: (n - F.char_length(F.replace(s, ch, F.lit("")))) / n)
    h = F.aggregate(probs, F.lit(0.0).cast("double"), lambda acc, p: acc - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.abs(h))


def _per_batch(of, text) -> Column:
    """A function of Arrow batches over the UTF-8 bytes of ``text``."""
    return F.arrow_udf(of, T.DoubleType())(_col(text).cast("string").cast("binary"))


def shannon_entropy(text) -> Column:
    """-sum p*log2(p) over the code points of ``text``; null/'' give 0.0."""
    return _per_batch(CP.entropies, text)


#: Digits outside the decimal class (superscripts, circled digits, ...): every
#: character with a digit value that is not of class Nd.
OTHER_DIGITS = "".join(chr(c) for c in range(0x110000)
                       if unicodedata.digit(chr(c), None) is not None and unicodedata.category(chr(c)) != "Nd")


def class_entropy(text) -> Column:
    """Entropy over four character classes: letters, digits, space/tab, other."""
    return _per_batch(CP.class_entropies, text)


def rule_code_entropy(code) -> Column:
    """Entropy of Python's ``bin(code)`` text ('0b101', '-0b11')."""
    c = _col(code).cast("long")
    text = F.when(c < 0, F.concat(F.lit("-0b"), F.bin(-c))).otherwise(F.concat(F.lit("0b"), F.bin(c)))
    return shannon_entropy_counts(text)


def text_length(text) -> Column:
    return F.char_length(F.coalesce(_col(text), F.lit(""))).cast("long")


def special_char_count(text) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(K.SPECIAL_CHARS_REGEX)).cast("long")


def _contains_any(lowered: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | lowered.contains(w)
    return cond


def risk_keyword_count(text, keywords: list[str] = K.RISK_KEYWORDS) -> Column:
    """Number of distinct keywords present in lower(text)."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    total = F.lit(0)
    for w in keywords:
        total = total + low.contains(w).cast("int")
    return total.cast("long")


def scanner_label(uri) -> Column:
    """1 when lower(uri) holds a scanner pattern or more than 3 special chars."""
    low = F.lower(F.coalesce(_col(uri), F.lit("")))
    hit = _contains_any(low, K.SCANNER_PATTERNS) | (
        F.regexp_count(low, F.lit(K.SPECIAL_CHARS_REGEX)) > K.SCANNER_SPECIAL_LIMIT)
    return hit.cast("int")


def classify_threat(uri, args, args_entropy) -> Column:
    """Ordered threat classifier; first matching branch wins."""
    u = F.lower(F.coalesce(_col(uri), F.lit("")))
    a = F.lower(F.coalesce(_col(args), F.lit("")))
    ent = F.coalesce(_col(args_entropy), F.lit(0.0))
    return (F.when(_contains_any(a, K.THREAT_SQL_WORDS), F.lit(K.THREAT_SQL))
            .when(_contains_any(a, K.THREAT_XSS_MARKS), F.lit(K.THREAT_XSS))
            .when(_contains_any(u, K.THREAT_ADMIN_WORDS), F.lit(K.THREAT_ADMIN))
            .when(_contains_any(u, K.THREAT_TRAVERSAL_MARKS), F.lit(K.THREAT_TRAVERSAL))
            .when(ent > K.THREAT_ENTROPY_LIMIT, F.lit(K.THREAT_ENCODED))
            .otherwise(F.lit(K.THREAT_FALLBACK)))


def restore_args(rule, row_id) -> Column:
    """Query string restored from the rule type when the log lacks it.

    The payload is picked by ``row_id mod len(list)`` so the choice does not
    depend on row order or partitioning.
    """
    r = F.coalesce(_col(rule).cast("string"), F.lit(""))
    rid = _col(row_id).cast("long")
    sqli = F.array(*[F.lit(p) for p in K.SQLI_PAYLOADS])
    xss = F.array(*[F.lit(p) for p in K.XSS_PAYLOADS])
    return (F.when(r.contains("SQLi"), F.element_at(sqli, (F.pmod(rid, F.lit(len(K.SQLI_PAYLOADS))) + 1).cast("int")))
            .when(r.contains("XSS") | r.contains("CrossSite"),
                  F.element_at(xss, (F.pmod(rid, F.lit(len(K.XSS_PAYLOADS))) + 1).cast("int")))
            .otherwise(F.lit("")))


def round6(c) -> Column:
    return F.round(_col(c), 6)
