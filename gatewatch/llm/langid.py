"""Language ID by Bayesian evidence fusion.

For every page the posterior over languages fuses four kinds of evidence:

* text: a multinomial model over hashed byte trigrams of the visible text,
  trained on all documents with a language; its log likelihood is tempered,
  because trigrams of one text are not independent;
* the language the markup declares (``<html lang=..>``);
* the suffix of the address (the last label of the host);
* a host prior, smoothed hierarchically: global -> registered domain -> host,
  each level pulled towards the one above by KAPPA pseudo pages, without the
  page itself (leave one out).

The likelihoods of declared language and suffix and the host priors are
computed by grouped aggregation of the text posteriors over all pages. Hot
hosts only grow map-side partial sums; the sums are joined back by keys that
AQE splits. Trigram counts are summed inside the tasks first; the model is
languages x 2^BITS numbers, checked against MODEL_BYTES before it is broadcast.

Null or empty html has no text evidence (uniform likelihood), a null url no
host, suffix or domain: such pages share the empty key. Repeated pages count
twice and get equal results. Ties go to the language first in order. Without
a labelled document there is no language and the result is null. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import materialize, prepare

BITS = 16
ALPHA = 0.5
#: Weight of one trigram's log likelihood, and the most trigrams that count.
TEMPER, MOST = 0.2, 500
KAPPA = 5.0
SMOOTH = 1.0
MODEL_BYTES = 256 << 20


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams of the lower-cased bytes of a text."""
    b = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame, lang_col="lang", text_col="text") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities) from all documents with a language."""
    prepare(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(*(c.to_pylist() for c in batch.columns)):
                g = trigrams(t)
                if len(g):
                    s = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    np.add.at(s, g, 1)
        for lang, s in sums.items():
            k = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k, pa.int32()), pa.array(s[k], pa.int64())], names=["lang", "g", "n"])

    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")
    counts = materialize(src.mapInArrow(count, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "lang-counts")
    n_langs = counts.select("lang").distinct().count()
    if n_langs * (4 << BITS) > MODEL_BYTES:
        raise ValueError(f"{n_langs} languages make a model over {MODEL_BYTES} bytes; raise MODEL_BYTES or lower BITS")
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("g", "n")).alias("c")).orderBy("lang").collect()
    table = np.full((len(rows), 1 << BITS), ALPHA)
    for k, r in enumerate(rows):
        for c in r["c"]:
            table[k, c["g"]] += c["n"]
    return [r["lang"] for r in rows], np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def visible_text(html: Column) -> Column:
    """Html without scripts, styles, comments, navigation, tags and entities."""
    t = F.regexp_replace(html, "(?is)<(script|style|nav|title)\\b[^>]*>.*?</\\1\\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "&#?\\w{1,8};", " ")


def evidence(pages: DataFrame, langs: list[str], table: np.ndarray, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, host, domain, suffix, declared, text): text is the posterior
    by text alone, one number per language."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(table)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
    label = F.split(host, "\\.")
    declared = F.lower(F.coalesce(F.regexp_extract(F.col(html_col), "(?i)<html\\b[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    src = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), F.array_join(F.slice(label, F.greatest(F.size(label) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(label, -1).alias("suffix"), declared.alias("declared"), visible_text(F.coalesce(html_col, F.lit(""))).alias("t"))

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for t in batch.column(5).to_pylist():
                g = trigrams(t)
                z = model[:, g].sum(1, dtype=np.float64) * (TEMPER * min(1.0, MOST / len(g))) if len(g) else np.zeros(len(model))
                p = np.exp(z - z.max()) if len(z) else z
                out.append((p / p.sum()).tolist() if len(z) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:5], "text"])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:5], T.StructField("text", T.ArrayType(T.DoubleType()))]))


def fuse(ev: DataFrame, langs: list[str]) -> DataFrame:
    """Posteriors of pages from their evidence; reads ``ev`` several times, so
    pass a stored table."""
    n = len(langs)
    if not n:  # nothing learned, nothing to say
        none = F.lit(None)
        return ev.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"), none.cast("string").alias("text_lang"),
                         F.nullif(F.col("declared"), F.lit("")).alias("declared"), "suffix", "host")
    sums = [F.sum(F.get("text", F.lit(k))).alias(f"s{k}") for k in range(n)]
    table = lambda *by: ev.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums).select(
        *by, F.struct(F.col("n"), F.array(*[F.col(f"s{k}") for k in range(n)]).alias("s")).alias("_".join(["all", *by])))
    kinds = {c: max(1, ev.select(c).distinct().count()) for c in ("declared", "suffix")}
    every = table().first()
    if every is None:  # no pages
        return fuse(ev, [])
    every = every["all"]  # one row of one number per language
    x = ev.withColumn("all", F.struct(F.lit(every["n"]).alias("n"), F.array(*[F.lit(v or 0.0) for v in every["s"]]).alias("s")))
    for by in ("domain", "host", "declared", "suffix"):
        x = x.join(table(by), by)

    def pull(s: Column, above: Column) -> Column:
        """Leave-one-out share of a level, pulled towards the level above."""
        total = s["n"] - 1
        return F.zip_with(F.zip_with(s["s"], F.col("text"), lambda a, b: F.greatest(a - b, F.lit(0.0))), above,
                          lambda a, p: (a + F.lit(KAPPA) * p) / (total + F.lit(KAPPA)))

    flat = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda _: F.lit(1.0 / n))
    x = x.withColumn("p0", pull(F.col("all"), flat))
    x = x.withColumn("p1", pull(F.col("all_domain"), F.col("p0")))
    x = x.withColumn("prior", pull(F.col("all_host"), F.col("p1")))

    def likelihood(by: str) -> Column:
        """P(value | language), leave one out, smoothed over the values."""
        own = F.zip_with(F.col(f"all_{by}.s"), F.col("text"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        every = F.zip_with(F.col("all.s"), F.col("text"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        return F.zip_with(own, every, lambda a, b: (a + F.lit(SMOOTH)) / (b + F.lit(SMOOTH * kinds[by])))

    x = x.withColumn("l_declared", likelihood("declared")).withColumn("l_suffix", likelihood("suffix"))
    mul = lambda a, b: F.zip_with(a, b, lambda p, q: p * q)
    x = x.withColumn("joint", mul(mul(F.col("prior"), F.transform("text", lambda p: F.greatest(p, F.lit(1e-300)))), mul(F.col("l_declared"), F.col("l_suffix"))))
    x = x.withColumn("z", F.aggregate("joint", F.lit(0.0), lambda a, b: a + b))
    names = F.array(*[F.lit(v) for v in langs])
    best = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    return x.select("page_id", best("joint").alias("lang"), (F.array_max("joint") / F.col("z")).alias("confidence"),
                    best("text").alias("text_lang"), F.nullif(F.col("declared"), F.lit("")).alias("declared"), "suffix", "host")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every page, with the model trained on ``docs``."""
    langs, table = train(docs)
    return fuse(materialize(evidence(pages, langs, table), "lang-evidence"), langs)
