import numpy as np
from pyspark.sql import functions as F

from gatewatch.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_text_model_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = F.pmod(F.col("doc_id"), F.lit(4)) == 3
    langs, table = L.train(docs.where(~out))
    held = docs.where(out & (F.col("n_chars") > 100)).select("lang", "text").collect()
    right = sum(langs[int(table[:, L.trigrams(r["text"])].sum(1).argmax())] == r["lang"] for r in held)
    assert langs == ["de", "en", "es", "fr"] and right >= 0.9 * len(held)


def test_pages_agree_with_markup(spark):
    got = L.identify(spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    known = [r for r in got if r["declared"]]
    assert sum(r["lang"] == r["declared"] for r in known) >= 0.9 * len(known)
    assert all(0 < r["confidence"] <= 1 for r in got)


def test_fusion_against_numpy(spark):
    """Priors and likelihoods, leave one out, by brute force."""
    rng = np.random.default_rng(1)
    rows = [(k, f"h{k % 3}.d{k % 2}.com", f"d{k % 2}.com", "com" if k % 4 else "org", ["", "en", "fr"][k % 3], rng.dirichlet([1, 1]).tolist()) for k in range(40)]
    ev = spark.createDataFrame(rows, "page_id long, host string, domain string, suffix string, declared string, text array<double>")
    got = {r["page_id"]: r for r in L.fuse(ev, ["en", "fr"]).collect()}
    for r in rows:
        def level(col, above):
            mates = [np.array(x[5]) for x in rows if (col is None or x[col] == r[col]) and x is not r]
            return (np.sum(mates, axis=0) + L.KAPPA * above) / (len(mates) + L.KAPPA) if mates else above
        p = level(1, level(2, level(None, np.array([0.5, 0.5]))))
        for col in (3, 4):
            own = np.sum([x[5] for x in rows if x[col] == r[col] and x is not r] or [[0, 0]], axis=0)
            every = np.sum([x[5] for x in rows if x is not r], axis=0)
            p = p * (own + L.SMOOTH) / (every + L.SMOOTH * len({x[col] for x in rows}))
        p = p * np.array(r[5])
        assert got[r[0]]["lang"] == ["en", "fr"][int(p.argmax())]
        assert abs(got[r[0]]["confidence"] - p.max() / p.sum()) < 1e-9


def test_hard_cases(spark):
    docs = spark.createDataFrame([(1, "the the of and " * 20, "en"), (2, "der die das und " * 20, "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "", "", "x"), (2, "http://u@A.b.co:80/x", "<html lang=de><p>der die das und", "x"),
                                   (2, "http://u@A.b.co:80/x", "<html lang=de><p>der die das und", "x"), (3, "no url", "der " * 200_000, "x")],
                                  "page_id long, url string, html string, host string")
    got = L.identify(pages, docs).collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 4
    assert {r["lang"] for r in got if r["page_id"] in (2, 3)} == {"de"} and {r["host"] for r in got if r["page_id"] == 2} == {"a.b.co"}
    assert L.identify(pages.limit(0), docs).count() == 0
    assert {r["lang"] for r in L.identify(pages, docs.limit(0)).collect()} == {None}
