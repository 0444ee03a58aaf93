"""Periodic runs: Lyndon grouping and runs against brute force."""
import random

import pytest

from gatewatch.llm import periodic as P


def _lyndon(s):
    out = []
    for i in range(len(s)):
        ends = [j for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))]
        out.append(max(ends) - i)
    return out


def _runs(w, least=6, times=4):
    found = set()
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, times * q) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                found.add((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _text(rng):
    w = []
    for _ in range(rng.randrange(1, 6)):
        root = [rng.choice("ab c é".split()) for _ in range(rng.randrange(1, 7))]
        w += (root * 7)[:rng.randrange(1, len(root) * 6)]
    return w


def test_grouping_gives_lyndon_array_and_equal_roots():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(0, 24))]
        length, group = P.lyndon_groups(s)
        assert length == _lyndon(s)
        for i in range(len(s)):
            assert [g == group[i] for g in group] == [s[j:j + length[j]] == s[i:i + length[i]] for j in range(len(s))]


def test_runs_against_brute_force():
    rng = random.Random(2)
    for _ in range(800):
        w = _text(rng)
        assert P.text_runs(w) == _runs(w)
    assert P.text_runs(list("ab") * 50_000 + ["z"]) == [(0, 100_000, 2)]


def _collapsed(w, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(_text(rng)) for _ in range(40)] + [None, "", " \n\t", "x " * 30_000, "x y " * 6, "one two"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, texts[1], None)]
    out = P.find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string"))
    assert out.columns == ["doc_id", "text", "runs", "__pr_words", "__pr_runs", "__pr_text"]
    got = sorted(str((r["doc_id"], r["text"], r["runs"], r["__pr_words"], [tuple(x) for x in r["__pr_runs"]], r["__pr_text"])) for r in out.collect())
    want = []
    for i, t, e in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = _runs(w) if len(w) < 1000 else [(0, 30_000, 1)]
        want.append(str((i, t, e, len(w), runs, _collapsed(w, runs))))
    assert got == sorted(want)
    assert P.find_runs(out.select("doc_id", "text").limit(0)).count() == 0
    digest = out.select("doc_id", *P.digest_columns()).collect()
    none = [r for r in digest if r["doc_id"] == texts.index(None)][0]
    assert none["n_runs"] == 0 and none["start"] is None and none["exponent_milli"] is None and none["runs_sha256"] == none["collapsed_sha256"]
    with pytest.raises(ValueError):
        P.find_runs(out.select("doc_id", "text"), exponent=3)
