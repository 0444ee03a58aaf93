"""Spelling variants against brute force over all pairs of words."""
import random
from collections import Counter

from gatewatch.llm import queries as Q
from gatewatch.llm import variants as V


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _brute(words):
    out = {}
    for w, n in words.items():
        near = sorted((v for v in words if _near(w, v)), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= 5 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, r in out.items():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def _words():
    rng = random.Random(4)
    words = {}
    for _ in range(25):
        base = "".join(rng.choices("abcdé", k=rng.randrange(4, 9))) + rng.choice(["tion", "ción", ""])
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice("abz𝒳")], [w[k], "q"]])
            if len(w) >= 2:
                words["".join(w)] = rng.choice([5, 6, 30, 150, 150, 800])
    words |= {"a" * 60: 5, "a" * 61: 25, "a" * 62: 125, "ab": 5, "b" * 5000: 9, "b" * 4999 + "c": 45}
    return words


def test_groups_with_and_without_hot_chunks(spark):
    words = _words()
    want = _brute(words)
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    for hot in (V.HOT, 1):
        got = V.group_variants(df, hot=hot).collect()
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert V.group_variants(df.limit(0)).count() == 0


def test_hot_chunks_do_not_pair_all(spark):
    """Words that share an ending are cut further instead of paired."""
    rng = random.Random(6)
    words = {"".join(rng.choices("abcdefghij", k=5)) + "tions" for _ in range(1500)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {(a, w) for w in words for k in range(10) for c in "abcdefghijtions" for a in (w[:k] + c + w[k + 1:],) if a in words and a != w}
    got = {(r["x"], r["y"]) for r in V.near_pairs(df).collect()}
    assert got | {(y, x) for x, y in got} == want


def test_word_counts(spark):
    texts = ["Straße straße STRAßE Ünïcode-word ab abcdef×÷ÀÿŸ", "abcdef " * 7, None, "", "Ünïcode " * 400, "z" * 100_000]
    rows = [(k, t, 1) for k, t in enumerate(texts)] * 5 + [(None, "nullid " * 199, 1)]
    got = {r["word"]: r["n"] for r in V.count_words(spark.createDataFrame(rows, "doc_id long, text string, n long"), spelled=Q.one_deleted).collect()}
    want = Counter()
    for i, t, _ in rows:
        for w in V.LETTERS.findall(t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            w = Q.one_deleted("" if i is None else str(i), w)
            if len(w) >= 6:
                want[w] += 1
    assert got == {w: n for w, n in want.items() if n >= 5}
    assert V.LETTERS.findall("a×÷Àÿ Ÿ") == ["a×÷Àÿ"]


def test_the_deleted_code_point():
    import zlib
    hit = [(i, "abcdefgh") for i in range(4000) if zlib.crc32(f"{i}:abcdefgh".encode()) % 199 == 0]
    assert hit
    for i, w in hit:
        k = zlib.crc32(f"{i}:{w}".encode()) % 8
        assert Q.one_deleted(str(i), w) == w[:k] + w[k + 1:]
