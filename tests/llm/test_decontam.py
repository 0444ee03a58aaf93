import hashlib
import random
import re

import numpy as np

from gatewatch.llm import decontam as D
from gatewatch.llm.common import tokens

SCHEMA = "doc_id long, text string, n_words long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def _brute(text, items):
    w, hit, found = _words(text), set(), set()
    for i, t in items:
        x = _words(t)
        n = min(13, len(x))
        for k in range(len(x) - n + 1) if x else ():
            for a in range(len(w) - n + 1):
                if w[a:a + n] == x[k:k + n]:
                    hit |= set(range(a, a + n))
                    found.add(str(i))
    ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)


def _data(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "ä1", "x", "the", "of", "Ünï"]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate((40, 13, 14, 30, 3, 60))] + [(9, None), (10, "..."), (4, "the of Beta"), (11, "the OF beta")]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 60))) for _ in range(30)]
    texts += [f"{texts[0]}, {items[0][1][10:150]}! zzz", items[1][1].upper(), items[5][1] + " " + items[5][1], "x " * 3000 + items[3][1], None, "", " .. "]
    docs = [(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 1), (None, items[2][1], 1)]
    return (spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), docs, items)


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, bench, rows, items = _data(spark)
    want = sorted((str(i), *_brute(t, items)) for i, t, _ in rows)
    for size in (1 << 20, 150):
        blocks = D.test_blocks(bench, size)
        assert (len(blocks) > 1) == (size == 150)
        got = D.scan(docs, blocks, keep=["doc_id"]).collect()
        assert sorted((str(r[0]), *r[1:6]) for r in got) == want


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, bench, rows, items = _data(spark)
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns
    want = sorted(str(r) for r in rows if not _brute(r[1], items)[4])
    assert sorted(str(tuple(r)) for r in out.collect()) == want
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_suffix_array_order_and_longest(spark):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 400).astype(np.int32)
    sa = D.SuffixArray(ids, 3, 50)
    key = lambda p: tuple(ids[p:p + 50][:(list(ids[p:p + 50]) + [0]).index(0)])
    assert sorted(sa.sa) == list(np.flatnonzero(ids)) and [key(p) for p in sa.sa] == sorted(key(p) for p in np.flatnonzero(ids))


def test_longest_matches(spark):
    docs, bench, rows, items = _data(spark)
    got = {(r["item_id"], r["item_at"]): r for r in D.longest_matches(docs, bench).collect()}
    for i, t in items[:4]:
        x = _words(t)
        for k in range(len(x)):
            best = max((n for _, d, _ in rows for w in [_words(d)] for a in range(len(w))
                        for n in [next((m for m in range(min(len(x) - k, len(w) - a)) if x[k + m] != w[a + m]), min(len(x) - k, len(w) - a))]), default=0)
            assert (got[(i, k)]["length"] if (i, k) in got else 0) == best
    r = got[(5, 0)]
    w = [t for j, t, _ in rows if j == r["doc_id"]][0]
    assert [x.decode() for x in tokens(w)][r["at"]:r["at"] + r["length"]] == [x.decode() for x in tokens(items[5][1])][:r["length"]]


def test_long_items_take_linear_memory(spark):
    """An item of 30,000 words, one of them in a document; beside brute force
    on the place and length of the longest match."""
    rng = random.Random(8)
    x = [f"w{rng.randrange(9000)}" for _ in range(30_000)]
    block = D.TestBlock([(1, [w.encode() for w in x]), (2, [b"two", b"words"])])
    assert sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray)) < 5_000_000
    docs = [["own"] * 5 + x[12_000:15_000] + ["end"], ["two", "words"], x[:12], x[-13:], []]
    hit, items, longest, place = D.search_shard([[w.encode() for w in d] for d in docs], block)
    assert [int(h.sum()) for h in hit] == [3000, 2, 0, 13, 0] and items == [{1}, {2}, set(), {1}, set()]
    assert longest.tolist() == [3000, 2, 0, 13, 0] and place[0] == 5
