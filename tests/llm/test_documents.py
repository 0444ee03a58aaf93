"""Line dedup, near-duplicates, toxicity, the pipeline."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from gatewatch.llm import components as CC
from gatewatch.llm import line_dedup as L
from gatewatch.llm import minhash as M
from gatewatch.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def _clean(rows):
    """Brute force over distinct (id, text) rows, every two neighbouring worded lines a chunk."""
    places = defaultdict(list)
    for i, t in set(rows):
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if x.split()]
        for a, b in zip(worded, worded[1:]):
            places[lines[a], lines[b]].append((i is not None, i or 0, hashlib.md5(t.encode()).digest(), a, b, (i, t)))
    gone, safe = defaultdict(set), defaultdict(set)
    for v in places.values():
        for k, (*_, a, b, doc) in enumerate(sorted(v, key=lambda x: x[:4])):
            if k:
                gone[doc] |= set(range(a, b + 1))
            elif len(v) > 1:
                safe[doc] |= set(range(a, b + 1))
    return Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i, t)] - safe[(i, t)])) for i, t in rows)


def _repeating(pad):
    rng = random.Random(3)
    block = [f"shared line {k} of a passage{pad}" for k in range(30)]
    rows = [(k, "\n".join([f"own {k} {j}{pad}" for j in range(rng.randrange(6))] + block[:rng.choice([30, 30, 7])] + [f"end {k}{pad}"])) for k in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, "\n \n".join(block[:3])), (None, rows[0][1]), (3, rows[3][1]), (54, f"z{pad}\n" * 20_000), (55, rows[0][1])]
    # a line alone between blank ones, a line before and after a passage that repeat elsewhere
    rows += [(60 + k, f"own {k}{pad}\n\nalone{pad}\n\nmore {k}{pad}") for k in range(3)]
    rows += [(70 + k, "\n".join(x + pad for x in t.split())) for k, t in enumerate(("Z A q1", "Z A B q2", "w3 A B q3"))]
    return rows


def test_line_dedup(spark):
    for pad, words in (("", 0), (" as a rather long line of ten words", L.PASSAGE_WORDS)):
        rows = _repeating(pad)
        docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")
        out = L.drop_repeated_chunks(docs, passage_words=words)
        got = out.collect()
        assert out.columns[:3] == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in got) == _clean(rows)
        text = {r["doc_id"]: r["text"] for r in got}
        assert all(text[i] == t for i, t in rows if i in (60, 61, 62, 70))
        assert [text[k].replace(pad, "").split() for k in (71, 72)] == [["A", "B", "q2"], ["w3", "q3"]]
        assert L.drop_repeated_chunks(docs.limit(0)).count() == 0


def test_boundaries_shift_with_the_text_and_every_passage_has_one():
    rng = random.Random(5)
    for _ in range(300):
        passage = [rng.randrange(1, 9) for _ in range(rng.randrange(2, 12))]
        lines = [b" ".join(b"%d_%d" % (rng.randrange(10**9), j) for j in range(n)) for n in passage]
        found = []
        for _ in range(2):
            head, tail = ([b"w%d" % rng.randrange(10**9)] * rng.randrange(5) for _ in range(2))
            text = head + lines + tail
            n = [len(x.split()) for x in text]
            cut = {a - len(head) for a in L.boundaries(text, n)}
            found.append({a for a in cut if 0 <= a <= len(lines) - L.WINDOW})
            if sum(passage) > L.PASSAGE_WORDS:
                # chunks and what they are extended by leave no gap in the passage
                held = set()
                for a in found[-1]:
                    l, r = L.around(n, a + len(head))
                    held |= set(range(a - l, a + L.WINDOW + r))
                assert held >= set(range(len(lines)))
        if sum(passage) > L.PASSAGE_WORDS:
            assert found[0] & found[1]
    roll = L.rolling([b"a", b"b", b"c", b"a", b"b"])
    assert roll[0] == roll[3] and len(set(roll)) == 3


def test_later_copies_of_passages_of_short_lines_go_whole(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows, want = [], {}
    for p in range(40):
        passage = [line(rng.randrange(1, 7)) for _ in range(3)]
        while sum(len(x.split()) for x in passage) <= L.PASSAGE_WORDS:
            passage.append(line(rng.randrange(1, 7)))
        for copy in range(3):
            head, tail = [line(3) for _ in range(rng.randrange(9))], [line(4) for _ in range(rng.randrange(9))]
            rows.append((10 * p + copy, "\n".join(head + passage + tail)))
            want[10 * p + copy] = "\n".join(head + tail) if copy else rows[-1][1]
    got = L.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want


def test_later_copies_of_short_passages_go_whole(spark):
    line = lambda *k: " ".join(f"w{'_'.join(map(str, k))}_{j}" for j in range(26))
    rows, want = [], {}
    for n in range(2, 7):
        for copy in range(3):
            i = 10 * n + copy
            head, tail = [line("own", i, k) for k in range(copy)], [line("end", i)]
            rows.append((i, "\n".join([*head, *[line("p", n, k) for k in range(n)], *tail])))
            want[i] = "\n".join(head + tail) if copy else rows[-1][1]
    rows += [(100 + k, "\n".join([line("a", k), line("single"), line("b", k)])) for k in range(3)]
    want |= dict(rows[-3:])
    got = L.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["__ld_removed_chunks"] == (r["doc_id"] < 100 and r["doc_id"] % 10 > 0) for r in got)
    assert sum(r["__ld_removed_lines"] for r in got) == 2 * sum(range(2, 7))


def test_removed_runs_count_against_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr("gatewatch.llm.common.BROADCAST_BYTES", 20_000)
    text = lambda k, runs: "\n".join(x for j in range(runs) for x in (f"p{j} " * 9, f"q{j} " * 9, f"own {k} {j}"))
    for runs, hinted in ((500, False), (5, True)):
        out = L.drop_repeated_chunks(spark.createDataFrame([(k, text(k, runs)) for k in range(3)], "doc_id long, text string"))
        assert ("strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()) == hinted
        assert sorted(r["__ld_removed_chunks"] for r in out.collect()) == [0, runs, runs]


def test_same_hash_other_bytes_stays(spark):
    line = lambda k: " ".join(f"v{k}_{j}" for j in range(12))
    rows = [(k, "\n".join(line((k, j)) for j in range(6))) for k in range(200)]  # 1000 chunks in 256 hashes
    docs = spark.createDataFrame(rows + [(300, rows[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.drop_repeated_chunks(docs, digest_bytes=1).collect()}
    assert all(got[k] == t for k, t in rows) and got[300] != rows[0][1]
    assert L.drop_repeated_chunks(docs).where("doc_id = 300").first()["text"] == ""


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 480)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["comp"] for r in CC.components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a
    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {a: find(a) for a in root}


def _near_docs():
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(5000)
    base = [word() for _ in range(200)]
    rows = []
    for k in range(60):  # a group with 0..12 edits: pairs on both sides of the threshold
        w = list(base)
        for _ in range(k % 13):
            w[rng.randrange(200)] = word()
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(word() for _ in range(rng.randrange(1, 80)))) for k in range(40)]
    rows += [(200, None), (201, ""), (202, "!!"), (203, "!!"), (204, "One two"), (205, "one, TWO."), (None, base and " ".join(base)), (100, rows[60][1]), (300, "rep " * 5000)]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = _near_docs()
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, digest string")
    texts = sorted({t or "" for _, t in rows})
    sh = {t: M.shingles(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t
    for k, a in enumerate(texts):
        for b in texts[:k]:
            if len(sh[a][0]) and M.probability_jaccard(sh[a], sh[b]) >= M.THRESHOLD:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            r = find(t or "")
            least[r] = min(least.get(r, i), i)
    got = Counter((r["id"], r["class_id"]) for r in M.near_duplicates(docs).collect())
    assert got == Counter((i, least[find(t or "")]) for i, t in rows)
    one = M.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(least.values())
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_and_one_id_with_two_texts_stay_apart(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)),
            (7, text(4)), (8, text(3)), (9, text(5)), (None, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in M.keep_one(docs).collect()) == sorted(
        [(0, text(0)), (0, text(1)), (0, text(2)), (7, text(3)), (7, text(4)), (9, text(5))])
    got = M.near_duplicates(docs).collect()
    assert len(got) == len(rows) and len({bytes(r["class_key"]) for r in got}) == 6
    assert sorted(Counter(bytes(r["class_key"]) for r in got).values()) == [1, 1, 2, 2, 2, 2]


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    x, y = (h[:45], rng.integers(1, 9, 45).astype(float)), (h[10:], rng.integers(1, 9, 50).astype(float))
    dx, dy = dict(zip(x[0].tolist(), x[1])), dict(zip(y[0].tolist(), y[1]))
    want = sum(1 / sum(max(dx.get(j, 0) / dx[i], dy.get(j, 0) / dy[i]) for j in set(dx) | set(dy)) for i in set(dx) & set(dy))
    assert abs(M.probability_jaccard(x, y) - want) < 1e-12
    m = 40_000
    s = M.probminhash(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), np.repeat([0, 1], [45, 50]), 2, m)
    assert abs((s[0] == s[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_machine_learns_an_interaction():
    """b alone and a alone are harmless, both together are toxic."""
    x = [[], [0], [1], [0, 1]] * 50
    m = T.fit_machine(x, [len(v) == 2 for v in x], [10, 11], steps=800)
    assert m.score([0, 1]) > 0.5 > max(m.score([0]), m.score([1]), m.score([]))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = T.fit(docs, labels)
    got = {r["doc_id"]: r["__tox_score"] for r in T.score(docs.select("doc_id", "text"), m, keep=["doc_id"]).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    hit = [r["toxic"] for r in held if got[r["doc_id"]] >= T.THRESHOLD]
    assert sum(hit) >= 0.9 * len(hit) and sum(hit) >= 0.75 * sum(r["toxic"] for r in held)


def test_toxicity_hard_cases(spark):
    docs = spark.createDataFrame([(k, "hello there" if k % 6 else "you idiot", "x") for k in range(60)] + [(None, None, "x"), (99, "", "x"), (99, "", "x"), (98, "a " * 300_000, "x")],
                                 "doc_id long, text string, b string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    for known, keep in ((labels, 54), (labels.limit(0), None), (labels.where("toxic = 1"), None)):
        m = T.fit(docs, known)
        out = T.score(docs, m).collect()
        assert len(out) == 64 and all(0 <= r["__tox_score"] <= 1 for r in out)
        if keep:
            assert T.drop_toxic(docs, m).count() == keep and T.drop_toxic(docs, m).columns == docs.columns
    assert T.score(docs.limit(0), m).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, before, SF), "t")
        ids = {r[0] for r in before.select("doc_id").collect()}
        assert {r[0] for r in after.select("doc_id").distinct().collect()} <= ids
        if name != "sharding":
            assert after.columns == docs.columns
        counts.append(after.count())
        before = after
    assert 1000 > counts[0] > counts[1] > counts[2] < counts[3] == counts[4]
