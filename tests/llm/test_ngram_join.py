"""The n-gram join against brute force over all pairs."""
import random

import numpy as np

from gatewatch.llm import ngram_join as J


def _set(t):
    w = [x.decode() for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()]
    return {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), (min(ids) if ids else None) if sets[k] else i))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(9)
    word = lambda: "W%d" % rng.randrange(3000)
    shared = [word() for _ in range(70)]
    rows = []
    for g in range(6):
        base = [word() for _ in range(rng.choice([12, 60, 200, 900]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join([word() for _ in range(rng.randrange(1, 30))] + shared) for _ in range(40)]
    rows += ["one", "One", "one two three", "ONE\ttwo\nthree", "one two three four", None, "", "  ", "x " * 20_000, "x x x x"]
    rows += [rows[0], rows[0].upper(), rows[20]]
    rows = [(1000 - k, t) for k, t in enumerate(rows)]
    return rows + [rows[3], (None, rows[5][1]), (None, "all null ids here now"), (None, "all null ids here now"), (None, None), (700, "own text of a repeated id"), (700, rows[0][1])]


def test_components_against_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n long, token string")
    want = _brute(rows)
    assert len({c for _, _, c in want}) > 20
    for args in ({}, {"block": 4, "hot_size": 5}):
        got = sorted(((r["id"], r["n"], r["component_id"]) for r in J.link_documents(docs, **args).collect()), key=str)
        assert got == want
    assert J.link_documents(docs.limit(0)).count() == 0


def _pairs(sets, percent):
    return {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if J.links(sets[a], sets[b], percent)}


def test_traversal_prunes_and_loses_no_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, rng.integers(5, 400), dtype=np.uint64)
        for _ in range(8):
            keep = rng.random(len(base)) > rng.choice([0, .02, .05, .2])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)])))
    size = np.array([len(s) for s in sets])
    bits = np.stack([np.frombuffer(J.bitmap(s), np.uint64) for s in sets])
    n = len(sets)
    for percent in (85, 60):
        want = _pairs(sets, percent)
        x, y = J.tree_pairs(np.zeros(n, int), np.full(n, 2), np.arange(n), size, bits, np.arange(n), percent)
        got = set(zip(x.tolist(), y.tolist()))
        assert want <= got and len(got) < n * (n - 1) / 4
        side = rng.integers(0, 2, n)  # two trees
        x, y = J.tree_pairs(np.zeros(n, int), side, np.arange(n), size, bits, np.arange(n), percent)
        assert {p for p in want if side[p[0]] != side[p[1]]} <= set(zip(x.tolist(), y.tolist())) and all(side[x] != side[y])
    # one component: nothing is left to do
    assert not len(J.tree_pairs(np.zeros(n, int), np.full(n, 2), np.arange(n), size, bits, np.zeros(n, int))[0])


def test_fine_bitmaps_lose_no_link():
    rng = np.random.default_rng(5)
    pruned = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, rng.integers(1, 1500), dtype=np.uint64)
        x = np.unique(base[rng.random(len(base)) > rng.choice([0, .05, .3])])
        y = np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, .05, .3])], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
        ok = J.may_overlap(J.fine_bitmap(x), J.fine_bitmap(y), len(x), len(y))
        assert ok or not J.links(x, y)
        pruned += not ok
    assert pruned > 50


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 500, rng.integers(1, 60), dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > .06], rng.integers(0, 500, rng.integers(0, 5), dtype=np.uint64)]))
        hot = np.unique(rng.integers(0, 500, rng.integers(0, 200), dtype=np.uint64))
        if len(x) and len(y) and J.links(x, y):
            assert set(J.prefix(x, hot).tolist()) & set(J.prefix(y, hot).tolist())


def _cluster(rng, count=24, length=600):
    base = np.unique(rng.integers(0, 2**63, length, dtype=np.uint64))
    return [np.unique(np.concatenate([base[rng.random(len(base)) > .04], rng.integers(0, 2**63, 8, dtype=np.uint64)])) for _ in range(count)]


def test_pair_of_many_trees_leaves_one():
    rng = np.random.default_rng(6)
    sets = _cluster(rng) + [s for _ in range(6) for s in _cluster(rng, 1, 3000)]
    none = np.empty(0, np.uint64)
    trees: dict = {}
    for k, s in enumerate(sets):
        for t in J.prefix(s, none).view(np.int64).tolist():
            trees.setdefault(t, []).append(k)
    trees[7] = list(range(24, 30))  # long texts that share one shingle by chance
    order = sorted((t for t in trees if len(trees[t]) > 1), key=lambda t: (-len(trees[t]), t))
    tops = [[t for t in order if k in trees[t]][:J.TOPS] for k in range(len(sets))]
    bits = [J.fine_bitmap(s, J.LEAF_BITS) for s in sets]
    seen, plain = [], 0
    for t in order:  # each tree alone, as in tasks of their own
        of = np.array(trees[t])
        n = np.array([len(sets[k]) for k in of])
        zero, two = np.zeros(len(of), int), np.full(len(of), 2)
        coarse = np.stack([np.frombuffer(J.bitmap(sets[k]), np.uint64) for k in of])
        plain += len(J.tree_pairs(zero, two, of, n, coarse, of)[0])
        x, y = J.leaf_pairs(np.full(len(of), t), zero, two, of, n, of, [bits[k] for k in of],
                            np.array([u for k in of for u in tops[k]]), np.array([len(tops[k]) for k in of]))
        seen += list(zip(x.tolist(), y.tolist()))
    want = _pairs(sets, 85)
    assert len(want) > 100 and want <= set(seen)
    assert len(seen) < 1.2 * len(set(seen)) and len(seen) < plain / 20
    assert not any(x >= 24 for x, _ in seen)


def test_bitmaps_of_several_lengths_agree_with_the_pairwise_test():
    rng = np.random.default_rng(8)
    sets = [s for n in (3, 100, 240, 300, 700, 1500, 2500, 6000) for s in _cluster(rng, 3, n)]
    bits, n = [J.fine_bitmap(s, J.LEAF_BITS) for s in sets], np.array([len(s) for s in sets])
    fine = J.Bitmaps(bits, n)
    assert max(map(len, bits)) == J.LEAF_BITS // 8 and (fine.coarse == np.stack([np.frombuffer(J.bitmap(s), np.uint64) for s in sets])).all()
    a, b = (v.ravel() for v in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    ok = fine.may_link(a, b, 85)
    for i, j, k in zip(a.tolist(), b.tolist(), ok.tolist()):
        if min(len(bits[i]), len(bits[j])) > J.BITS // 8:
            assert k == J.may_overlap(bits[i], bits[j], n[i], n[j])
        else:
            assert k


def test_rounds_of_dealing_make_a_row_once():
    rng = np.random.default_rng(2)
    none = np.empty(0, np.uint64)
    for s in _cluster(rng, 20, 200):
        before, held, made = none, set(J.prefix(s, none).tolist()), 0
        for round_ in range(4):  # most of what it is dealt by becomes hot
            cold = np.setdiff1d(J.prefix(s, before), before)
            more = cold[rng.random(len(cold)) < .8]
            hot = np.union1d(before, more)
            now = J.fresh(s, hot, more, before)
            held = held - set(more.tolist())
            assert not held & set(now.tolist())
            held |= set(now.tolist())
            made += len(now)
            assert set(J.prefix(s, hot).tolist()) <= held
            before = hot
        assert made < 4 * len(J.prefix(s, none))


def test_shingles_of_the_same_nodes_are_one_tree(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    rows = []
    for g in range(20):
        base = text(300)
        rows += [(10 * g + k, f"{base} {text(5)}") for k in range(3)]
    kept, real = {}, J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, name: kept.setdefault(name, real(df, name)) if name in ("join-trees", "join-dealt") else real(df, name))
    out = J.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["id"] // 10 * 10 for r in out)
    assert kept["join-dealt"].count() > 1000 and kept["join-trees"].count() < 60


def test_near_copies_are_dealt_anew_once():
    rng = np.random.default_rng(11)
    sets, none = _cluster(rng, 400, 200), np.empty(0, np.uint64)
    token, count = J.shared(sets)
    hot = np.sort(token[count > 100])
    assert len(hot) > 150 and not len(J.shared(sets[:1])[0]) and not len(J.shared([])[0])
    dealt = [J.prefix(s, hot) for s in sets]
    # all that they are dealt by is their own or known as hot: nothing is left for a second round
    token, count = np.unique(np.concatenate([p[~np.isin(p, hot)] for p in dealt]), return_counts=True)
    assert count.max() <= 100
    assert sum(len(J.fresh(s, hot, hot, none)) for s in sets) <= sum(map(len, dealt))
