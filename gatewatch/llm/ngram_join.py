"""Jaccard join of word n-gram sets by signature trees.

A document's set holds its distinct ``SHINGLE``-word shingles (A-Z lower-cased,
words split at white space; the whole sequence if it is shorter). Two documents
link when 100 * |both| >= PERCENT * |either|; components of links are classes.

1. Equal sets are one node. A shingle is a 64-bit hash.
2. Of two sets that link, the smallest n - ceil(PERCENT n / 100) + 1 shingles of
   either, in any order that all sets share, have one in common. So the
   documents are dealt by those shingles, one tree per shingle that at least
   two nodes hold. The order is by hash, but shingles held by more than ``HOT``
   nodes (boilerplate; at most ``MOST_HOT`` of them, the most frequent) come
   last, so a tree is large only for documents that consist of boilerplate.
   Which shingles come last changes the work, never the result. Shingles held
   by the same nodes, as copies have many, make one tree.
3. Signature trees: leaves are documents with a bitmap of ``BITS`` bits of their
   shingles and their set size, ordered by size; a node holds the OR of its
   children's bitmaps, their size range, and the largest number of shingles
   that share a bit in one document (the excess). Two documents under nodes a
   and b have at most popcount(or_a & or_b) + min(excess_a, excess_b) shingles
   in common. The dual traversal goes down pairs of nodes and prunes those
   whose size ranges are too far apart, or where that maximum is under the
   overlap that the smallest sizes need.
4. Pairs of leaves are tested once more before they leave the task, by the same
   bound, with bitmaps of at least twice as many bits as shingles (folded to one
   length; ``LEAF_BITS`` at most), and longer texts again with bitmaps of any
   length, which keeps texts out of the shuffle; the rest is verified exactly on
   the whole sets.
5. The traversal runs twice. First every document that is the first of trees
   meets all that share one of them, each once, and what links is joined to
   components. Then the trees that still hold more than one component are
   traversed against themselves, where node pairs of one and the same component
   are pruned too. So copies are not expanded into pairs and no link between
   components is lost. A pair that shares several trees leaves one of them only:
   documents carry the ``TOPS`` largest of their trees, and a tree passes over a
   pair that has met in a larger one of these.

Trees of more than ``BLOCK`` documents are cut into blocks by a hash of the
node; a task holds one or two blocks. Many small trees are walked at once,
level by level, as arrays.

Texts without words, null texts included, have an empty set and link with
nothing. Null ids are allowed: a class whose ids are all null has a null
component. Repeated rows have equal sets. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import broadcast_if_small, materialize, prepare
from gatewatch.llm.components import components
from gatewatch.llm.minhash import _mix, _power_tables

SHINGLE = 4
PERCENT = 85
BITS = 512
HOT = 256
MOST_HOT = 1 << 18
HOT_ROUNDS = 4
BLOCK = 1024
FAN = 4
LEAF_BITS = 4096
TOPS = 8
#: Node pairs that a traversal expands at a time.
CHUNK = 1 << 14

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)

#: Bytes of a word: A-Z lower-cased, white space as a separator.
WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else 32 if c in b" \t\n\x0b\x0c\r" else c) for c in range(256))


# ---- sets --------------------------------------------------------------------

def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct shingles as sorted hashes."""
    if not text:
        return np.empty(0, _U)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(WORD_BYTES), np.uint8)
    edge = np.diff(np.concatenate([[False], b != 32, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        power, inverse = _power_tables(len(b) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(b.astype(_U) * power[:len(b)], dtype=_U)])
        w = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(_U))
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, _U(k))
        for j in range(k):
            h = (h ^ w[j:j + len(h)]) * _ODD
            h ^= h >> _U(29)
        return np.unique(_mix(h))


def prefix(shingles: np.ndarray, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles by which a set is dealt: smallest hashes first, hot last."""
    n = len(shingles)
    if not n:
        return shingles
    size = n + (-percent * n) // 100 + 1
    if not len(hot):
        return shingles[:size]
    is_hot = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] == shingles
    return np.concatenate([shingles[~is_hot], shingles[is_hot]])[:size]


def fresh(shingles: np.ndarray, order: np.ndarray, more: np.ndarray, before: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles by which a set is dealt with ``order`` last but was not with
    ``before`` last, and those of them that became hot by now (``more``)."""
    now = prefix(shingles, order, percent)
    return now[np.isin(now, more) | ~np.isin(now, prefix(shingles, before, percent))]


def shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least two and an eighth of the sets hold, and how
    many hold them."""
    token, count = np.unique(np.concatenate([np.empty(0, _U), *sets]), return_counts=True)
    often = count >= max(2, len(sets) // 8)
    return token[often], count[often]


def bitmap(shingles: np.ndarray) -> bytes:
    return fine_bitmap(shingles, BITS)


def fine_bitmap(shingles: np.ndarray, most: int | None = None) -> bytes:
    """As many bits as the next power of two over twice the set's size, but not
    more than ``most``, a power of two."""
    width = max(BITS, 1 << (2 * len(shingles)).bit_length())
    width = min(width, most or width)
    seen = np.zeros(width, np.uint8)
    seen[(shingles >> _U(8)) & _U(width - 1)] = 1
    return np.packbits(seen, bitorder="little").tobytes()


def may_overlap(x: bytes, y: bytes, nx: int, ny: int, percent: int = PERCENT) -> bool:
    """Whether two sets of these sizes and fine bitmaps may link."""
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    most = int(np.bitwise_count(a & b).sum()) + min(nx - int(np.bitwise_count(a).sum()), ny - int(np.bitwise_count(b).sum()))
    return (100 + percent) * most >= percent * (nx + ny)


def links(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


# ---- signature trees -----------------------------------------------------------

class Bitmaps:
    """Fine bitmaps of several lengths, each folded to all shorter ones;
    ``coarse`` has them at BITS bits."""

    def __init__(self, bits: list[bytes], size: np.ndarray):
        words = np.array([len(b) // 8 for b in bits])
        flat, start = np.frombuffer(b"".join(bits), _U), np.cumsum(words) - words
        self.size, self.level = size, np.round(np.log2(words * 64 / BITS)).astype(np.int64)
        self.folded: dict = {}
        for k in range(int(self.level.max()), -1, -1):
            rows, width = np.flatnonzero(self.level == k), BITS // 64 << k
            held = flat[start[rows][:, None] + np.arange(width)]
            if k + 1 in self.folded:
                longer = self.folded[k + 1]
                rows, held = np.concatenate([rows, longer["rows"]]), np.concatenate([held, longer["bits"][:, :width] | longer["bits"][:, width:]])
            at = np.zeros(len(words), np.int64)
            at[rows] = np.arange(len(rows))
            self.folded[k] = dict(rows=rows, bits=held, at=at, excess=size[rows] - np.bitwise_count(held).sum(1, dtype=np.int64))
        self.coarse = self.folded[0]["bits"][self.folded[0]["at"]]

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows may link; BITS bits are not tested again."""
        ok, level = np.ones(len(a), bool), np.minimum(self.level[a], self.level[b])
        for k in range(1, int(level.max(initial=0)) + 1):
            of, x = np.flatnonzero(level == k), self.folded[k]
            for c in range(0, len(of), CHUNK):
                p = of[c:c + CHUNK]
                i, j = x["at"][a[p]], x["at"][b[p]]
                most = np.bitwise_count(x["bits"][i] & x["bits"][j]).sum(1, dtype=np.int64) + np.minimum(x["excess"][i], x["excess"][j])
                ok[p] = (100 + percent) * most >= percent * (self.size[a[p]] + self.size[b[p]])
        return ok


class Tops:
    """The first trees of each row, in an order that all rows share, up to the
    tree that the row stands in."""

    def __init__(self, tree: np.ndarray, first: np.ndarray, count: np.ndarray):
        here = np.arange(TOPS) < count[:, None]
        self.first = np.zeros((len(tree), TOPS), np.int64)
        self.first[here] = first
        self.before = here & ~np.logical_or.accumulate(here & (self.first == tree[:, None]), axis=1)

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows of one tree share a tree before it."""
        out = np.zeros(len(a), bool)
        for c in range(0, len(a), CHUNK):
            i, j = a[c:c + CHUNK], b[c:c + CHUNK]
            for k in range(TOPS):
                out[c:c + CHUNK] |= self.before[i, k] & ((self.first[j] == self.first[i, k][:, None]) & self.before[j]).any(1)
        return out


class Forest:
    """Signature trees over documents sorted by (tree, size); ``levels`` goes
    from documents to roots, with one root per tree."""

    def __init__(self, tree: np.ndarray, size: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        excess = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [dict(tree=tree, lo=size, hi=size, bits=bits, excess=excess, first=comp, last=comp, begin=None, end=None)]
        while len(tree) and (tree[1:] == tree[:-1]).any():
            below = self.levels[-1]
            start = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            place = np.arange(len(tree)) - np.repeat(start, np.diff(np.append(start, len(tree))))
            begin = np.flatnonzero(place % FAN == 0)
            end = np.append(begin[1:], len(tree))
            tree = tree[begin]
            self.levels.append(dict(
                tree=tree, lo=np.minimum.reduceat(below["lo"], begin), hi=np.maximum.reduceat(below["hi"], begin),
                bits=np.bitwise_or.reduceat(below["bits"], begin, axis=0), excess=np.maximum.reduceat(below["excess"], begin),
                first=np.minimum.reduceat(below["first"], begin), last=np.maximum.reduceat(below["last"], begin), begin=begin, end=end))

    def may_link(self, k: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs of level k may hold a pair that links."""
        x = self.levels[k]
        near = (100 * x["hi"][a] >= percent * x["lo"][b]) & (100 * x["hi"][b] >= percent * x["lo"][a])
        one = (x["first"][a] == x["last"][a]) & (x["first"][a] == x["first"][b]) & (x["first"][b] == x["last"][b])
        keep = np.flatnonzero(near & ~one)
        i, j = a[keep], b[keep]
        most = np.bitwise_count(x["bits"][i] & x["bits"][j]).sum(1, dtype=np.int64) + np.minimum(x["excess"][i], x["excess"][j])
        # both / (sizes - both) >= p / 100, with sizes as small as they may be
        ok = np.zeros(len(a), bool)
        ok[keep] = (100 + percent) * most >= percent * (x["lo"][i] + x["lo"][j])
        return ok

    def traverse(self, a: np.ndarray, b: np.ndarray, percent: int = PERCENT):
        """Yields (i, j) arrays of documents that may link, below the pairs of
        roots a, b; a pair of equal roots is a tree against itself."""
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            k, a, b = todo.pop()
            if len(a) > CHUNK:
                todo += [(k, a[c:c + CHUNK], b[c:c + CHUNK]) for c in range(0, len(a), CHUNK)]
                continue
            ok = self.may_link(k, a, b, percent) if k else self.may_link(k, a, b, percent) & (a != b)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if not k:
                yield a, b
                continue
            begin, end = self.levels[k]["begin"], self.levels[k]["end"]
            na, nb = end[a] - begin[a], end[b] - begin[b]
            of = np.repeat(np.arange(len(a)), na * nb)
            step = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = begin[a][of] + step // nb[of], begin[b][of] + step % nb[of]
            ordered = (a != b)[of] | (i <= j)
            todo.append((k - 1, i[ordered], j[ordered]))


def tree_pairs(group: np.ndarray, side: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, comp: np.ndarray,
               percent: int = PERCENT, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of nodes that may link, of many groups at once. In a
    group, side 2 is one tree against itself; sides 0 and 1 are two trees.
    ``keep`` tells which pairs of rows to return."""
    order = np.lexsort((node, size, side, group))
    group, side, node = group[order], side[order], node[order]
    tree = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (side[1:] != side[:-1])]))
    forest = Forest(tree, size[order], bits[order], comp[order])
    first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    of, kind = group[first], side[first]
    alone = np.flatnonzero(kind == 2)
    left = np.flatnonzero((kind[:-1] == 0) & (kind[1:] == 1) & (of[1:] == of[:-1]))
    found = []
    for i, j in forest.traverse(np.concatenate([alone, left]), np.concatenate([alone, left + 1]), percent):
        ok = keep(order[i], order[j]) if keep else slice(None)
        found.append((node[i[ok]], node[j[ok]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = (np.concatenate(p) for p in zip(*found))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def leaf_pairs(tree: np.ndarray, group: np.ndarray, side: np.ndarray, node: np.ndarray, size: np.ndarray, comp: np.ndarray, bits: list[bytes],
               first: np.ndarray, count: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """``tree_pairs`` by fine bitmaps, without the pairs that met in a tree
    before; ``first`` has the ``count`` first trees of all rows."""
    fine, tops = Bitmaps(bits, size), Tops(tree, first, count)

    def keep(a, b):
        ok = np.flatnonzero(~tops.met(a, b))
        return ok[fine.may_link(a[ok], b[ok], percent)]

    return tree_pairs(group, side, node, size, fine.coarse, comp, percent, keep)


# ---- Spark ---------------------------------------------------------------------

def sets_of(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, text_key, key, n, tokens, bits, fine) of every row: digests of the
    text and of the set, set size, the shingles it is dealt by, its bitmap of up
    to LEAF_BITS bits and, where that is shorter than the whole one, the latter."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    none = np.empty(0, _U)

    def run(batches):
        for batch in batches:
            made: list = [[], [], [], [], []]
            for text in batch.column(2):
                s = shingle_set(text.as_py())
                for out, v in zip(made, (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), prefix(s, none, percent).view(np.int64), fine_bitmap(s, LEAF_BITS), fine_bitmap(s) if 2 * len(s) >= LEAF_BITS else None)):
                    out.append(v)
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(made, kinds)]],
                                             names=["id", "text_key", "key", "n", "tokens", "bits", "fine"])

    return src.mapInArrow(run, T.StructType([
        src.schema["id"], T.StructField("text_key", T.BinaryType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("fine", T.BinaryType())]))


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes, by their row's id and text digest.
    Where rows with both repeat, one of them is taken."""
    want = nodes.join(wanted.distinct(), "node").select("node", "same", F.col("rep.text_key").alias("_t"), F.col("rep.id").alias("_r"))
    want = materialize(want, "join-wanted")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("_m", F.unhex(F.md5("text")))
    hit = src.join(broadcast_if_small(want, 48), (F.col("_m") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_r")))
    return hit.where("same = 1").select("node", "text").unionByName(hit.where("same > 1").select("node", "text").dropDuplicates(["node"]))


def dealt(docs: DataFrame, nodes: DataFrame, rows: DataFrame, id_col: str, text_col: str, percent: int, hot_size: int = HOT) -> DataFrame:
    """(node, token) rows of the shingles that may have a tree, after the hot
    ones were put last: shingles that too many nodes are dealt by are found,
    the nodes they touch are dealt anew, and again for what has become hot by
    that. Groups of near copies would meet in other shingles each time: at the
    first round the shingles that many touched nodes share, dealt by them or
    not, are hot too. A round makes only the rows that a node did not have; rows that hot
    ones push out later may stay, they add no pair that does not link. ``rows``
    is (node, token) in the order of hashes. At most MOST_HOT shingles are
    collected."""
    spark = docs.sparkSession
    counts = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "join-counts")
    hot, often, moved = np.empty(0, np.int64), counts, None
    named = lambda values: F.broadcast(spark.createDataFrame([(int(v),) for v in values], "token long"))

    def anew(order, more, before):
        def run(batches):
            for batch in batches:
                node, token = [], []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    now = fresh(shingle_set(text.as_py()), order, more, before, percent)
                    node.append(np.full(len(now), k, np.int64))
                    token.append(now.view(np.int64))
                if node:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(token))], names=["node", "token"])
        return run

    def together(batches):
        for batch in batches:
            token, c = shared([shingle_set(text.as_py()) for text in batch.column(1)])
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(c, pa.int64())], names=["token", "c"])

    for _ in range(HOT_ROUNDS):
        top = often.where(F.col("c") > hot_size).orderBy(F.desc("c"), "token").limit(MOST_HOT).select("token").collect()
        more = np.setdiff1d(np.array([r["token"] for r in top], np.int64), hot)[:MOST_HOT - len(hot)]
        if not len(more):
            break
        now = rows if moved is None else rows.unionByName(moved)
        if moved is None:
            touched = now.join(named(more), "token", "left_semi").select("node")
            wide = texts_of(docs, nodes, touched, id_col, text_col).mapInArrow(together, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
            top = wide.where(F.col("c") > hot_size).orderBy(F.desc("c"), "token").limit(MOST_HOT).select("token").collect()
            also = np.array([r["token"] for r in top], np.int64)
            more = np.union1d(more, also[~np.isin(also, more)][:MOST_HOT - len(more)])
        before, hot = hot, np.union1d(hot, more)
        touched = materialize(now.join(named(more), "token", "left_semi").select("node").distinct(), "join-touched")
        # what a touched node is dealt by besides what it was dealt by
        made = texts_of(docs, nodes, touched, id_col, text_col).mapInArrow(
            anew(*(np.sort(v.view(_U)) for v in (hot, more, before))), "node long, token long")
        moved = materialize(made if moved is None else moved.join(named(more), "token", "left_anti").unionByName(made), "join-moved")
        often = moved.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    if moved is None:
        return rows.join(counts.select("token"), "token", "left_semi")
    cold = rows.join(named(hot), "token", "left_anti")
    alive = counts.select("token").union(moved.select("token")).distinct()
    return cold.unionByName(moved.distinct()).join(alive, "token", "left_semi")


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (x, y) that may link, from rows (token, i, j, side, node, n,
    comp, bits, tops): one pair of trees per (token, i, j)."""
    cols = ["token", "i", "j", "side", "node", "n", "comp", "bits", "tops"]

    def walk(parts):
        token, i, j, side, node, n, comp = (np.concatenate([np.asarray(p.column(c).to_numpy(zero_copy_only=False), np.int64) for p in parts]) for c in range(7))
        bits = [v for p in parts for v in p.column(7).to_pylist()]
        first, count = (np.concatenate([np.asarray(f(p.column(8)), np.int64) for p in parts]) for f in (lambda c: c.flatten(), lambda c: c.value_lengths()))
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        x, y = leaf_pairs(token, group, side, node, n, comp, bits, first, count, percent)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last group of a batch is complete
            keys = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(3)]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            same = held and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in range(3))
            if held and not (same and not cut):
                yield walk([*held, batch.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield walk([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield walk(held)

    spread = rows.select(*cols).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return spread.mapInArrow(run, "x long, y long").distinct()


def refine(pairs: DataFrame, fine: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their fine bitmaps (node, n, fine)."""
    a = fine.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("fine").alias("fx"))
    b = fine.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("fine").alias("fy"))

    def run(batches):
        for batch in batches:
            ok = [may_overlap(fx, fy, nx, ny, percent) for nx, fx, ny, fy in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["x", "y"])

    return pairs.join(a, "x").join(b, "y").select("x", "y", "nx", "fx", "ny", "fy").mapInArrow(run, "x long, y long")


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""
    a = texts.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    b = texts.select(F.col("node").alias("y"), F.col("text").alias("ty"))

    def run(batches):
        held: dict = {}

        def of(k, t):
            if k not in held:
                if len(held) >= 64:
                    held.clear()
                held[k] = shingle_set(t)
            return held[k]

        for batch in batches:
            x, y, tx, ty = batch.columns
            ok = [links(of(p, tx[k].as_py()), of(q, ty[k].as_py()), percent) for k, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist()))]
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([x.take(at), y.take(at)], names=["x", "y"])

    return pairs.join(a, "x").join(b, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK, hot_size: int = HOT) -> DataFrame:
    """(id, n, key, component, component_id) of every row: set size, the set's
    digest, the class (null for an empty set) and its smallest id (the row's
    own for an empty set)."""
    rows = materialize(sets_of(docs, id_col, text_col, percent).withColumn("row", F.monotonically_increasing_id()), "join-sets")
    same = rows.where("n > 0").groupBy("key", "id", "text_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("same"))
    rep = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "text_key", "same"))
    nodes = same.groupBy("key").agg(rep.alias("rep")).select("key", "rep", F.col("rep.row").alias("node"), F.col("rep.same").alias("same"))
    nodes = materialize(nodes, "join-nodes")
    of_nodes = rows.withColumnRenamed("row", "node").join(broadcast_if_small(nodes.select("node"), 8), "node", "left_semi")
    dealt_rows = dealt(docs, nodes, of_nodes.select("node", F.explode("tokens").alias("token")), id_col, text_col, percent, hot_size)
    dealt_rows = materialize(dealt_rows, "join-dealt")
    # shingles held by the same nodes are one tree
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    trees = dealt_rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("low"), *marks).where("c > 1")
    trees = trees.groupBy("c", "low", "m0", "m1").agg(F.min("token").alias("token")).select("token", "c", "low")
    trees = materialize(trees, "join-trees")
    members = materialize(dealt_rows.join(trees, "token").withColumn("nb", F.ceil(F.col("c") / block)).withColumn("blk", F.expr("pmod(xxhash64(node), nb)")), "join-members")
    held = of_nodes.select("node", "n", "bits", "fine").join(broadcast_if_small(members.select("node").distinct(), 8), "node", "left_semi")
    held = materialize(held, "join-signatures")
    signed, fine = held.select("node", "n", "bits"), held.select("node", "n", F.coalesce("fine", "bits").alias("fine"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = materialize(refine(pairs, fine, percent), "join-refined")
        ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y"))
        return materialize(verify(pairs, texts_of(docs, nodes, ends, id_col, text_col), percent), "join-links")

    # first: the first document of trees against all that share one of them
    near = materialize(members.where("node <> low").select(F.col("low").alias("token"), "node").distinct(), "join-near")
    stars = near.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).alias("nb"))
    firsts = stars.select("token", F.col("token").alias("node"), F.explode(F.expr("sequence(0L, nb - 1)")).alias("i"), F.lit(0).alias("side"))
    others = near.join(stars, "token").select("token", "node", F.expr("pmod(xxhash64(node), nb)").alias("i"), F.lit(1).alias("side"))
    seed = firsts.unionByName(others).withColumn("j", F.col("i")).join(signed, "node").withColumn("comp", F.col("node"))
    pairs = materialize(candidates(seed.withColumn("tops", F.expr("cast(array() as array<long>)")), percent), "join-pairs")
    first = linked(pairs)
    label = components(first)
    # then: trees of more than one component against themselves
    named = members.where("c > 2").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = materialize(named.select("token", "node", "c", "nb", "blk", "comp"), "join-named")
    mixed = named.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
    mixed = materialize(named.join(mixed, "token", "left_semi"), "join-mixed")
    tops = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "token"))), 1, TOPS)["token"]
    signed = signed.join(mixed.groupBy("node").agg(tops.alias("tops")), "node")
    rest = mixed.withColumn("o", F.explode(F.expr("sequence(0L, nb - 1)")))
    rest = rest.select("token", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "node", "comp",
                       F.when(F.col("blk") == F.col("o"), F.lit(2)).when(F.col("blk") < F.col("o"), F.lit(0)).otherwise(F.lit(1)).alias("side"))
    more = linked(candidates(rest.join(signed, "node"), percent).join(pairs, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        label = components(first.unionByName(more))
    named = nodes.select("key", "node", F.col("rep.id").alias("rep_id")).join(label, "node", "left").select("key", "rep_id", F.coalesce("comp", "node").alias("component"))
    named = materialize(named, "join-components")
    named = named.join(named.groupBy("component").agg(F.min("rep_id").alias("low_id")), "component").select("key", "component", "low_id")
    own = rows.select("id", "n", "key").join(named, "key", "left")
    return own.select("id", "n", "key", "component", F.when(F.col("n") > 0, F.col("low_id")).otherwise(F.col("id")).alias("component_id"))
