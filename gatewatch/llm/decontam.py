"""Benchmark decontamination with training suffix arrays.

Each task turns its documents, Arrow batch by Arrow batch, into shards: word
ids with a separator after every document, and a suffix array of the shard,
sorted by prefix doubling. A word that occurs in no test item separates, too:
no match can cross it, and no suffix that starts with it can match, so such
suffixes are left out of the array (nothing that could match is). Every test
suffix is binary-searched in every shard: the range of suffixes that start
with its window gives all places of the window, the neighbours of its place
give its longest match. Documents are never shuffled.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters.
A window is 13 words of an item, or the whole item if it has fewer. A document
is contaminated when at least one in 20 of its words lies in a window.

The test set is a stated query set. It is taken in blocks of at most
``BLOCK_BYTES`` of text, each broadcast; with several blocks the documents
pass once per block and carry the words hit so far as a bitmap.

Null and empty texts have no words and are never contaminated; items without
words are ignored; repeated documents and items are judged each, repeated
item_ids count once. Text columns are whole; the memory of a task is a shard
(``SHARD_BYTES`` of text, or one longer document). All columns of the input
pass through untouched; results carry a ``__dc_`` prefix until selected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.common import prepare, tokens

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
#: contaminated: SHARE * hit words >= words
SHARE = 20


class TestBlock:
    """Suffixes of some test items: one flat array of word ids with a 0 after
    every item, and where each suffix begins and ends. Memory is linear in the
    words (a window's words are held once per distinct window)."""

    __test__ = False

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        sizes = np.array([len(ws) for _, ws in items], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1 if len(items) else np.empty(0, np.int64)
        self.depth = int(sizes.max()) if len(items) else 1
        self.flat = np.zeros(int((sizes + 1).sum()), np.int32)
        for (_, ws), a in zip(items, begin.tolist()):
            self.flat[a:a + len(ws)] = [self.vocab[x] for x in ws]
        self.names = [i for i, _ in items]
        self.starts = np.concatenate([np.arange(a, a + n) for a, n in zip(begin, sizes)]) if len(items) else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(items)), sizes)  # item of a suffix
        self.ends = np.repeat(begin + sizes, sizes)
        self.offset = self.starts - np.repeat(begin, sizes)
        self.lens = self.ends - self.starts
        # distinct windows, and the suffixes that start with each
        width = np.minimum(window, np.repeat(sizes, sizes))
        full = np.flatnonzero(self.lens >= width)
        self.width = int(width.max()) if len(width) else 1
        words = self.words(full, width[full], self.width)
        self.wmatrix, back = np.unique(words, axis=0, return_inverse=True) if len(full) else (words, np.empty(0, np.int64))
        order = np.argsort(back.reshape(-1), kind="stable")
        self.wrows = full[order]
        self.wbegin = np.concatenate([[0], np.cumsum(np.bincount(back.reshape(-1), minlength=len(self.wmatrix)))]).astype(np.int64)
        self.wlens = (self.wmatrix > 0).sum(1).astype(np.int64)

    def words(self, rows: np.ndarray, lens: np.ndarray, width: int) -> np.ndarray:
        """The first ``lens`` words of some suffixes as a matrix, 0 beyond."""
        span = np.arange(width)
        at = np.minimum(self.starts[rows][:, None] + span, max(len(self.flat) - 1, 0))
        return np.where(span < lens[:, None], self.flat[at], 0).astype(np.int32) if len(rows) else np.zeros((0, width), np.int32)


class SuffixArray:
    """Suffixes of ``ids`` that start with a known word (id over 0), in order
    of their first ``depth`` words; 0 ends a suffix."""

    def __init__(self, ids: np.ndarray, vocab: int, depth: int):
        n = len(ids)
        self.ids = np.concatenate([ids, np.zeros(depth + 64, np.int32)])
        pos = np.flatnonzero(ids)
        bits = max(1, int(vocab).bit_length())
        self.packed = k = max(1, min(62 // bits, depth))
        self.bits = bits
        key, alive = self.ids[pos].astype(np.int64), np.ones(len(pos), bool)
        for j in range(1, k):
            nxt = self.ids[pos + j]
            alive &= nxt > 0
            key = (key << bits) | np.where(alive, nxt, 0)
        order = np.argsort(key, kind="stable")
        self.sa, self.keys = pos[order], key[order]
        if not len(pos):
            return
        zeros = np.flatnonzero(self.ids == 0)
        first = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        rank = np.zeros(n + depth + 64, np.int64)
        rank[self.sa] = start + 1
        h, open_ = k, None
        while h < depth:
            if open_ is None:
                size = np.diff(np.concatenate([np.flatnonzero(first), [len(first)]]))
                open_ = np.flatnonzero(np.repeat(size > 1, size))
            p = self.sa[open_]
            ends = zeros[np.searchsorted(zeros, p)]
            keep = ends - p > h  # a suffix that ended cannot be told apart further
            open_, p = open_[keep], p[keep]
            if not len(open_):
                break
            group = rank[p]
            second = rank[p + h]
            order = np.lexsort((second, group))
            p, group, second = p[order], group[order], second[order]
            self.sa[open_] = p
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            rank[p] = open_[begin] + 1
            size = np.diff(np.concatenate([np.flatnonzero(new), [len(new)]]))
            open_ = open_[np.repeat(size > 1, size)]
            h *= 2

    def _packed(self, q: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key range of the suffixes that agree in the packed words."""
        k = min(self.packed, q.shape[1])
        low = np.zeros(len(q), np.int64)
        for j in range(k):
            low = (low << self.bits) | q[:, j]
        low <<= self.bits * (self.packed - k)
        free = np.maximum(self.packed - lens, 0)
        return low, low + (np.int64(1) << (self.bits * free)) - 1

    def bounds(self, q: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last place of the suffixes that start with the
        first ``lens`` words of each row of ``q``, by binary search."""
        low, high = self._packed(q, lens)
        lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        return self._search(q, lens, lo, hi, False), self._search(q, lens, lo, hi, True)

    def _search(self, q, lens, lo, hi, right):
        lo, hi = lo.copy(), hi.copy()
        todo = np.flatnonzero((lo < hi) & (lens > self.packed))
        done_hi = (lens <= self.packed)
        span = np.arange(q.shape[1])
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            t = self.ids[self.sa[mid][:, None] + span]
            x = q[todo]
            differs = (t != x) & (span < lens[todo][:, None])
            at = differs.argmax(1)
            some = differs[np.arange(len(todo)), at]
            less = some & (t[np.arange(len(todo)), at] < x[np.arange(len(todo)), at])
            go = less | (~some if right else False)
            lo[todo] = np.where(go, mid + 1, lo[todo])
            hi[todo] = np.where(go, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return np.where(done_hi & right, hi, lo)

    def common(self, block: TestBlock, rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Words that each suffix shares with the text at its place, compared in
        stretches that double as long as they agree."""
        out, width = np.zeros(len(rows), np.int64), 32
        live = np.arange(len(rows))
        while len(live):
            going = []
            for a in range(0, len(live), max(1, (1 << 20) // width)):
                k = live[a:a + max(1, (1 << 20) // width)]
                n = np.minimum(width, block.lens[rows[k]] - out[k])
                span = np.arange(width)
                x = block.flat[np.minimum(block.starts[rows[k]][:, None] + out[k][:, None] + span, len(block.flat) - 1)]
                t = self.ids[np.minimum(pos[k][:, None] + out[k][:, None] + span, len(self.ids) - 1)]
                differs = (t != x) | (span >= n[:, None])
                same = np.where(differs.any(1), differs.argmax(1), width)
                out[k] += same
                going.append(k[(same == width) & (out[k] < block.lens[rows[k]])])
            live = np.concatenate(going)
            width *= 2
        return out

    def longest(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of every suffix's longest match: binary search for
        its place in the array, whose neighbours share the most with it."""
        best, where = np.zeros(len(block.starts), np.int64), np.zeros(len(block.starts), np.int64)
        if not len(self.sa):
            return best, where
        step = max(1, (1 << 20) // block.depth)
        for a in range(0, len(best), step):
            rows = np.arange(a, min(a + step, len(best)))
            lens = block.lens[rows]
            q = block.words(rows, lens, int(lens.max()))
            low, _ = self._packed(q, np.maximum(lens, self.packed))
            lo, hi = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, low, "right")
            at = self._search(q, np.maximum(lens, self.packed + 1), lo, hi, False)
            for k in (at - 1, at):
                ok = (k >= 0) & (k < len(self.sa))
                p = self.sa[np.clip(k, 0, len(self.sa) - 1)]
                n = np.where(ok, self.common(block, rows, p), 0)
                where[rows] = np.where(n > best[rows], p, where[rows])
                best[rows] = np.maximum(n, best[rows])
        return best, where


def _shards(texts: list) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of its first document, token lists) of shards of a batch."""
    begin, words, size = 0, [], 0
    for k, t in enumerate(texts):
        if words and size + len(t or "") > SHARD_BYTES:
            yield begin, words
            begin, words, size = k, [], 0
        words.append(tokens(t))
        size += len(t or "")
    if words:
        yield begin, words


def _ids(docs: list[list[bytes]], vocab: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of documents with a 0 after each, and their first places."""
    from itertools import repeat
    lens = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    ids = np.zeros(starts[-1], np.int32)
    for d, a in zip(docs, starts):
        ids[a:a + len(d)] = np.fromiter(map(vocab.get, d, repeat(0)), np.int32, len(d))
    return ids, starts


def search_shard(docs: list[list[bytes]], block: TestBlock):
    """Per document: words hit (bool array), items found (set), and its
    longest verbatim match as (words, first word)."""
    ids, starts = _ids(docs, block.vocab)
    hit = [np.zeros(len(d), bool) for d in docs]
    items: list[set] = [set() for _ in docs]
    longest = np.zeros(len(docs), np.int64)
    place = np.zeros(len(docs), np.int64)
    sa = SuffixArray(ids, len(block.vocab), block.width)
    if not len(sa.sa) or not len(block.wlens):
        return hit, items, longest, place
    lo, hi = sa.bounds(block.wmatrix, block.wlens)
    delta = np.zeros(len(ids) + 1, np.int32)
    for w in np.flatnonzero(hi > lo):  # all places of one window at a time
        pos = np.sort(sa.sa[lo[w]:hi[w]])
        np.add.at(delta, pos, 1)
        np.add.at(delta, pos + block.wlens[w], -1)
        owner = np.searchsorted(starts, pos, "right") - 1
        rows = block.wrows[block.wbegin[w]:block.wbegin[w + 1]]
        found = {block.names[i] for i in np.unique(block.owner[rows])}
        for d in np.unique(owner):
            items[d].update(found)
        for r in rows:
            n = sa.common(block, np.full(len(pos), r), pos)
            for k in np.flatnonzero(n > longest[owner]):
                if n[k] > longest[owner[k]]:
                    longest[owner[k]], place[owner[k]] = n[k], pos[k] - starts[owner[k]]
    edge = np.diff(np.concatenate([[0], (np.cumsum(delta[:-1]) > 0).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        d = int(np.searchsorted(starts, a, "right") - 1)
        hit[d][a - starts[d]:b - starts[d]] = True
    return hit, items, longest, place


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, item_col="item_id", text_col="text") -> list[TestBlock]:
    """The test set in blocks of bounded text."""
    out, items, size = [], [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len(row["t"] or "")
        if items and size + n > block_bytes:
            out.append(TestBlock(items))
            items, size = [], 0
        if ws := tokens(row["t"]):
            items.append((row["i"], ws))
            size += n
    return [*out, TestBlock(items)]


RESULT = (T.StructType().add("__dc_n_words", "long").add("__dc_n_hit", "long").add("__dc_n_items", "long")
          .add("__dc_items_sha256", "string").add("__dc_contaminated", "boolean").add("__dc_longest", "long").add("__dc_longest_at", "long"))
#: What is carried from block to block.
STATE = (T.StructType().add("__dc_hits", "binary").add("__dc_found", T.ArrayType(T.StringType()))
         .add("__dc_longest", "long").add("__dc_longest_at", "long"))
ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def scan(docs: DataFrame, blocks: list[TestBlock], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) of every document plus RESULT."""
    spark = docs.sparkSession
    prepare(spark)
    keep = docs.columns if keep is None else keep
    out = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text_col])])
    base = T.StructType([f for f in out.schema.fields])
    for k, block in enumerate(blocks):
        shared, first, last = spark.sparkContext.broadcast(block), k == 0, k == len(blocks) - 1
        fields = [f for f in base.fields if not last or f.name in keep]
        names = [f.name for f in fields]
        schema = T.StructType([*fields, *(RESULT if last else STATE).fields])

        def run(batches, shared=shared, first=first, last=last, names=names):
            for batch in batches:
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                hits, founds, longs, at = [], [], [], []
                for _, words in _shards(column(text_col).to_pylist()):
                    h, f, n, p = search_shard(words, shared.value)
                    hits += h
                    founds += [{"" if x is None else str(x) for x in s} for s in f]
                    longs += n.tolist()
                    at += p.tolist()
                if not first:  # join what the blocks before have found
                    before = zip(*(column(c).to_pylist() for c in STATE.names))
                    for j, (bits, found, n, p) in enumerate(before):
                        hits[j] = hits[j] | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(hits[j])).astype(bool)
                        founds[j] |= set(found)
                        longs[j], at[j] = max((n, -p), (longs[j], -at[j]))[0], min((-n, p), (-longs[j], at[j]))[1]
                cols = [column(c) for c in names]
                if last:
                    n_hit = [int(x.sum()) for x in hits]
                    extra = [[len(x) for x in hits], n_hit, [len(s) for s in founds],
                             [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in founds],
                             [h > 0 and SHARE * h >= len(x) for h, x in zip(n_hit, hits)],
                             longs, [p if n else None for n, p in zip(longs, at)]]
                    fields = RESULT.fields
                else:
                    extra = [[np.packbits(x).tobytes() for x in hits], [sorted(s) for s in founds], longs, at]
                    fields = STATE.fields
                arrays = [pa.array(x, ARROW[f.dataType.simpleString()]) for x, f in zip(extra, fields)]
                yield pa.RecordBatch.from_arrays([*cols, *arrays], names=[*names, *[f.name for f in fields]])

        out = out.mapInArrow(run, schema)
    return out


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per item and first word: the longest verbatim match of that test suffix
    in any document (words), one document that holds it and where. Shards
    report their best, a map-side-combined maximum merges them."""
    prepare(docs.sparkSession)
    schema = T.StructType().add("item_id", "long").add("item_at", "long").add("length", "long").add("doc", "long").add("at", "long")
    out = None
    for block in test_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                owners = batch.column(0).to_pylist()
                for begin, words in _shards(batch.column(1).to_pylist()):
                    ids, starts = _ids(words, block.vocab)
                    sa = SuffixArray(ids, len(block.vocab), block.depth)
                    n, at = sa.longest(block)
                    d = np.searchsorted(starts, at, "right") - 1
                    rows = [(block.names[block.owner[r]], int(block.offset[r]), int(n[r]), owners[begin + int(d[r])], int(at[r] - starts[d[r]])) for r in np.flatnonzero(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(5)], names=[f.name for f in schema.fields])

        part = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id", "item_at").agg(F.max(F.struct("length", (-F.col("doc")).alias("d"), (-F.col("at")).alias("a"))).alias("b"))
    return best.select("item_id", "item_at", F.col("b.length").alias("length"), (-F.col("b.d")).alias("doc_id"), (-F.col("b.a")).alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, columns of ``docs``."""
    found = scan(docs, test_blocks(benchmark), text_col)
    return found.where("NOT __dc_contaminated").select(*[f"`{c}`" for c in docs.columns])
