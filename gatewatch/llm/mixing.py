"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating,
and share ``RATIO`` of all words; none gets more than ``MAX_EPOCHS`` times its
own size, the excess goes to the others by weight (water filling).

Plan, per source: documents fall into blocks of about ``BLOCK_WORDS`` words by
a seeded hash. A target of e whole sizes plus a rest is e passes over all
blocks and a last pass over the first blocks whose running total stays within
the rest; from the block that crosses it, documents are taken in hash order
until little room is left, then the largest that still fit, then one more if
that comes nearer, so the total misses the target by no more than half of
the smallest document left out of that block.

Splitting tree: the root holds each source's number of block draws; a node
over shards [lo, hi) hands its left half an exact multivariate-hypergeometric
share of them (one inverse-distribution hypergeometric draw per source, the
capacities of both halves fixed), until every node is one shard. A shard then
owns, per source, a consecutive range of that source's permuted draws, so
draws are disjoint and complete; within a shard rows are ordered by hash.

All of it is DataFrame / SQL functions. Draws come from hashes of (seed, node,
source), so reruns agree. The tree's node rows hold one number per source and
shards by sources rows are made in the end; both are independent of rows.
No window runs over a whole source: running totals go over groups of
``GROUP`` blocks first, then inside each group.

Rows that agree in id, source and text are one unit with their sizes added and
are taken together. Texts without words (null, empty) are never drawn. A null
source is a source. Empty input gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewatch.llm.common import NON_SPACE, key_of, materialize

WEIGHTS = (5, 2, 1)
RATIO = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 21
GROUP = 1024
SLACK = 3
SEED = 20260101
#: Multiplier of the affine permutation of a source's draws (a prime).
STRIDE = 2_654_435_761


def narrow(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, sk, h, size) of every document."""
    t = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key_of(F.col(source_col)).alias("sk"),
        _unit(F.col(id_col), F.col(source_col), t).alias("h"),
        F.coalesce(F.regexp_count(t, F.lit(NON_SPACE)), F.lit(0)).cast("long").alias("size"))


def _unit(doc_id: Column, source: Column, text: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id, source, text)


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: sk, source_size, weight, target."""
    src = rows.groupBy("sk", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    src = src.withColumn("weight", weight.cast("double"))
    cap = F.col("source_size") * F.lit(float(MAX_EPOCHS))
    # water filling: sources by cap / weight; those before the level are full
    by_level = Window.orderBy(cap / F.col("weight"), F.col("sk"))
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = (F.lit(RATIO) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), zero)) / F.sum("weight").over(after)
    src = src.withColumn("level", level).withColumn("cap", cap)
    # the level is the first one that the source itself does not reach
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("sk"), F.col("level").alias("level")))).over(everything)
    src = src.withColumn("final", final["level"])
    return src.select("sk", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


# ---- hypergeometric draws as SQL expressions --------------------------------

def _let(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and name it within ``body``."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def hypergeometric_sql(n_all: str, n_kind: str, n_draw: str, u: str) -> str:
    """How many of ``n_kind`` marked items are among ``n_draw`` drawn from
    ``n_all``: inversion of the distribution at ``u``, over its support within
    12 standard deviations (all that doubles resolve). Two streaming sums; no
    factorials."""
    support = f"""named_struct(
        'a', greatest(greatest(0L, {n_draw} - ({n_all} - {n_kind})), cast(floor({n_draw} * ({n_kind} / cast(greatest({n_all}, 1L) as double)) - 12 * SD - 2) as bigint)),
        'b', least(least({n_kind}, {n_draw}), cast(ceil({n_draw} * ({n_kind} / cast(greatest({n_all}, 1L) as double)) + 12 * SD + 2) as bigint)))"""
    sd = (f"sqrt(greatest(0D, {n_draw} * ({n_kind} / cast(greatest({n_all}, 1L) as double)) * (1 - {n_kind} / cast(greatest({n_all}, 1L) as double))"
          f" * (({n_all} - {n_draw}) / cast(greatest({n_all} - 1, 1L) as double))))")
    ratio = (f"(cast({n_kind} - hk as double) * ({n_draw} - hk)) / (cast(hk + 1 as double) * ({n_all} - {n_kind} - {n_draw} + hk + 1))")
    total = f"aggregate(sequence(hs.a, hs.b), named_struct('p', 1D, 't', 0D), (hz, hk) -> named_struct('p', if(hk < hs.b, hz.p * {ratio}, 0D), 't', hz.t + hz.p), hz -> hz.t)"
    pick = (f"aggregate(sequence(hs.a, hs.b), named_struct('p', 1D, 't', 0D, 'x', hs.a), (hz, hk) -> named_struct("
            f"'p', if(hk < hs.b, hz.p * {ratio}, 0D), 't', hz.t + hz.p, 'x', if(hz.t < {u} * hw, hk, hz.x)), hz -> hz.x)")
    return _let(support.replace("SD", sd), "hs", f"if(hs.a >= hs.b, hs.a, {_let(total, 'hw', pick)})")


def split_tree(counts: DataFrame, n_shards: int) -> DataFrame:
    """(sk, draws) -> (shard, sk, quota): exact quotas, summing per source to
    its draws and per shard to its share of all draws (within one)."""
    node = counts.orderBy("sk").agg(
        F.sort_array(F.collect_list(F.struct("sk", "draws"))).alias("kinds"), F.coalesce(F.sum("draws"), F.lit(0)).alias("n"))
    nodes = node.select(F.lit(0).cast("long").alias("lo"), F.lit(n_shards).cast("long").alias("hi"), F.lit(0).cast("long").alias("at"),
                        F.col("n"), F.col("n").alias("n0"), "kinds")
    draw = hypergeometric_sql("z.n", "e.draws", "z.c", f"((shiftrightunsigned(xxhash64({SEED}L, lo, hi, e.sk), 11) + 0.5D) / 9007199254740992D)")
    step = _let(draw, "x", "named_struct('n', z.n - e.draws, 'c', z.c - x, 'xs', concat(z.xs, array(x)))")
    for _ in range(max(0, math.ceil(math.log2(max(n_shards, 1))))):
        mid = F.expr("if(hi - lo > 1, (lo + hi) div 2, hi)")
        nodes = (nodes.withColumn("mid", mid)
                 .withColumn("cap", F.expr(f"(n0 * mid) div {n_shards}L - (n0 * lo) div {n_shards}L"))
                 .withColumn("xs", F.expr(
                     "if(mid = hi, transform(kinds, e -> e.draws), aggregate(kinds, named_struct('n', n, 'c', cap, 'xs', cast(array() as array<bigint>)),"
                     f" (z, e) -> {step}, z -> z.xs))"))
                 .select(F.expr("""explode(if(mid = hi,
                        array(named_struct('lo', lo, 'hi', hi, 'n', n, 'kinds', kinds)),
                        array(named_struct('lo', lo, 'hi', mid, 'n', cap, 'kinds', zip_with(kinds, xs, (e, x) -> named_struct('sk', e.sk, 'draws', x))),
                              named_struct('lo', mid, 'hi', hi, 'n', n - cap, 'kinds', zip_with(kinds, xs, (e, x) -> named_struct('sk', e.sk, 'draws', e.draws - x))))))""").alias("c"), "n0")
                 .select(F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), F.lit(0).cast("long").alias("at"), F.col("c.n").alias("n"), "n0", F.col("c.kinds").alias("kinds")))
        nodes = materialize(nodes, "mix-tree")
    return nodes.select(F.col("lo").alias("shard"), F.explode("kinds").alias("e")).select("shard", "e.sk", F.col("e.draws").alias("quota"))


# ---- the plan and the draw --------------------------------------------------

class MixPlan:
    """sources: one row per source (blocks, passes, blocks of the last pass,
    draws); crossing: units taken from the crossing blocks; owner: which shard
    owns each permuted draw of a source."""

    def __init__(self, sources: DataFrame, crossing: DataFrame, owner: DataFrame, n_shards: int):
        self.sources, self.crossing, self.owner, self.n_shards = sources, crossing, owner, n_shards


def plan_mix(rows: DataFrame) -> MixPlan:
    """Plan from (sk, source, h, size) rows; reads them three times, so pass a
    stored table."""
    src = targets(rows).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(MAX_EPOCHS))).otherwise(0).cast("long")
    src = src.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    src = materialize(src, "mix-sources")
    blocked = rows.where("size > 0").join(src.select("sk", "n_blocks", "rest"), "sk").withColumn("block", F.expr("pmod(h, n_blocks)"))
    sums = blocked.groupBy("sk", "block", "rest").agg(F.sum("size").alias("w")).withColumn("g", F.expr(f"block div {GROUP}"))
    groups = sums.groupBy("sk", "g").agg(F.sum("w").alias("gw")).select(
        "sk", "g", F.coalesce(F.sum("gw").over(Window.partitionBy("sk").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("g0"))
    upto = Window.partitionBy("sk", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("w").over(upto)).join(groups, ["sk", "g"]).withColumn("end", F.col("end") + F.col("g0"))
    marks = ends.groupBy("sk").agg(
        F.max(F.when(F.col("end") <= F.col("rest"), F.col("block"))).alias("last_full"),
        F.min(F.when((F.col("end") > F.col("rest")) & (F.col("end") - F.col("w") < F.col("rest")),
                     F.struct("block", (F.col("rest") - (F.col("end") - F.col("w"))).alias("room")))).alias("cross"))
    marks = materialize(marks.select("sk", (F.coalesce("last_full", F.lit(-1)) + 1).alias("full"), "cross"), "mix-marks")
    # inside the one crossing block of each source: hash order until the room
    # left is about SLACK times the largest unit, then the largest that fit,
    # then one more if the total comes nearer to the target with it than without
    units = (blocked.join(marks.where("cross IS NOT NULL").select("sk", F.col("cross.block").alias("block"), F.col("cross.room").alias("room")), ["sk", "block"])
             .groupBy("sk", "block", "room", "h").agg(F.sum("size").alias("size")))
    fit = """aggregate({items}, named_struct('left', {left}, 'hs', {taken}, 'rest', cast(array() as array<struct<size: bigint, h: bigint>>)), (z, i) ->
        if(i.size <= z.left{less}, named_struct('left', z.left - i.size, 'hs', concat(z.hs, array(i.h)), 'rest', z.rest),
           named_struct('left', z.left, 'hs', z.hs, 'rest', concat(z.rest, array(named_struct('size', i.size, 'h', i.h))))))"""
    block = units.groupBy("sk", "block", "room").agg(F.sort_array(F.collect_list(F.struct("h", "size"))).alias("items"))
    block = block.withColumn("a", F.expr(fit.format(items="items", left="room", taken="cast(array() as array<bigint>)",
                                                   less=f" - {SLACK} * array_max(transform(items, i -> i.size)) and size(z.rest) = 0")))
    block = block.withColumn("b", F.expr(fit.format(items="sort_array(a.rest, false)", left="a.left", taken="a.hs", less="")))
    over = "array_min(transform(filter(b.rest, i -> i.size < 2 * b.left), i -> named_struct('size', i.size, 'h', i.h)))"
    crossing = block.withColumn("o", F.expr(over)).select("sk", F.explode(F.expr("if(o IS NULL, b.hs, concat(b.hs, array(o.h)))")).alias("h"))
    crossing = materialize(crossing, "mix-crossing")
    src = src.join(marks, "sk", "left").select(
        "sk", "source_size", "target", "n_blocks", "epochs", F.coalesce("full", F.lit(0)).cast("long").alias("full"), F.col("cross.block").alias("cross"))
    src = materialize(src.withColumn("draws", F.col("epochs") * F.col("n_blocks") + F.coalesce(F.col("cross") + 1, F.col("full"))), "mix-plan")
    words = src.agg(F.sum("target")).first()[0] or 0
    n_shards = max(1, math.ceil(words / SHARD_WORDS))
    quotas = split_tree(src.where("draws > 0").select("sk", "draws"), n_shards)
    start = F.coalesce(F.sum("quota").over(Window.partitionBy("sk").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owner = quotas.withColumn("start", start).where("quota > 0").select(
        "sk", "shard", F.explode(F.expr("sequence(start, start + quota - 1)")).alias("draw"))
    return MixPlan(src, crossing, materialize(owner, "mix-owner"), n_shards)


def draw_mix(rows: DataFrame, plan: MixPlan, sk: str = "sk", h: str = "h", size: str = "size") -> DataFrame:
    """The mixed rows: every column of ``rows`` once per draw, plus
    ``__mix_pass`` and ``__mix_shard``. The source table has one row per
    source and the crossing table a few rows per source; AQE broadcasts them
    when they are measured to be small."""
    s = plan.sources.select(F.col("sk").alias("__mix_sk"), "n_blocks", "epochs", "full", "cross", "draws")
    s = s.select("__mix_sk", F.struct("n_blocks", "epochs", "full", "cross", "draws").alias("__mix_s"))
    x = plan.crossing.select(F.col("sk").alias("__mix_xk"), F.col("h").alias("__mix_xh"), F.lit(True).alias("__mix_x"))
    r = (rows.where(F.col(size) > 0).join(s, F.col(sk) == F.col("__mix_sk"))
         .join(x, (F.col(sk) == F.col("__mix_xk")) & (F.col(h) == F.col("__mix_xh")), "left")
         .withColumn("__mix_block", F.expr(f"pmod(`{h}`, __mix_s.n_blocks)")))
    last = (F.col("__mix_block") < F.col("__mix_s.full")) | F.coalesce(F.col("__mix_x"), F.lit(False))
    r = r.withColumn("__mix_n", F.col("__mix_s.epochs") + F.when(last, 1).otherwise(0)).where("__mix_n > 0")
    r = r.withColumn("__mix_pass", F.explode(F.expr("sequence(0L, __mix_n - 1)")))
    r = r.withColumn("__mix_draw", F.expr(
        f"pmod((__mix_pass * __mix_s.n_blocks + __mix_block) * {STRIDE}L, __mix_s.draws)"))
    o = plan.owner.select(F.col("sk").alias("__mix_ok"), F.col("draw").alias("__mix_od"), F.col("shard").alias("__mix_shard"))
    r = r.join(o, (F.col(sk) == F.col("__mix_ok")) & (F.col("__mix_draw") == F.col("__mix_od")))
    return r.select(*[F.col(f"`{c}`") for c in rows.columns], "__mix_pass", "__mix_shard")


def shuffle_locally(mixed: DataFrame, h: str = "h") -> DataFrame:
    """Rows of one output shard together, in a seeded random order."""
    return mixed.repartition("__mix_shard").sortWithinPartitions(
        "__mix_shard", F.xxhash64(F.lit(SEED + 1), F.col(h), F.col("__mix_pass")))


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed documents, repeats as repeated rows, columns of ``docs``."""
    plan = plan_mix(materialize(narrow(docs, id_col, text_col, source_col), "mix-rows"))
    t = F.col(text_col)
    rows = docs.select("*", key_of(F.col(source_col)).alias("__mix_k"), _unit(F.col(id_col), F.col(source_col), t).alias("__mix_h"),
                       F.coalesce(t.rlike(NON_SPACE), F.lit(False)).cast("int").alias("__mix_size"))
    mixed = shuffle_locally(draw_mix(rows, plan, "__mix_k", "__mix_h", "__mix_size"), "__mix_h")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words the
    mix takes of it."""
    rows = materialize(narrow(docs), "mix-rows")
    plan = plan_mix(rows)
    drawn = draw_mix(rows.select("sk", "h", "size"), plan).groupBy("sk", "h").agg(F.count(F.lit(1)).alias("n"))
    units = rows.groupBy("sk", "h").agg(F.count(F.lit(1)).alias("copies")).join(drawn, ["sk", "h"])
    per_row = units.select("sk", "h", F.expr("n div copies").alias("times"))
    return (rows.join(per_row, ["sk", "h"], "left").join(plan.sources.select("sk", "source_size", "target"), "sk")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), "source"))
