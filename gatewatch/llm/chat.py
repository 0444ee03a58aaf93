"""Chat formatting from reply trees.

Messages form trees (tree, node, parent). Iterative self-joins enumerate the
root-to-leaf paths: with every step a message's pointer doubles its reach
(parent, grandparent, ...), and the paths, grown from the leaves, double in
length, so a tree of depth d takes log2(d) rounds, not d. Only ids are joined
in the rounds. Branches are ranked by their mean score, each chosen path is
formatted as one conversation.

Template: every turn is ``<s>[role]`` newline text ``</s>`` newline. In texts
and roles ``\\``, ``<``, ``[`` and ``]`` are written ``\\e``, ``\\l``, ``\\b`` and
``\\c``, so no control string can occur inside a turn, and reading back is
exact. The loss mask is a list of byte ranges of the formatted text that cover
the assistants' texts, nothing else.

All DataFrame / SQL functions. Null texts and roles count as empty. Rows of
equal turn are ordered by role and text; repeated rows stay repeated. Extra
columns are ignored. A conversation becomes one string, so it must fit a row;
that also bounds the one window per conversation that links turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatewatch.llm.common import materialize

#: (raw, escaped); the escape character itself is written first, read last.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))
OPEN, CLOSE = "<s>[", "</s>\n"
MASKED_ROLE = "assistant"


def escape(c: Column) -> Column:
    for raw, esc in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def unescape(c: Column) -> Column:
    for raw, esc in reversed(ESCAPES):
        c = F.replace(c, F.lit(esc), F.lit(raw))
    return c


def chain(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each turn replies to the one before it.
    -> tree, node, parent, role, text, score."""
    rows = conversations.select(
        F.col("conv_id").alias("tree"), F.col("turn").alias("_t"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("_t", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def one_per_node(messages: DataFrame) -> DataFrame:
    """One row per (tree, node): of repeated ones the smallest by parent (null
    first), role, text and score. Rows without a node are left out."""
    rest = ["parent", "role", "text", "score"]
    least = messages.where("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("_m"))
    return least.select("tree", "node", *[F.col(f"_m.{c}") for c in rest])


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every message on every root-to-leaf path;
    ``up`` counts from the leaf. (tree, node) must be unique. Messages whose
    parent is missing are roots. A branch whose parents run into a cycle has no
    root: it is on no path, nor are the messages of the cycle.

    Pointers that reach 2^k up are doubled first; the ones still alive after as
    many steps as the largest tree has messages mark such branches. Then round k
    joins the current paths' pieces with the pointers of 2^k. Only ids are
    shuffled."""
    ids = materialize(messages.select("tree", "node", "parent"), "chat-nodes")
    known = ids.select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"))
    up = ids.join(known, F.col("tree").eqNullSafe(F.col("_kt")) & (F.col("parent") == F.col("_kn")), "left").select(
        "tree", "node", F.col("_kn").alias("to"))
    parents = ids.select(F.col("tree").alias("_kt"), F.col("parent").alias("_kn")).where("_kn IS NOT NULL").distinct()
    grown = ids.join(parents, F.col("tree").eqNullSafe(F.col("_kt")) & (F.col("node") == F.col("_kn")), "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    same = F.col("tree").eqNullSafe(F.col("_kt"))
    # pointers that still lead to a message; a message leaves when its pointer passes the root
    ups, reach = [materialize(up.where("to IS NOT NULL"), "chat-up")], 1
    while not ups[-1].isEmpty() and reach <= most:
        step = ups[-1].select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"), F.col("to").alias("_to"))
        ups.append(materialize(ups[-1].join(step, same & (F.col("to") == F.col("_kn"))).select("tree", "node", F.col("_to").alias("to")), "chat-up"))
        reach *= 2
    lost = ups.pop().select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"))
    if not lost.isEmpty():
        grown = grown.join(lost, same & (F.col("leaf") == F.col("_kn")), "left_anti")
    for k, step in enumerate(ups):
        step = step.select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"), F.col("to").alias("_to"))
        more = grown.join(step, same & (F.col("node") == F.col("_kn"))).select("tree", "leaf", F.col("_to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        grown = materialize(grown.unionByName(more), "chat-paths")
    return grown


def choose_paths(messages: DataFrame, grown: DataFrame, top: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank): branches by mean score, best first, ties by
    leaf; ``top`` keeps that many per tree (None: all)."""
    scores = messages.select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"), "score")
    per = (grown.join(scores, F.col("tree").eqNullSafe(F.col("_kt")) & (F.col("node") == F.col("_kn")))
           .groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score")))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def format_paths(messages: DataFrame, grown: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one row per chosen path; ``loss``
    is an array of (start, length) byte ranges."""
    body = messages.select(F.col("tree").alias("_kt"), F.col("node").alias("_kn"), "role", escape(F.col("text")).alias("_e"))
    pick = chosen.select(F.col("tree").alias("_ct"), F.col("leaf").alias("_cl"), "rank")
    turns = (grown.join(pick, F.col("tree").eqNullSafe(F.col("_ct")) & (F.col("leaf") == F.col("_cl")))
             .join(body, F.col("tree").eqNullSafe(F.col("_kt")) & (F.col("node") == F.col("_kn"))))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit("]\n"))
    turn = F.concat(head, F.col("_e"), F.lit(CLOSE))
    per = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    before = per.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("tree", "leaf", "rank", "up", "role", turn.alias("turn"), F.octet_length(head).alias("_h"), F.octet_length("_e").alias("_n"))
    turns = turns.withColumn("_at", F.coalesce(F.sum(F.octet_length("turn")).over(before), F.lit(0)) + F.col("_h"))
    made = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("up")).alias("k"), "turn", F.when(F.col("role") == MASKED_ROLE, F.struct(F.col("_at").alias("start"), F.col("_n").cast("long").alias("length"))).alias("span")))).alias("ts"))
    return made.select("tree", "leaf", "rank", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
                       F.array_compact(F.transform("ts", lambda t: t["span"])).alias("loss"))


def format_trees(messages: DataFrame, top: int | None = None, unique: bool = False) -> DataFrame:
    """Reply trees -> formatted conversations. ``unique`` says that (tree, node)
    does not repeat, as in ``chain``; else one row of each counts."""
    messages = materialize(messages if unique else one_per_node(messages), "chat-messages")
    grown = paths(messages)
    return format_paths(messages, grown, choose_paths(messages, grown, top))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted text: ``turns`` (role, text) and ``loss_text``."""
    parts = F.slice(F.split(F.col("formatted"), "<s>\\["), 2, 2_000_000_000)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, "]\n", 1)).alias("role"),
        unescape(F.substring(p, F.length(F.substring_index(p, "]\n", 1)) + 3,
                             F.length(p) - F.length(F.substring_index(p, "]\n", 1)) - 2 - len(CLOSE))).alias("text"))
    raw = F.element_at(F.transform(F.array(F.col("formatted").cast("binary")), lambda b: F.transform(
        "loss", lambda s: F.decode(F.substring(b, s["start"].cast("int") + 1, s["length"].cast("int")), "UTF-8"))), 1)
    return formatted.select("*", F.transform(parts, turn).alias("turns"),
                            F.array_join(F.transform(raw, unescape), "").alias("loss_text"))
