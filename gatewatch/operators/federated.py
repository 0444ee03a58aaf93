"""Weighted federated merge of isolation forests (parameters only).

Each node fits its own forest on its own rows; the merge takes, per node,
k = min(T, max(1, round_half_even(T * w * nodes))) trees (w = n_node / N)
chosen by a seeded hash order, renumbers them into one forest, and sets the
global offset to the sample-weighted mean of the node offsets. The node
parameter table and the tree tables are small (one row per node / tree);
no data rows leave their node's partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.operators import forest as FR
from gatewatch.operators.quantiles import rank_values
from gatewatch.session import materialize


def position_split(df: DataFrame, order: str, fractions: list[float], out: str = "node") -> DataFrame:
    """Row-order split (first int(n*f1) rows, next ..., rest) without a
    global window: the cut values are the ``order`` values at those ranks
    (distributed rank lookup), then a range predicate labels each row."""
    cum, acc = [], 0.0
    for f in fractions[:-1]:
        acc += f
        cum.append(acc)

    def targets(n):
        return {f"cut{i}": (F.floor(n * F.lit(c)), F.floor(n * F.lit(c)), F.lit(0.0)) for i, c in enumerate(cum)}
    cuts = rank_values(df, order, targets).first()
    label = None
    for i in range(len(cum)):
        v = cuts[f"cut{i}"] if cuts is not None else None
        cond = F.col(order) < F.lit(v) if v is not None else F.lit(False)
        label = F.when(cond, F.lit(i + 1)) if label is None else label.when(cond, F.lit(i + 1))
    return df.withColumn(out, label.otherwise(F.lit(len(fractions))) if label is not None else F.lit(1))


def validate_compatibility(params: DataFrame) -> None:
    """Every node must share the feature schema (one distinct n_features)."""
    k = params.agg(F.countDistinct("n_features").alias("k")).first()["k"]
    if k != 1:
        raise ValueError("nodes disagree on the number of features")


def quotas(params: DataFrame, seed: int = 42) -> DataFrame:
    """Per node: weight, tree quota k (half-even rounding) and the weighted
    global offset; ``params`` = node_id, n_samples, n_trees, offset."""
    w = Window.partitionBy()  # one row per node: a tiny table
    total = F.sum("n_samples").over(w)
    nodes = F.count(F.lit(1)).over(w)
    weight = F.col("n_samples") / total
    k = F.least(F.col("n_trees"),
                F.greatest(F.lit(1), F.bround(F.col("n_trees") * weight * nodes, 0).cast("long")))
    return params.withColumns({"weight": weight, "k": k,
                               "global_offset": F.sum(F.col("offset") * F.col("n_samples")).over(w) / total,
                               "total_samples": total})


@dataclass
class Merged:
    forest: FR.Forest
    params: DataFrame
    offset: float


def merge(node_forests: dict[str, FR.Forest], params: DataFrame, seed: int = 42) -> Merged:
    """Select k trees per node by seeded hash order and renumber them."""
    q = quotas(params, seed)
    tables = []
    for node_id, f in node_forests.items():
        tables.append(f.nodes.withColumn("node_id_src", F.lit(node_id)))
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    q = q.withColumn("first_tree", F.coalesce(F.sum("k").over(  # one row per node
        Window.orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    trees = nodes.select("node_id_src", "tree_id").distinct()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node_id_src"), F.lit("m"),
                             F.col("tree_id").cast("string")).cast("binary"))
    wt = Window.partitionBy("node_id_src").orderBy(draw, "tree_id")
    chosen = (trees.withColumn("_r", F.row_number().over(wt))
              .join(q.select(F.col("node_id").alias("node_id_src"), "k", "first_tree"), "node_id_src")
              .filter(F.col("_r") <= F.col("k"))
              .withColumn("global_tree", (F.col("first_tree") + F.col("_r") - 1).cast("int")))
    merged = (nodes.join(chosen.select("node_id_src", "tree_id", "global_tree"), ["node_id_src", "tree_id"])
              .select(F.lit("global").alias("forest_id"), F.col("global_tree").alias("tree_id"), "node_id",
                      "left", "right", "feature", "threshold", "n_node_samples"))
    merged = materialize(merged, "fed_nodes")
    first = next(iter(node_forests.values()))
    offset, n_sel = q.agg(F.max("global_offset"), F.sum("k")).first()
    forest = FR.Forest(nodes=merged, features=first.features, max_samples=first.max_samples, n_trees=int(n_sel))
    return Merged(forest=forest, params=q, offset=offset)
