"""Model tables: save / load a forest (node table + metadata, parquet,
versioned by model id) and the lightweight JSON export (one JSON object per
tree with its node arrays, plus the metadata with scaler and code maps)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.operators import forest as FR
from gatewatch.session import checkpoint_dir

META_SCHEMA = ("model_id string, max_samples int, offset double, n_features int, n_trees int, "
               "features array<string>, scaler_mean array<double>, scaler_scale array<double>, "
               "country_map map<string,double>")


def save_forest(spark: SparkSession, forest: FR.Forest, nodes_pdf: pd.DataFrame | None = None,
                model_id: str = "model", root: str | None = None, scaler: dict | None = None,
                country_map: dict | None = None) -> str:
    """Write ``forest_nodes`` and ``forest_meta`` under the shared folder."""
    root = root or f"{checkpoint_dir(spark)}/models"
    nodes = (spark.createDataFrame(nodes_pdf, schema=FR.NODE_SCHEMA) if nodes_pdf is not None else forest.nodes)
    # each model lands in its own partition folder (model_id=...)
    nodes.write.mode("overwrite").parquet(f"{root}/forest_nodes/model_id={model_id}")
    meta = spark.createDataFrame([(
        model_id, int(forest.max_samples), float(forest.offset) if forest.offset is not None else None,
        len(forest.features), int(forest.n_trees), list(forest.features),
        list(scaler["mean"]) if scaler else None, list(scaler["scale"]) if scaler else None,
        {k: float(v) for k, v in (country_map or {}).items()})], META_SCHEMA)
    meta.write.mode("overwrite").parquet(f"{root}/forest_meta/model_id={model_id}")
    return root


def load_forest(spark: SparkSession, root: str, model_id: str) -> tuple[FR.Forest, dict]:
    nodes = spark.read.parquet(f"{root}/forest_nodes").filter(F.col("model_id") == model_id).drop("model_id")
    meta_row = spark.read.parquet(f"{root}/forest_meta").filter(F.col("model_id") == model_id).first()
    meta = meta_row.asDict(recursive=True)
    forest = FR.Forest(nodes=nodes, features=list(meta["features"]), max_samples=int(meta["max_samples"]),
                       n_trees=int(meta["n_trees"]), offset=meta["offset"])
    return forest, meta


def export_json(nodes: DataFrame, meta: dict) -> DataFrame:
    """One JSON document per tree (children_left, children_right, feature,
    threshold, n_node_samples in node order)."""
    s = F.sort_array(F.collect_list(F.struct("node_id", "left", "right", "feature", "threshold",
                                             "n_node_samples")))
    per_tree = nodes.groupBy("tree_id").agg(s.alias("n"))
    return per_tree.select("tree_id", F.to_json(F.struct(
        F.col("n.node_id").alias("node_id"), F.col("n.left").alias("children_left"), F.col("n.right").alias("children_right"),
        F.col("n.feature").alias("feature"), F.col("n.threshold").alias("threshold"),
        F.col("n.n_node_samples").alias("n_node_samples"),
        F.lit(int(meta["max_samples"])).alias("max_samples"))).alias("json"))


def meta_json(meta: dict) -> str:
    keep = {k: meta.get(k) for k in ("max_samples", "offset", "n_features", "features", "scaler_mean",
                                     "scaler_scale", "country_map")}
    return json.dumps(keep)


def native_score_expr(nodes_pdf: pd.DataFrame, features: list[str], psi: int) -> Column:
    """The same score as a native expression (nested CASE per tree). Meant
    for small forests (parity checks, SQL export); large forests use the
    vectorised UDF."""
    trees = []
    for tid, t in nodes_pdf.groupby("tree_id"):
        rows = {int(r.node_id): r for r in t.itertuples()}

        def walk(nid, depth):
            r = rows[nid]
            if r.left < 0:
                return F.lit(depth + FR.c_factor(r.n_node_samples))
            return F.when(F.col(features[int(r.feature)]).cast("double") <= F.lit(float(r.threshold)),
                          walk(int(r.left), depth + 1)).otherwise(walk(int(r.right), depth + 1))
        trees.append(walk(min(rows), 0))
    total = trees[0]
    for x in trees[1:]:
        total = total + x
    return -F.pow(F.lit(2.0), -(total / len(trees)) / F.lit(FR.c_factor(psi)))
