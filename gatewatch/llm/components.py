"""Connected components of a link table, in Spark.

Every node points to its smallest neighbour, pointers are jumped until they
end in roots, links are contracted to roots, and again until no link is left.
Each round's table is written to the shared folder, so no lineage builds up.
Links are counted by map-side-combined minima; a node with very many links is
no hot task. Nothing goes to the driver but the emptiness of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.common import materialize


def components(links: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, comp) for every node that occurs in a link; comp is the smallest
    node of its component. Null ends are ignored; repeated links and self
    links are allowed."""
    e = links.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    e = materialize(e, "cc-links")
    label = materialize(e.select(F.col("x").alias("node")).union(e.select("y")).distinct().withColumn("comp", F.col("node")), "cc-labels")
    e = e.where("x <> y")
    while not e.isEmpty():
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("c"), F.least("x", "m").alias("p"))
        up = materialize(up, "cc-up")
        while True:
            q = up.select(F.col("c").alias("c2"), F.col("p").alias("p2"))
            new = materialize(up.join(q, F.col("p") == F.col("c2"), "left").select("c", "p", F.coalesce("p2", "p").alias("q")), "cc-jump")
            up = new.select("c", F.col("q").alias("p"))
            if new.where("q <> p").isEmpty():
                break
        a, b = up.select(F.col("c").alias("x"), F.col("p").alias("px")), up.select(F.col("c").alias("y"), F.col("p").alias("py"))
        e = materialize(e.join(a, "x").join(b, "y").where("px <> py").select(
            F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "cc-links")
        label = materialize(label.join(up, F.col("comp") == F.col("c"), "left").select("node", F.coalesce("p", "comp").alias("comp")), "cc-labels")
    return label
