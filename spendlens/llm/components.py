"""Connected components of an edge table, on Spark: labels fall to the
smallest node id by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spendlens.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges of longs to ``(node, label)``, the label being the
    smallest node of the component.  Null ends and loops link nothing; a node
    without an edge has no row.  Each round is stored, so lineage stays short;
    a star needs two rounds, a path of n nodes about log n."""
    e = edges.where("a <> b").select("a", "b")
    both = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = stored(both.groupBy(F.col("a").alias("node"))
                 .agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(lab.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        near = seen.groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("lb"))
        low = lab.join(near, "node").select("node", F.col("label").alias("old"),
                                            F.least("label", "lb").alias("label"))
        # Hooking: the old root of a node takes the node's new label too.
        roots = (low.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("root")))
        low = (low.join(roots, "node", "left")
               .select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("up"))
        moved = Observation()
        lab = stored(low.join(jump, "label", "left")
                     .select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
                     .observe(moved, F.count_if(F.col("label") != F.col("old")).alias("n")).select("node", "label"))
        if not moved.get["n"]:
            return lab
