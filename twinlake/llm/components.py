"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b); ``comp`` is the smallest node of its component.

    Each round takes the smallest label around a node, then that label's own label; what it gives is
    written to the shared folder, so lineage stays short. Rounds grow with the log of the longest path."""
    e = edges.select("a", "b").where("a <> b")
    both = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-label")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("around"))
        step = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "around").alias("comp"))
        jump = step.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left")
        new = materialise(jump.select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), "cc-label")
        moved = new.where("old <> comp").limit(1).count()
        label = new.select("node", "comp")
        if not moved:
            return label
