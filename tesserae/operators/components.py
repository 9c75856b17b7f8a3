"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch


def closure(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """``node, component`` of the nodes of ``a, b``; the component is its smallest node.

    Null ends and loops are ignored; no edges give no rows.  Each round takes the
    least label among the neighbours and then the label of that label.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = scratch.keep(labels.withColumnRenamed("a", "node"), "labels-0")
    for k in range(1, max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "was", F.least("label", "far").alias("label"))
        step = scratch.keep(step, f"labels-{k}")
        scratch.drop(f"labels-{k - 1}")
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
