"""Connected components of a graph of pairwise matches by alternating star rewrites.

Each round rewrites the edge list twice.  *Large-star* connects every larger
neighbour of a node to the smallest node it sees; *small-star* connects every
smaller neighbour (and the node itself) to the smallest one.  When a round leaves
the edges unchanged, each node hangs directly on the minimum of its component.
The number of rounds grows with the logarithm of the longest chain.

Both rewrites are a pre-aggregated minimum per node and a join back, so a node
with very many neighbours is combined on the map side and its join partition is
split by adaptive execution; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch


def _state(df: DataFrame) -> tuple:
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("a"),
        F.sum(F.shiftright(F.xxhash64("v", "u"), 20)).alias("b"),
    ).first()
    return row["n"], row["a"], row["b"]


def large_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v) to edges (larger neighbour, minimum)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # only (node, larger neighbour) matters: of an edge u > v, that is seen from v
    seen = edges.select(F.col("v").alias("u"), F.col("u").alias("larger"))
    return seen.join(least, "u").select(F.col("larger").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges (u > v): every smaller neighbour of u, and u, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``edges`` (columns ``src``, ``dst`` of one orderable type).

    ``component`` is the component's smallest node.  Null ends and loops are
    ignored, repeated and reversed edges count once, extra columns are dropped;
    no edges give no rows.  Fails if ``max_rounds`` rounds do not suffice (a
    chain would have to exceed 2**60 nodes).
    """
    now = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    now = scratch.keep(now.distinct(), "cc-0")
    before = _state(now)
    for k in range(1, max_rounds + 1):
        after = scratch.keep(small_star(large_star(now)), f"cc-{k}")
        scratch.drop(f"cc-{k - 1}")
        state = _state(after)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
