"""Problem 1: one group identifier for all files linked directly or through chains.

Files are linked by an equal digest or by matching frames.  Links are built
without enumerating pairs inside groups of copies: all files of a digest, and
all files of a frame class, hang on one representative; only representatives of
different classes are compared.  The closure is `components.connected_components`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import connected_components
from tesserae.llm.frames import DH_BITS, MIN_COSINE, PH_BITS, classes_match, digest, dot, frame_rows, path_frames, prefixes
from tesserae.operators.hamming import near_pairs, plan_for
from tesserae.session import Scratch


def class_links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``lead1, lead2``: the leads (smallest paths) of different classes that match; a pair may come more than once.

    ``classes``: ``lead, nf, fs``.  Candidates are classes with a matching pair
    of frames among their rarest ones.  Classes of one frame match by that; others
    are verified on all their frames.
    """
    prefix = scratch.keep(prefixes(classes, ("lead",), ("hist", "nn")), "prefix")
    patterns = scratch.keep(prefix.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n")), "patterns")
    near = near_pairs(patterns, plan_for(patterns.count(), DH_BITS), PH_BITS)
    pairs = near.unionByName(patterns.where("n > 1").selectExpr("v as v1", "w as w1", "v as v2", "w as w2"))
    side = lambda k: prefix.select(*[F.col(c).alias(f"{c}{k}") for c in prefix.columns])
    met = pairs.join(side(1), ["v1", "w1"]).join(side(2), ["v2", "w2"])
    met = met.where("lead1 <> lead2 and (v1 <> v2 or w1 <> w2 or lead1 < lead2) and 2 * u1 * u2 >= nf1 * nf2")
    met = met.where(dot(F.col("hist1"), F.col("hist2")) / F.sqrt(F.col("nn1") * F.col("nn2")) >= MIN_COSINE)
    met = scratch.keep(met.select("lead1", "lead2", ((F.col("nf1") == 1) & (F.col("nf2") == 1)).alias("sure")), "met")
    full = lambda s: classes.select(F.col("lead").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("nf", "fs")])
    cand = met.where("not sure").select(F.least("lead1", "lead2").alias("a"), F.greatest("lead1", "lead2").alias("b")).distinct()
    seen = cand.join(full("a"), "a").join(full("b"), "b").where(classes_match("a_", "b_"))
    return met.where("sure").select("lead1", "lead2").unionByName(seen.select(F.col("a").alias("lead1"), F.col("b").alias("lead2")))


def linked_groups(files: DataFrame, frames: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``path, group_id`` of every path of ``files`` in a group of two or more; ``group_id`` is its smallest path.

    Repeated rows count once; null paths are dropped; files without a digest or
    without frames only lack that kind of link; frames of paths that are not in
    ``files`` are ignored.  Empty tables give no rows, extra columns are ignored.
    """
    scratch = scratch or Scratch(files.sparkSession, "groups")
    listed = files.select("path", digest("md5").alias("digest")).where("path is not null")
    first = listed.where("digest is not null").groupBy("digest").agg(F.min("path").alias("dst"), F.max("path").alias("last"))
    by_digest = listed.join(first.where("dst < last"), "digest").select(F.col("path").alias("src"), "dst")

    paths = path_frames(frame_rows(frames, listed))
    leaders = paths.groupBy("cid").agg(F.min("path").alias("lead"), F.max("path").alias("last"), F.first("nf").alias("nf"), F.first("fs").alias("fs"))
    leaders = scratch.keep(leaders, "leaders")
    across = scratch.keep(class_links(leaders, scratch), "across").select(F.col("lead1").alias("src"), F.col("lead2").alias("dst"))
    # copies of a class are linked if the class matches itself
    copied = leaders.where("lead < last").select("cid", "lead", F.col("nf").alias("a_nf"), F.col("fs").alias("a_fs"), F.col("nf").alias("b_nf"), F.col("fs").alias("b_fs"))
    copied = copied.where(classes_match("a_", "b_")).select("cid", F.col("lead").alias("dst"))
    copies = paths.select("cid", F.col("path").alias("src")).join(copied, "cid").select("src", "dst")
    edges = by_digest.unionByName(across).unionByName(copies)
    return connected_components(edges, scratch).select(F.col("node").alias("path"), F.col("component").alias("group_id"))
