"""Exact and perceptual duplicates of media files.

No operator lists the pairs of a bucket or of a group of copies: exact groups are
aggregates with member rows beside them, and perceptual links come from an exact
Hamming join, so that a bucket key that many files share costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions.media import digest, extension, signature
from tesserae.operators.components import closure
from tesserae.operators.hamming import near_pairs, plan_for
from tesserae.session import Scratch

TIER_NAMES = tuple(t[0] for t in fixed.TIERS)


def listed(files: DataFrame) -> DataFrame:
    """The distinct files with their digest; files without path are dropped."""
    return files.where("path is not null").distinct().withColumn("md5", digest(F.col("md5")))


def exact_groups(files: DataFrame, same_parent: bool = False) -> DataFrame:
    """``md5[, parent], n, n_sizes, bytes, wasted, keep`` of each digest that two or more files share.

    ``keep`` is the largest file (the smallest path among equals); ``wasted`` is
    what the others hold.  Null sizes count as 0 bytes and as no size.
    """
    keys = ["md5", "parent"] if same_parent else ["md5"]
    size = F.coalesce("size_bytes", F.lit(0))
    order = F.struct((-size).alias("s"), F.col("path").alias("p"))
    # the number of different sizes is not needed exactly: all equal or not
    return (
        listed(files)
        .where("md5 is not null")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.min("size_bytes") == F.max("size_bytes"), F.lit(False)).alias("size_match"),
            F.sum(size).alias("bytes"),
            (F.sum(size) - F.max(size)).alias("wasted"),
            F.min(order)["p"].alias("keep"),
        )
        .where("n > 1")
    )


def exact_members(files: DataFrame) -> DataFrame:
    """``md5, path, is_keep``: the files of the exact groups, one row each."""
    groups = exact_groups(files).select("md5", "keep")
    return listed(files).join(groups, "md5").select("md5", "path", (F.col("path") == F.col("keep")).alias("is_keep"))


def duplicate_stats(files: DataFrame) -> DataFrame:
    """``kinds, groups, files, wasted`` by the number of different extensions in a group, and in total (kinds 0)."""
    f = listed(files).where("md5 is not null").select("md5", "path", extension(F.col("path")).alias("ext"), F.coalesce("size_bytes", F.lit(0)).alias("size"))
    per = f.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ext").alias("kinds"), (F.sum("size") - F.max("size")).alias("wasted")).where("n > 1")
    out = per.rollup("kinds").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("files"), F.sum("wasted").alias("wasted"))
    return out.select(F.coalesce("kinds", F.lit(0)).cast("bigint").alias("kinds"), "groups", "files", "wasted")


def latest_entries(cache: DataFrame) -> DataFrame:
    """The newest cache entry of each path: by scan time (null is the oldest), then by id."""
    c = cache.where("path is not null")
    newest = c.groupBy("path").agg(F.max(F.struct("scanned_at", "entry_id", "sig", "md5", "size_bytes")).alias("e"))
    return newest.select("path", "e.entry_id", "e.sig", digest(F.col("e.md5")).alias("md5"), "e.size_bytes")


def changed_files(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, sig, reason`` of the files to hash again: new, changed (other signature) or unhashed (no digest cached)."""
    now = listed(files).select("path", F.coalesce(signature(F.col("size_bytes"), F.col("mtime")), F.lit("")).alias("sig"))
    old = latest_entries(cache).select("path", F.col("sig").alias("old_sig"), F.col("md5").alias("old_md5"), F.lit(True).alias("known"))
    met = now.join(old, "path", "left")
    reason = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("old_sig").isNull() | (F.col("old_sig") != F.col("sig")), "changed")
        .when(F.col("old_md5").isNull(), "unhashed")
    )
    return met.select("path", "sig", reason.alias("reason")).where("reason is not null")


def unframed_files(files: DataFrame, frames: DataFrame) -> DataFrame:
    """``path`` of the files without frames."""
    return listed(files).select("path").distinct().join(frames.select("path"), "path", "left_anti")


def replaced_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after a scan for digests: entries of scanned files are replaced as a whole, others stay."""
    now = listed(files).select("path", signature(F.col("size_bytes"), F.col("mtime")).alias("sig"), "md5", "size_bytes")
    old = latest_entries(cache).select("path", "sig", "md5", "size_bytes")
    return now.unionByName(old.join(now.select("path"), "path", "left_anti"))


def merged_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after a scan that merges: null fields of the new entry keep the old value."""
    now = listed(files).select("path", signature(F.col("size_bytes"), F.col("mtime")).alias("sig"), "md5", "size_bytes")
    old = latest_entries(cache).select("path", *[F.col(c).alias(f"old_{c}") for c in ("sig", "md5", "size_bytes")])
    met = now.join(old, "path", "full")
    return met.select("path", *[F.coalesce(c, f"old_{c}").alias(c) for c in ("sig", "md5", "size_bytes")])


def usable_hist(h: Column) -> Column:
    return F.coalesce((F.size(h) == 16) & F.exists(h, lambda x: x != 0) & F.forall(h, lambda x: x.isNotNull()), F.lit(False))


def hist_cosine(a: Column, b: Column) -> Column:
    """Cosine of two histograms; 0 for empty, unequal or zero ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def frame_tier(dh: Column, ph: Column, cosine: Column) -> Column:
    """The rank of the strictest tier that two frames reach: 0, 1, 2, or null."""
    rules = [(dh <= d) & (ph <= p) & (cosine >= c) for _, d, p, c in fixed.TIERS]
    chain = F.when(rules[0], 0)
    for rank, rule in enumerate(rules[1:], 1):
        chain = chain.when(rule, rank)
    return chain


def media_frames(frames: DataFrame) -> DataFrame:
    """Distinct frames with ``nf``, the number of frames of the path."""
    f = frames.where("path is not null").select("path", "frame", "dh", "dh16", "ph", "hist").distinct()
    return f.withColumn("nf", F.count(F.lit(1)).over(Window.partitionBy("path")))


def bucket_sizes(frames: DataFrame) -> DataFrame:
    """``dh16, n``: how many paths have their first frame in each bucket (16 bits)."""
    first = frames.where("path is not null").groupBy("path").agg(F.min(F.struct("frame", "dh16"))["dh16"].alias("dh16"))
    return first.where("dh16 is not null").select("path", F.col("dh16").bitwiseAND(F.lit(0xFFFF)).alias("dh16"))


def bucket_candidates(frames: DataFrame) -> DataFrame:
    """``dh16, n, same_pairs, near_pairs`` per bucket: how many comparisons a bucket search would make.

    A bucket of two or more paths is compared with itself and with the 16 buckets
    that differ in one bit.
    """
    sizes = bucket_sizes(frames).groupBy("dh16").agg(F.count(F.lit(1)).alias("n"))
    probes = sizes.where("n > 1").select("dh16", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("dh16").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))).alias("other"))
    near = probes.join(sizes.select(F.col("dh16").alias("other"), F.col("n").alias("m")), "other").groupBy("dh16").agg(F.sum(F.col("n") * F.col("m")).alias("near_pairs"))
    out = sizes.join(near, "dh16", "left")
    return out.select("dh16", "n", F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("same_pairs"), F.coalesce("near_pairs", F.lit(0)).alias("near_pairs"))


def matched_paths(frames: DataFrame, scratch: Scratch, min_tier: str = TIER_NAMES[-1]) -> DataFrame:
    """``a, b, tier`` of all path pairs (a < b) that reach ``min_tier`` or a stricter one with at least half of their frame pairs; the strictest rank.

    Frames with an unusable histogram or null hashes count but never match.
    """
    kept = TIER_NAMES.index(min_tier) + 1
    _, dh_bits, ph_bits, _ = fixed.TIERS[kept - 1]
    f = media_frames(frames)
    usable = f.where(usable_hist(F.col("hist")) & F.col("dh").isNotNull() & F.col("ph").isNotNull())
    usable = scratch.keep(usable, "usable")
    patterns = scratch.keep(usable.groupBy(F.col("dh").alias("v"), F.col("ph").alias("w")).agg(F.count(F.lit(1)).alias("n")), "patterns")
    near = near_pairs(patterns, plan_for(patterns.count(), dh_bits), ph_bits)
    pairs = near.unionByName(patterns.where("n > 1").selectExpr("v as v1", "w as w1", "v as v2", "w as w2"))
    side = lambda s, v, w: usable.select(F.col("dh").alias(v), F.col("ph").alias(w), *[F.col(c).alias(f"{s}_{c}") for c in ("path", "frame", "hist", "nf")])
    met = pairs.join(side("a", "v1", "w1"), ["v1", "w1"]).join(side("b", "v2", "w2"), ["v2", "w2"])
    met = met.where("a_path <> b_path and (v1 <> v2 or w1 <> w2 or a_path < b_path)")
    bits = lambda c: F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2")))
    tier = frame_tier(bits("v"), bits("w"), hist_cosine(F.col("a_hist"), F.col("b_hist")))
    met = met.select(
        F.least("a_path", "b_path").alias("a"),
        F.greatest("a_path", "b_path").alias("b"),
        (F.col("a_nf") * F.col("b_nf")).alias("pairs"),
        tier.alias("rank"),
    ).where(F.col("rank") < kept)
    counted = met.groupBy("a", "b", "pairs").agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in range(kept)])
    chain = F.lit(None).cast("int")
    for k in reversed(range(kept)):
        chain = F.when(2 * F.col(f"k{k}") >= F.col("pairs"), k).otherwise(chain)
    return counted.select("a", "b", chain.alias("tier")).where("tier is not null")


def perceptual_groups(files: DataFrame, frames: DataFrame, scratch: Scratch, min_tier: str = "reencode", same_parent: bool = False) -> DataFrame:
    """``group_id, path, n, tier, score, is_keep`` of files that look alike and share no digest with another file.

    Two files are linked if they match at ``min_tier`` or stricter and their first
    frames fall into one bucket, or into buckets one bit apart of which one
    holds two or more candidates.  Groups are the closure; the tier of a group is
    the strictest among its pairs; the largest file (smallest path among equals)
    is kept.
    """
    l = listed(files)
    exact = exact_members(files).select("path")
    candidates = l.select("path", "parent", F.coalesce("size_bytes", F.lit(0)).alias("size")).join(exact, "path", "left_anti")
    seen = frames.join(candidates.select("path"), "path", "left_semi")
    pairs = scratch.keep(matched_paths(seen, scratch, min_tier), "pairs")
    buckets = bucket_sizes(seen)
    buckets = buckets.join(buckets.groupBy("dh16").agg(F.count(F.lit(1)).alias("n")), "dh16")
    end = lambda s: buckets.join(candidates.select("path", "parent"), "path").select(F.col("path").alias(s), F.col("dh16").alias(f"k{s}"), F.col("n").alias(f"n{s}"), F.col("parent").alias(f"p{s}"))
    met = pairs.join(end("a"), "a").join(end("b"), "b")
    away = F.bit_count(F.col("ka").bitwiseXOR(F.col("kb")))
    met = met.where((away == 0) | ((away == 1) & (F.greatest("na", "nb") > 1)))
    if same_parent:
        met = met.where("pa = pb")
    groups = scratch.keep(closure(met.select("a", "b"), scratch), "groups")
    of = lambda s: groups.select(F.col("node").alias(s), F.col("component").alias(f"g{s}"))
    inner = pairs.join(of("a"), "a").join(of("b"), "b").where("ga = gb").groupBy(F.col("ga").alias("component")).agg(F.min("tier").alias("tier"))
    members = groups.join(candidates.withColumnRenamed("path", "node"), "node")
    head = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("size")).alias("s"), F.col("node").alias("p")))["p"].alias("keep"))
    out = groups.join(head, "component").join(inner, "component")
    name = F.element_at(F.array(*[F.lit(t) for t in TIER_NAMES]), F.col("tier") + 1)
    return out.select(
        F.col("component").alias("group_id"), F.col("node").alias("path"), "n", name.alias("tier"), F.round(1 - F.col("tier") / len(TIER_NAMES), 6).alias("score"), (F.col("node") == F.col("keep")).alias("is_keep")
    )


def all_groups(files: DataFrame, frames: DataFrame, scratch: Scratch, min_tier: str = "reencode") -> DataFrame:
    """``group_id, path, tier, is_keep``: exact groups and perceptual ones; a file in an exact group is in no other."""
    exact = exact_members(files).select(F.col("md5").alias("group_id"), "path", F.lit("exact").alias("tier"), "is_keep")
    return exact.unionByName(perceptual_groups(files, frames, scratch, min_tier).select("group_id", "path", "tier", "is_keep"))


def victims(files: DataFrame, frames: DataFrame, scratch: Scratch, source: str, min_tier: str = "reencode") -> DataFrame:
    """``path, group_id, tier`` of the files to set aside: all but the kept one of each group that touches ``source``.

    In exact groups a file outside ``source`` is kept before files inside, so an
    import never displaces what is there; perceptual groups keep their largest file.
    """
    groups = all_groups(files, frames, scratch, min_tier)
    inside = F.col("path").startswith(source)
    order = F.struct(F.when(F.col("tier") == "exact", inside).otherwise(F.lit(False)).alias("i"), (~F.col("is_keep")).alias("k"), F.col("path").alias("p"))
    keep = groups.groupBy("group_id", "tier").agg(F.min(order)["p"].alias("keep"), F.max(inside).alias("touched"))
    return groups.join(keep.where("touched"), ["group_id", "tier"]).where("path <> keep").select("path", "group_id", "tier")


def group_stats(groups: DataFrame, files: DataFrame) -> DataFrame:
    """``measure, name, value`` of duplicate groups ``group_id, path, tier, is_keep``.

    Measures: 'total' (groups, duplicates, size_matched, md5_matched, perceptual,
    wasted_bytes), 'tier' (groups of each tier) and 'kind' (groups that hold each
    extension).  A group is known by its id and whether it is exact.
    """
    size = listed(files).groupBy("path").agg(F.max("size_bytes").alias("size"))
    g = groups.join(size, "path").withColumn("exact", F.col("tier") == "exact").withColumn("ext", extension(F.col("path")))
    per = g.groupBy("group_id", "exact", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.min("size") == F.max("size"), F.lit(False)).alias("same"), F.sum(F.when(F.col("is_keep"), 0).otherwise(F.coalesce("size", F.lit(0)))).alias("wasted")
    )
    total = per.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if("same").alias("size_matched"), F.count_if("exact").alias("md5_matched"), F.count_if(~F.col("exact")).alias("perceptual"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted_bytes")
    )
    total = total.unpivot([], total.columns, "name", "value").select(F.lit("total").alias("measure"), "name", F.col("value").cast("bigint").alias("value"))
    tiers = per.groupBy(F.col("tier").alias("name")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("tier").alias("measure"), "name", "value")
    kinds = g.select("group_id", "exact", F.col("ext").alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("value")).select(F.lit("kind").alias("measure"), "name", "value")
    return total.unionByName(tiers).unionByName(kinds)
