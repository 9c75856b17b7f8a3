"""Matching of paths by their perceptual frames.

Two frames match if ``dh`` differs in at most 8 bits, ``ph`` in at most 10, both
``hist`` are usable (16 numbers, not all 0) and their cosine is at least 0.85.
Two paths match if at least half of all pairs of their frames match.

Paths with the same multiset of frames form one class; everything is computed on
one representative per class, so copies never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DH_BITS, PH_BITS, MIN_COSINE, MIN_SHARE = 8, 10, 0.85, 0.5


def digest(column: str | Column) -> Column:
    """The 32 lower-case hexadecimal digits of a digest, or null if it is none."""
    text = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return F.when(text.rlike("^[0-9a-f]{32}$"), text)


def usable_hist(hist: str | Column) -> Column:
    """16 numbers of which at least one is not 0; nulls make it unusable."""
    h = F.col(hist) if isinstance(hist, str) else hist
    return F.coalesce((F.size(h) == 16) & F.forall(h, lambda x: x.isNotNull()) & F.exists(h, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda s, x: s + x)


def frame_rows(frames: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Distinct frames ``path, frame, dh, ph, hist`` of the given paths, laid out by path.

    Frames without path are dropped.  ``hist`` is null where unusable; a null
    ``dh`` or ``ph`` makes a frame that counts but never matches.
    """
    rows = frames.select("path", "frame", "dh", "ph", "hist").where("path is not null").repartition("path")
    if paths is not None:
        rows = rows.join(paths.select("path"), "path", "left_semi")
    rows = rows.dropDuplicates(["path", "frame", "dh", "ph", "hist"])
    ok = usable_hist("hist") & F.col("dh").isNotNull() & F.col("ph").isNotNull()
    return rows.withColumn("hist", F.when(ok, F.col("hist")))


def path_frames(rows: DataFrame) -> DataFrame:
    """``path, cid, nf, fs`` of rows of `frame_rows`: the class of equal frame multisets, the number of frames, and the usable ones.

    ``cid`` is a pair of hashes of the whole multiset (112 bits), so that classes stay apart however many there are.
    """
    content = ["dh", "ph", "hist"]
    per = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("nf"),
        F.sum(F.shiftright(F.xxhash64(*content), 16)).alias("s1"),
        F.sum(F.shiftright(F.xxhash64(F.lit(7), *content), 16)).alias("s2"),
        F.collect_list(F.when(F.col("hist").isNotNull(), F.struct("dh", "ph", "hist", dot(F.col("hist"), F.col("hist")).cast("double").alias("nn")))).alias("fs"),
    )
    cid = F.struct(F.xxhash64("nf", "s1", "s2").alias("h"), F.xxhash64("s2", "s1", "nf").alias("i"))
    return per.select("path", cid.alias("cid"), "nf", "fs")


def classes_match(a: str, b: str) -> Column:
    """Whether at least half of all frame pairs of the classes in ``{a}nf, {a}fs`` and ``{b}nf, {b}fs`` match."""

    def match(x: Column, y: Column) -> Column:
        near = (F.bit_count(x["dh"].bitwiseXOR(y["dh"])) <= DH_BITS) & (F.bit_count(x["ph"].bitwiseXOR(y["ph"])) <= PH_BITS)
        return near & (dot(x["hist"], y["hist"]) / F.sqrt(x["nn"] * y["nn"]) >= MIN_COSINE)

    matched = F.aggregate(f"{a}fs", F.lit(0).cast("bigint"), lambda s, x: s + F.size(F.filter(f"{b}fs", lambda y: match(x, y))))
    return 2 * matched >= F.col(f"{a}nf") * F.col(f"{b}nf")


def prefixes(classes: DataFrame, keys: tuple[str, ...] = ("cid",), extra: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, nf, u, v, w``: the rarest frames of each class, so many that two matching classes have a matching pair among theirs.

    If p and q of the n and m frames are taken and 2 * p * q > n * m, then fewer than
    half of all pairs lie outside, whatever frames are taken.  p is therefore the
    least number with 2 * p * p > n * n.  Unusable frames are taken first: they
    match nothing.  ``u`` is the number of usable frames; a class with fewer than
    half usable ones can match none.  Patterns that many classes hold (of the same
    ``keys[1:]``) are taken last.  ``extra`` names fields of the frames to keep.
    """
    take = (F.floor(F.col("nf") / F.sqrt(F.lit(2.0))) + 1 - F.col("nf") + F.size("fs")).cast("int")
    able = classes.where(2 * F.size("fs") >= F.col("nf"))
    c = able.select(*keys, "nf", F.size("fs").alias("u"), take.alias("take"), "fs").where("take > 0")
    out = [*keys, "nf", "u", "v", "w", *extra]
    flat = lambda d: d.select(*keys, "nf", "u", "take", F.explode("fs").alias("f")).select(
        *keys, "nf", "u", "take", F.col("f.dh").alias("v"), F.col("f.ph").alias("w"), *[F.col(f"f.{x}").alias(x) for x in extra]
    )
    whole, part = flat(c.where("take >= u")).select(*out), flat(c.where("take < u"))
    held = able.select(*keys[1:], F.explode("fs").alias("f")).groupBy(*keys[1:], F.col("f.dh").alias("v"), F.col("f.ph").alias("w"))
    common = held.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rare = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("n", F.lit(1)), "v", "w"))
    part = part.join(common, [*keys[1:], "v", "w"], "left").withColumn("at", rare).where("at <= take").select(*out)
    return whole.unionByName(part)
