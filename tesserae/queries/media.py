"""Queries on single files: kinds, sizes, gates, library views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import detectors as X
from tesserae.functions import fixed
from tesserae.functions import media as M
from tesserae.operators.ranks import ranked
from tesserae.queries.registry import names, query, values
from tesserae.session import Scratch, table

F_SQL = "f AS (SELECT DISTINCT * FROM files WHERE path IS NOT NULL)"
EXT = r"lower(regexp_extract(path, '[^/.][^/]*(\.[^/.]*)$', 1))"
ASPECT = "CASE WHEN width <= 0 OR height <= 0 THEN 'any' WHEN abs(width - height) * 100 <= greatest(width, height) * 15 THEN 'square' WHEN width > height THEN 'horizontal' ELSE 'vertical' END"
SIGNAL = "CASE WHEN width = 0 OR height = 0 THEN NULL WHEN height > width AND height / greatest(width, 1) > 1.8 THEN 'phone' WHEN height > width THEN 'vertical' WHEN width / greatest(height, 1) > 2.0 THEN 'wide' ELSE 'landscape' END"
KIND = f"CASE WHEN e IN ({names(fixed.STATIC_EXTENSIONS)}) THEN 'image' WHEN e IN ({names(fixed.FRAME_EXTENSIONS)}) THEN 'animated' WHEN e IN ({names(fixed.ANIMATED_EXTENSIONS)}) THEN 'video' ELSE 'image' END"
#: The resolution bins: the first that holds all pixels.
BINS = (("SD", 1280 * 720 - 1), ("HD", 1920 * 1080 - 1), ("FHD", 2560 * 1440 - 1), ("QHD", 3840 * 2160 - 1), ("4K", 5120 * 2880 - 1), ("5K+", 2**62))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("path is not null").distinct()


@query(f"""WITH {F_SQL}, x AS (SELECT path, {EXT} AS e FROM f) SELECT path, CASE WHEN e IN ({names(fixed.SAMPLED_ANIMATIONS)}) THEN 'animated'
  WHEN e IN ({names(fixed.ANIMATED_EXTENSIONS)}) THEN 'video' WHEN e IN ({names(fixed.STATIC_EXTENSIONS)}) THEN 'static' END AS media, {KIND} AS kind FROM x""")
def media_kind(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", M.media_kind(F.col("path")).alias("media"), M.file_kind(F.col("path")).alias("kind"))


@query(f"WITH {F_SQL}, x AS (SELECT path, name, {EXT} AS e FROM f) SELECT path FROM x WHERE e IN ({names((*fixed.STATIC_EXTENSIONS, *fixed.PLUGIN_EXTENSIONS, *fixed.ANIMATED_EXTENSIONS))}) AND NOT starts_with(name, '.') AND name NOT IN ({names(fixed.SKIPPED_NAMES)})")
def supported_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(M.is_supported(F.col("name"))).select("path")


@query(f"WITH {F_SQL} SELECT path, {ASPECT} AS aspect, {SIGNAL} AS signal FROM f")
def aspect_class(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", M.aspect_class(F.col("width"), F.col("height")).alias("aspect"), M.size_signal(F.col("width"), F.col("height")).alias("signal"))


@query(f"""WITH {F_SQL} SELECT path, round(width / height, 6) AS ratio, (width > height)::INT AS is_wide, (height > width)::INT AS is_tall, (abs(width / height - 1) < 0.1)::INT AS is_square,
  (width / height > 2)::INT AS is_ultrawide, (width / height < 0.6)::INT AS is_phone FROM f WHERE width > 0 AND height > 0""")
def aspect_features(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("width") / F.col("height")
    flags = {"is_wide": F.col("width") > F.col("height"), "is_tall": F.col("height") > F.col("width"), "is_square": F.abs(r - 1) < 0.1, "is_ultrawide": r > 2, "is_phone": r < 0.6}
    return files(spark, d).where("width > 0 and height > 0").select("path", F.round(r, 6).alias("ratio"), *[x.cast("int").alias(k) for k, x in flags.items()])


@query(f"""WITH {F_SQL}, b AS (SELECT a / b::DOUBLE AS r, n, k FROM (VALUES {values((a, b, n, k) for k, (a, b, n) in enumerate(fixed.ASPECT_BUCKETS))}) t(a, b, n, k))
  SELECT path, CASE WHEN width > 0 AND height > 0 THEN (SELECT arg_min(n, (abs(r - f.width / f.height), k)) FROM b) ELSE 'image' END AS token FROM f""")
def aspect_bucket(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", M.aspect_token(F.col("width"), F.col("height")).alias("token"))


@query(f"WITH {F_SQL} SELECT path, CASE " + " ".join(f"WHEN width::BIGINT * height <= {most} THEN '{n}'" for n, most in BINS) + " END AS resolution FROM f")
def resolution_bins(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", M.resolution_bin(F.col("width"), F.col("height"), BINS).alias("resolution"))


P_SQL = "p AS (SELECT DISTINCT ON (path) * FROM profiles WHERE path IS NOT NULL)"


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """One profile per path: repeated rows count once (maps cannot be compared by distinct)."""
    return table(spark, d, "profiles").where("path is not null").dropDuplicates(["path"])


G = fixed.GATES
BARE = f"""SELECT *, CASE WHEN skin < 0.08 THEN 0 ELSE least(1, least(1, (skin - 0.05) / 0.30) * CASE WHEN subject >= 0.35 THEN 1 ELSE 0.5 END * CASE WHEN tex < 4.5 THEN 1 ELSE greatest(0, 1 - (tex - 4.5) / 1.5) END) END AS bare FROM
  (SELECT *, CASE WHEN coalesce(len(sh), 0) < 2 THEN 0 ELSE least(1, 1.3 * (1 - sh[1])) END AS subject FROM (SELECT *, list_reverse_sort(list_transform(map_values(weights), lambda x: x / (CASE WHEN list_sum(map_values(weights)) > 0 THEN list_sum(map_values(weights)) ELSE 1 END))) AS sh,
    coalesce(skin_fraction, 0) AS skin, coalesce(texture_entropy, 0) AS tex FROM p))"""


@query(f"""WITH {F_SQL}, {P_SQL}, b AS ({BARE}), c AS (SELECT path, min(category) AS category FROM classified WHERE category IS NOT NULL GROUP BY path), a AS (SELECT min(category) AS least FROM categories)
  SELECT f.path, CASE WHEN size_bytes > {G["most_bytes"]} THEN 'Discarded' WHEN b.path IS NOT NULL AND coalesce(sharpness, 0) < {G["least_sharpness"]} THEN 'Low-Quality' WHEN bare >= {G["nsfw"]} THEN 'NSFW' ELSE coalesce(c.category, a.least) END AS gate
  FROM f LEFT JOIN b USING (path) LEFT JOIN c USING (path), a""")
def gate_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Size, sharpness, aesthetic (off by default) and bare-skin gates in their order, then the stored decision, then the first category."""
    stored = table(spark, d, "classified").where("path is not null and category is not null").groupBy("path").agg(F.min("category").alias("category"))
    least = table(spark, d, "categories").agg(F.min("category").alias("least"))
    p = profiles(spark, d).select("path", "sharpness", "aesthetic", X.shares(F.col("weights")).alias("s"), F.coalesce("skin_fraction", F.lit(0.0)).alias("skin"), F.coalesce("texture_entropy", F.lit(0.0)).alias("tex"), F.lit(True).alias("seen"))
    p = p.withColumn("bare", X.bare_skin(F.col("skin"), X.subject_area(F.col("s")), F.col("tex")))
    rows = files(spark, d).select("path", "size_bytes").join(p, "path", "left").join(stored, "path", "left").crossJoin(F.broadcast(least))
    gate = X.gate(F.col("size_bytes"), F.col("seen"), F.col("sharpness"), F.col("aesthetic"), F.col("bare"), F.lit(None).cast("double"))
    return rows.select("path", F.coalesce(gate, "category", "least").alias("gate"))


@query(f"""SELECT path, confidence, CASE WHEN confidence >= {G["nsfw"]} OR (confidence >= {G["reply_unsure"]} AND confidence >= {G["reply_nsfw"]}) THEN 'NSFW' END AS either, CASE WHEN confidence >= {G["reply_unsure"]} AND confidence >= {G["reply_nsfw"]} THEN 'NSFW' END AS reply_only FROM (SELECT DISTINCT path, confidence FROM classified)""")
def nsfw_gate(spark: SparkSession, d: str) -> DataFrame:
    """The two triggers of the bare-skin gate on the stored scores: measured or replied, and replied alone."""
    rows = table(spark, d, "classified").select("path", "confidence").distinct()
    none = F.lit(None).cast("double")
    gate = lambda bare, reply: X.gate(F.lit(0), F.lit(True), F.lit(1e9), F.lit(1.0), bare, reply)
    return rows.select("path", "confidence", gate(F.col("confidence"), F.col("confidence")).alias("either"), gate(none, F.col("confidence")).alias("reply_only"))


#: The sort orders of a library page: (SQL, columns with direction).
ORDERS = {
    "name": ("lower(name), path", lambda: [F.lower("name"), "path"]),
    "name_desc": ("lower(name) DESC, path", lambda: [F.desc(F.lower("name")), "path"]),
    "oldest": ("mtime NULLS FIRST, path", lambda: [F.asc_nulls_first("mtime"), "path"]),
    "newest": ("mtime DESC NULLS LAST, path", lambda: [F.desc_nulls_last("mtime"), "path"]),
    "smallest": ("size_bytes NULLS FIRST, path", lambda: [F.asc_nulls_first("size_bytes"), "path"]),
    "largest": ("size_bytes DESC NULLS LAST, path", lambda: [F.desc_nulls_last("size_bytes"), "path"]),
    "type": ("kind, lower(name), path", lambda: ["kind", F.lower("name"), "path"]),
}


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """The files that pass a name, type and aspect filter."""
    f = files(spark, d).select("path", "name", "size_bytes", "mtime", M.file_kind(F.col("path")).alias("kind"), M.aspect_class(F.col("width"), F.col("height")).alias("aspect"))
    return f.where(F.lower("name").contains("img") & (F.col("kind") != "video") & F.col("aspect").isin("horizontal", "square"))


def _whole(order: str):
    def whole(spark: SparkSession, d: str) -> DataFrame:
        """All filtered files with their rank in one of the sort orders."""
        return ranked(filtered(spark, d), ORDERS[order][1](), Scratch(spark, "library")).select("path", "kind", "rank")

    return whole


for _order, (_sql, _) in ORDERS.items():
    query(
        f"""WITH {F_SQL}, x AS (SELECT *, {EXT} AS e, {ASPECT} AS aspect FROM f), y AS (SELECT *, {KIND} AS kind FROM x)
  SELECT path, kind, row_number() OVER (ORDER BY {_sql}) AS rank FROM y WHERE contains(lower(name), 'img') AND kind <> 'video' AND aspect IN ('horizontal', 'square')""",
        f"library_{_order}",
    )(_whole(_order))


@query(f"WITH {F_SQL}, x AS (SELECT *, {EXT} AS e, {ASPECT} AS aspect FROM f), y AS (SELECT *, {KIND} AS kind FROM x) SELECT path FROM y WHERE kind <> 'video' AND aspect IN ('vertical', 'square')")
def phone_candidates(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where((M.file_kind(F.col("path")) != "video") & M.aspect_class(F.col("width"), F.col("height")).isin("vertical", "square")).select("path")


@query(f"""WITH {P_SQL} SELECT path, round(CASE WHEN coalesce(anime_score, 0) > 0.25 THEN least(1.2, 1.2 * ((coalesce(anime_score, 0) - 0.25) / 0.25)) ELSE 0 END, 6) AS anime,
  round(CASE WHEN coalesce(sharpness, 0) > 200 THEN least(0.5, 0.5 * ((coalesce(sharpness, 0) - 200) / 300)) ELSE 0 END, 6) AS sharp,
  round(greatest(0, least(1, coalesce(sharpness, 0) / 1500)), 6) AS sharp_scaled, round(greatest(0, least(1, coalesce(texture_entropy, 0) / 6)), 6) AS texture_scaled FROM p""")
def ramps(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return profiles(spark, d).select(
        "path",
        F.round(M.ramp(c("anime_score"), 0.25, 1.2, 0.25), 6).alias("anime"),
        F.round(M.ramp(c("sharpness"), 200, 0.5, 300), 6).alias("sharp"),
        F.round(M.rescaled(c("sharpness"), *fixed.FEATURE_RANGES["sharpness"]), 6).alias("sharp_scaled"),
        F.round(M.rescaled(c("texture_entropy"), *fixed.FEATURE_RANGES["texture_entropy"]), 6).alias("texture_scaled"),
    )


@query(f"WITH {F_SQL} SELECT path, substr(md5(name), 1, 8) AS name8, size_bytes::VARCHAR || '-' || floor(mtime)::BIGINT::VARCHAR AS sig FROM f")
def name_digests(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", M.text_digest8(F.col("name")).alias("name8"), M.signature(F.col("size_bytes"), F.col("mtime")).alias("sig"))


@query(f"""WITH {F_SQL}, x AS (SELECT *, {EXT} AS e FROM f), c AS (SELECT DISTINCT path, category FROM classified),
  k AS (SELECT md5 FROM (SELECT CASE WHEN regexp_matches(lower(trim(md5)), '^[0-9a-f]{{32}}$') THEN lower(trim(md5)) END AS md5 FROM f) WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)
  SELECT (SELECT count(*) FROM f) AS total, (SELECT count(DISTINCT category) FROM c) AS categories, (SELECT count(*) FROM k) AS duplicate_groups,
  (SELECT count(*) FROM x WHERE e IN ({names(fixed.ANIMATED_EXTENSIONS)})) AS animated, (SELECT count(*) FROM f WHERE width = 0 OR height = 0) AS unknown_size""")
def dashboard(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    ext = M.extension(F.col("path"))
    counts = f.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ext.isin(*fixed.ANIMATED_EXTENSIONS)).alias("animated"), F.count_if((F.col("width") == 0) | (F.col("height") == 0)).alias("unknown_size")
    )
    groups = f.groupBy(M.digest(F.col("md5")).alias("m")).count().where("m is not null and count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"))
    cats = table(spark, d, "classified").agg(F.count_distinct("category").alias("categories"))
    # three single rows
    return counts.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(cats))


@query(f"""WITH {F_SQL}, c AS (SELECT parent AS category, count(*) AS n FROM f GROUP BY parent)
  SELECT category, n, repeat('#', least(n, 40)::INT) AS bar, '[' || rpad(upper(substr(category, 1, 3)), 3, ' ') || ']' AS icon, category IN (SELECT category FROM categories) AS configured FROM c""")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    from tesserae.functions.text import icon

    n = files(spark, d).groupBy(F.col("parent").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    known = table(spark, d, "categories").select("category", F.lit(True).alias("k"))
    out = n.join(known, "category", "left")
    return out.select("category", "n", F.expr("repeat('#', cast(least(n, 40) as int))").alias("bar"), icon(F.col("category")).alias("icon"), F.coalesce("k", F.lit(False)).alias("configured"))


@query(f"""WITH {F_SQL}, s AS (SELECT parent, sum(coalesce(size_bytes, 0))::BIGINT AS done FROM f GROUP BY parent), t AS (SELECT sum(done) AS total FROM s)
  SELECT parent, round(CASE WHEN done > 0 THEN 10.0 / done * greatest(total - done, 0) END, 6)::DOUBLE AS eta FROM s, t""")
def eta(spark: SparkSession, d: str) -> DataFrame:
    s = files(spark, d).groupBy("parent").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("done"))
    t = s.agg(F.sum("done").alias("total"))
    return s.crossJoin(F.broadcast(t)).select("parent", F.round(M.eta_seconds(F.col("done"), F.col("total"), F.lit(10.0)), 6).alias("eta"))


@query(f"""WITH {F_SQL}, n AS (SELECT path, width % 12 AS n FROM f)
  SELECT path, CASE WHEN n <= 0 THEN '' WHEN n <= 5 THEN array_to_string(range(n), ',') ELSE array_to_string(list_transform(range(5), lambda i: round((n - 1) * i / 4)::INT), ',') END AS frames FROM n""")
def frame_indices(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.array_join(M.sample_indices(F.col("width") % 12, 5).cast("array<string>"), ",").alias("frames"))
