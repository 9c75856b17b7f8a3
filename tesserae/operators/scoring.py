"""Scoring of every profile against every category, and the decision.

The categories are a fixed, small table that is broadcast: each row of it carries
flags, palette shares and fingerprint structs, so that the thirteen signals are
plain expressions over one row and stay inside generated code.  Only the two
sparse signals (shared tags, shared prompt words) come from equi-joins, as maps per
profile.  Totals per path are hash aggregates with partial sums; no scores of a
path are collected or sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.functions.media import ramp, size_signal
from tesserae.functions.text import clean_tags
from tesserae.operators import prompts, stats, tags
from tesserae.session import spread

#: Parts of the categories whose best score is kept per path.
PARTS = 20
SIGNALS = tuple(fixed.SIGNAL_WEIGHTS)
FINGERPRINT = (
    "vw_score", "neon_score", "pastel_score", "nature_score", "anime_score", "space_score", "skin_fraction", "sharpness", "aesthetic", "minimalist_score",
    "gradient_score", "texture_entropy",
)
#: Tags whose presence in a category opens a rule.
FLAGS = {
    "portrait": ("portrait",), "drawn": ("anime", "illustration"), "minimalist": ("minimalist",), "photo": ("photo", "photograph"), "pattern": ("pattern",),
    "abstract": ("abstract",), "person": ("portrait", "person", "human"), "outdoor": ("landscape", "nature", "outdoor"), "simple": ("minimalist", "simple"),
    "centered": ("centered", "symmetrical"), "digital": ("digital-art", "illustration"), "detailed": ("detailed",), "high": ("high-quality",),
    "voxel": ("voxel", "minecraft", "block", "lego", "game", "8-bit", "pixel-art"), "pixel": ("pixel-art", "8-bit", "retro"),
    "clean": ("minimalist", "simple", "clean", "monochrome"), "figure": ("portrait", "person", "human", "face", "figure"),
    "adult": ("nsfw", "18+", "explicit", "ecchi", "hentai", "mature"), "gradient": ("gradient", "abstract"), "phone": ("phone",), "vertical": ("vertical",),
    "wide": ("wide", "panoramic"), "landscape": ("landscape",),
}


def category_rows(categories: DataFrame, category_stats: DataFrame) -> DataFrame:
    """One row per category with everything the signals need."""
    c = categories.select("category", clean_tags(F.col("tags")).alias("ctags"), "prompt", "palette")
    informative = tags.document_frequency(categories)
    # a style tag counts once for each rule that names it
    times = {t: sum(1 for _, x, _ in fixed.STYLE_RULES if x == t) for _, t, _ in fixed.STYLE_RULES}
    styled = informative.where(F.col("tag").isin(*times))
    factor = reduce(lambda a, kv: F.when(F.col("tag") == kv[0], kv[1]).otherwise(a), times.items(), F.lit(1))
    styled = styled.where(tags.idf(F.col("df") * factor, F.col("n")) >= 1.10).agg(F.collect_set("tag").alias("style_tags"))
    c = c.crossJoin(F.broadcast(styled)).join(stats.fingerprints(category_stats, FINGERPRINT), "category", "left")
    has = lambda names: F.arrays_overlap("ctags", F.array(*[F.lit(n) for n in names]))
    flags = [has(names).alias(f"is_{k}") for k, names in FLAGS.items()]
    styles = [(F.array_contains("ctags", t) & F.array_contains("style_tags", t)).alias(f"st_{i}") for i, t in enumerate(sorted(times))]
    painted = F.coalesce(F.size("palette"), F.lit(0)) > 0
    palette = [F.coalesce(F.try_element_at("palette", F.lit(k)), F.lit(0.0)).alias(f"cp_{i}") for i, k in enumerate(fixed.COLOURS)]
    theme = None
    for t in fixed.THEMES:
        rule = F.lower("category").contains(t)
        theme = F.when(rule, t) if theme is None else theme.when(rule, t)
    return c.select("category", (F.size("ctags") > 0).alias("tagged"), painted.alias("painted"), C.norm(F.col("palette")).alias("cnorm"), theme.alias("theme"), F.lower("category").isin(*FLAGS["adult"]).alias("adult_name"), *flags, *styles, *palette, *[F.coalesce(f"fp_{k}_{f}", F.lit(0.0)).alias(f"fp_{k}_{f}") for f in FINGERPRINT for k in "mrwgdu"])


def profile_rows(profiles: DataFrame, categories: DataFrame) -> DataFrame:
    """One row per profile with its values, shares and ramps, and the sparse signals as maps."""
    have = set(profiles.columns)

    def v(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    names = ("skin_fraction", "aesthetic", "sharpness", "minimalist_score", "gradient_score", "minecraft_score", "pixel_art_score", "portrait_score", "nsfw_score", "tenengrad", "subject_area_ratio", "centeredness", "overall_symmetry", "periodicity_score", "is_periodic", "gradient_complexity", "texture_complexity", "clip_nsfw")
    pw = F.coalesce(F.size("weights"), F.lit(0)) > 0
    shares = [F.when(pw, F.col(f"share_{i}")).otherwise(0.0).alias(f"ps_{i}") for i in range(len(fixed.COLOURS))]
    by_tag = {}
    for key, tag, threshold in fixed.STYLE_RULES:
        by_tag.setdefault(tag, []).append(ramp(v(key), threshold, 1.0))
    style = [sum(by_tag[t], F.lit(0.0)).alias(f"ramp_{i}") for i, t in enumerate(sorted(by_tag))]
    tex, uniq = v("texture_entropy", 6.0), v("unique_colors", 256.0)
    a, s = ramp(v("aesthetic"), 0.5, 0.7, 0.3), ramp(v("sharpness"), 200, 0.5, 300)
    bonus = [
        ramp(v("skin_fraction"), 0.10, 1.5, 0.15).alias("b_portrait"),
        ramp(v("anime_score"), 0.25, 1.2, 0.25).alias("b_drawn"),
        F.when((tex < 4) & (uniq < 96), 1.2 * F.least((4.0 - tex) / 1.5, (96.0 - uniq) / 64)).otherwise(0.0).alias("b_minimalist"),
        F.when((a > 0) & (s > 0), a + s).otherwise(0.0).alias("b_photo"),
        ramp(v("periodicity_score"), 0.4, 1.2, 0.3).alias("b_pattern"),
        ramp(v("gradient_complexity"), 0.4, 0.6, 0.3).alias("b_abstract"),
    ]
    p = C.with_shares(profiles).select(
        "path", pw.alias("pw"), (C.norm(F.col("weights")) / F.col("palette_total")).alias("pnorm"), *shares, *style, *bonus, *[v(n).alias(f"v_{n}") for n in names],
        v("subject_area_ratio", 0.5).alias("subject"), size_signal(F.col("width"), F.col("height")).alias("shape"), F.map_filter("clip_scores", lambda _, x: x.isNotNull()).alias("clip"),
        *[F.when(pw, C.theme_score(F.col("weights"), t)).otherwise(0.0).alias(f"th_{t}") for t in fixed.THEMES],
        *stats.fingerprint_values(FINGERPRINT), prompts.prompt(profiles.columns).alias("text"),
    )
    tag = tags.tag_signal(tags.suggested_tags(profiles), categories)
    tag = tag.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("category", "value"))).alias("tag_map"))
    # at most one entry per category; distinct generated texts are few
    words = prompts.prompt_cosine(p.select("text"), categories).groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("prompt_map"))
    return p.join(tag, "path", "left").join(words, "text", "left")


def signal_columns() -> dict[str, Column]:
    """The thirteen signals of a (profile, category) row; 0 where a signal says nothing."""
    c, zero = F.col, F.lit(0.0)
    f = lambda k, x: F.when(c(f"is_{k}"), x).otherwise(zero)
    cut = lambda x: F.least(x, F.lit(1.0))
    n_style = len({t for _, t, _ in fixed.STYLE_RULES})
    product = sum((c(f"ps_{i}") * c(f"cp_{i}") for i in range(len(fixed.COLOURS))), zero)
    style = sum((F.when(c(f"st_{i}"), c(f"ramp_{i}")).otherwise(zero) for i in range(n_style)), zero)
    style += sum((f(k, c(f"b_{k}")) for k in ("portrait", "drawn", "minimalist", "photo", "pattern", "abstract")), zero)
    content = f("voxel", c("v_minecraft_score") * 1.5) + f("pixel", c("v_pixel_art_score") * 1.5) + f("clean", c("v_minimalist_score") * 1.4)
    content += f("figure", c("v_portrait_score") * 1.2) + f("adult", c("v_nsfw_score") * 1.6) + f("gradient", c("v_gradient_score") * 0.8)
    area = c("v_subject_area_ratio")
    composition = f("person", F.when((area > 0.2) & (area < 0.6), 1.0).otherwise(zero)) + f("outdoor", F.when(c("subject") < 0.3, 1.0).otherwise(zero))
    composition += f("simple", F.when(c("subject") < 0.2, 0.8).otherwise(zero)) + f("centered", F.when((c("v_centeredness") > 0.7) | (c("v_overall_symmetry") > 0.7), 0.8).otherwise(zero))
    quality = f("photo", F.when(c("v_tenengrad") > 100, 1.0).otherwise(zero)) + f("digital", F.when(c("v_tenengrad") > 50, 0.7).otherwise(zero))
    quality += f("detailed", F.when(c("v_sharpness") > 400, 0.7).otherwise(zero)) + f("high", F.when(c("v_aesthetic") > 0.7, 0.8).otherwise(zero))
    pattern = f("pattern", F.greatest("v_periodicity_score", "v_is_periodic")) + f("abstract", F.when(c("v_gradient_complexity") > 0.5, 0.6).otherwise(zero))
    pattern += f("simple", F.when(c("v_texture_complexity") < 0.3, 0.6).otherwise(zero))
    shape = f("phone", F.when(c("shape") == "phone", 1.0).otherwise(zero)) + f("vertical", F.when(c("shape") == "vertical", 0.6).otherwise(zero))
    shape += f("wide", F.when(c("shape") == "wide", 1.0).otherwise(zero)) + f("landscape", F.when((c("shape") == "landscape") & (c("subject") < 0.3), 0.5).otherwise(zero))
    theme = zero
    for t in fixed.THEMES:
        theme = F.when(c("theme") == t, c(f"th_{t}")).otherwise(theme)
    base = stats.fingerprint_score(FINGERPRINT)
    both = c("pw") & c("painted") & (c("pnorm") > 0) & (c("cnorm") > 0)
    finger = F.greatest(zero, cut(base * F.when(both, 0.7).otherwise(1.0) + F.when(both, 0.3 * product / (c("pnorm") * c("cnorm"))).otherwise(zero)))
    look = lambda m: F.coalesce(F.try_element_at(m, c("category")), zero)
    return {
        "tags": look(c("tag_map")),
        "palette": F.greatest(zero, cut(product)),
        "style": F.when(c("tagged"), cut(style / 3.0)).otherwise(zero),
        "content": cut(content / 2.0),
        "theme": theme,
        "composition": cut(composition / 2.0),
        "quality": cut(quality / 2.0),
        "pattern": cut(pattern),
        "size": cut(shape),
        "prompt": look(c("prompt_map")),
        "clip": look(c("clip")),
        "clip_nsfw": F.when(c("adult_name") & (c("v_clip_nsfw") >= 0.30), c("v_clip_nsfw")).otherwise(zero),
        "fingerprint": F.coalesce(finger, zero),
    }


def combined(signals: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), sum((signals[k] * w for k, w in fixed.SIGNAL_WEIGHTS.items()), F.lit(0.0)))


def classified(profiles: DataFrame, categories: DataFrame, category_stats: DataFrame, scratch) -> DataFrame:
    """``path, category, score, confidence``: the best category of every profile.

    Scores are normalised over the categories; a clear lead (twice the second) is
    flattened by the power 0.6, a narrow one (below 1.2) sharpened by 1.4; equal
    scores (to 9 decimals) go to the smaller name.  No categories give no rows.
    """
    spark = profiles.sparkSession
    cats = scratch.keep(category_rows(categories, category_stats), "categories")
    order = sorted(r["category"] for r in cats.select("category").collect())
    if not order:
        return spark.createDataFrame([], "path string, category string, score double, confidence double")
    place = spark.createDataFrame([(k, len(order) - i) for i, k in enumerate(order)], "category string, place bigint")
    cats = F.broadcast(cats.join(F.broadcast(place), "category").withColumn("part", F.col("place") % PARTS))
    rows = spread(scratch.keep(profile_rows(profiles, categories), "profiles"), "path")
    # score and name in one number: 9 decimals of the score, then the place of the name
    base = len(order) + 1
    packed = (F.round(F.col("s") * 1e9).cast("bigint") * base + F.col("place")).alias("packed")
    score = combined(signal_columns())
    scored = rows.crossJoin(cats).select("path", score.alias("s"), "place", "part").select("path", "part", "s", packed)
    parts = scored.groupBy("path", "part").agg(F.max("packed").alias("m"), F.sum("s").alias("s1"), F.sum(F.pow("s", F.lit(0.6))).alias("s06"), F.sum(F.pow("s", F.lit(1.4))).alias("s14"))
    parts = scratch.keep(parts, "parts")
    first = parts.groupBy("path").agg(F.max("m").alias("first"), *[F.sum(c).alias(c) for c in ("s1", "s06", "s14")])
    first = scratch.keep(first.withColumn("part", (F.col("first") % base) % PARTS), "first")
    # the second best is the best of another part, or in the same part: only that one is scored again
    others = parts.join(first.select("path", "first"), "path").where("m < first").select("path", "m")
    again = rows.join(first.select("path", "first", "part"), "path").join(cats, "part").select("path", "first", score.alias("s"), "place").select("path", "first", packed)
    # a condition inside the aggregate: as a filter it would be pushed down and the score computed twice
    again = again.groupBy("path").agg(F.max(F.when(F.col("packed") < F.col("first"), F.col("packed"))).alias("m"))
    second = others.unionByName(again).groupBy("path").agg(F.max("m").alias("second"))
    value = lambda c: F.floor(F.col(c) / base) / 1e9
    out = first.join(second, "path", "left").select("path", value("first").alias("a"), value("second").alias("b"), (F.col("first") % base).alias("place"), "s1", "s06", "s14")
    total = F.when(F.col("s1") == 0, 1e-9).otherwise(F.col("s1"))
    gap = F.when(F.col("b").isNotNull() & (F.col("a") > 0), (F.col("a") / total) / F.greatest(F.col("b") / total, F.lit(0.01)))
    share = lambda p, s: F.pow(F.col("a"), F.lit(p)) / F.col(s)
    confidence = F.when(gap > 2.0, share(0.6, "s06")).when(gap < 1.2, share(1.4, "s14")).otherwise(F.col("a") / total)
    return out.join(F.broadcast(place), "place").select("path", "category", F.round("a", 6).alias("score"), F.round(confidence, 3).alias("confidence"))


def decided_rows(decided: DataFrame, profiles: DataFrame, categories: DataFrame, category_stats: DataFrame, scratch) -> DataFrame:
    """The scoring rows of each path with its decided category."""
    rows = scratch.keep(profile_rows(profiles, categories), "decided-profiles").join(decided.select("path", "category"), "path")
    return rows.join(scratch.keep(category_rows(categories, category_stats), "decided-categories"), "category")


def explained(profiles: DataFrame, categories: DataFrame, category_stats: DataFrame, scratch, most: int = 3, signals: int = 3) -> DataFrame:
    """``path, place, category, share, reasons``: the ``most`` best categories of every profile and why.

    ``share`` is the score's part of all scores of the path; ``reasons`` are the
    strongest weighted signals of those above 0.05 as 'name=value' with two decimals.
    The best are found as the greatest numbers per part of the (fixed) categories,
    so no path's scores are collected; only the winners' signals are written out.
    """
    spark = profiles.sparkSession
    cats = scratch.keep(category_rows(categories, category_stats), "categories")
    order = sorted(r["category"] for r in cats.select("category").collect())
    if not order:
        return spark.createDataFrame([], "path string, place int, category string, share double, reasons string")
    place = spark.createDataFrame([(k, len(order) - i) for i, k in enumerate(order)], "category string, name bigint")
    cats = F.broadcast(cats.join(F.broadcast(place), "category"))
    rows = spread(scratch.keep(profile_rows(profiles, categories), "profiles"), "path")
    base = len(order) + 1
    scored = rows.crossJoin(cats).select("path", combined(signal_columns()).alias("s"), "name")
    scored = scratch.keep(scored.select("path", "s", (F.round(F.col("s") * 1e9).cast("bigint") * base + F.col("name")).alias("packed")), "scores")
    total = scored.groupBy("path").agg(F.sum("s").alias("total"), F.max("packed").alias("p1"))
    best = total.select("path", "total", F.lit(1).alias("place"), F.col("p1").alias("packed"))
    last = total.select("path", F.col("p1").alias("below"))
    for k in range(2, most + 1):
        nxt = scored.join(last, "path").groupBy("path").agg(F.max(F.when(F.col("packed") < F.col("below"), F.col("packed"))).alias("packed")).where("packed is not null")
        nxt = scratch.keep(nxt, f"place-{k}")
        best = best.unionByName(nxt.join(total.select("path", "total"), "path").select("path", "total", F.lit(k).alias("place"), "packed"))
        last = nxt.select("path", F.col("packed").alias("below"))
    best = best.select("path", "total", "place", "packed", (F.col("packed") % base).alias("name"))
    met = rows.join(best, "path").join(cats, "name")
    found = signal_columns()
    ranked = F.array_sort(F.array_compact(F.array(*[F.when(found[k] > 0.05, F.struct((-F.round(found[k] * w, 9)).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for i, (k, w) in enumerate(fixed.SIGNAL_WEIGHTS.items())])))
    reasons = F.array_join(F.transform(F.slice(ranked, 1, signals), lambda x: F.concat(x["k"], F.lit("="), F.format_number(-x["v"], 2))), ", ")
    score = F.floor(F.col("packed") / base) / 1e9
    return met.select("path", "place", "category", F.round(score / F.when(F.col("total") > 0, F.col("total")).otherwise(1e-9), 3).alias("share"), reasons.alias("reasons"))
