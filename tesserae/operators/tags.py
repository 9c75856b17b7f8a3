"""Tag vocabularies of categories: frequencies, pollution, matching, suggestion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.functions.text import clean_tags


def category_tags(categories: DataFrame) -> DataFrame:
    """``category, tag``: the distinct cleaned tags of each category."""
    return categories.select("category", F.explode(clean_tags(F.col("tags"))).alias("tag"))


def document_frequency(categories: DataFrame) -> DataFrame:
    """``tag, df, n``: in how many of the ``n`` categories each tag appears."""
    n = categories.agg(F.count(F.lit(1)).alias("n"))
    return category_tags(categories).groupBy("tag").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))


def idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def polluted(categories: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The tags that at least this part of the categories has."""
    return document_frequency(categories).where(F.col("df") >= threshold * F.col("n"))


def without_excluded(tags: Column, most: int) -> Column:
    """Distinct tags in order; a tag that excludes an earlier kept one is dropped; at most ``most``."""
    left = [a for a, b in fixed.EXCLUSIVE] + [b for a, b in fixed.EXCLUSIVE]
    right = [b for a, b in fixed.EXCLUSIVE] + [a for a, b in fixed.EXCLUSIVE]
    clash: dict[str, list[str]] = {}
    for a, b in zip(left, right, strict=True):
        clash.setdefault(a, []).append(b)

    def step(kept: Column, t: Column) -> Column:
        blocked = F.lit(False)
        for tag, others in clash.items():
            blocked = blocked | ((t == tag) & F.arrays_overlap(kept, F.array(*[F.lit(o) for o in others])))
        skip = F.array_contains(kept, t) | blocked | (F.size(kept) >= most)
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(tags, F.array().cast("array<string>"), step)


def without_generic(tags: Column, more: Iterable[str] = ()) -> Column:
    """Distinct tags that are neither generic nor in ``more``, in order."""
    drop = [*fixed.GENERIC_TAGS, *more]
    return F.filter(tags, lambda t: ~t.isin(*drop))


def content_first(tags: Column) -> Column:
    """Colour words behind all others, otherwise in order."""
    words = [*fixed.COLOUR_TAGS.values(), "black", "white", "gray", "grey", "cyan", "magenta"]
    return F.concat(F.filter(tags, lambda t: ~t.isin(*words)), F.filter(tags, lambda t: t.isin(*words)))


def merged_sources(*sources: Column, most: int) -> Column:
    """The tags of several sources, earlier sources first, distinct, content before colours, capped."""
    return F.slice(content_first(F.array_distinct(F.concat(*sources))), 1, most)


def raw_tags(columns: Iterable[str]) -> Column:
    """All tags that the rules give for a profile, in rule order, with repeats.

    Reads the columns of `colour.with_shares`.  A missing column or null value takes the default that each rule states: 0 for
    most, 256 colours, 0.5 for centredness and the subject's area.
    """
    have = set(columns)

    def v(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    w = F.col("weights")
    share = C.shared
    painted = F.coalesce(F.size(w), F.lit(0)) > 0
    rules: list[tuple[Column, tuple[str, ...]]] = [(v(key) >= threshold, (tag,)) for key, tag, threshold in fixed.STYLE_RULES]
    rules += [
        ((v("anime_score") >= 0.25) & (v("unique_colors", 256) <= 32), ("pixel-art",)),
        (v("skin_fraction") > 0.12, ("portrait", "person", "human")),
        (v("sharpness") >= 400, ("detailed",)),
        (v("aesthetic") > 0.6, ("photo", "photograph")),
        (v("centeredness", 0.5) > 0.75, ("centered",)),
        (v("overall_symmetry") > 0.7, ("symmetrical",)),
        ((v("texture_entropy") < 3.0) & (v("unique_colors", 256) < 64), ("minimalist",)),
        (v("texture_entropy") > 4.7, ("detailed",)),
    ]
    out = [F.when(rule, F.lit(tag)) for rule, tags in rules for tag in tags]
    # palette colours in the order of the fixed list
    out += [F.when(painted & (share(c) >= 0.25), F.lit(tag)) for c, tag in fixed.COLOUR_TAGS.items()]
    neutral, warm, cool = share("Black", "White", "Gray"), share("Orange", "Yellow", "Red", "Pink-Magenta"), share("Blue", "Teal-Cyan", "Purple")
    vivid = share("Red", "Orange", "Yellow", "Green", "Teal-Cyan", "Blue", "Purple", "Pink-Magenta")
    broad = F.size(F.filter(F.map_values(w), lambda x: x / F.col("palette_total") > 0.10))
    palette: list[tuple[Column, tuple[str, ...]]] = [
        (neutral > 0.78, ("grayscale", "monochrome", "black-and-white")),
        (neutral > 0.88, ("minimalist",)),
        ((warm > 0.45) & (v("space_score") < 0.4), ("sunset",)),
        ((cool > 0.55) & (v("space_score") > 0.35), ("night",)),
        ((cool > 0.55) & (v("space_score") <= 0.35), ("cool",)),
        ((warm > 0.30) & (cool < 0.20), ("warm",)),
        ((v("nature_score") > 0.25) & (share("Green", "Blue", "Teal-Cyan") > 0.35), ("nature", "landscape", "outdoor")),
        ((vivid > 0.70) & (broad >= 4), ("vibrant", "colorful")),
    ]
    out += [F.when(painted & rule, F.lit(tag)) for rule, tags in palette for tag in tags]
    wd, ht = v("width"), v("height")
    sized = (wd > 0) & (ht > 0)
    subject = v("subject_area_ratio", 0.5)
    last: list[tuple[Column, tuple[str, ...]]] = [
        (sized & (ht > wd), ("vertical",)),
        (sized & (ht > wd) & (ht / wd > 1.8), ("phone",)),
        (sized & (ht <= wd) & (wd / ht > 2.0), ("wide", "panoramic")),
        (sized & (wd * ht >= 1920 * 1080 * 4), ("4k",)),
        (sized & (wd * ht >= 1920 * 1080), ("hd",)),
        ((v("periodicity_score") > 0.6) | (v("is_periodic") > 0.5), ("pattern", "abstract")),
        (v("is_tiled") > 0.5, ("tile", "pattern")),
        (subject > 0.6, ("portrait",)),
        (subject < 0.18, ("minimalist",)),
        (v("skin_fraction") > 0.25, ("figure", "human")),
    ]
    out += [F.when(rule, F.lit(tag)) for rule, tags in last for tag in tags]
    return F.array_compact(F.array(*out))


def suggested_tags(profiles: DataFrame, most: int = 20) -> DataFrame:
    """``path, tags``: the rule tags of each profile after exclusion, in order."""
    p = C.with_shares(profiles)
    raw = p.select("path", raw_tags(profiles.columns).alias("raw"))
    return raw.select("path", without_excluded(F.col("raw"), most).alias("tags"))


def expanded_tags(tags: DataFrame, most: int = 5, least_weight: float = 0.5) -> DataFrame:
    """``path, tag, weight``: up to ``most`` related tags a path does not have yet; the heaviest first, equal weights by name.

    ``tags``: ``path, tags``.  The table of related tags is fixed and small.
    """
    spark = tags.sparkSession
    related = spark.createDataFrame([r for r in fixed.COOCCURRENCE if r[2] >= least_weight], "tag string, related string, weight double")
    met = tags.select("path", "tags", F.explode("tags").alias("tag")).join(F.broadcast(related), "tag").where(~F.expr("array_contains(tags, related)"))
    found = met.groupBy("path").agg(F.collect_set(F.struct((-F.col("weight")).alias("w"), "related")).alias("found"))
    # one entry per related tag: its greatest weight
    per = found.select("path", F.explode("found").alias("x")).groupBy("path", "x.related").agg(F.min("x.w").alias("w"))
    top = per.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("w", "related"))), 1, most).alias("top"))
    return top.select("path", F.explode("top").alias("x")).select("path", F.col("x.related").alias("tag"), (-F.col("x.w")).alias("weight"))


def tag_match(tags: DataFrame, categories: DataFrame, name_bonus: float = 3.0) -> DataFrame:
    """``path, category, score`` of the best category by the summed rarity of shared tags; nothing where none is shared.

    A category whose own name is among the tags gains ``name_bonus``.  Equal scores
    (to 9 decimals) go to the smaller name.  ``tags``: ``path, tags``.
    """
    weights = document_frequency(categories).select("tag", idf(F.col("df"), F.col("n")).alias("idf"))
    rows = category_tags(categories).join(weights, "tag")
    met = tags.select("path", "tags", F.explode(F.array_distinct("tags")).alias("tag")).join(F.broadcast(rows), "tag")
    score = met.groupBy("path", "category").agg((F.sum("idf") + F.when(F.max(F.expr("array_contains(tags, lower(category))")), name_bonus).otherwise(0.0)).alias("s"))
    best = score.groupBy("path").agg(F.min(F.struct((-F.round("s", 9)).alias("s"), "category")).alias("b"))
    return best.select("path", "b.category", F.round(-F.col("b.s"), 6).alias("score"))


def tag_signal(tags: DataFrame, categories: DataFrame) -> DataFrame:
    """``path, category, value``: rarity-weighted tag overlap in [0, 1], the best category of a path has 1.

    Tags of 35 % of the categories or more are ignored (unless a path has no
    others); a path that meets 60 % or more of the categories gets nothing.
    """
    n = categories.agg(F.count(F.lit(1)).alias("n"))
    weights = document_frequency(categories).select("tag", idf(F.col("df"), F.col("n")).alias("idf"), (F.col("df") >= 0.35 * F.col("n")).alias("common"))
    rows = category_tags(categories).join(weights, "tag").where("not common").select("category", "tag", "idf")
    seen = tags.select("path", F.explode(F.array_distinct("tags")).alias("tag"))
    met = seen.join(F.broadcast(rows), "tag")
    per = met.groupBy("path", "category").agg(F.sum("idf").alias("s"), F.avg("idf").alias("a"))
    # the bonus for a category's own name among the tags
    own = categories.select("category", F.lower("category").alias("tag")).join(weights, "tag", "left").where("coalesce(idf, 1.0) >= 1.5 and not coalesce(common, false)")
    named = seen.join(F.broadcast(own.select("category", "tag")), "tag").select("path", "category", F.lit(2.0).alias("bonus"))
    raw = per.join(named, ["path", "category"], "left").select("path", "category", (F.col("s") * F.least(F.col("a") / 2.5, F.lit(1.0)) + F.coalesce("bonus", F.lit(0.0))).alias("raw"))
    top = raw.groupBy("path").agg(F.max("raw").alias("best"), F.count(F.lit(1)).alias("active")).crossJoin(F.broadcast(n)).where("active < n * 0.6")
    return raw.join(top, "path").select("path", "category", (F.col("raw") / F.col("best")).alias("value"))
