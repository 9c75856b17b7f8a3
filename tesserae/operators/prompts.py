"""Descriptions generated from profiles, and matching of descriptions by TF-IDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed


def _values(columns: Iterable[str]):
    have = set(columns)
    return lambda name, default=0.0: F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)


def palette_phrase(weights: Column) -> Column:
    """The phrases of the dominant and the second colour."""
    phrase = C.palette_literal(fixed.COLOUR_PHRASES)
    first = F.coalesce(F.try_element_at(phrase, C.dominant(weights)), F.lit("varied palette"))
    second = F.try_element_at(phrase, C.secondary(weights))
    return F.when(F.coalesce(F.size(weights), F.lit(0)) > 0, F.concat_ws(", ", first, second)).otherwise("varied colour palette")


def style_phrase(columns: Iterable[str], long: bool = False) -> Column:
    """The phrase of the first style rule that applies; null if none does."""
    v = _values(columns)
    chain = None
    for key, threshold, short_text, long_text in fixed.STYLE_PHRASES:
        rule, text = v(key) >= threshold, long_text if long else short_text
        chain = F.when(rule, text) if chain is None else chain.when(rule, text)
    return chain


def content_phrases(columns: Iterable[str]) -> Column:
    """All content phrases that apply, in order; a column that is missing counts as 0, a null value never applies."""
    have = set(columns)
    found = [F.when((F.col(k).cast("double") if k in have else F.lit(0.0)) >= t, F.lit(text)) for k, t, text in fixed.CONTENT_PHRASES]
    return F.array_compact(F.array(*found))


def mood_phrase(columns: Iterable[str]) -> Column:
    """The mood of palette and style; null for an empty palette or no mood."""
    v, w = _values(columns), F.col("weights")
    s = C.shared
    warm, cool = s("Orange", "Yellow", "Red", "Pink-Magenta"), s("Blue", "Teal-Cyan", "Purple")
    light, dark = s("White", "Yellow"), s("Black", "Blue", "Purple")
    mood = (
        F.when((warm > 0.40) & ((s("Orange") > 0.18) | (s("Pink-Magenta") > 0.18)), "sunset warmth")
        .when(warm > 0.40, "warm atmosphere")
        .when((cool > 0.45) & ((dark > 0.40) | (v("space_score") > 0.30)), "nighttime calm")
        .when(cool > 0.45, "cool atmosphere")
        .when(light > 0.55, "bright airy atmosphere")
        .when(dark > 0.45, "moody dark atmosphere")
        .when((v("vintage_score") > 0.25) | (v("sepia_score") > 0.25), "minimalist monochrome feel")
        .when(v("pastel_score") > 0.30, "soft pastel calm")
        .when(v("neon_score") > 0.30, "vibrant energy")
        .when((v("unique_colors", 256) < 32) & (v("anime_score") > 0.25), "soft pastel calm")
    )
    return F.when(F.coalesce(F.size(w), F.lit(0)) > 0, mood)


def orientation_phrase(w: Column, h: Column) -> Column:
    chain = (
        F.when((h > w) & (h / F.greatest(w, F.lit(1)) > 1.8), "vertical phone wallpaper")
        .when(h > w, "vertical wallpaper")
        .when(w / F.greatest(h, F.lit(1)) > 2.0, "wide panoramic wallpaper")
        .when(w.cast("bigint") * h >= 3840 * 2160, "4K resolution")
        .otherwise("high resolution")
    )
    return F.when((w != 0) & (h != 0), chain)


def prompt(columns: Iterable[str], style: str = "concise") -> Column:
    """A description of the row's profile: concise, detailed or vivid; reads the columns of `colour.with_shares`."""
    columns = list(columns)
    palette, content, mood = palette_phrase(F.col("weights")), content_phrases(columns), mood_phrase(columns)
    short, sized = style_phrase(columns), orientation_phrase(F.col("width"), F.col("height"))
    if style == "concise":
        return F.concat(F.concat_ws(", ", F.coalesce(short, palette), F.get(content, F.lit(0)), mood, sized), F.lit("."))
    if style == "detailed":
        first = F.concat(F.lit("A wallpaper "), palette, F.coalesce(F.concat(F.lit(" in a "), style_phrase(columns, True), F.lit(" style")), F.lit("")), F.lit("."))
        second = F.when(F.size(content) > 0, F.concat(F.lit("The composition is "), F.array_join(F.slice(content, 1, 2), ", "), F.lit(".")))
        return F.concat_ws(" ", first, second, F.concat(F.lit("It evokes a "), mood, F.lit(".")))
    if style == "vivid":
        return F.concat(F.concat_ws(", ", palette, short, mood, F.slice(content, 1, 3), sized), F.lit(", high quality, detailed"))
    raise ValueError(f"unknown style {style!r}")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def prompt_idf(categories: DataFrame) -> DataFrame:
    """``word, df, idf`` over the categories that have a prompt."""
    p = categories.where(F.length("prompt") > 0)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    df = p.select(F.explode(F.array_distinct(words(F.col("prompt")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("word", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _vectors(texts: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """``key, word, x``: normalised TF-IDF; words without a known rarity weigh 1."""
    tf = texts.select(key, F.explode(words(F.col("text"))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    x = tf.join(F.broadcast(idf.select("word", "idf")), "word", "left").select(key, "word", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("x"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, key).select(key, "word", (F.col("x") / F.col("norm")).alias("x"))


def prompt_cosine(texts: DataFrame, categories: DataFrame) -> DataFrame:
    """``text, category, score`` of every distinct text and category prompt that share a word.

    Each distinct text is scored once; the prompts are a fixed, small table.
    """
    idf = prompt_idf(categories)
    t = texts.select("text").where(F.length("text") > 0).distinct()
    a = _vectors(t.withColumn("id", F.col("text")), "id", idf)
    b = _vectors(categories.where(F.length("prompt") > 0).select("category", F.col("prompt").alias("text")), "category", idf)
    met = a.join(F.broadcast(b.withColumnRenamed("x", "y")), "word")
    return met.groupBy(F.col("id").alias("text"), "category").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


def prompt_winner(scores: DataFrame) -> DataFrame:
    """``text, category, score`` where the best score is 0.10 or more and 1.4 times the second; equal scores by name."""
    ranked = scores.groupBy("text").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "category"))), 1, 2).alias("top"))
    first, second = -F.get("top", F.lit(0))["s"], -F.get("top", F.lit(1))["s"]
    clear = (first >= 0.10) & (second.isNull() | (first >= 1.4 * second))
    return ranked.where(clear).select("text", F.get("top", F.lit(0))["category"].alias("category"), F.round(first, 6).alias("score"))


def mean_profiles(profiles: DataFrame, members: DataFrame, scores: Iterable[str]) -> DataFrame:
    """One mean profile per category: scores (null counts as 0), summed palette as shares, floor of the mean size.

    ``members``: ``path, category``.
    """
    scores = list(scores)
    p = profiles.join(members, "path")
    means = p.groupBy("category").agg(
        *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 9).alias(c) for c in scores],
        F.floor(F.avg("width")).cast("int").alias("width"),
        F.floor(F.avg("height")).cast("int").alias("height"),
    )
    parts = p.select("category", F.explode("weights").alias("colour", "w")).groupBy("category", "colour").agg(F.round(F.sum("w"), 9).alias("w"))
    palette = parts.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("colour", "w")))).alias("weights"))
    return means.join(palette, "category", "left")


def category_prompt(means: DataFrame, style: str = "concise") -> DataFrame:
    """``category, prompt`` of mean profiles, led by the category's name."""
    return C.with_shares(means).select("category", F.concat(F.translate("category", "_", " "), F.lit(" style: "), prompt(means.columns, style)).alias("prompt"))
