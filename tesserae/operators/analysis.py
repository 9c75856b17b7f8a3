"""From decoded images to profiles, decisions, tags and names; and decisions from the stored answers of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import detectors as X
from tesserae.functions import fixed, kernels, pixels
from tesserae.functions import text as T
from tesserae.functions.media import aspect_token
from tesserae.operators import scoring, tags


def _none() -> Column:
    return F.array().cast("array<string>")


def image_words(images: DataFrame) -> DataFrame:
    """``path`` and the features that are names (`kernels.words`); null for images that cannot be used."""
    names = [f.split()[0] for f in kernels.WORDS_SCHEMA.split(", ")[1:]]
    return images.mapInPandas(pixels._rows(kernels.words, names), kernels.WORDS_SCHEMA)


def profiles(images: DataFrame) -> DataFrame:
    """The profile of every usable image: palette, styles, content detectors, sharpness and shape, one row per path.

    The palette is computed in Python; colours, styles and scores are expressions
    over its at most 12 rows per image, summed with partial results.
    """
    p = pixels.image_palettes(images).select("path", "r", "g", "b", "share", C.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x"))
    h, s, v = (F.col(f"x.{k}") for k in "hsv")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    p = p.withColumn("colour", C.colour_name(h, s, v)).withColumn("style", C.colour_styles(h, s, v))
    part = lambda rule: F.sum(F.when(rule, F.col("share")).otherwise(0.0))
    scores = p.groupBy("path").agg(
        *[part(F.col(f"style.{k}")).alias(f"{n}_score") for k, n in (("vaporwave", "vw"), ("neon", "neon"), ("pastel", "pastel"), ("nature", "nature"))],
        F.least(F.lit(1.0), 1.5 * part((s > 55) & (v > 40))).alias("anime_score"), part(v < 30).alias("dark"), part((h >= 5) & (h <= 38) & (s >= 15) & (s <= 65) & (v >= 35) & (v <= 92)).alias("skin_fraction"),
        F.least(F.lit(1.0), part(v < 12) + 0.4 * part(F.col("colour") == "Black")).alias("space_score"),
        part(r.between(80, 200) & g.between(50, 170) & (b < g) & (r - b > 25) & (s < 45) & (v > 25)).alias("sepia_score"), part((s < 35) & (h >= 35) & (h <= 60) & (v > 40) & (v < 80)).alias("vintage_score"),
        F.sort_array(F.collect_list("share"), asc=False).alias("shares"),
    )
    weights = p.groupBy("path", "colour").agg(F.sum("share").alias("w")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("colour", "w")))).alias("weights"))
    number = pixels.image_features(images, (pixels.quality, pixels.texture))
    named = image_words(images).select("path", "brightness", "dominant", F.col("unique").cast("double").alias("unique_colors"))
    out = scores.join(weights, "path").join(number, "path").join(named, "path").join(images.select("path", "width", "height"), "path")
    subject = X.subject_area(F.col("shares"))
    found = {
        "cyberpunk_score": F.least(F.lit(1.0), F.col("neon_score") * (1 + 0.8 * F.col("dark")) + 0.8 * F.col("vw_score")), "minecraft_score": X.blocks(F.col("shares")), "gradient_score": X.gradient(F.col("shares")),
        "pixel_art_score": X.pixel_art(F.col("unique_colors"), F.col("width"), F.col("height")), "minimalist_score": X.minimalist(F.col("unique_colors"), F.col("skin_fraction"), subject, F.col("texture_entropy")),
        "portrait_score": X.portrait(F.col("skin_fraction"), subject, F.lit(0.5)), "nsfw_score": X.bare_skin(F.col("skin_fraction"), subject, F.col("texture_entropy")), "subject_area_ratio": subject,
        "clip_scores": F.create_map().cast("map<string,double>"),
    }
    return out.withColumns(found).drop("shares", "dark")


def lowlevel(images: DataFrame) -> DataFrame:
    """Profiles with all feature families; where a family names a feature that the profile has, the family's is taken."""
    p, wide = profiles(images), pixels.image_features(images, kernels.FAMILIES)
    return p.drop(*(set(p.columns) & set(wide.columns) - {"path"})).join(wide, "path")


def fusion(images: DataFrame, clip: DataFrame) -> DataFrame:
    """Low-level profiles with the scores of an image-text model: ``path, clip_scores`` of ``clip`` (none where missing)."""
    none = F.create_map().cast("map<string,double>")
    return lowlevel(images).drop("clip_scores").join(clip.select("path", "clip_scores"), "path", "left").withColumn("clip_scores", F.coalesce("clip_scores", none))


def with_clip(images: DataFrame, clip: DataFrame) -> DataFrame:
    """Plain profiles with the scores of an image-text model."""
    none = F.create_map().cast("map<string,double>")
    return profiles(images).drop("clip_scores").join(clip.select("path", "clip_scores"), "path", "left").withColumn("clip_scores", F.coalesce("clip_scores", none))


ANALYZERS: dict[str, Callable[..., DataFrame]] = {"lowlevel": lowlevel, "clip": with_clip, "fusion": fusion, "ollama": profiles}


def analyzer(mode: str) -> Callable[..., DataFrame]:
    """The analyzer of a mode; an unknown mode is a ValueError."""
    if mode not in ANALYZERS:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(sorted(ANALYZERS))}")
    return ANALYZERS[mode]


def analysed(images: DataFrame, categories: DataFrame, category_stats: DataFrame, scratch, mode: str = "lowlevel", **inputs: DataFrame) -> DataFrame:
    """``path, category, confidence, gate, tags, subject``: images to categories in one call.

    The profile of the mode, the gates, the decision over all signals where no gate
    holds a file back, and the tags that describe the same content.
    """
    p = scratch.keep(analyzer(mode)(images, **inputs), "analysed-profiles")
    decided = scoring.classified(p, categories, category_stats, scratch).select("path", "category", "confidence")
    none = F.lit(None).cast("double")
    gate = X.gate(F.lit(0), F.lit(True), F.col("sharpness"), F.col("aesthetic"), F.col("nsfw_score"), none)
    out = p.select("path", gate.alias("gate")).join(decided, "path", "left").join(detected_tags(p), "path", "left")
    return out.select("path", F.coalesce("gate", "category").alias("category"), "confidence", "gate", F.coalesce("tags", _none()).alias("tags"), "subject")


def detected_tags(p: DataFrame, most: int = 8) -> DataFrame:
    """``path, tags, subject``: the content tags of each profile, and the first of them."""
    s = tags.suggested_tags(p, 12).select("path", F.slice("tags", 1, most).alias("tags"))
    return s.select("path", "tags", F.get("tags", F.lit(0)).alias("subject"))


def best_score(scores: Column, known: Column, least: float) -> Column:
    """The category of the greatest score among the known ones if it is above ``least``; equal scores by name."""
    rows = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull() & F.array_contains(known, e["key"]))
    first = F.get(F.array_sort(F.transform(rows, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))
    return F.when(-first["v"] > least, first["k"])


def score_cascade(p: DataFrame, categories: DataFrame, by_tags: DataFrame, fallback: DataFrame, least: float) -> DataFrame:
    """``path, category``: by the model's scores (``clip_scores``) above ``least``, else by tags, else the fallback.

    ``by_tags`` and ``fallback``: ``path, category``.  The categories are a fixed table.
    """
    known = categories.agg(F.collect_set("category").alias("known"))
    rows = p.select("path", "clip_scores").crossJoin(F.broadcast(known)).select("path", best_score(F.col("clip_scores"), F.col("known"), least).alias("a"))
    rows = rows.join(by_tags.select("path", F.col("category").alias("b")), "path", "left").join(fallback.select("path", F.col("category").alias("c")), "path", "left")
    return rows.select("path", F.coalesce("a", "b", "c").alias("category"))


def file_tags(stored: Column, suggested: Column, weights: Column, most: int = 8) -> Column:
    """A model's tags, else suggested ones, else the three strongest colours; ``most`` at most."""
    top = F.transform(F.slice(C.ranked(weights), 1, 3), lambda x: F.lower(x["colour"]))
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.slice(F.coalesce(some(stored), some(suggested), some(top), _none()), 1, most)


def fallback_name(primary: Column, weights: Column, width: Column, height: Column, brightness: Column, content8: Column, most: int = 4) -> Column:
    """Words for a file name, never none: tags, colours, aspect, brightness; a digest where there is nothing else."""
    cols = F.coalesce(F.transform(F.slice(C.ranked(weights), 1, most), lambda x: F.lower(x["colour"])), _none())
    every = F.concat(T.tag_components(F.coalesce(primary, _none()), 60), cols, F.array(aspect_token(width, height)), F.array_compact(F.array(F.nullif(brightness, F.lit("")))))
    found = F.slice(F.array_distinct(every), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(content8))


def learned_tags(have: Column, suggested: Column, category: Column) -> Column:
    """A category's tags with the suggested ones (and the fixed ones of the adult folder), sorted."""
    more = F.concat(suggested, F.when(category == "NSFW", F.array(*[F.lit(t) for t in fixed.ADULT_TAGS])).otherwise(_none()))
    return F.array_sort(F.array_union(F.transform(have, F.lower), F.transform(more, F.lower)))


def structured(raw: Column, focused: Column, most: int = 8) -> Column:
    """A model's tags that are registered and not generic, cleaned, distinct, ``most`` at most."""
    low = F.transform(raw, lambda t: F.rtrim(F.lower(F.trim(t)), F.lit(".,;:!?\"'")))
    return F.slice(F.array_distinct(F.filter(low, lambda t: (t != "") & ~t.isin(*fixed.GENERIC_TAGS) & F.array_contains(focused, t))), 1, most)


def cleaned_categories(categories: DataFrame, threshold: float = 0.5, most: int = 25) -> DataFrame:
    """``category, before, kept, removed``: tags cleaned category by category in order of name, each seeing what the earlier ones left.

    The order matters, so the fixed table of categories is worked on by the driver.
    """
    rows = categories.select("category", T.clean_tags(F.col("tags")).alias("tags")).where("category is not null").collect()
    live, out = {r["category"]: list(r["tags"] or []) for r in rows}, []
    held: dict[str, int] = {}
    for own in live.values():
        for t in own:
            held[t] = held.get(t, 0) + 1
    for name in sorted(live):
        own = live[name]
        kept = [t for t in own if t in fixed.ALWAYS_KEPT or held[t] < threshold * len(live)][:most]
        removed = [t for t in own if t not in kept]
        for t in removed:
            held[t] -= 1
        live[name] = kept
        out.append((name, len(own), len(kept), removed))
    return categories.sparkSession.createDataFrame(out, "category string, before int, kept int, removed array<string>")


def mapped_by_model(rows: DataFrame, load: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, tries: int = 3) -> DataFrame:
    """Rows through a model or service: loaded once per Python worker, each batch tried again after 1, 2, 4 ... seconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = load()
        for batch in batches:
            for k in range(tries):
                try:
                    out = apply(model, batch)
                    break
                except OSError:
                    if k + 1 == tries:
                        raise
                    time.sleep(2**k)
            yield out

    return rows.mapInPandas(run, schema)


def drawn_pictures(spark, n: int = 40, width: int = 48, height: int = 32) -> DataFrame:
    """``n`` pictures drawn by a rule, in the columns of `sources.readers.pixels`, for machines without image files."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:height, :width]
        for b in batches:
            out = []
            for i in b["id"]:
                red, green = (x * 5 + y * 3 * (i % 7) + 17 * i) % 256, (x * x + y * 7 + i * 29) % 256
                blue = ((x // 8 + y // 8 + i) % 2) * 200 + i % 50
                out.append((f"picture-{i:03}", width, height, 3, np.stack([blue, green, red], axis=2).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "channels", "data"])

    return spark.range(n).mapInPandas(draw, "path string, width int, height int, channels int, data binary")
