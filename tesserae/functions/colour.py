"""Column expressions on colours and palettes (maps from colour to weight)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import fixed


def total(weights: Column) -> Column:
    """The sum of a palette's weights, 1 where it is 0."""
    s = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.when(s == 0, 1.0).otherwise(s)


def share(weights: Column, colours: Iterable[str]) -> Column:
    """The summed share of some colours; missing ones count as 0."""
    parts = [F.coalesce(F.try_element_at(weights, F.lit(c)), F.lit(0.0)) for c in colours]
    return reduce(lambda a, b: a + b, parts) / total(weights)


def with_shares(df: DataFrame) -> DataFrame:
    """``df`` with the share of each fixed colour of its palette as ``share_0``...; all 0 for an empty or missing one.

    Rules that use many shares read these columns, so that each is computed once per row.
    """
    df = df.withColumn("palette_total", F.coalesce(total(F.col("weights")), F.lit(1.0)))
    one = lambda c: F.coalesce(F.try_element_at("weights", F.lit(c)), F.lit(0.0)) / F.col("palette_total")
    return df.withColumns({f"share_{i}": one(c) for i, c in enumerate(fixed.COLOURS)})


def shared(*colours: str) -> Column:
    """The summed share of some colours, from the columns of `with_shares`."""
    return reduce(lambda a, b: a + b, [F.col(f"share_{fixed.COLOURS.index(c)}") for c in colours])


def normalised(weights: Column) -> Column:
    t = total(weights)
    return F.transform_values(weights, lambda _, v: v / t)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the colours of ``a``; colours missing in ``b`` count as 0."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + F.coalesce(e["value"] * F.try_element_at(b, e["key"]), F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(a), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two palettes; 0 where either has no length."""
    return F.coalesce(F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))), F.lit(0.0))


def palette_literal(palette: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in palette.items() for x in kv])


def theme_score(weights: Column, theme: str) -> Column:
    """Cosine with the palette of a theme; 0 for an empty or missing palette."""
    return F.when(F.size(weights) > 0, F.least(F.lit(1.0), cosine(normalised(weights), palette_literal(fixed.THEMES[theme])))).otherwise(0.0)


def ranked(weights: Column) -> Column:
    """(negative weight, colour) in order: the greatest weight first, equal weights by name."""
    return F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("colour"))))


def dominant(weights: Column) -> Column:
    return F.get(ranked(weights), F.lit(0))["colour"]


def secondary(weights: Column) -> Column:
    """The second colour if its share is above 12 %."""
    second = F.get(ranked(weights), F.lit(1))
    return F.when(-second["w"] / total(weights) > 0.12, second["colour"])


def suggested(weights: Column) -> Column:
    """The square root of each share, rounded to 4 places."""
    t = total(weights)
    return F.transform_values(weights, lambda _, v: F.round(F.sqrt(v / t), 4))


def buckets(weights: Column) -> Column:
    """The broad palette kinds that apply, in fixed order; empty for an empty or missing palette."""
    s = lambda *c: share(weights, c)
    most = F.array_max(F.map_values(weights)) / total(weights)
    rules = [
        ("dark", s("Black") + s("Purple") * 0.5 + s("Blue") * 0.3 > 0.30),
        ("warm", s("Red", "Orange", "Yellow") > 0.35),
        ("cool", s("Blue", "Teal-Cyan") + s("Green") * 0.5 > 0.30),
        ("neon", s("Pink-Magenta", "Teal-Cyan") > 0.25),
        ("pastel", (s("White") > 0.40) & (most < 0.50)),
        ("monochrome", s("Black", "White", "Gray") > 0.85),
    ]
    found = F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules]))
    return F.when(F.size(weights) > 0, found).otherwise(F.array().cast("array<string>"))


def palette_match(weights: Column, expected: Column) -> Column:
    """The part of the expected colours with a share of 5 % or more; 0.5 where none is expected."""
    t = total(weights)
    names = F.array_distinct(expected)
    hit = F.size(F.filter(names, lambda c: F.coalesce(F.try_element_at(weights, c), F.lit(0.0)) / t >= 0.05))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, 0.5).when(F.coalesce(F.size(weights), F.lit(0)) <= 0, 0.0).otherwise(hit / F.size(names))


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value in percent."""
    rn, gn, bn = r / 255.0, g / 255.0, b / 255.0
    most, least = F.greatest(rn, gn, bn), F.least(rn, gn, bn)
    delta = most - least
    hue = (
        F.when(delta == 0, 0.0)
        .when(most == rn, 60.0 * F.pmod((gn - bn) / delta, F.lit(6.0)))
        .when(most == gn, 60.0 * ((bn - rn) / delta + 2))
        .otherwise(60.0 * ((rn - gn) / delta + 4))
    )
    return F.struct(hue.alias("h"), F.when(most == 0, 0.0).otherwise(delta / most * 100.0).alias("s"), (most * 100.0).alias("v"))


def lab(r: Column, g: Column, b: Column) -> Column:
    """CIE L*a*b* under D65."""
    linear = lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)
    rl, gl, bl = linear(r / 255.0), linear(g / 255.0), linear(b / 255.0)
    bend = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)
    x = bend((rl * 0.4124564 + gl * 0.3575761 + bl * 0.1804375) / 0.95047)
    y = bend(rl * 0.2126729 + gl * 0.7151522 + bl * 0.0721750)
    z = bend((rl * 0.0193339 + gl * 0.1191920 + bl * 0.9503041) / 1.08883)
    return F.struct((116.0 * y - 16.0).alias("l"), (500.0 * (x - y)).alias("a"), (200.0 * (y - z)).alias("b"))


def delta_e(p: Column, q: Column) -> Column:
    """Euclidean distance of two Lab colours."""
    return F.sqrt(sum((F.pow(p[c] - q[c], F.lit(2.0)) for c in ("l", "a", "b")), F.lit(0.0)))


def colour_name(h: Column, s: Column, v: Column) -> Column:
    """One of the 11 colour names."""
    hue = F.pmod(F.floor(h), F.lit(360))
    chain = F.when((v > 85) & (s < 20), "White").when((v < 18) | ((v < 25) & (s < 25)), "Black").when(s < 12, "Gray")
    for end, name in fixed.HUES:
        chain = chain.when(hue < end, name)
    return chain


def colour_styles(h: Column, s: Column, v: Column) -> Column:
    """Flags vaporwave, neon, pastel, nature of one colour."""
    light, dark = (v > 85) & (s < 20), (v < 18) | ((v < 25) & (s < 25))
    chromatic = ~light & ~dark & (s >= 12)
    green = (h >= 65) & (h < 150) & (v > 30) & (v < 80)
    return F.struct(
        (((h >= 280) & (h < 340) | (h >= 170) & (h < 200)) & (s > 50) & (v > 40) & (v < 90)).alias("vaporwave"),
        ((s > 75) & (v > 50) & (v < 95)).alias("neon"),
        ((s >= 20) & (s <= 45) & (v > 55) & (v < 95) & ~light).alias("pastel"),
        (chromatic & F.when(green, (s > 15) & (s < 60)).otherwise(h < 200)).alias("nature"),
    )
