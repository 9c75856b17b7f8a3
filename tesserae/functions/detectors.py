"""Column expressions that detect kinds of content from palette shares and a few numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.functions.media import aspect_class


def shares(weights: Column) -> Column:
    """The shares of a palette, greatest first; null for a missing palette."""
    t = C.total(weights)
    return F.sort_array(F.transform(F.map_values(weights), lambda w: w / t), asc=False)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _n(s: Column) -> Column:
    return F.coalesce(F.size(s), F.lit(0))


def blocks(s: Column) -> Column:
    """Few colours of which three cover most: block-built pictures."""
    n = _n(s)
    return F.when((n <= 0) | (n > 12), 0.0).otherwise(F.least(F.lit(1.0), _sum(F.slice(s, 1, 3)) * (12 - n) / 6))


def gradient(s: Column) -> Column:
    """Many colours of moderate share, none above half."""
    n = _n(s)
    spread = _sum(F.transform(s, lambda x: F.least(x, F.lit(0.20)))) / F.least(n, F.lit(12))
    return F.when((n < 4) | (F.get(s, F.lit(0)) > 0.5), 0.0).otherwise(F.least(F.lit(1.0), 1.5 * spread))


def subject_area(s: Column) -> Column:
    """A guess of the subject's area: what the first colour leaves."""
    return F.when(_n(s) < 2, 0.0).otherwise(F.least(F.lit(1.0), 1.3 * (1 - F.get(s, F.lit(0)))))


def pixel_art(colours: Column, w: Column, h: Column) -> Column:
    n = w * h
    size = F.when(n < 20000, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (n - 20000) / 80000))
    few = F.when(colours < 64, F.greatest(F.lit(0.0), 1 - (colours - 8) / 56)).otherwise(0.0)
    return F.when(colours <= 0, 0.0).otherwise(F.least(F.lit(1.0), size * few + few * 0.3))


def minimalist(colours: Column, skin: Column, subject: Column, texture: Column) -> Column:
    plus = lambda x: F.greatest(F.lit(0.0), x)
    root = F.pow(plus(1 - colours / 96.0) * plus(1 - subject / 0.4) * plus(1 - texture / 4.0), F.lit(1.0 / 3.0))
    return F.least(F.lit(1.0), root + 0.05 * (1 - F.least(F.lit(1.0), skin / 0.10)))


def portrait(skin: Column, subject: Column, centred: Column) -> Column:
    framed = F.when((subject >= 0.3) & (subject <= 0.7), 1.0).otherwise(0.4)
    return F.when(skin < 0.05, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), skin / 0.25) * framed * (0.6 + 0.4 * centred)))


def bare_skin(skin: Column, subject: Column, texture: Column) -> Column:
    smooth = F.when(texture < 4.5, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (texture - 4.5) / 1.5))
    return F.when(skin < 0.08, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), (skin - 0.05) / 0.30) * F.when(subject >= 0.35, 1.0).otherwise(0.5) * smooth))


def keyword_match(expected: Column, excluded: Column, have: Column) -> Column:
    """The part of the expected words a row has, less the part of the excluded ones; 0.5 where neither is given."""
    part = lambda words: F.size(F.array_intersect(words, have)) / F.greatest(F.size(words), F.lit(1))
    some, none = F.size(expected) > 0, F.size(excluded) > 0
    return F.when(some & none, F.greatest(F.lit(0.0), part(expected) - part(excluded))).when(some, part(expected)).when(none, 1 - part(excluded)).otherwise(0.5)


def config_match(palette: Column, expected: Column, excluded: Column, have: Column, w: Column, h: Column, aspects: list[str], least: tuple[int, int]) -> Column:
    """The mean of palette, keyword, aspect and resolution match."""
    shape = F.lit(1.0) if "any" in aspects else F.when(aspect_class(w, h).isin(*aspects), 1.0).otherwise(0.0)
    size = F.when((w >= least[0]) & (h >= least[1]), 1.0).otherwise(0.3) if least[0] and least[1] else F.lit(1.0)
    return (palette + keyword_match(expected, excluded, have) + shape + size) / 4.0


def gate(size: Column, seen: Column, sharpness: Column, aesthetic: Column, bare: Column, reply: Column, least_aesthetic: float = 0.0, use_reply: bool = True) -> Column:
    """Where a file goes before it is classified, or null: too large, too blurred or plain, or bare skin by measure or by a model's reply.

    ``seen`` is null for files without a profile, which only the size can stop.  The
    aesthetic gate is off at 0.
    """
    g = fixed.GATES
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    blurred = zero(sharpness) < g["least_sharpness"]
    if least_aesthetic > 0:
        blurred = blurred | (zero(aesthetic) < least_aesthetic)
    replied = (zero(reply) >= g["reply_unsure"]) & (zero(reply) >= g["reply_nsfw"]) if use_reply else F.lit(False)
    known = F.coalesce(seen, F.lit(False))
    return F.when(size > g["most_bytes"], "Discarded").when(known & blurred, "Low-Quality").when(known & (replied | (zero(bare) >= g["nsfw"])), "NSFW")
