"""Column expressions on files: formats, sizes, names, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import fixed


def digest(md5: Column) -> Column:
    """32 lower-case hexadecimal digits, or null for anything else."""
    text = F.lower(F.regexp_replace(md5, r"^\s+|\s+$", ""))
    return F.when(text.rlike("^[0-9a-f]{32}$"), text)


def extension(path: Column) -> Column:
    """The extension with its dot in lower case; empty for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]*)$", 1))


def media_kind(path: Column) -> Column:
    """static, animated or video, as frames are sampled; null for other files."""
    ext = extension(path)
    return (
        F.when(ext.isin(*fixed.SAMPLED_ANIMATIONS), "animated")
        .when(ext.isin(*fixed.ANIMATED_EXTENSIONS), "video")
        .when(ext.isin(*fixed.STATIC_EXTENSIONS), "static")
    )


def file_kind(path: Column) -> Column:
    """image, animated or video; image for unknown extensions."""
    ext = extension(path)
    return (
        F.when(ext.isin(*fixed.STATIC_EXTENSIONS), "image")
        .when(ext.isin(*fixed.FRAME_EXTENSIONS), "animated")
        .when(ext.isin(*fixed.ANIMATED_EXTENSIONS), "video")
        .otherwise("image")
    )


def is_supported(name: Column, animations: bool = True) -> Column:
    """Whether a directory scan takes the file."""
    known = [*fixed.STATIC_EXTENSIONS, *fixed.PLUGIN_EXTENSIONS, *(fixed.ANIMATED_EXTENSIONS if animations else ())]
    return extension(name).isin(*known) & ~name.startswith(".") & ~name.isin(*fixed.SKIPPED_NAMES)


def detect_format(content: Column) -> Column:
    """The format of the first bytes; null if unknown or empty.  RIFF kinds go first, then the signatures in order."""
    at = lambda offset, sig: F.substring(content, offset + 1, len(sig)) == F.lit(bytearray(sig))
    rules = [(at(0, b"RIFF") & at(8, kind), name) for kind, name in fixed.RIFF_KINDS]
    rules += [(at(offset, sig), name) for offset, sig, name in fixed.MAGIC]
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0]))


def signature(size_bytes: Column, mtime: Column) -> Column:
    """size-seconds, which changes whenever a file does; null without a size or time."""
    return F.concat(size_bytes.cast("string"), F.lit("-"), F.floor(mtime).cast("bigint").cast("string"))


def aspect_class(w: Column, h: Column) -> Column:
    """any, square (within 15 % of the larger side), horizontal or vertical."""
    return (
        F.when((w <= 0) | (h <= 0) | w.isNull() | h.isNull(), "any")
        .when(F.abs(w - h) * 100 <= F.greatest(w, h) * 15, "square")
        .when(w > h, "horizontal")
        .otherwise("vertical")
    )


def size_signal(w: Column, h: Column) -> Column:
    """phone, vertical, wide or landscape; null where a side is 0 or unknown."""
    return (
        F.when((w == 0) | (h == 0) | w.isNull() | h.isNull(), None)
        .when((h > w) & (h / F.greatest(w, F.lit(1)) > 1.8), "phone")
        .when(h > w, "vertical")
        .when(w / F.greatest(h, F.lit(1)) > 2.0, "wide")
        .otherwise("landscape")
    )


def aspect_token(w: Column, h: Column) -> Column:
    """The name of the nearest aspect ratio (first among equals); 'image' where a side is unknown."""
    ratio = w / h
    options = F.array(*[F.struct(F.abs(F.lit(a / b) - ratio).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (a, b, name) in enumerate(fixed.ASPECT_BUCKETS)])
    return F.when((w > 0) & (h > 0), F.array_min(options)["name"]).otherwise("image")


def resolution_bin(w: Column, h: Column, bins: tuple[tuple[str, int], ...]) -> Column:
    """The first bin whose largest number of pixels holds w * h; null if none does."""
    pixels = w.cast("bigint") * h
    chain = F.when(pixels <= bins[0][1], bins[0][0])
    for name, most in bins[1:]:
        chain = chain.when(pixels <= most, name)
    return chain


def ramp(value: Column, threshold: float, ceiling: float, width: float = 0.20) -> Column:
    """0 up to the threshold, then linearly to the ceiling over ``width``; a missing value counts as 0."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    rise = F.lit(ceiling) if width <= 0 else F.least(F.lit(ceiling), F.lit(ceiling) * ((v - threshold) / width))
    return F.when(v > threshold, rise).otherwise(0.0)


def rescaled(value: Column, lo: float, hi: float) -> Column:
    """Linearly from [lo, hi] to [0, 1], clamped; a missing value counts as 0."""
    v = (F.coalesce(value.cast("double"), F.lit(0.0)) - lo) / max(hi - lo, 1e-9)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def text_digest8(text: Column) -> Column:
    """The first 8 digits of the MD5 of a text."""
    return F.substring(F.md5(text), 1, 8)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the present pace; null before the first item is done."""
    return F.when(done > 0, elapsed / done * F.greatest(total - done, F.lit(0)))


def duration_seconds(text: Column) -> Column:
    """Seconds of the first HH:MM:SS.ff in a text; null without one."""
    part = lambda k: F.regexp_extract(text, r"(\d+):(\d{2}):(\d{2}(?:\.\d+)?)", k)
    return F.when(part(1) != "", part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def sample_indices(n: Column, k: int) -> Column:
    """At most k frame numbers of n: first, evenly spaced, last; without repeats."""
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.round((n - 1) * i / F.lit(float(k - 1))).cast("int"))
    return F.when(n > 0, F.array_distinct(F.when(n <= k, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(at))).otherwise(F.array().cast("array<int>"))
