"""Column expressions on names, tags and model replies."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.functions import fixed


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


#: What counts as blank at the ends of a reply.
BLANKS = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())


def fold(text: Column) -> Column:
    """Compatibility-decomposed ASCII letters; other characters are dropped.

    Only text outside ASCII is sent to Python, so a projection of plain names stays on the JVM side.
    """
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_folded(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))


def strip(text: Column, characters: str) -> Column:
    return F.btrim(text, F.lit(characters))


def sanitize(name: Column) -> Column:
    """A safe file name: ASCII, other signs and blanks to single underscores, no outer '._-'."""
    t = F.regexp_replace(fold(name), r"[^\w\s.-]", "_")
    return strip(F.regexp_replace(t, r"[\s_]+", "_"), "._-")


def slugify(name: Column) -> Column:
    """Lower case, words joined by dashes."""
    t = F.regexp_replace(F.lower(fold(name)), r"[^\w\s-]", "")
    return strip(F.regexp_replace(t, r"[\s_]+", "-"), "-._")


def sanitize_tag(tag: Column) -> Column:
    """A tag as part of a file name; empty for a null tag."""
    t = F.lower(F.trim(F.regexp_replace(fold(F.coalesce(tag, F.lit(""))), r"[^\w\s-]", "")))
    return strip(F.regexp_replace(t, r"[\s_]+", "-"), "-")


def clean_tags(tags: Column) -> Column:
    """Lower-cased, trimmed, distinct, in order; nulls and blanks dropped; a null array gives an empty one."""
    seen = F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != "")))
    return F.coalesce(seen, F.array().cast("array<string>"))


def tag_components(clean: Column, most: int) -> Column:
    """Up to ``most`` distinct file-name parts of an array of cleaned ASCII tags, in order."""
    parts = F.transform(clean, lambda t: strip(F.regexp_replace(F.regexp_replace(t, r"[^\w\s-]", ""), r"[\s_]+", "-"), "-"))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, most)


def parsed_tags(reply: Column, allowed: list[str], most: int = fixed.TAG_PICKS) -> Column:
    """The allowed tags of a free-form reply, distinct, in order: fences, bullets and numbering are removed."""
    text = F.trim(reply)
    text = F.when(text.startswith("```"), F.regexp_replace(text, r"(?m)^\s*```.*$", "")).otherwise(text)
    pieces = F.transform(
        F.split(text, "[,;\n•·]+"),
        lambda p: F.lower(F.trim(F.regexp_replace(F.regexp_replace(p, r"^[\s\d.)(*\-•]+", ""), r"[\s.,;:•]+$", ""))),
    )
    found = F.slice(F.array_distinct(F.filter(pieces, lambda p: p.isin(*allowed))), 1, most)
    return F.when(F.length(reply) > 0, found).otherwise(F.array().cast("array<string>"))


def json_block(reply: Column) -> Column:
    """From the first brace to the last one; null without a block."""
    block = F.regexp_extract(reply, r"\{[\s\S]+\}", 0)
    return F.when(block != "", block)


def repaired_json(reply: Column) -> Column:
    """The JSON text of a reply without code fences and trailing commas."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def structured_tags(tags: Column, stop: list[str], most: int = 12) -> Column:
    """Lower-cased tags of 2 to 29 characters without blanks, outside the stop list, distinct, capped."""
    low = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return F.slice(F.array_distinct(F.filter(low, lambda t: (F.length(t) >= 2) & (F.length(t) <= 29) & ~t.contains(" ") & ~t.isin(*stop))), 1, most)


def description_words(text: Column) -> Column:
    """The words of 3 to 21 letters or dashes of a description, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]{2,20}"), F.lit(0))


def icon(category: Column) -> Column:
    """The first three letters in brackets."""
    return F.concat(F.lit("["), F.rpad(F.upper(F.substring(category, 1, 3)), 3, " "), F.lit("]"))


def clipped_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut back to the last full stop if there is one."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"^([\s\S]*\.)", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", cut).otherwise(head)


def synthesised(text: Column) -> Column:
    """A written description without outer quotes and a bad leading phrase's sentence, of at most 600 characters and a full stop; null if nothing is left.

    The phrase goes with its first full stop, else its first line break, if that
    is among the first 200 characters.  Longer texts end at the last full stop.
    """
    t = strip(strip(strip(text, BLANKS), '"'), "'")
    bad = F.lit(False)
    for phrase in fixed.BAD_LEADS:
        bad = bad | F.lower(t).startswith(phrase)
    dot, line = F.instr(t, "."), F.instr(t, "\n")
    at = F.when(dot.between(1, 200), dot).when(line.between(1, 200), line).otherwise(F.lit(0))
    t = F.when(bad & (at > 0), strip(F.substring(t, at + 1, F.length(t)), BLANKS)).otherwise(t)
    head = F.substring(t, 1, 600)
    cut = F.concat(F.when(F.contains(head, F.lit(".")), F.regexp_extract(head, r"^([\s\S]*)\.", 1)).otherwise(head), F.lit("."))
    return F.nullif(F.when(F.length(t) > 600, cut).otherwise(t), F.lit(""))


def split_extension(name: Column) -> Column:
    """``base`` and ``ext`` (with its dot); archives keep both parts of '.x.tar'."""
    ext = F.regexp_extract(name, r"^.*[^.](\.[^.]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    inner = F.when(F.lower(ext) == ".tar", F.regexp_extract(base, r"^.*[^.](\.[^.]*)$", 1)).otherwise(F.lit(""))
    return F.struct(F.substring(base, F.lit(1), F.length(base) - F.length(inner)).alias("base"), F.concat(inner, ext).alias("ext"))


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")
