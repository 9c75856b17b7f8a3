"""Problem 8: one form for texts that look the same.

Only words with characters outside ASCII need work, and each distinct one is
worked on once: it is exploded to positioned code points, joined with the
(broadcast, fixed-size) tables of decompositions, look-alike letters and
combining classes, its marks are put in canonical order and recomposed, and the
word is rebuilt and joined back by position.

What doesn't change the look: full and half width, ligatures and other joined
forms, composed or separate accents, letters of another script with the same
shape, kinds of hyphen, kinds of single blank, invisible characters.  What does:
case, accents, raised figures, digits, missing blanks, line breaks and tabs,
another emoji (a joiner inside an emoji sequence therefore stays).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm.words import distinct_words, join_words
from tesserae.session import Scratch, spread

# Letters of Cyrillic, Greek, Armenian and Cherokee with the shape of a Latin (or Greek) letter, and that letter.
SAME_SHAPE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "օ": "o", "Օ": "O", "Г": "Γ", "П": "Π", "Ф": "Φ",
    "ѵ": "v", "Ѵ": "V", "ү": "y", "ӏ": "l", "Ӏ": "I", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Ս": "U", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Decompositions that keep the look; others (raised, lowered, circled, fractions, styled letters) change it.
KEPT_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
JOINED_NAMES = ("LIGATURE", "LEADER", "ELLIPSIS", "ROMAN NUMERAL", "KANGXI RADICAL", "CJK RADICAL", "DOUBLE EXCLAMATION", "MICRO SIGN")
BLANKS = " \xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
HYPHENS = "-\u2010\u2011\ufe63\uff0d"
#: Characters without a shape of their own; the zero-width joiner is treated apart.
INVISIBLE = "\xad\u034f\u061c\u180b-\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0100-\U000e01ef"
CONTROLS = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 32), 127, *range(128, 160)]))
#: Marks of a run that are recomposed by joins; runs with more go through the same rule in Python.
MARKS = 3
EMOJI = "\U0001f000-\U0001faff\u2190-\u21ff\u2300-\u23ff\u2600-\u27bf\u2b00-\u2bff"
PIECES = r"[\x00-\x7F]*[ \n\t]|[^ \n\t]+"


def _sequence(c: str) -> str:
    """What stands for a code point in the form, before marks are ordered and recomposed."""
    if c in BLANKS:
        return " "
    if c in HYPHENS:
        return "-"
    if c in SAME_SHAPE:
        return SAME_SHAPE[c]
    if "\uac00" <= c <= "\ud7a3":  # syllables decompose by rule, not by table
        return unicodedata.normalize("NFD", c)
    tag, _, rest = unicodedata.decomposition(c).rpartition("> ")
    if not rest:
        return c
    joined = tag == "<compat" and any(n in unicodedata.name(c, "") for n in JOINED_NAMES)
    if tag and tag + ">" not in KEPT_TAGS and not joined:
        return c
    return "".join(_sequence(chr(int(x, 16))) for x in rest.split())


def look_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decompositions and look-alikes (``c, seq``), combining classes (``ch, ccc``), compositions (``pair, whole``).

    All come from the Unicode tables of Python by rule; together under 30,000 short rows, whatever the corpus.
    """
    points = [chr(k) for k in range(0x80, 0x30000) if unicodedata.category(chr(k)) not in ("Cn", "Co", "Cs")]
    mapped = [(c, s) for c in points if (s := _sequence(c)) != c]
    classes = [(c, k) for c in points if (k := unicodedata.combining(c))]
    whole = list(compositions().items())
    frame = lambda rows, a, b: spark.createDataFrame(pd.DataFrame(rows, columns=[a, b]).drop_duplicates(a))
    return frame(mapped, "c", "seq"), frame(classes, "ch", "ccc").withColumn("ccc", F.col("ccc").cast("int")), frame(whole, "pair", "whole")


def compositions() -> dict[str, str]:
    """What a base and a mark become, by the Unicode tables of Python; the base as it stands in the form."""
    points = [chr(k) for k in range(0x80, 0x30000) if unicodedata.category(chr(k)) not in ("Cn", "Co", "Cs")]
    whole: dict[str, str] = {}
    for c in points:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            # the first part as it stands in the form: a look-alike letter is already exchanged
            first = _sequence(chr(int(parts[0], 16)))
            first = unicodedata.normalize("NFC", first)
            pair = first + chr(int(parts[1], 16))
            if len(first) == 1 and unicodedata.combining(pair[1]):
                made = unicodedata.normalize("NFC", pair)
                if len(made) == 1:
                    whole.setdefault(pair, made)
    return whole


def _without_invisible(text: Column) -> Column:
    seen = F.regexp_replace(text, f"[{INVISIBLE}]", "")
    seen = F.regexp_replace(seen, "\u200d+", "\u200d")
    return F.regexp_replace(seen, f"(?<![{EMOJI}])\u200d|\u200d(?![{EMOJI}])", "")


def rebuild_words(words: DataFrame) -> DataFrame:
    """``word, n, out``: the form of each word."""
    mapped, classes, whole = look_tables(words.sparkSession)
    # by a hash of the word: a repartition by the word itself would be merged with the aggregation below it, whose few bytes end up in one task
    words = spread(words.withColumn("wid", F.xxhash64("word")), "wid")
    points = words.select("wid", "word", "n", F.posexplode_outer(F.split(_without_invisible(F.col("word")), "")).alias("i", "c"))
    points = points.join(F.broadcast(mapped), "c", "left")
    points = points.select("wid", "word", "n", "i", F.posexplode_outer(F.split(F.coalesce("seq", "c"), "")).alias("j", "ch"))
    points = points.join(F.broadcast(classes), "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    per_word = points.groupBy("wid", "word", "n").agg(F.array_sort(F.collect_list(F.struct("i", "j", "ch", "ccc"))).alias("cs"))
    # a run is a base with the marks that follow it; most words have no mark
    marked = F.exists("cs", lambda x: x["ccc"] > 0)
    plain = per_word.where(~marked).select("word", "n", F.array_join(F.transform("cs", lambda x: x["ch"]), "").alias("out"))
    runs = _runs(per_word.where(marked))
    runs = runs.groupBy("wid", "word", "n", "run").agg(F.array_sort(F.collect_list(F.struct("ccc", "k", "ch"))).alias("m"))
    # canonical order is by class, then by position; the base has class 0
    few = runs.where(F.size("m") <= 1 + MARKS)
    state = few.select("wid", "word", "n", "run", "m", F.col("m")[0]["ch"].alias("base"), F.lit("").alias("kept"), F.lit(0).alias("last"))
    for t in range(1, MARKS + 1):
        mark = F.get("m", F.lit(t))
        state = state.withColumn("mark", mark["ch"]).withColumn("mc", mark["ccc"])
        state = state.withColumn("pair", F.when(F.col("mc") > F.col("last"), F.concat("base", "mark")))
        state = state.join(F.broadcast(whole), "pair", "left")
        hit = F.col("whole").isNotNull()
        state = state.select(
            "wid", "word", "n", "run", "m",
            F.coalesce("whole", "base").alias("base"),
            F.when(hit | F.col("mark").isNull(), F.col("kept")).otherwise(F.concat("kept", "mark")).alias("kept"),
            F.when(hit | F.col("mark").isNull(), F.col("last")).otherwise(F.col("mc")).alias("last"),
        )
    done = state.select("wid", "word", "n", "run", F.concat("base", "kept").alias("s"))
    done = done.unionByName(_long_runs(runs.where(F.size("m") > 1 + MARKS)))
    done = done.groupBy("wid", "word", "n").agg(F.array_sort(F.collect_list(F.struct("run", "s"))).alias("rs"))
    return plain.unionByName(done.select("word", "n", F.array_join(F.transform("rs", lambda x: x["s"]), "").alias("out")))


def _long_runs(runs: DataFrame) -> DataFrame:
    """``wid, word, n, run, s``: runs of any number of marks, recomposed like the short ones."""
    whole = compositions()

    @F.pandas_udf("string")
    def recompose(chars: pd.Series, classes: pd.Series) -> pd.Series:
        out = []
        for cs, ks in zip(chars, classes, strict=True):
            base, kept, last = cs[0], [], 0
            for c, k in zip(cs[1:], ks[1:], strict=True):
                if k > last and base + c in whole:
                    base = whole[base + c]
                else:
                    kept.append(c)
                    last = k
            out.append(base + "".join(kept))
        return pd.Series(out, dtype=object)

    part = lambda name: F.transform("m", lambda x: x[name])
    return runs.select("wid", "word", "n", "run", recompose(part("ch"), part("ccc")).alias("s"))


def _runs(per_word: DataFrame) -> DataFrame:
    """``wid, word, n, run, k, ch, ccc``: each code point with the number of the base it belongs to."""
    at = per_word.select("wid", "word", "n", F.posexplode("cs").alias("k", "x")).select("wid", "word", "n", "k", F.col("x.ch").alias("ch"), F.col("x.ccc").alias("ccc"))
    return at.withColumn("run", F.sum((F.col("ccc") == 0).cast("int")).over(Window.partitionBy("wid", "word").orderBy("k")))


def look_forms(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, form``: two forms are equal exactly where the texts look equal.

    ``doc_id`` is unique.  Null texts have a null form, empty texts an empty one;
    a text of invisible characters only has an empty form.
    """
    scratch = scratch or Scratch(documents.sparkSession, "looks")
    pieces = documents.select("doc_id", F.col("text").isNull().alias("none"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("pos", "piece"))
    foreign = F.col("piece").rlike(r"[^\x00-\x7F]")
    occurrences = pieces.select("doc_id", "none", "pos", F.when(foreign, F.col("piece")).alias("word"), F.when(~foreign, F.col("piece")).alias("plain"))
    words = distinct_words(occurrences, rebuild_words, scratch, "words")
    met = join_words(occurrences, words, F.coalesce("plain", F.lit("")))
    per = met.groupBy("doc_id").agg(F.max("none").alias("none"), F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["out"]), "")
    return per.select("doc_id", F.when(~F.col("none"), F.translate(text, CONTROLS, "")).alias("form"))


def look_pairs(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id_a, doc_id_b`` (a < b): documents whose texts look the same but differ in characters.

    Texts without a visible sign take no part.  Equal texts form one class;
    classes of one form are paired, then their members, so equal texts are never
    compared with each other.
    """
    scratch = scratch or Scratch(documents.sparkSession, "looks")
    forms = look_forms(documents, scratch).where(r"form is not null and form rlike '[^\\p{IsWhite_Space}]'")
    keyed = forms.select("doc_id", F.md5("form").alias("form")).join(documents.select("doc_id", F.md5("text").alias("text")), "doc_id")
    keyed = scratch.keep(keyed, "keyed")
    mixed = keyed.groupBy("form").agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x < y").select("form")
    members = scratch.keep(keyed.join(mixed, "form", "left_semi"), "members")
    classes = members.select("form", "text").distinct()
    pairs = classes.select("form", F.col("text").alias("t1")).join(classes.select("form", F.col("text").alias("t2")), "form").where("t1 < t2")
    side = lambda k: members.select("form", F.col("text").alias(f"t{k}"), F.col("doc_id").alias(f"d{k}"))
    out = pairs.join(side(1), ["form", "t1"]).join(side(2), ["form", "t2"])
    return out.select(F.least("d1", "d2").alias("doc_id_a"), F.greatest("d1", "d2").alias("doc_id_b"))


def look_classes(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, class_id, texts``: for each document with a visible sign the smallest one of its look, and how many different texts have it.

    The compact form of `look_pairs` for looks that very many documents share: nothing is paired.
    """
    scratch = scratch or Scratch(documents.sparkSession, "looks")
    forms = look_forms(documents, scratch).where(r"form is not null and form rlike '[^\\p{IsWhite_Space}]'")
    keyed = scratch.keep(forms.select("doc_id", F.md5("form").alias("form")).join(documents.select("doc_id", F.md5("text").alias("text")), "doc_id"), "keyed")
    heads = keyed.groupBy("form", "text").agg(F.min("doc_id").alias("d")).groupBy("form").agg(F.min("d").alias("class_id"), F.count(F.lit(1)).alias("texts"))
    return keyed.join(heads, "form").select("doc_id", "class_id", "texts")
