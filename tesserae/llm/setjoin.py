"""Problem 2: all pairs of similar sets by a prefix-filtered join.

Tokens are ordered by rarity over all sets.  Two sets whose Jaccard similarity
reaches the threshold share a token among the first ``n - ceil(t*n) + 1`` of each,
so only those prefixes are indexed and joined.  Length and positional filters cut
candidates before exact verification on the full sets.  Equal sets form one class
that is joined once, so copies do not multiply.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch

BLANKS = " \t\n\r\f\x0b\xa0\u3000"


def clean_set(values: str | Column) -> Column:
    """Distinct non-empty values without outer blanks, in lower case, sorted; null gives the empty set."""
    values = F.col(values) if isinstance(values, str) else values
    trimmed = F.transform(values, lambda x: F.lower(F.btrim(x, F.lit(BLANKS))))
    kept = F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))
    return F.coalesce(kept, F.array().cast("array<string>"))


def similar_classes(classes: DataFrame, threshold: Fraction = Fraction(3, 5)) -> DataFrame:
    """``a, b, common, total`` of all class pairs ``a < b`` with ``common / total >= threshold`` (exact integers).

    ``classes``: ``sid`` (unique), ``tokens`` (distinct strings, at least one).
    """
    num, den = threshold.numerator, threshold.denominator
    tokens = classes.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    tokens = tokens.select("sid", "n", F.xxhash64("token").alias("tok"))
    df = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a token of a single set takes a place in its prefix but can have no partner: only its number is needed
    shared = tokens.join(df, "tok").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("ts"))
    least = F.floor((F.col("n") * num + (den - 1)) / den)
    lone = F.col("n") - F.size("ts")
    keep = F.greatest(F.col("n") - least + 1 - lone, F.lit(0)).cast("int")
    prefix = shared.select("sid", "n", lone.alias("lone"), F.posexplode(F.slice("ts", 1, keep)).alias("at", "t"))
    prefix = prefix.select(F.col("t.tok").alias("tok"), "sid", "n", (F.col("n") - F.col("lone") - F.col("at") - 1).alias("rest"))
    a, b = (prefix.select("tok", *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "n", "rest")]) for s in "ab")
    met = a.join(b, "tok").where("sid_a < sid_b")
    met = met.where(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num}")
    met = met.where(f"(1 + least(rest_a, rest_b)) * {den + num} >= (n_a + n_b) * {num}")
    met = met.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()
    full = lambda s: classes.select(F.col("sid").alias(s), F.col("tokens").alias(f"t_{s}"))
    met = met.join(full("a"), "a").join(full("b"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("t_a", "t_b")).alias("common"), (F.size("t_a") + F.size("t_b")).alias("s"))
    return met.where(f"common * {den} >= (s - common) * {num}").select("a", "b", "common", (F.col("s") - F.col("common")).alias("total"))


def _classes(left: DataFrame, right: DataFrame | None, min_size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    rows = left.select(F.lit("l").alias("side"), F.col("key"), clean_set("values").alias("tokens"))
    if right is not None:
        rows = rows.unionByName(right.select(F.lit("r").alias("side"), F.col("key"), clean_set("values").alias("tokens")))
    rows = rows.where(f"key is not null and size(tokens) >= {max(1, min_size)}")
    rows = scratch.keep(rows.withColumn("sid", F.xxhash64("tokens")).distinct(), "sets")
    return rows, rows.groupBy("sid").agg(F.first("tokens").alias("tokens"))


def similar_pairs(
    left: DataFrame, right: DataFrame | None = None, threshold: Fraction = Fraction(3, 5), min_size: int = 1, scratch: Scratch | None = None
) -> DataFrame:
    """``kind, key_a, key_b``: similar pairs within ``left`` ('within', smaller key first) and between ``left`` and ``right`` ('between').

    Both inputs have ``key`` and ``values`` (array of strings).  Null keys and
    sets smaller than ``min_size`` after cleaning take no part; repeated rows
    count once; equal sets of different keys are a pair.  A key pair comes out
    once even if a key has several sets.
    """
    scratch = scratch or Scratch(left.sparkSession, "sets")
    rows, classes = _classes(left, right, min_size, scratch)
    pairs = scratch.keep(similar_classes(classes, threshold).select("a", "b"), "pairs")
    members = rows.select("sid", "side", "key")
    copied = members.groupBy("sid").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.unionByName(copied.where("n > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b")))
    side = lambda s: members.select(F.col("sid").alias(s), F.col("side").alias(f"side_{s}"), F.col("key").alias(f"key_{s}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    within = (
        out.where("side_a = 'l' and side_b = 'l' and key_a <> key_b and (a <> b or key_a < key_b)")
        .select(F.lit("within").alias("kind"), F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    )
    turned = F.col("side_a") == "r"
    between = out.where("side_a <> side_b and (a <> b or side_a = 'l')").select(
        F.lit("between").alias("kind"),
        F.when(turned, F.col("key_b")).otherwise(F.col("key_a")).alias("key_a"),
        F.when(turned, F.col("key_a")).otherwise(F.col("key_b")).alias("key_b"),
    )
    return within.unionByName(between).distinct()


def similar_links(left: DataFrame, threshold: Fraction = Fraction(3, 5), min_size: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """The compact form for heavily copied data: ``key, class_key, copies, links`` per key.

    ``class_key`` is the smallest key with the same set, ``copies`` their number,
    ``links`` the number of similar sets with other values.  Nothing is expanded.
    """
    scratch = scratch or Scratch(left.sparkSession, "links")
    rows, classes = _classes(left, None, min_size, scratch)
    pairs = similar_classes(classes, threshold)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("links"))
    heads = rows.groupBy("sid").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("copies"))
    heads = heads.join(ends, "sid", "left")
    out = rows.select("sid", "key").join(heads, "sid")
    return out.select("key", "class_key", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
