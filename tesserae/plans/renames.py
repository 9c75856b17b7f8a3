"""Rename and move plans.

A plan is a table; nothing is touched until `apply_plan` is called with it, on the
driver, for local files.  Numbers and collisions are per folder or per target, by
windows over those keys.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.media import text_digest8
from tesserae.operators.ranks import ranked_within
from tesserae.session import Scratch

#: Rename strategies that need no tags.
PLAIN = (
    "sequential", "category", "date_prefix", "sanitize", "slugify", "lowercase", "uppercase", "no_spaces", "hash8", "date_hash", "title_case", "underscore", "reverse",
    "truncate", "zero_pad", "timestamp",
)
TAGGED = ("tags", "category_tags", "subject_tags", "date_tags", "ai_classification")


def new_base(strategy: str, base: Column, n: Column, folder: Column, comps: Column, subject: Column, content8: Column, today: str, stamp: int, pad: int, cut: int) -> Column:
    """The new name without extension."""
    number = F.lpad(n.cast("string"), pad, "0")
    number = F.when(F.length(n.cast("string")) > pad, n.cast("string")).otherwise(number)
    cat = F.coalesce(F.nullif(T.sanitize(folder), F.lit("")), F.lit("file"))
    digits = F.regexp_extract(base, r"^(\d+)(.*)$", 1)
    joined = lambda *parts: F.concat_ws("_", *parts)
    rules = {
        "sequential": lambda: number,
        "category": lambda: joined(cat, number),
        "date_prefix": lambda: joined(F.lit(today), base),
        "sanitize": lambda: T.sanitize(base),
        "slugify": lambda: T.slugify(base),
        "lowercase": lambda: F.lower(base),
        "uppercase": lambda: F.upper(base),
        "no_spaces": lambda: T.strip(F.regexp_replace(base, r"\s+", "_"), "_"),
        "hash8": lambda: content8,
        "date_hash": lambda: joined(F.lit(today), content8),
        "title_case": lambda: F.replace(T.title_case(F.translate(base, "_-", "  ")), F.lit(" "), F.lit("_")),
        "underscore": lambda: T.strip(F.regexp_replace(base, r"[\s\-]+", "_"), "_"),
        "reverse": lambda: F.reverse(base),
        "truncate": lambda: F.substring(base, 1, cut),
        "zero_pad": lambda: F.when(digits != "", F.concat(F.when(F.length(F.regexp_replace(digits, "^0+(?=.)", "")) >= 8, F.regexp_replace(digits, "^0+(?=.)", "")).otherwise(F.lpad(F.regexp_replace(digits, "^0+(?=.)", ""), 8, "0")), F.regexp_extract(base, r"^(\d+)(.*)$", 2))).otherwise(base),
        "timestamp": lambda: joined(F.lit(str(stamp)), base),
        "tags": lambda: F.array_join(comps, "_"),
        "category_tags": lambda: F.array_join(F.concat(F.array(cat), comps), "_"),
        "subject_tags": lambda: F.array_join(F.array_distinct(F.concat(F.when(subject != "", F.array(subject)).otherwise(F.array().cast("array<string>")), comps)), "_"),
        "date_tags": lambda: F.array_join(F.concat(F.array(F.lit(today)), comps), "_"),
        "ai_classification": lambda: joined(F.upper(F.substring(cat, 1, 3)), cat, F.coalesce(F.nullif(F.array_join(comps, "-"), F.lit("")), F.lit("untagged"))),
    }
    if strategy not in rules:
        raise ValueError(f"unknown strategy {strategy!r}")
    return rules[strategy]()


def rename_plan(files: DataFrame, strategy: str, scratch: Scratch, today: str = "2024-01-01", stamp: int = 1_700_000_000, start: int = 1, pad: int = 3, cut: int = 32, most_tags: int = 3) -> DataFrame:
    """``path, new_path`` of ``files`` (``path, parent, md5``, and ``tags`` and ``subject`` for tag strategies).

    Files are numbered by path in their folder.  Names above 120 characters are cut,
    empty ones become file_N; of several files with one target all but the first
    get their number appended, and what then still meets another target or an
    existing name takes the next free number.  The clock is a parameter, so a plan is repeatable.
    Without tags the last resort is 'untagged'.
    """
    order = Window.partitionBy("parent").orderBy("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    have = set(files.columns)
    f = files.where("path is not null").withColumn("n", (F.row_number().over(order) - 1 + start).cast("int")).withColumn("x", T.split_extension(name))
    tags = F.col("tags") if "tags" in have else F.array().cast("array<string>")
    comps = T.tag_components(T.clean_tags(tags), most_tags)
    if strategy in TAGGED:
        comps = F.when(F.size(comps) > 0, comps).otherwise(F.array(F.lit("untagged"))) if strategy != "ai_classification" else comps
    subject = T.sanitize_tag(F.col("subject")) if "subject" in have else F.lit("")
    content8 = F.coalesce(F.substring("md5", 1, 8), F.lit("00000000"))
    f = f.withColumn("b", new_base(strategy, F.col("x.base"), F.col("n"), F.col("parent"), comps, subject, content8, today, stamp, pad, cut))
    f = f.withColumn("b", F.when(F.col("b") == "", F.concat(F.lit("file_"), F.lpad(F.col("n").cast("string"), pad, "0"))).otherwise(F.col("b")))
    f = f.withColumn("b", F.when(F.length("b") > 120, F.regexp_replace(F.substring("b", 1, 120), r"[_\-.]+$", "")).otherwise(F.col("b")))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    f = f.withColumn("target", F.concat(folder, F.col("b"), F.col("x.ext")))
    again = F.row_number().over(Window.partitionBy("target").orderBy("path")) > 1
    wanted = F.when(again & (F.col("target") != F.col("path")), F.concat(folder, F.col("b"), F.lit("_"), F.col("n").cast("string"), F.col("x.ext"))).otherwise(F.col("target"))
    return free_targets(f.select("path", wanted.alias("wanted")), f.select("path"), scratch).withColumnRenamed("target", "new_path")


def numbered(name: Column) -> Column:
    """``stem, k, ext`` of a file name that ends in '_k'; ``k`` is null for others."""
    x = T.split_extension(name)
    k = F.regexp_extract(x["base"], r"_([1-9][0-9]{0,8})$", 1)
    return F.struct(F.regexp_replace(x["base"], r"_[1-9][0-9]{0,8}$", "").alias("stem"), F.when(k != "", k.cast("bigint")).alias("k"), x["ext"].alias("ext"))


def free_targets(wanted: DataFrame, existing: DataFrame, scratch: Scratch) -> DataFrame:
    """``path, target``: the wanted name where it is free, else the same with the next free number; all targets differ and none exists.

    ``wanted``: ``path`` (unique), ``wanted`` (a full path); ``existing``: ``path`` of
    what is there.  A file that stays where it is keeps its name, then the smallest
    path; the others of a name are numbered by path with the numbers that no existing
    or wanted name has.  Every step is an aggregate, an equi-join or a sort in ranges,
    so a name that very many files want is never gathered.
    """
    w = scratch.keep(wanted.select("path", "wanted"), "wanted")
    there = existing.where("path is not null").select(F.col("path").alias("wanted")).distinct()
    first = w.groupBy("wanted").agg(F.min(F.struct((F.col("path") != F.col("wanted")).alias("moves"), "path")).alias("first"))
    met = w.join(first, "wanted").join(there.withColumn("taken", F.lit(True)), "wanted", "left")
    keeps = (F.col("path") == F.col("first.path")) & (~F.col("first.moves") | F.col("taken").isNull())
    met = scratch.keep(met.select("path", "wanted", keeps.alias("keeps")), "met")
    kept, need = met.where("keeps").select("path", F.col("wanted").alias("target")), met.where("not keeps").select("wanted", "path")
    if need.isEmpty():
        return kept
    split = F.regexp_extract("wanted", r"^(.*/)?([^/]*)$", 1), F.regexp_extract("wanted", r"^(.*/)?([^/]*)$", 2)
    names = there.unionByName(w.select("wanted")).select(split[0].alias("folder"), numbered(split[1]).alias("x")).where("x.k is not null")
    used = names.select(F.concat("folder", "x.stem", "x.ext").alias("wanted"), F.col("x.k").alias("k")).distinct().join(need.select("wanted"), "wanted", "left_semi")
    # the j-th used number k has k - j free ones before it; the i-th file takes the number that is its place among files and used numbers in this order
    used = ranked_within(used, ["wanted"], ["k"], scratch, "used").select("wanted", F.lit(None).cast("string").alias("path"), (F.col("k") - F.col("rank")).alias("at"))
    files = ranked_within(need, ["wanted"], ["path"], scratch, "need").select("wanted", "path", F.col("rank").alias("at"))
    place = ranked_within(files.unionByName(used), ["wanted"], ["at", F.col("path").isNull(), "path"], scratch, "places").where("path is not null")
    x = T.split_extension(split[1])
    return kept.unionByName(place.select("path", F.concat(split[0], x["base"], F.lit("_"), F.col("rank").cast("string"), x["ext"]).alias("target")))


def move_plan(moves: DataFrame, existing: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """``path, target``: each file into ``root/category/name``, numbered where that is taken.

    ``moves``: ``path, category, name``; ``existing``: ``path`` of what is there already.
    """
    return free_targets(moves.select("path", F.concat_ws("/", F.lit(root), "category", "name").alias("wanted")), existing, scratch)


def flatten_plan(files: DataFrame, existing: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """``path, target``: all files into one folder; names that several files have are led by their folder's name, then numbered."""
    f = files.select("path", "name", "parent").distinct()
    n = f.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    flat = F.when(F.col("n") > 1, F.concat_ws("_", "parent", "name")).otherwise(F.col("name"))
    return free_targets(f.join(n, "name").select("path", F.concat(F.lit(root + "/"), flat).alias("wanted")), existing, scratch)


def plan_stats(plan: DataFrame) -> DataFrame:
    """How many files a rename plan would rename and skip."""
    return plan.agg(F.count_if(F.col("path") != F.col("new_path")).alias("renamed"), F.count_if(F.col("path") == F.col("new_path")).alias("skipped"))


def apply_plan(plan: DataFrame, limit: int) -> dict[str, int]:
    """Rename local files in two phases; refuses plans of more than ``limit`` rows.  Existing targets get a number."""
    rows = [(r[0], r[1]) for r in plan.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"the plan has more than {limit} rows")
    done = {"renamed": 0, "skipped": 0, "errors": 0}
    waiting = []
    for old, new in rows:
        if old == new or not os.path.exists(old):
            done["skipped"] += 1
            continue
        try:
            os.rename(old, old + ".moving")
            waiting.append((old + ".moving", old, new))
        except OSError:
            done["errors"] += 1
    for held, old, new in waiting:
        base, ext = os.path.splitext(new)
        k = 1
        while os.path.exists(new):
            new, k = f"{base}_{k}{ext}", k + 1
        try:
            os.makedirs(os.path.dirname(new), exist_ok=True)
            os.rename(held, new)
            done["renamed"] += 1
        except OSError:
            os.rename(held, old)
            done["errors"] += 1
    return done
