"""Feature statistics of categories, fingerprints, samples and small models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions.media import rescaled
from tesserae.operators.ranks import ranked_within
from tesserae.session import Scratch


def long_features(profiles: DataFrame, features: Iterable[str], keys: Iterable[str] = ("path",)) -> DataFrame:
    """``keys, feature, value`` of the non-null features of a wide table."""
    keys = list(keys)
    return profiles.unpivot(keys, list(features), "feature", "value").where("value is not null and not isnan(value)")


def feature_stats(profiles: DataFrame, members: DataFrame, features: Iterable[str]) -> DataFrame:
    """``category, feature, mean, std, min, max, samples``: sample deviation, 0 for a single sample; 10 decimals."""
    rows = long_features(profiles.join(members, "path"), features, ("path", "category"))
    v = F.col("value")
    return rows.groupBy("category", "feature").agg(
        F.round(F.avg(v), 10).alias("mean"),
        F.round(F.coalesce(F.nanvl(F.stddev_samp(v), F.lit(0.0)), F.lit(0.0)), 10).alias("std"),
        F.round(F.min(v), 10).alias("min"),
        F.round(F.max(v), 10).alias("max"),
        F.count(v).alias("samples"),
    )


def global_stats(stats: DataFrame) -> DataFrame:
    """``feature, mean, std, within_std, samples`` over all categories, weighted by samples.

    ``std`` is the spread between categories, ``within_std`` the pooled spread inside
    them, both from a variance of at least 1e-6.
    """
    n = F.greatest(F.col("samples"), F.lit(0))
    s = stats.where("mean is not null").withColumn("n", n)
    m = s.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("g"), F.sum("n").alias("total")).where("total > 0")
    b = s.join(F.broadcast(m), "feature").groupBy("feature", "g", "total").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("g"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.pow("std", F.lit(2))).alias("within")
    )
    root = lambda c: F.sqrt(F.greatest(F.col(c) / F.col("total"), F.lit(1e-6)))
    return b.select("feature", F.col("g").alias("mean"), root("between").alias("std"), root("within").alias("within_std"), F.col("total").alias("samples"))


def shrunk(std: Column, within: Column, samples: Column) -> Column:
    """A category's deviation drawn towards the pooled one with the weight of 5 samples; at least 0.05."""
    w = F.lit(5.0) / (5.0 + F.greatest(samples, F.lit(0)))
    both = F.sqrt((1.0 - w) * std * std + w * within * within)
    return F.greatest(F.when(std <= 0, within).when(within <= 0, std).otherwise(both), F.lit(0.05))


def fingerprints(stats: DataFrame, features: Iterable[str]) -> DataFrame:
    """One row per category with what scoring needs of each feature, as plain numbers without nulls.

    ``m`` mean, ``r`` 1 / (3 deviations), ``w`` weight (0 for a missing feature), ``g``
    global mean, ``d`` 0.35 / global spread, ``u`` side of the global mean (0 if near).
    """
    g = global_stats(stats).select("feature", F.col("mean").alias("gm"), F.col("std").alias("gs"), "within_std")
    base = F.lit(1.0)
    for name, weight in fixed.FEATURE_WEIGHTS.items():
        base = F.when(F.col("feature") == name, weight).otherwise(base)
    away = F.col("mean") - F.col("gm")
    unique = F.when(F.col("gs") > 0.001, F.least(F.greatest(F.lit(0.4), 0.4 + F.abs(away) / F.col("gs") * 0.6), F.lit(2.5))).otherwise(1.0)
    parts = {
        "m": F.col("mean"),
        "r": 1.0 / (3.0 * shrunk(F.col("std"), F.col("within_std"), F.col("samples"))),
        "w": base * unique,
        "g": F.col("gm"),
        "d": 0.35 / F.greatest("gs", F.lit(0.01)),
        "u": F.when(F.abs(away) > 0.01, F.signum(away)).otherwise(0.0),
    }
    rows = stats.join(F.broadcast(g), "feature").select("category", "feature", *[x.alias(k) for k, x in parts.items()])
    pick = lambda f, k: F.coalesce(F.max(F.when(F.col("feature") == f, F.col(k))), F.lit(0.0)).alias(f"fp_{k}_{f}")
    return rows.groupBy("category").agg(*[pick(f, k) for f in features for k in parts])


def fingerprint_score(features: Iterable[str]) -> Column:
    """The weighted similarity of the values ``fv_*`` (present: ``fh_*`` is 1, else 0) with the fingerprint columns; null where none can be compared."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for f in features:
        x = lambda k: F.col(f"fp_{k}_{f}")  # noqa: B023, E731
        v, w = F.col(f"fv_{f}"), x("w") * F.col(f"fh_{f}")
        off = v - x("g")
        against = (x("u") * off < 0) & (F.abs(off) > 0.01)
        direction = F.when(against, F.greatest(F.lit(0.25), 1.0 - F.least(F.abs(off) * x("d"), F.lit(0.7)))).otherwise(1.0)
        top = top + F.greatest(F.lit(0.0), 1.0 - F.abs(v - x("m")) * x("r")) * direction * w
        weight = weight + w
    return F.try_divide(top, weight)


def fingerprint_values(features: Iterable[str]) -> list[Column]:
    """The columns ``fv_*`` and ``fh_*`` of a profile."""
    there = lambda f: F.col(f).isNotNull() & ~F.isnan(f)
    return [F.when(there(f), F.col(f)).otherwise(0.0).alias(f"fv_{f}") for f in features] + [F.when(there(f), 1.0).otherwise(0.0).alias(f"fh_{f}") for f in features]


def majority(members: DataFrame, value: str) -> DataFrame:
    """``category, value, n``: the most frequent value per category, equal counts by value; nulls do not vote."""
    counts = members.where(F.col(value).isNotNull()).groupBy("category", value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("category").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("value"))).alias("b"))
    return best.select("category", "b.value", (-F.col("b.k")).alias("n"))


def ranked_by_size(files: DataFrame, scratch: Scratch, by: str = "parent") -> DataFrame:
    """Files with their rank ``i`` by size (null sizes count as 0, then by path) in their folder, and its number ``n`` of files.

    A folder that holds a large part of all files is sorted in ranges like any other.
    """
    f = files.select(by, "path", F.coalesce("size_bytes", F.lit(0)).alias("size"))
    n = f.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    r = ranked_within(f, [by], ["size", "path"], scratch)
    return r.join(n, by).select(by, "path", (F.col("rank") - 1).alias("i"), "n")


def smart_sample(files: DataFrame, k: int, scratch: Scratch, by: str = "parent") -> DataFrame:
    """``by, path``: the smallest, the largest and ``k - 2`` evenly spaced files by size per folder; all of small folders."""
    r = ranked_by_size(files, scratch, by)
    middle, extra = F.col("n") - 2, k - 2
    at = F.transform(F.sequence(F.lit(0), F.lit(max(extra - 1, 0))), lambda j: F.least(F.floor(j * (middle / F.lit(float(max(extra, 1))))), middle - 1) + 1)
    picked = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1) | (F.lit(extra > 0) & F.array_contains(at.cast("array<bigint>"), F.col("i")))
    return r.where((F.col("n") <= k) | picked).select(by, "path")


def stratified_sample(files: DataFrame, k: int, scratch: Scratch, by: str = "parent", most: int = 6) -> DataFrame:
    """``by, path``: round-robin over ``most`` size buckets per folder until ``k`` are taken; all of small folders.

    A bucket is a range of ranks, so the turn of a file follows from its rank; only
    the at most ``k`` first of each bucket are ordered.
    """
    buckets = min(k, most)
    r = ranked_by_size(files, scratch, by)
    b = F.least(F.floor(F.col("i") / F.col("n") * buckets), F.lit(buckets - 1))
    r = r.withColumn("b", b)
    # the first rank of a bucket is the smallest i with floor(i / n * buckets) = b
    first = r.groupBy(by, "b").agg(F.min("i").alias("first"))
    early = r.join(first, [by, "b"]).withColumn("turn", F.col("i") - F.col("first")).where((F.col("n") <= k) | (F.col("turn") < k))
    early = early.withColumn("o", F.row_number().over(Window.partitionBy(by).orderBy("turn", "b")))
    return early.where((F.col("n") <= k) | (F.col("o") <= k)).select(by, "path")


def uniform_sample(files: DataFrame, k: int, scratch: Scratch, by: str = "parent") -> DataFrame:
    """``by, path``: every n/k-th file by path per folder; all of small folders."""
    f = files.select(by, "path")
    r = ranked_within(f, [by], ["path"], scratch).withColumn("i", F.col("rank") - 1).join(f.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)
    step = F.col("n") / F.lit(float(k))
    # i is picked if i = floor(j * step) for a whole j
    j = F.ceil(F.col("i") / step)
    return r.where((F.col("n") <= k) | ((F.floor(j * step) == F.col("i")) & (j < k))).select(by, "path")


def scaled(columns: Iterable[str]) -> dict[str, Column]:
    """All model features of a row in [0, 1]; columns that are missing count as 0."""
    have = set(columns)
    return {f: rescaled(F.col(f) if f in have else F.lit(0.0), lo, hi) for f, (lo, hi) in fixed.FEATURE_RANGES.items()}


def predicted_tags(profiles: DataFrame, k: int = 5, temperature: float = 0.3) -> DataFrame:
    """``path, tag, mass``: the k likeliest tags by softmax over the distance to the labelled examples; equal mass by name."""
    x = scaled(profiles.columns)
    sims = []
    for _, features, _ in fixed.EXAMPLES:
        total = F.lit(0.0)
        for f, (lo, hi) in fixed.FEATURE_RANGES.items():
            y = max(0.0, min(1.0, (features.get(f, 0.0) - lo) / (hi - lo)))
            total = total + F.pow(x[f] - F.lit(float(y)), F.lit(2))
        sims.append(F.exp(-F.sqrt(total / len(fixed.FEATURE_RANGES)) / temperature))
    p = profiles.select("path", *[s.alias(f"s{i}") for i, s in enumerate(sims)])
    z = sum((F.col(f"s{i}") for i in range(len(sims))), F.lit(0.0))
    tags = sorted({t for _, _, tags in fixed.EXAMPLES for t in tags})
    mass = lambda t: sum((F.col(f"s{i}") / len(e[2]) for i, e in enumerate(fixed.EXAMPLES) if t in e[2]), F.lit(0.0)) / z
    ranked = F.array_sort(F.array(*[F.struct((-F.round(mass(t), 9)).alias("m"), F.lit(t).alias("tag")) for t in tags]))
    return p.select("path", F.explode(F.slice(ranked, 1, k)).alias("x")).select("path", "x.tag", F.round(-F.col("x.m"), 6).alias("mass"))


def fitted(profiles: DataFrame, members: DataFrame, features: Iterable[str]) -> DataFrame:
    """One row per category with mean and population deviation (0.05 for 0) of each scaled feature."""
    x = scaled(profiles.columns)
    p = profiles.select("path", *[x[f].alias(f) for f in features]).join(members, "path")
    out = []
    for f in features:
        sd = F.round(F.stddev_pop(f), 9)
        out += [F.round(F.avg(f), 9).alias(f"mu_{f}"), F.when(sd > 0, sd).otherwise(0.05).alias(f"sd_{f}")]
    return p.groupBy("category").agg(*out)


def fit_score(columns: Iterable[str], features: Iterable[str]) -> Column:
    """The mean of max(0, 1 - min(z, 3) / 3) over the features of a row and its model columns."""
    x, features = scaled(columns), list(features)
    parts = [F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(x[f] - F.col(f"mu_{f}")) / F.col(f"sd_{f}"), F.lit(3.0)) / 3.0) for f in features]
    return sum(parts, F.lit(0.0)) / len(parts)
