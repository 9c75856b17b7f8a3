"""Exact row numbers without gathering a group: sorted in ranges, numbered by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch


def ranked(df: DataFrame, order: list[str | Column], scratch: Scratch, name: str = "sorted") -> DataFrame:
    """``df`` with ``rank`` from 1 by ``order``: a sort in ranges, then each range's start is added to the places within it."""
    rows = scratch.keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    # the upper bits of the id are the range, the lower 33 the place; one row per range
    sizes = sorted((r["_k"], r["count"]) for r in rows.groupBy(F.shiftright("_at", 33).alias("_k")).count().collect())
    starts, before = [], 0
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_k bigint, _before bigint")
    rows = rows.withColumn("_k", F.shiftright("_at", 33)).join(F.broadcast(starts), "_k")
    return rows.withColumn("rank", F.col("_at") - F.shiftleft("_k", 33) + F.col("_before") + 1).drop("_k", "_at", "_before")


def ranked_within(df: DataFrame, keys: list[str], order: list[str | Column], scratch: Scratch, name: str = "sorted") -> DataFrame:
    """``df`` with ``rank`` from 1 by ``order`` within equal ``keys``, none null.

    A key that holds a large part of all rows is spread over ranges like any other:
    the place within a key is the place in the whole less that of the key's first
    row, a minimum with partial results.
    """
    rows = ranked(df, [*keys, *order], scratch, name)
    first = rows.groupBy(*keys).agg((F.min("rank") - 1).alias("_start"))
    return rows.join(first, keys).withColumn("rank", F.col("rank") - F.col("_start")).drop("_start")
