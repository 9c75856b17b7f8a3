"""Distinct-word tables: do costly work once per distinct word and join it back by position.

Occurrences are joined in two parts.  The most frequent words, a bounded number
of bounded length, are broadcast, so that no shuffle partition grows with a word
that makes up a large share of the corpus; all others meet in a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: At most this many words of at most this many characters are broadcast (under 2 MB).
HOT_WORDS, HOT_CHARS = 8_192, 48


def distinct_words(occurrences: DataFrame, work: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """``word, n, out``: ``work`` applied once to the table of distinct non-null words."""
    counted = occurrences.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return scratch.keep(work(counted), name)


def join_words(occurrences: DataFrame, words: DataFrame, empty: Column) -> DataFrame:
    """``occurrences`` with ``out`` of each word; ``empty`` where the word is null."""
    hot = words.where(F.length("word") <= HOT_CHARS).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", F.col("out").alias("hot_out"))
    met = occurrences.join(F.broadcast(hot), "word", "left")
    done = met.where("hot_out is not null or word is null").withColumn("out", F.coalesce("hot_out", empty)).drop("hot_out", "word")
    rest = met.where("hot_out is null and word is not null").drop("hot_out").join(words.select("word", "out"), "word").drop("word")
    return done.unionByName(rest)
