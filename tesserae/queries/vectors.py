"""Queries on embedding vectors, format signatures and the scan stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions.media import detect_format
from tesserae.queries.registry import query
from tesserae.session import table
from tesserae.streaming.cache import scans_per_window


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


V = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z)))) AS u FROM embeddings),
  c0 AS (SELECT label, i, avg(u[i]) AS m FROM v, range(1, 65) r(i) GROUP BY label, i), c1 AS (SELECT label, list(m ORDER BY i) AS m FROM c0 GROUP BY label), cc AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda z: z * z)))) AS c FROM c1)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return e.select("vec_id", "label", norm.alias("norm"), "embedding").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("u"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """The normalised mean of the normalised vectors of each label."""
    m = units(spark, d).select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
    return c.select("label", F.sqrt(dot(F.col("m"), F.col("m"))).alias("n"), "m").select("label", F.transform("m", lambda x: x / F.col("n")).alias("c"))


@query(f"WITH {V} SELECT label, i - 1 AS i, round(c[i], 6) AS x FROM cc, range(1, 65) r(i)")
def prompt_avg_embedding(spark: SparkSession, d: str) -> DataFrame:
    return centroids(spark, d).select("label", F.posexplode("c").alias("i", "x")).select("label", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {V} SELECT vec_id, cc.label, round(list_dot_product(u, c), 6) AS cosine, round((list_dot_product(u, c) + 1) / 2, 6) AS score FROM v, cc")
def vector_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with every label's centroid (a small, broadcast table), and its score in [0, 1]."""
    x = units(spark, d).select("vec_id", "u").crossJoin(F.broadcast(centroids(spark, d))).select("vec_id", "label", dot(F.col("u"), F.col("c")).alias("s"))
    return x.select("vec_id", "label", F.round("s", 6).alias("cosine"), F.round((F.col("s") + 1) / 2, 6).alias("score"))


@query(f"""WITH {V}, s AS (SELECT vec_id, cc.label, exp(list_dot_product(u, c)) AS e FROM v, cc), p AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM s)
  SELECT vec_id, round(least(1, 2 * sum(p) FILTER (label >= 7)), 6) AS mass FROM p GROUP BY vec_id""")
def softmax_mass(spark: SparkSession, d: str) -> DataFrame:
    """Twice the softmax mass of some labels, 1 at most."""
    x = units(spark, d).select("vec_id", "u").crossJoin(F.broadcast(centroids(spark, d))).select("vec_id", "label", F.exp(dot(F.col("u"), F.col("c"))).alias("e"))
    per = x.groupBy("vec_id").agg(F.sum("e").alias("all"), F.sum(F.when(F.col("label") >= 7, F.col("e")).otherwise(0.0)).alias("some"))
    return per.select("vec_id", F.round(F.least(F.lit(1.0), 2 * F.col("some") / F.col("all")), 6).alias("mass"))


HEADS = [(i, "00" * o + s.hex() + "00" * 8, n) for i, (o, s, n) in enumerate(fixed.MAGIC)]


@query()
def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    """The format found for every file's made-up header: the signature that its name's digest picks."""
    heads = F.array(*[F.lit(h) for _, h, _ in HEADS])
    f = table(spark, d, "files").select("path").distinct()
    at = F.pmod(F.xxhash64("path"), F.lit(len(HEADS))).cast("int")
    return f.select("path", F.element_at(heads, at + 1).alias("head")).select("path", detect_format(F.unhex("head")).alias("format"))


@query("SELECT date_trunc('day', scanned_at) AS start, count(*) AS scans, sum(coalesce(size_bytes, 0))::BIGINT AS new_bytes FROM (SELECT DISTINCT * FROM hash_cache) WHERE scanned_at IS NOT NULL GROUP BY 1")
def scans_per_day(spark: SparkSession, d: str) -> DataFrame:
    return scans_per_window(table(spark, d, "hash_cache").distinct()).withColumn("start", F.col("start").cast("timestamp_ntz"))
