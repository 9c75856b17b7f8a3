"""Queries pN_... of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.encoding import decode, encode, token_counts
from tesserae.llm.fusion import fused_fields, survivors
from tesserae.llm.frames import usable_hist
from tesserae.llm.grouping import linked_groups
from tesserae.llm.history import repeated_entries
from tesserae.llm.knn import nearest
from tesserae.llm.lookalike import look_classes, look_forms, look_pairs
from tesserae.llm.packing import pack
from tesserae.llm.setjoin import similar_links, similar_pairs
from tesserae.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(table(spark, d, "files"), table(spark, d, "frames"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "classified").selectExpr("path as key", "tags as values")
    right = table(spark, d, "categories").selectExpr("category as key", "style_keywords as values")
    return similar_pairs(left, right, min_size=3)


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    return similar_links(table(spark, d, "classified").selectExpr("path as key", "tags as values"), min_size=3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(table(spark, d, "hash_cache"))


def p3_fused(spark: SparkSession, d: str) -> DataFrame:
    return fused_fields(table(spark, d, "hash_cache"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_entries(table(spark, d, "hash_cache"), table(spark, d, "frames"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    usable = table(spark, d, "frames").where(usable_hist("hist")).selectExpr("path", "frame", "hist as vec")
    return nearest(usable, size=16).drop("cos")


def p5_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of all embeddings for every one whose id is divisible by 100."""
    rows = table(spark, d, "embeddings").selectExpr("'' as path", "vec_id as frame", "embedding as vec", "vec_id % 100 = 0 as asked")
    return nearest(rows).selectExpr("frame as vec_id", "near_frame as near_id", "round(cos, 6) as cos")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode(encode(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return look_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return look_forms(table(spark, d, "documents"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


CLEAN = "list_sort(list_distinct(list_filter(list_transform({0}, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')))"

P2_SQL = f"""WITH a AS (SELECT DISTINCT path AS key, {CLEAN.format('tags')} AS s FROM classified WHERE path IS NOT NULL), b AS (SELECT DISTINCT category AS key, {CLEAN.format('style_keywords')} AS s FROM categories),
  t AS (SELECT 'l' AS side, key, s FROM a WHERE len(s) >= 3 UNION ALL SELECT 'r', key, s FROM b WHERE len(s) >= 3), e AS (SELECT side, key, s, unnest(s) AS tok FROM t),
  c AS (SELECT x.side AS sx, y.side AS sy, x.key AS kx, y.key AS ky, count(*) AS common, len(any_value(x.s)) AS n, len(any_value(y.s)) AS m FROM e x JOIN e y USING (tok) WHERE x.side = 'l' AND (y.side = 'r' OR x.key < y.key) GROUP BY ALL)
  SELECT CASE WHEN sy = 'l' THEN 'within' ELSE 'between' END AS kind, kx AS key_a, ky AS key_b FROM c WHERE common * 8 >= (n + m) * 3"""

P3_SQL = """WITH e AS (SELECT DISTINCT entry_id, path, sig, lower(trim(md5)) AS md5, size_bytes, size, scanned_at FROM hash_cache WHERE regexp_matches(lower(trim(md5)), '^[0-9a-f]{32}$') AND path IS NOT NULL),
  f AS (SELECT *, coalesce(size_bytes > 0, false) AS b, coalesce(len(size) = 2 AND size[1] > 0 AND size[2] > 0, false) AS s, coalesce(sig <> '', false) AS g FROM e),
  n AS (SELECT md5 FROM e GROUP BY md5 HAVING count(DISTINCT path) > 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY b::INT + s::INT + g::INT DESC, scanned_at DESC NULLS LAST, entry_id DESC) AS rk,
    row_number() OVER (PARTITION BY md5 ORDER BY b DESC, coalesce(TRY_CAST(regexp_extract(sig, '([0-9]+)', 1) AS BIGINT) = size_bytes, false) DESC, scanned_at DESC NULLS LAST, entry_id DESC) AS rb,
    row_number() OVER (PARTITION BY md5 ORDER BY s DESC, size[1]::BIGINT * size[2] DESC, scanned_at DESC NULLS LAST, entry_id DESC) AS rs FROM f JOIN n USING (md5))
  SELECT md5, max(CASE WHEN rk = 1 THEN entry_id END) AS keep_entry, max(CASE WHEN rb = 1 THEN CASE WHEN b THEN entry_id ELSE 0 END END) AS size_bytes_entry, max(CASE WHEN rs = 1 THEN CASE WHEN s THEN entry_id ELSE 0 END END) AS size_entry FROM r GROUP BY md5"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query on whole tables; the others are tested against brute force or round trips."""
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
