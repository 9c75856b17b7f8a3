"""Queries on exact and perceptual duplicates, and the incremental cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import duplicates as D
from tesserae.queries.registry import query
from tesserae.session import Scratch, table

FILES = r"""f AS (SELECT DISTINCT path, name, parent, ext, size_bytes, mtime, width, height,
  CASE WHEN regexp_matches(lower(trim(md5)), '^[0-9a-f]{32}$') THEN lower(trim(md5)) END AS md5 FROM files WHERE path IS NOT NULL)"""
EXACT = """x AS (SELECT md5, count(*) AS n, coalesce(min(size_bytes) = max(size_bytes), false) AS size_match, sum(coalesce(size_bytes, 0))::BIGINT AS bytes,
  (sum(coalesce(size_bytes, 0)) - max(coalesce(size_bytes, 0)))::BIGINT AS wasted FROM f WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)"""
KEEP = "k AS (SELECT md5, path AS keep FROM f JOIN x USING (md5) QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY coalesce(f.size_bytes, 0) DESC, path) = 1)"
LATEST = r"""c AS (SELECT path, entry_id, sig, size_bytes, CASE WHEN regexp_matches(lower(trim(md5)), '^[0-9a-f]{32}$') THEN lower(trim(md5)) END AS md5
  FROM hash_cache WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, entry_id DESC) = 1)"""
SIG = "size_bytes::VARCHAR || '-' || floor(mtime)::BIGINT::VARCHAR"


@query(f"WITH {FILES}, {EXACT}, {KEEP} SELECT md5, n, size_match, bytes, wasted, keep FROM x JOIN k USING (md5)")
def md5_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "files"))


@query(f"""WITH {FILES} SELECT md5, parent, count(*) AS n, coalesce(min(size_bytes) = max(size_bytes), false) AS size_match, sum(coalesce(size_bytes, 0))::BIGINT AS bytes,
  (sum(coalesce(size_bytes, 0)) - max(coalesce(size_bytes, 0)))::BIGINT AS wasted, arg_min(path, (-coalesce(size_bytes, 0), path)) AS keep
  FROM f WHERE md5 IS NOT NULL GROUP BY md5, parent HAVING count(*) > 1""")
def md5_groups_per_folder(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "files"), same_parent=True)


@query(f"WITH {FILES}, {EXACT}, {KEEP} SELECT md5, path, path = keep AS is_keep FROM f JOIN k USING (md5)")
def keep_largest(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_members(table(spark, d, "files"))


@query(rf"""WITH {FILES}, g AS (SELECT md5, count(*) AS n, count(DISTINCT lower(regexp_extract(path, '[^/.][^/]*(\.[^/.]*)$', 1))) AS kinds,
  sum(coalesce(size_bytes, 0)) - max(coalesce(size_bytes, 0)) AS wasted FROM f WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)
  SELECT coalesce(kinds, 0)::BIGINT AS kinds, count(*) AS groups, sum(n)::BIGINT AS files, sum(wasted)::BIGINT AS wasted FROM g GROUP BY ROLLUP (kinds)""")
def dup_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_stats(table(spark, d, "files"))


@query(f"""WITH {FILES}, {LATEST}, n AS (SELECT path, coalesce({SIG}, '') AS sig FROM f)
  SELECT * FROM (SELECT n.path, n.sig, CASE WHEN c.path IS NULL THEN 'new' WHEN c.sig IS NULL OR c.sig <> n.sig THEN 'changed' WHEN c.md5 IS NULL THEN 'unhashed' END AS reason
  FROM n LEFT JOIN c ON n.path = c.path) WHERE reason IS NOT NULL""")
def incremental_changed(spark: SparkSession, d: str) -> DataFrame:
    return D.changed_files(table(spark, d, "files"), table(spark, d, "hash_cache"))


@query("SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM frames WHERE path IS NOT NULL)")
def perceptual_changed(spark: SparkSession, d: str) -> DataFrame:
    return D.unframed_files(table(spark, d, "files"), table(spark, d, "frames"))


@query(f"""WITH {FILES}, {LATEST} SELECT path, {SIG} AS sig, md5, size_bytes FROM f
  UNION ALL SELECT path, sig, md5, size_bytes FROM c WHERE path NOT IN (SELECT path FROM f)""")
def cache_replaced(spark: SparkSession, d: str) -> DataFrame:
    return D.replaced_cache(table(spark, d, "files"), table(spark, d, "hash_cache"))


@query(f"""WITH {FILES}, {LATEST} SELECT coalesce(f.path, c.path) AS path, coalesce(f.size_bytes::VARCHAR || '-' || floor(f.mtime)::BIGINT::VARCHAR, c.sig) AS sig,
  coalesce(f.md5, c.md5) AS md5, coalesce(f.size_bytes, c.size_bytes) AS size_bytes FROM f FULL JOIN c ON f.path = c.path""")
def cache_merged(spark: SparkSession, d: str) -> DataFrame:
    return D.merged_cache(table(spark, d, "files"), table(spark, d, "hash_cache"))


@query("""SELECT path, frame, bit_count(xor(dh, ph))::INT AS dh_ph, bit_count(xor(dh, ah))::INT AS dh_ah,
  round(coalesce(list_cosine_similarity(hist::DOUBLE[], [1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16]::DOUBLE[]), 0), 6) AS cosine
  FROM (SELECT DISTINCT path, frame, dh, ph, ah, hist FROM frames WHERE len(hist) = 16 AND list_max(hist) > 0)
  UNION ALL SELECT path, frame, bit_count(xor(dh, ph))::INT, bit_count(xor(dh, ah))::INT, 0.0
  FROM (SELECT DISTINCT path, frame, dh, ph, ah, hist FROM frames WHERE NOT coalesce(len(hist) = 16 AND list_max(hist) > 0, false))""")
def hamming_and_cosine(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frames").select("path", "frame", "dh", "ph", "ah", "hist").distinct()
    bits = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))).cast("int")
    line = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda x: x)
    return f.select("path", "frame", bits("dh", "ph").alias("dh_ph"), bits("dh", "ah").alias("dh_ah"), F.round(D.hist_cosine(F.col("hist"), line), 6).alias("cosine"))


BUCKETS = "b AS (SELECT path, arg_min(dh16, frame) & 65535 AS dh16 FROM frames WHERE path IS NOT NULL GROUP BY path), s AS (SELECT dh16, count(*) AS n FROM b WHERE dh16 IS NOT NULL GROUP BY dh16)"


@query(f"""WITH {BUCKETS}, p AS (SELECT s.dh16, s.n, xor(s.dh16, (1 << i)::INT) AS other FROM s, range(16) r(i) WHERE s.n > 1),
  q AS (SELECT p.dh16, sum(p.n * s.n)::BIGINT AS near_pairs FROM p JOIN s ON p.other = s.dh16 GROUP BY p.dh16)
  SELECT s.dh16, s.n, s.n * (s.n - 1) // 2 AS same_pairs, coalesce(near_pairs, 0) AS near_pairs FROM s LEFT JOIN q USING (dh16)""")
def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.bucket_candidates(table(spark, d, "frames"))


FRAME_SQL = """u AS (SELECT path, frame, dh, dh16, ph, hist, count(*) OVER (PARTITION BY path) AS nf FROM (SELECT DISTINCT path, frame, dh, dh16, ph, hist FROM frames WHERE path IS NOT NULL)),
  v AS (SELECT *, sqrt(list_sum(list_transform(hist, lambda x: x::DOUBLE * x))) AS nn FROM u WHERE len(hist) = 16 AND list_max(hist) > 0),
  j AS (SELECT a.path AS a, b.path AS b, a.nf * b.nf AS pairs, bit_count(xor(a.dh, b.dh)) AS db, bit_count(xor(a.ph, b.ph)) AS pb, list_dot_product(a.hist::DOUBLE[], b.hist::DOUBLE[]) / (a.nn * b.nn) AS cs
    FROM v a JOIN v b ON a.path < b.path AND bit_count(xor(a.dh, b.dh)) <= 14 AND bit_count(xor(a.ph, b.ph)) <= 16),
  m AS (SELECT a, b, pairs, count(*) FILTER (db <= 2 AND pb <= 2 AND cs >= 0.97) AS k0, count(*) FILTER (db <= 8 AND pb <= 10 AND cs >= 0.85) AS k1,
    count(*) FILTER (cs >= 0.75) AS k2 FROM j GROUP BY a, b, pairs),
  t AS (SELECT a, b, CASE WHEN 2 * k0 >= pairs THEN 0 WHEN 2 * k1 >= pairs THEN 1 WHEN 2 * k2 >= pairs THEN 2 END AS tier FROM m)"""


@query(f"WITH {FRAME_SQL} SELECT a, b, tier FROM t WHERE tier IS NOT NULL")
def frame_majority(spark: SparkSession, d: str) -> DataFrame:
    return D.matched_paths(table(spark, d, "frames"), Scratch(spark, "tiers"))


def groups_sql(min_tier: int, same_parent: bool = False) -> str:
    """The closure of links within a bucket or one bit beside it, by a recursive query."""
    return f"""WITH RECURSIVE {FILES}, {EXACT}, cand AS (SELECT path, parent, coalesce(size_bytes, 0) AS size FROM f WHERE md5 IS NULL OR md5 NOT IN (SELECT md5 FROM x)),
  {FRAME_SQL.replace("FROM frames WHERE path IS NOT NULL", "FROM frames WHERE path IN (SELECT path FROM cand)")},
  b0 AS (SELECT path, arg_min(dh16, frame) & 65535 AS k FROM u GROUP BY path), bk AS (SELECT path, parent, k, count(*) OVER (PARTITION BY k) AS n FROM b0 JOIN cand USING (path)),
  l AS (SELECT t.a, t.b FROM t JOIN bk p ON t.a = p.path JOIN bk q ON t.b = q.path WHERE t.tier <= {min_tier} {"AND p.parent = q.parent" if same_parent else ""}
    AND (p.k = q.k OR (bit_count(xor(p.k, q.k)) = 1 AND greatest(p.n, q.n) > 1))),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
  g AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
  i AS (SELECT ga.component, min(t.tier) AS tier FROM t JOIN g ga ON t.a = ga.node JOIN g gb ON t.b = gb.node WHERE ga.component = gb.component AND t.tier IS NOT NULL GROUP BY 1),
  h AS (SELECT component, count(*) AS n, arg_min(node, (-size, node)) AS keep FROM g JOIN cand ON node = path GROUP BY 1),
  per AS (SELECT component AS group_id, node AS path, n, ['reencode', 'resize', 'similar'][tier + 1] AS tier, round(1 - tier / 3.0, 6)::DOUBLE AS score, node = keep AS is_keep
    FROM g JOIN h USING (component) JOIN i USING (component))"""


@query(groups_sql(0) + " SELECT * FROM per")
def perceptual_groups(spark: SparkSession, d: str) -> DataFrame:
    return D.perceptual_groups(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"))


@query(groups_sql(2) + " SELECT * FROM per")
def perceptual_groups_loose(spark: SparkSession, d: str) -> DataFrame:
    return D.perceptual_groups(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"), "similar")


@query(groups_sql(1, True) + " SELECT * FROM per")
def perceptual_groups_per_folder(spark: SparkSession, d: str) -> DataFrame:
    return D.perceptual_groups(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"), "resize", same_parent=True)


ALL = f"{KEEP}, ag AS (SELECT md5 AS group_id, path, 'exact' AS tier, path = keep AS is_keep FROM f JOIN k USING (md5) UNION ALL SELECT group_id, path, tier, is_keep FROM per)"


@query(groups_sql(1) + f", {ALL} SELECT * FROM ag")
def duplicates_combined(spark: SparkSession, d: str) -> DataFrame:
    return D.all_groups(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"), "resize")


@query(groups_sql(1) + f""", {ALL}, w AS (SELECT *, starts_with(path, '/library/') AS inside FROM ag),
  kk AS (SELECT group_id, tier, bool_or(inside) AS touched, arg_min(path, ((tier = 'exact' AND inside)::INT, (NOT is_keep)::INT, path)) AS kept FROM w GROUP BY ALL)
  SELECT w.path, w.group_id, w.tier FROM w JOIN kk USING (group_id, tier) WHERE touched AND path <> kept""")
def dedupe_victims(spark: SparkSession, d: str) -> DataFrame:
    return D.victims(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"), "/library/", "resize")


@query(groups_sql(1) + f""", {ALL}, gx AS (SELECT ag.*, f.size, tier = 'exact' AS exact, lower(regexp_extract(ag.path, '[^/.][^/]*(\\.[^/.]*)$', 1)) AS ext FROM ag JOIN (SELECT path, max(size_bytes) AS size FROM f GROUP BY path) f ON ag.path = f.path),
  pg AS (SELECT group_id, exact, tier, count(*) AS n, coalesce(min(size) = max(size), false) AS same, sum(CASE WHEN is_keep THEN 0 ELSE coalesce(size, 0) END) AS wasted FROM gx GROUP BY ALL),
  tt AS (SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, count(*) FILTER (same) AS size_matched, count(*) FILTER (exact) AS md5_matched, count(*) FILTER (NOT exact) AS perceptual, coalesce(sum(wasted), 0)::BIGINT AS wasted_bytes FROM pg)
  SELECT 'total' AS measure, name, value FROM (UNPIVOT tt ON COLUMNS(*) INTO NAME name VALUE value) UNION ALL SELECT 'tier', tier, count(*) FROM pg GROUP BY tier UNION ALL SELECT 'kind', ext, count(*) FROM (SELECT DISTINCT group_id, exact, ext FROM gx) GROUP BY ext""".replace("\\\\", "\\"))
def dup_group_stats(spark: SparkSession, d: str) -> DataFrame:
    groups = D.all_groups(table(spark, d, "files"), table(spark, d, "frames"), Scratch(spark, "groups"), "resize")
    return D.group_stats(Scratch(spark, "stats").keep(groups, "groups"), table(spark, d, "files"))
