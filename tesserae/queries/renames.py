"""Queries on names: cleaning, rename strategies, move plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.media import digest
from tesserae.plans import renames as R
from tesserae.queries.duplicates import FILES
from tesserae.queries.media import files
from tesserae.queries.registry import query
from tesserae.session import Scratch, table

ASCII = "strip_accents({})"
SAN = r"trim(regexp_replace(regexp_replace({}, '[^\w\s.-]', '_', 'g'), '[\s_]+', '_', 'g'), '._-')"
SLUG = r"trim(regexp_replace(regexp_replace(lower({}), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-._')"
TAG = r"trim(regexp_replace(trim(regexp_replace(lower({}), '[^\w\s-]', '', 'g')), '[\s_]+', '-', 'g'), '-')"
SPLIT = r"nm AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS nme, regexp_extract(path, '[^/]*[^/.](\.[^./]*)$', 1) AS ex FROM f), sp AS (SELECT *, left(nme, length(nme) - length(ex)) AS base, regexp_replace(path, '[^/]*$', '') AS folder FROM nm)"


@query(f"WITH {FILES}, {SPLIT} SELECT path, base, ex AS ext, {SAN.format('base')} AS sanitized, {SLUG.format('base')} AS slug, {TAG.format('base')} AS tag FROM sp")
def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path", T.split_extension(F.regexp_extract("path", r"([^/]*)$", 1)).alias("x"))
    b = F.col("x.base")
    return f.select("path", b.alias("base"), F.col("x.ext").alias("ext"), T.sanitize(b).alias("sanitized"), T.slugify(b).alias("slug"), T.sanitize_tag(b).alias("tag"))


EXT_SQL = r"(CASE WHEN lower(regexp_extract({0}, '^.*[^.](\.[^.]*)$', 1)) = '.tar' THEN regexp_extract(left({0}, length({0}) - 4), '^.*[^.](\.[^.]*)$', 1) ELSE '' END || regexp_extract({0}, '^.*[^.](\.[^.]*)$', 1))"


def free_sql(wanted: str, existing: str) -> str:
    """Tables up to ``ft`` (path, target) of `plans.renames.free_targets` for the table ``wanted`` (path, wanted)."""
    name = "regexp_extract(wanted, '([^/]*)$', 1)"
    return rf"""fe AS (SELECT DISTINCT path AS wanted FROM ({existing})), fm AS (SELECT w.path, w.wanted, w.path = first_value(w.path) OVER (PARTITION BY w.wanted ORDER BY w.path <> w.wanted, w.path) AND (w.path = w.wanted OR fe.wanted IS NULL) AS keeps FROM {wanted} w LEFT JOIN fe ON w.wanted = fe.wanted),
  fn AS (SELECT wanted, row_number() OVER (PARTITION BY wanted ORDER BY path) AS i, path FROM fm WHERE NOT keeps), fa AS (SELECT regexp_replace(wanted, '[^/]*$', '') AS folder, {name} AS nme, {EXT_SQL.format(name)} AS ex FROM (SELECT wanted FROM fe UNION SELECT wanted FROM {wanted})),
  fu AS (SELECT DISTINCT folder || regexp_replace(left(nme, length(nme) - length(ex)), '_[1-9][0-9]{{0,8}}$', '') || ex AS wanted, regexp_extract(left(nme, length(nme) - length(ex)), '_([1-9][0-9]{{0,8}})$', 1)::BIGINT AS k FROM fa WHERE regexp_matches(left(nme, length(nme) - length(ex)), '_[1-9][0-9]{{0,8}}$')),
  fo AS (SELECT wanted, NULL AS path, k - row_number() OVER (PARTITION BY wanted ORDER BY k) AS pos FROM fu WHERE wanted IN (SELECT wanted FROM fn)), fp AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY pos, path IS NULL, path) AS k FROM (SELECT wanted, path, i AS pos FROM fn UNION ALL SELECT wanted, path, pos FROM fo)),
  fx AS (SELECT *, {name} AS nme, {EXT_SQL.format(name)} AS ex FROM fp WHERE path IS NOT NULL), ft AS (SELECT path, wanted AS target FROM fm WHERE keeps UNION ALL SELECT path, regexp_replace(wanted, '[^/]*$', '') || left(nme, length(nme) - length(ex)) || '_' || k || ex FROM fx)"""


CATF = "coalesce(nullif(" + SAN.format("parent") + ", ''), 'file')"
NUM = "CASE WHEN length(n::VARCHAR) > 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END"
H8 = "coalesce(substr(md5, 1, 8), '00000000')"
TITLE = r"list_aggregate(list_transform(regexp_extract_all(translate(base, '_-', '  '), '\p{L}+|\P{L}+'), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), 'string_agg', '')"
ZERO = r"CASE WHEN regexp_extract(base, '^(\d+)', 1) <> '' THEN CASE WHEN length(ltrim(regexp_extract(base, '^(\d+)', 1), '0')) >= 8 THEN ltrim(regexp_extract(base, '^(\d+)', 1), '0') ELSE lpad(ltrim(regexp_extract(base, '^(\d+)', 1), '0'), 8, '0') END || regexp_extract(base, '^\d+(.*)$', 1) ELSE base END"
BASES = {
    "sequential": NUM,
    "category": f"{CATF} || '_' || {NUM}",
    "date_prefix": "'2024-01-01_' || base",
    "sanitize": SAN.format("base"),
    "slugify": SLUG.format("base"),
    "lowercase": "lower(base)",
    "uppercase": "upper(base)",
    "no_spaces": r"trim(regexp_replace(base, '\s+', '_', 'g'), '_')",
    "hash8": H8,
    "date_hash": f"'2024-01-01_' || {H8}",
    "title_case": f"replace({TITLE}, ' ', '_')",
    "underscore": r"trim(regexp_replace(base, '[\s\-]+', '_', 'g'), '_')",
    "reverse": "reverse(base)",
    "truncate": "substr(base, 1, 32)",
    "zero_pad": ZERO,
    "timestamp": "'1700000000_' || base",
    "tags": "array_to_string(uc, '_')",
    "category_tags": f"array_to_string(list_concat([{CATF}], uc), '_')",
    "subject_tags": f"array_to_string(CASE WHEN list_contains(uc, subj) THEN list_concat([subj], list_filter(uc, lambda x: x <> subj)) WHEN subj <> '' THEN list_concat([subj], uc) ELSE uc END, '_')",
    "date_tags": "array_to_string(list_concat(['2024-01-01'], uc), '_')",
    "ai_classification": f"upper(substr({CATF}, 1, 3)) || '_' || {CATF} || '_' || CASE WHEN len(comps) > 0 THEN array_to_string(comps, '-') ELSE 'untagged' END",
}
TAGGED_SQL = rf"""k0 AS (SELECT DISTINCT path, tags, category FROM classified), k1 AS (SELECT path, lower(trim(tags[i])) AS t, i FROM k0, range(1, 40) r(i) WHERE i <= len(tags) AND trim(tags[i]) <> ''),
  k2 AS (SELECT path, trim(regexp_replace(regexp_replace(t, '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') AS c, i FROM k1), k3 AS (SELECT path, c, min(i) AS i FROM k2 WHERE c <> '' GROUP BY ALL), k4 AS (SELECT path, (list(c ORDER BY i))[:3] AS comps FROM k3 GROUP BY path)"""


def strategy_sql(strategy: str) -> str:
    return rf"""WITH {FILES}, {SPLIT}, {TAGGED_SQL}, nb AS (SELECT sp.*, row_number() OVER (PARTITION BY parent ORDER BY sp.path) AS n, coalesce(comps, []) AS comps, CASE WHEN len(coalesce(comps, [])) > 0 THEN comps ELSE ['untagged'] END AS uc,
    coalesce({TAG.format('k0.category')}, '') AS subj FROM sp LEFT JOIN k4 USING (path) LEFT JOIN k0 USING (path)),
  b0 AS (SELECT *, {BASES[strategy]} AS b FROM nb), b1 AS (SELECT *, CASE WHEN b = '' THEN 'file_' || lpad(n::VARCHAR, 3, '0') ELSE b END AS b1 FROM b0), b2 AS (SELECT *, CASE WHEN length(b1) > 120 THEN regexp_replace(substr(b1, 1, 120), '[_\-.]+$', '') ELSE b1 END AS b2 FROM b1),
  tg AS (SELECT *, folder || b2 || ex AS target FROM b2), rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY path) AS again FROM tg),
  fw AS (SELECT path, CASE WHEN again > 1 AND target <> path THEN folder || b2 || '_' || n::VARCHAR || ex ELSE target END AS wanted FROM rk), {free_sql('fw', 'SELECT path FROM rk')} SELECT path, target AS new_path FROM ft"""


def _renamed(strategy: str):
    def plan(spark: SparkSession, d: str) -> DataFrame:
        """A rename plan for all files by one strategy."""
        k = table(spark, d, "classified").select("path", "tags", F.col("category").alias("subject")).distinct()
        f = files(spark, d).select("path", "parent", digest(F.col("md5")).alias("md5")).join(k, "path", "left")
        return R.rename_plan(f, strategy, Scratch(spark, "rename"))

    return plan


for _s in (*R.PLAIN, *R.TAGGED):
    query(strategy_sql(_s), f"rename_{_s}")(_renamed(_s))

KC = "kc AS (SELECT path, min(category) AS category FROM classified WHERE category IS NOT NULL AND path IS NOT NULL GROUP BY path)"


@query(f"WITH {FILES}, {KC}, fw AS (SELECT f.path, '/library/' || category || '/' || name AS wanted FROM f JOIN kc USING (path)), {free_sql('fw', 'SELECT path FROM f')} SELECT path, target FROM ft")
def move_plan(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "classified").where("category is not null and path is not null").groupBy("path").agg(F.min("category").alias("category"))
    f = files(spark, d)
    return R.move_plan(f.join(k, "path").select("path", "category", "name"), f.select("path"), "/library", Scratch(spark, "move"))


@query(f"WITH {FILES}, n AS (SELECT DISTINCT path, name, parent FROM f), c AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM n), fw AS (SELECT path, '/flat/' || CASE WHEN n > 1 THEN parent || '_' || name ELSE name END AS wanted FROM c), {free_sql('fw', 'SELECT path FROM f')} SELECT path, target FROM ft")
def flatten_plan(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return R.flatten_plan(f, f.select("path"), "/flat", Scratch(spark, "flatten"))


@query(f"SELECT count(*) FILTER (path <> new_path) AS renamed, count(*) FILTER (path = new_path) AS skipped FROM ({strategy_sql('lowercase')})")
def rename_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.plan_stats(_renamed("lowercase")(spark, d))
