"""Queries on prompts and model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.functions import text as T
from tesserae.operators import prompts as P
from tesserae.queries.media import P_SQL, profiles
from tesserae.queries.registry import names, query, values
from tesserae.queries.tags import HAVE, SH, cats, v
from tesserae.session import table

P2 = f"""{P_SQL}, p1 AS (SELECT *, coalesce(cardinality(weights), 0) > 0 AS painted, CASE WHEN coalesce(list_sum(map_values(weights)), 0) = 0 THEN 1 ELSE list_sum(map_values(weights)) END AS tot FROM p)"""


def phrase_sql(source: str, have: tuple[str, ...]) -> str:
    """palette, style, long style, content, mood and orientation phrases of ``source`` (with painted and tot)."""
    phrase = "CASE {} " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in fixed.COLOUR_PHRASES.items()) + " END"
    style = [(k, t, a, b) for k, t, a, b in fixed.STYLE_PHRASES if k in have]
    content = [(k, t, x) for k, t, x in fixed.CONTENT_PHRASES if k in have]
    warm, cool, light, dark = SH("Orange", "Yellow", "Red", "Pink-Magenta"), SH("Blue", "Teal-Cyan", "Purple"), SH("White", "Yellow"), SH("Black", "Blue", "Purple")
    return f"""rk AS (SELECT *, list_sort(list_transform(map_entries(weights), lambda e: {{'w': -e.value, 'c': e.key}})) AS rk FROM {source}),
  ph AS (SELECT *, CASE WHEN painted THEN concat_ws(', ', coalesce({phrase.format('rk[1].c')}, 'varied palette'), CASE WHEN -rk[2].w / tot > 0.12 THEN {phrase.format('rk[2].c')} END) ELSE 'varied colour palette' END AS pal,
    CASE {" ".join(f"WHEN {v(k)} >= {t} THEN '{a}'" for k, t, a, _ in style)} END AS sty, CASE {" ".join(f"WHEN {v(k)} >= {t} THEN '{b}'" for k, t, _, b in style)} END AS sty_long,
    list_filter([{", ".join(f"CASE WHEN {k} >= {t} THEN '{x}' END" for k, t, x in content)}], lambda x: x IS NOT NULL) AS con,
    CASE WHEN NOT painted THEN NULL WHEN {warm} > 0.40 AND ({SH('Orange')} > 0.18 OR {SH('Pink-Magenta')} > 0.18) THEN 'sunset warmth' WHEN {warm} > 0.40 THEN 'warm atmosphere'
      WHEN {cool} > 0.45 AND ({dark} > 0.40 OR {v('space_score')} > 0.30) THEN 'nighttime calm' WHEN {cool} > 0.45 THEN 'cool atmosphere' WHEN {light} > 0.55 THEN 'bright airy atmosphere' WHEN {dark} > 0.45 THEN 'moody dark atmosphere'
      WHEN {v('pastel_score')} > 0.30 THEN 'soft pastel calm' WHEN {v('neon_score')} > 0.30 THEN 'vibrant energy' END AS mood,
    CASE WHEN width = 0 OR height = 0 OR width IS NULL OR height IS NULL THEN NULL WHEN height > width AND height / width > 1.8 THEN 'vertical phone wallpaper' WHEN height > width THEN 'vertical wallpaper'
      WHEN width / height > 2.0 THEN 'wide panoramic wallpaper' WHEN width::BIGINT * height >= 8294400 THEN '4K resolution' ELSE 'high resolution' END AS ori FROM rk)"""


PH = f"{P2}, {phrase_sql('p1', HAVE)}"
CONCISE = "concat_ws(', ', coalesce(sty, pal), con[1], mood, ori) || '.'"
DETAILED = """concat_ws(' ', 'A wallpaper ' || pal || coalesce(' in a ' || sty_long || ' style', '') || '.', CASE WHEN len(con) > 0 THEN 'The composition is ' || array_to_string(con[:2], ', ') || '.' END, 'It evokes a ' || mood || '.')"""
VIVID = "concat_ws(', ', pal, sty, mood, CASE WHEN len(con) > 0 THEN array_to_string(con[:3], ', ') END, ori) || ', high quality, detailed'"


@query(f"WITH {PH} SELECT path, {CONCISE} AS concise, {DETAILED} AS detailed, {VIVID} AS vivid FROM ph")
def generate_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = C.with_shares(profiles(spark, d))
    return p.select("path", *[P.prompt(p.columns, s).alias(s) for s in ("concise", "detailed", "vivid")])


IDF = r"""pw AS (SELECT category, list_filter(string_split_regex(lower(prompt), '\s+'), lambda w: w <> '') AS ws FROM categories WHERE length(prompt) > 0), pn AS (SELECT count(*) AS n FROM pw),
  pdf AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT category, unnest(ws) AS word FROM pw) GROUP BY word), pidf AS (SELECT word, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM pdf, pn)"""
VEC = lambda name, source, key: f"""{name}_t AS (SELECT {key}, word, count(*) AS tf FROM (SELECT {key}, unnest(ws) AS word FROM {source}) GROUP BY ALL), {name}_x AS (SELECT {key}, t.word, tf * coalesce(idf, 1) AS x FROM {name}_t t LEFT JOIN pidf USING (word)),
  {name} AS (SELECT {key}, word, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM {name}_x)"""  # noqa: E731
COS = lambda source: f"""{IDF}, tw AS (SELECT text, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM (SELECT DISTINCT text FROM {source} WHERE length(text) > 0)), {VEC("tv", "tw", "text")}, {VEC("cv", "pw", "category")},
  cs AS (SELECT tv.text, cv.category, sum(tv.x * cv.x) AS score FROM tv JOIN cv USING (word) GROUP BY ALL)"""  # noqa: E731


@query(f"WITH {IDF} SELECT word, df, round(idf, 6) AS idf FROM pidf")
def prompt_idf(spark: SparkSession, d: str) -> DataFrame:
    return P.prompt_idf(cats(spark, d)).withColumn("idf", F.round("idf", 6))


TEXTS = f"{PH}, gen AS (SELECT DISTINCT {CONCISE} AS text FROM ph)"


@query(f"WITH {TEXTS}, {COS('gen')} SELECT text, category, round(score, 6) AS score FROM cs")
def prompt_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = C.with_shares(profiles(spark, d))
    return P.prompt_cosine(p.select(P.prompt(p.columns).alias("text")), cats(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {COS("(SELECT text FROM documents WHERE source LIKE '%caption%' OR source LIKE '%prompt%')")}, rk AS (SELECT text, category, round(score, 9) AS s, row_number() OVER (PARTITION BY text ORDER BY round(score, 9) DESC, category) AS rn FROM cs),
  w AS (SELECT text, max(CASE WHEN rn = 1 THEN category END) AS category, max(CASE WHEN rn = 1 THEN s END) AS a, max(CASE WHEN rn = 2 THEN s END) AS b FROM rk GROUP BY text)
  SELECT md5(text) AS text, category, round(a, 6) AS score FROM w WHERE a >= 0.10 AND (b IS NULL OR a >= 1.4 * b)""")
def prompt_winner(spark: SparkSession, d: str) -> DataFrame:
    """The category whose prompt a caption or prompt text clearly resembles most."""
    t = table(spark, d, "documents").where(F.col("source").contains("caption") | F.col("source").contains("prompt")).select("text")
    return P.prompt_winner(P.prompt_cosine(t, cats(spark, d))).withColumn("text", F.md5("text"))


MEANS = f"""km AS (SELECT DISTINCT path, category FROM classified WHERE category IS NOT NULL), mp AS (SELECT km.category, p1.* FROM p1 JOIN km USING (path)),
  m1 AS (SELECT category, {", ".join(f"round(avg(coalesce({c}, 0)), 9) AS {c}" for c in HAVE)}, floor(avg(width))::INT AS width, floor(avg(height))::INT AS height FROM mp GROUP BY category),
  m2 AS (SELECT category, e.key AS colour, round(sum(e.value), 9) AS w FROM (SELECT category, unnest(map_entries(weights)) AS e FROM mp) GROUP BY ALL), m3 AS (SELECT category, map(list(colour ORDER BY colour), list(w ORDER BY colour)) AS weights FROM m2 GROUP BY category),
  mm AS (SELECT m1.*, weights, coalesce(cardinality(weights), 0) > 0 AS painted, CASE WHEN coalesce(list_sum(map_values(weights)), 0) = 0 THEN 1 ELSE list_sum(map_values(weights)) END AS tot FROM m1 LEFT JOIN m3 USING (category))"""


@query(f"WITH {P2}, {MEANS}, {phrase_sql('mm', HAVE)} SELECT category, replace(category, '_', ' ') || ' style: ' || {CONCISE} AS prompt FROM ph")
def category_prompt(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "classified").where("category is not null").select("path", "category").distinct()
    return P.category_prompt(P.mean_profiles(profiles(spark, d), k, HAVE))


STYLE_KEYS = {"anime_score": "anime", "space_score": "space", "nature_score": "nature", "neon_score": "neon", "pastel_score": "pastel", "minimalist_score": "minimalist"}


@query(f"""WITH {P_SQL}, k AS (SELECT DISTINCT path, category FROM classified WHERE category IS NOT NULL), a AS (SELECT category, {", ".join(f"round(avg(coalesce({c}, 0)), 9) AS {c}" for c in STYLE_KEYS)} FROM p JOIN k USING (path) GROUP BY category)
  SELECT category, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} >= 0.20 THEN '{w}' END" for c, w in STYLE_KEYS.items())}], lambda x: x IS NOT NULL), ',') AS keywords FROM a""")
def style_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The style words whose mean score over a category's files is 0.20 or more."""
    k = table(spark, d, "classified").where("category is not null").select("path", "category").distinct()
    a = profiles(spark, d).join(k, "path").groupBy("category").agg(*[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 9).alias(c) for c in STYLE_KEYS])
    return a.select("category", F.array_join(F.array_compact(F.array(*[F.when(F.col(c) >= 0.20, w) for c, w in STYLE_KEYS.items()])), ",").alias("keywords"))


TEMPLATES = ("a photo of {c}", "a wallpaper in the style of {c}", "{c} artwork")


@query(f"SELECT category, replace(t, '{{c}}', lower(replace(category, '_', ' '))) AS prompt FROM categories, (VALUES {values((t,) for t in TEMPLATES)}) v(t)")
def prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    c = cats(spark, d)
    return c.select("category", F.explode(F.transform(F.array(*[F.lit(t) for t in TEMPLATES]), lambda t: F.replace(t, F.lit("{c}"), F.lower(F.translate("category", "_", " "))))).alias("prompt"))


REPLY = r"CASE WHEN starts_with(trim(text), '```') THEN regexp_replace(trim(text), '(?m)^\s*```.*$', '', 'g') ELSE trim(text) END"


@query(rf"""WITH r AS (SELECT doc_id, length(text) AS n, string_split_regex({REPLY}, '[,;\n•·]+') AS ps FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, i, lower(trim(regexp_replace(regexp_replace(ps[i], '^[\s\d.)(*\-•]+', ''), '[\s.,;:•]+$', ''))) AS tag FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM r)),
  f AS (SELECT doc_id, tag, min(i) AS i FROM e WHERE tag IN ({names(fixed.CURATED_TAGS)}) GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f)
  SELECT r.doc_id, coalesce(string_agg(tag, '|' ORDER BY rn) FILTER (rn <= 8), '') AS tags FROM r LEFT JOIN g USING (doc_id) GROUP BY r.doc_id""")
def parse_llm_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(T.parsed_tags(F.col("text"), list(fixed.CURATED_TAGS)), "|").alias("tags"))


@query(r"""WITH j AS (SELECT doc_id, CASE WHEN regexp_extract(text, '\{[\s\S]+\}') <> '' THEN regexp_replace(regexp_extract(text, '\{[\s\S]+\}'), ',\s*([}\]])', '\1', 'g') END AS block FROM documents WHERE contains(text, '{'))
  SELECT doc_id, json_extract_string(block, '$.category') AS category, round(TRY_CAST(json_extract_string(block, '$.nsfw') AS DOUBLE), 6) AS nsfw FROM (SELECT * FROM j WHERE json_valid(block))""")
def llm_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the JSON objects in model replies; trailing commas are repaired, other texts are left out."""
    block = T.repaired_json(T.json_block(F.col("text")))
    docs = table(spark, d, "documents").where(F.col("text").contains("{")).select("doc_id", block.alias("block"))
    docs = docs.where(F.try_parse_json("block").isNotNull())
    return docs.select("doc_id", F.get_json_object("block", "$.category").alias("category"), F.round(F.get_json_object("block", "$.nsfw").try_cast("double"), 6).alias("nsfw"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_extract(substr(text, 1, 200), '^([\s\S]*\.)', 1) <> '' THEN regexp_extract(substr(text, 1, 200), '^([\s\S]*\.)', 1) ELSE substr(text, 1, 200) END AS clipped,
  len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,20}')))::INT AS words FROM documents WHERE text IS NOT NULL""")
def description_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.clipped_sentence(F.col("text"), 200).alias("clipped"), F.size(F.array_distinct(T.description_words(F.col("text")))).alias("words"))


BLANKS = "||".join(f"chr({ord(x)})" for x in T.BLANKS)


@query(f"""WITH a AS (SELECT doc_id, trim(trim(trim(text, {BLANKS}), chr(34)), chr(39)) AS t FROM documents), b AS (SELECT *, {" OR ".join(f"starts_with(lower(t), '{x}')" for x in fixed.BAD_LEADS)} AS bad, instr(t, '.') AS dot, instr(t, chr(10)) AS line FROM a),
  c AS (SELECT doc_id, CASE WHEN bad AND dot BETWEEN 1 AND 200 THEN trim(substr(t, dot + 1), {BLANKS}) WHEN bad AND line BETWEEN 1 AND 200 THEN trim(substr(t, line + 1), {BLANKS}) ELSE t END AS t FROM b)
  SELECT doc_id, nullif(CASE WHEN length(t) <= 600 THEN t WHEN contains(substr(t, 1, 600), '.') THEN regexp_extract(substr(t, 1, 600), '^([\\s\\S]*)\\.', 1) || '.' ELSE substr(t, 1, 600) || '.' END, '') AS prompt FROM c""")
def synthesised_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Each text as the description of a category: outer quotes and bad leading phrases removed, cut after 600 characters."""
    return table(spark, d, "documents").select("doc_id", T.synthesised(F.col("text")).alias("prompt"))
