"""Queries on decisions from models' scores and replies, file tags, learned and cleaned tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions import text as T
from tesserae.operators import analysis as A
from tesserae.operators import tags as G
from tesserae.queries.media import P_SQL, profiles
from tesserae.queries.palettes import palette_fallback
from tesserae.queries.registry import SQL, names, query
from tesserae.queries.scoring import classify_confidence
from tesserae.queries.tags import CT, KT, SUGGESTED, cats, tagged
from tesserae.queries.vectors import V, centroids, dot, units
from tesserae.session import table

BEST = lambda least: f"sc AS (SELECT path, arg_min(e.key, (-e.value, e.key)) AS category, max(e.value) AS v FROM (SELECT path, unnest(map_entries(clip_scores)) AS e FROM p) WHERE e.value IS NOT NULL AND e.key IN (SELECT category FROM categories) GROUP BY path), bs AS (SELECT path, category FROM sc WHERE v > {least})"


@query(f"""WITH {P_SQL}, {BEST(0.10)}, t AS ({SQL["classify_by_tags"]}), f AS ({SQL["palette_fallback"]}) SELECT p.path, coalesce(bs.category, t.category, f.category) AS category FROM p LEFT JOIN bs USING (path) LEFT JOIN t USING (path) LEFT JOIN f USING (path)""")
def clip_decision(spark: SparkSession, d: str) -> DataFrame:
    """The image-text model's best category above 0.10, else by tags, else by palette."""
    p = profiles(spark, d)
    return A.score_cascade(p, cats(spark, d), G.tag_match(G.suggested_tags(p, 24), cats(spark, d)), palette_fallback(spark, d), 0.10)


@query(f"""WITH {P_SQL}, {BEST(0.05)}, {KT}, {CT}, nn AS (SELECT count(*) AS n FROM categories), df AS (SELECT tag, count(*) AS df FROM ct GROUP BY tag), w AS (SELECT category, tag, ln((1 + n) / (1 + df)) + 1 AS idf FROM ct JOIN df USING (tag), nn), kd AS (SELECT DISTINCT path, tag FROM kt),
  s AS (SELECT kd.path, w.category, sum(idf) + CASE WHEN count(*) FILTER (kd.path IN (SELECT path FROM kd k2 WHERE k2.path = kd.path AND k2.tag = lower(w.category))) > 0 THEN 3 ELSE 0 END AS s FROM kd JOIN w USING (tag) GROUP BY kd.path, w.category),
  t AS (SELECT path, arg_min(category, (-round(s, 9), category)) AS category FROM s GROUP BY path), f AS ({SQL["classify_confidence"]}) SELECT p.path, coalesce(bs.category, t.category, f.category) AS category FROM p LEFT JOIN bs USING (path) LEFT JOIN t USING (path) LEFT JOIN f USING (path)""")
def reply_decision(spark: SparkSession, d: str) -> DataFrame:
    """A language model's best category above 0.05 (its scores in ``clip_scores``), else by its stored tags, else by all signals."""
    p = profiles(spark, d)
    by_tags = G.tag_match(tagged(spark, d).select("path", "tags"), cats(spark, d))
    return A.score_cascade(p, cats(spark, d), by_tags, classify_confidence(spark, d).select("path", "category"), 0.05)


@query(f"WITH RECURSIVE {SUGGESTED(12)} SELECT path, array_to_string(tags[:8], '|') AS tags, tags[1] AS subject FROM st")
def detected_tags(spark: SparkSession, d: str) -> DataFrame:
    return A.detected_tags(profiles(spark, d)).select("path", F.array_join("tags", "|").alias("tags"), "subject")


@query(f"""WITH RECURSIVE {SUGGESTED(8)}, {KT}, a AS (SELECT path, (list(tag ORDER BY i))[:8] AS tags FROM kt GROUP BY path), tc AS (SELECT path, list_transform((list_sort(list_transform(map_entries(weights), lambda e: {{'w': -e.value, 'c': lower(e.key)}})))[:3], lambda x: x.c) AS tags FROM (SELECT DISTINCT ON (path) path, weights FROM profiles WHERE path IS NOT NULL))
  SELECT st.path, array_to_string(CASE WHEN len(a.tags) > 0 THEN a.tags WHEN len(st.tags) > 0 THEN st.tags ELSE coalesce(tc.tags, []) END, '|') AS tags FROM st LEFT JOIN a USING (path) LEFT JOIN tc USING (path)""")
def file_tags(spark: SparkSession, d: str) -> DataFrame:
    """A file's stored tags, else suggested ones, else its three strongest colours."""
    p = profiles(spark, d)
    rows = p.select("path", "weights").join(G.suggested_tags(p, 8).withColumnRenamed("tags", "suggested"), "path").join(tagged(spark, d).select("path", "tags"), "path", "left")
    return rows.select("path", F.array_join(A.file_tags(F.col("tags"), F.col("suggested"), F.col("weights")), "|").alias("tags"))


@query(f"""WITH {KT}, {CT}, s AS (SELECT DISTINCT k0.category, tag FROM kt JOIN k0 USING (path)), u AS (SELECT category, tag FROM ct UNION SELECT s.category, s.tag FROM s JOIN categories USING (category) UNION SELECT category, unnest([{names(fixed.ADULT_TAGS)}]) FROM categories WHERE category = 'NSFW')
  SELECT category, count(*) AS n, string_agg(tag, '|' ORDER BY tag) AS tags FROM u GROUP BY category""")
def learned_tags(spark: SparkSession, d: str) -> DataFrame:
    """Each category's tags with those of its files."""
    files = tagged(spark, d).where("category is not null").select("category", F.explode("tags").alias("tag")).groupBy("category").agg(F.collect_set("tag").alias("more"))
    c = cats(spark, d).select("category", T.clean_tags(F.col("tags")).alias("have")).join(files, "category", "left")
    none = F.array().cast("array<string>")
    out = c.select("category", A.learned_tags(F.coalesce("have", none), F.coalesce("more", none), F.col("category")).alias("tags"))
    return out.where(F.size("tags") > 0).select("category", F.size("tags").cast("bigint").alias("n"), F.array_join("tags", "|").alias("tags"))


@query(f"WITH {CT} SELECT DISTINCT tag FROM ct WHERE length(tag) BETWEEN 2 AND 20 AND NOT contains(tag, ' ')")
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return G.category_tags(cats(spark, d)).select("tag").distinct().where(F.length("tag").between(2, 20) & ~F.col("tag").contains(" "))


@query(rf"""WITH {CT}, vo AS (SELECT list(DISTINCT tag) AS v FROM ct), k0 AS (SELECT DISTINCT path, tags FROM classified), e AS (SELECT path, rtrim(lower(trim(tags[i])), '.,;:!?"''') AS t, i FROM k0, range(1, 60) r(i) WHERE i <= len(tags)),
  f AS (SELECT path, t, min(i) AS i FROM e, vo WHERE t <> '' AND t NOT IN ({names(fixed.GENERIC_TAGS)}) AND list_contains(v, t) GROUP BY path, t), g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS rn FROM f)
  SELECT k0.path, coalesce(string_agg(t, '|' ORDER BY rn) FILTER (rn <= 8), '') AS tags FROM k0 LEFT JOIN g USING (path) GROUP BY k0.path""")
def structured_tags(spark: SparkSession, d: str) -> DataFrame:
    """Stored tags cleaned like a model's structured answer: registered ones that are not generic, eight at most."""
    known = G.category_tags(cats(spark, d)).agg(F.collect_set("tag").alias("known"))
    rows = table(spark, d, "classified").select("path", "tags").distinct().crossJoin(F.broadcast(known))
    none = F.array().cast("array<string>")
    return rows.select("path", F.array_join(A.structured(F.coalesce("tags", none), F.col("known")), "|").alias("tags"))


@query()
def clean_tags_live(spark: SparkSession, d: str) -> DataFrame:
    """What a cleaning category by category removes; the order matters."""
    return A.cleaned_categories(cats(spark, d))


@query(f"WITH n AS (SELECT DISTINCT lower(source) AS m FROM documents WHERE source IS NOT NULL) SELECT m, NOT (contains(m, '-text') OR contains(m, 'embed')) AND ({' OR '.join(f'contains(m, {chr(39)}{x}{chr(39)})' for x in fixed.SEEING_MODELS)}) AS sees FROM n")
def model_sees(spark: SparkSession, d: str) -> DataFrame:
    """Whether a model's name says that it takes images, over the sources of the documents."""
    m = table(spark, d, "documents").where("source is not null").select(F.lower("source").alias("m")).distinct()
    has = lambda words: F.greatest(*[F.col("m").contains(w) for w in words])
    return m.select("m", (~has(fixed.BLIND_MODELS) & has(fixed.SEEING_MODELS)).alias("sees"))


@query(rf"""WITH {CT}, v AS (SELECT DISTINCT tag FROM ct WHERE contains(tag, ' ') AND tag NOT IN ({names(fixed.GENERIC_TAGS)})), t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
  SELECT tag, count(*) AS docs FROM v, t WHERE len(list_filter(list_filter(string_split(tag, ' '), lambda w: w <> ''), lambda w: NOT contains(t, w))) = 0 GROUP BY tag""")
def phrase_tags(spark: SparkSession, d: str) -> DataFrame:
    """How many texts hold every word of a tag of several words; the tags are a fixed, broadcast table."""
    v = G.category_tags(cats(spark, d)).select("tag").distinct().where(F.col("tag").contains(" ") & ~F.col("tag").isin(*fixed.GENERIC_TAGS))
    v = v.agg(F.collect_list(F.struct("tag", F.filter(F.split("tag", " "), lambda w: w != "").alias("ws"))).alias("v"))
    t = table(spark, d, "documents").where("text is not null").select(F.lower("text").alias("t")).crossJoin(F.broadcast(v))
    met = F.filter("v", lambda x: F.forall(x["ws"], lambda w: F.contains(F.col("t"), w)))
    return t.select(F.explode(met).alias("x")).groupBy(F.col("x.tag").alias("tag")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {V}, s AS (SELECT vec_id, cc.label, list_dot_product(u, c) AS s FROM v, cc) SELECT vec_id, label, round(s, 6) AS cosine FROM s WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) <= 3")
def nearest_labels(spark: SparkSession, d: str) -> DataFrame:
    """The three words (here labels) of highest positive cosine with each vector; the vocabulary is broadcast."""
    c = centroids(spark, d).agg(F.collect_list(F.struct("label", "c")).alias("cs"))
    x = units(spark, d).select("vec_id", "u").crossJoin(F.broadcast(c))
    scored = F.array_sort(F.transform("cs", lambda y: F.struct((-F.round(dot(F.col("u"), y["c"]), 9)).alias("s"), y["label"].alias("label"))))
    return x.select("vec_id", F.explode(F.slice(F.filter(scored, lambda y: y["s"] < 0), 1, 3)).alias("y")).select("vec_id", "y.label", F.round(-F.col("y.s"), 6).alias("cosine"))
