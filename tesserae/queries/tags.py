"""Queries on tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.functions import text as T
from tesserae.operators import tags as G
from tesserae.queries.media import P_SQL, profiles
from tesserae.queries.registry import names, query, values
from tesserae.session import table

#: Distinct cleaned tags of each category, in no order.
CT = "ct AS (SELECT DISTINCT category, lower(trim(t)) AS tag FROM (SELECT category, unnest(tags) AS t FROM categories) WHERE trim(t) <> '')"
DF = f"{CT}, nn AS (SELECT count(*) AS n FROM categories), df AS (SELECT tag, count(*) AS df FROM ct GROUP BY tag)"
#: Cleaned tags of each classified file with the position of their first appearance.
KT = """k0 AS (SELECT path, tags, category FROM (SELECT DISTINCT path, category, tags FROM classified)),
  k1 AS (SELECT path, lower(trim(tags[i])) AS tag, i FROM k0, range(1, 40) r(i) WHERE i <= len(tags)), kt AS (SELECT path, tag, min(i) AS i FROM k1 WHERE tag <> '' GROUP BY path, tag)"""


def cats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "categories")


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """``path, tags, category`` of the classified files with cleaned tags."""
    return table(spark, d, "classified").select("path", "category", "tags").distinct().select("path", "category", T.clean_tags(F.col("tags")).alias("tags"))


@query(f"WITH {DF} SELECT tag, df, n, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM df, nn")
def tag_idf(spark: SparkSession, d: str) -> DataFrame:
    return G.document_frequency(cats(spark, d)).withColumn("idf", F.round(G.idf(F.col("df"), F.col("n")), 6))


@query(f"WITH {DF} SELECT tag, df, n FROM df, nn WHERE df >= 0.05 * n")
def polluted_tags(spark: SparkSession, d: str) -> DataFrame:
    return G.polluted(cats(spark, d), 0.05)


@query(f"""WITH {DF}, p AS (SELECT tag, df, n FROM df, nn WHERE df >= 0.05 * n), e AS (SELECT tag, category, row_number() OVER (PARTITION BY tag ORDER BY category) AS rn FROM ct JOIN p USING (tag))
  SELECT p.tag, p.df, round(100.0::DOUBLE * p.df / n, 6) AS percent, string_agg(category, ', ' ORDER BY category) AS examples FROM p JOIN e ON p.tag = e.tag AND rn <= 3 GROUP BY ALL""")
def pollution_report(spark: SparkSession, d: str) -> DataFrame:
    """Every polluted tag with its share of the categories and three example categories."""
    bad = G.polluted(cats(spark, d), 0.05).select("tag", "df", F.round(100.0 * F.col("df") / F.col("n"), 6).alias("percent"))
    rows = G.category_tags(cats(spark, d)).join(bad, "tag")
    return rows.groupBy("tag", "df", "percent").agg(F.array_join(F.slice(F.array_sort(F.collect_list("category")), 1, 3), ", ").alias("examples"))


JOIN = lambda source: f"SELECT path, coalesce(string_agg(tag, '|' ORDER BY i), '') AS tags FROM {source} GROUP BY path"


@query(f"WITH {KT}, g AS (SELECT * FROM kt WHERE tag NOT IN ({names(fixed.GENERIC_TAGS)})), o AS ({JOIN('g')}) SELECT DISTINCT k0.path, coalesce(o.tags, '') AS tags FROM k0 LEFT JOIN o USING (path)")
def without_generic_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("path", F.array_join(G.without_generic(F.col("tags")), "|").alias("tags"))


@query(f"WITH {KT}, g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY i) AS rn FROM kt), h AS (SELECT * FROM g WHERE rn <= 5), o AS ({JOIN('h')}) SELECT DISTINCT k0.path, coalesce(o.tags, '') AS tags FROM k0 LEFT JOIN o USING (path)")
def capped_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).select("path", F.array_join(F.slice("tags", 1, 5), "|").alias("tags"))


@query(f"""WITH {KT}, {CT}, j AS (SELECT DISTINCT k0.path, k0.category FROM k0 JOIN categories USING (category)),
  s AS (SELECT j.path, kt.tag, kt.i, ct.tag IS NOT NULL AS has FROM j JOIN kt USING (path) LEFT JOIN ct ON ct.category = j.category AND ct.tag = kt.tag)
  SELECT j.path, coalesce(string_agg(tag, '|' ORDER BY i) FILTER (NOT has), '') AS new_tags, count(*) FILTER (has) AS common FROM j LEFT JOIN s USING (path) GROUP BY j.path""")
def tags_against_category(spark: SparkSession, d: str) -> DataFrame:
    """Tags that a file's category does not have yet, and how many it shares (intersection and difference)."""
    c = cats(spark, d).select("category", T.clean_tags(F.col("tags")).alias("have"))
    out = tagged(spark, d).join(F.broadcast(c), "category")
    return out.select("path", F.array_join(F.array_except("tags", "have"), "|").alias("new_tags"), F.size(F.array_intersect("tags", "have")).cast("bigint").alias("common"))


@query(f"""WITH {CT} SELECT c.category, coalesce(string_agg(t.tag, '|' ORDER BY t.i), '') AS picks FROM categories c LEFT JOIN
  (SELECT tag, min(i) AS i FROM (VALUES {values((t, i) for i, t in enumerate(fixed.CURATED_TAGS))}) v(tag, i) WHERE tag IN (SELECT tag FROM ct) GROUP BY tag) t
  ON NOT EXISTS (SELECT 1 FROM ct WHERE ct.category = c.category AND ct.tag = t.tag) GROUP BY c.category""")
def curated_list(spark: SparkSession, d: str) -> DataFrame:
    """For each category the curated tags that the registry knows and the category lacks."""
    c = cats(spark, d)
    # the registry part of the curated list: at most as long as that fixed list
    curated = list(dict.fromkeys(fixed.CURATED_TAGS))
    known = G.category_tags(c).where(F.col("tag").isin(*curated)).agg(F.collect_set("tag").alias("known"))
    picks = F.filter(F.array(*[F.lit(t) for t in curated]), lambda t: F.array_contains(F.col("known"), t) & ~F.array_contains(F.col("have"), t))
    return c.select("category", T.clean_tags(F.col("tags")).alias("have")).crossJoin(F.broadcast(known)).select("category", F.array_join(picks, "|").alias("picks"))


EXCL = f"(VALUES {values([*fixed.EXCLUSIVE, *((b, a) for a, b in fixed.EXCLUSIVE)])}) v(a, b)"
MOOD = ("sunset", "night", "day", "light", "dark", "warm", "cool", "photo", "anime", "minimalist", "detailed", "summer", "winter")
MOOD_PICK = f"""mt AS (SELECT path, i, [{names(MOOD)}][(ascii(substr(md5(path || i::VARCHAR), 1, 1)) + ascii(substr(md5(path || i::VARCHAR), 2, 1))) % {len(MOOD)} + 1] AS tag FROM (SELECT DISTINCT path FROM classified), range(6) r(i))"""


@query(f"""WITH RECURSIVE {MOOD_PICK}, x AS {'(SELECT a, list(b) AS bs FROM ' + EXCL + ' GROUP BY a)'},
  r AS (SELECT path, 0 AS i, []::VARCHAR[] AS kept FROM (SELECT DISTINCT path FROM classified) UNION ALL
    SELECT r.path, r.i + 1, CASE WHEN list_contains(r.kept, m.tag) OR len(list_intersect(r.kept, coalesce(x.bs, []))) > 0 OR len(r.kept) >= 4 THEN r.kept ELSE list_append(r.kept, m.tag) END
    FROM r JOIN mt m ON m.path = r.path AND m.i = r.i LEFT JOIN x ON x.a = m.tag)
  SELECT path, array_to_string(kept, '|') AS tags FROM r WHERE i = 6""")
def mutual_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Six pseudo-random mood tags per path, reduced to at most four that do not exclude one another."""
    p = table(spark, d, "classified").select("path").distinct()
    at = lambda i: (F.ascii(F.substring(F.md5(F.concat("path", i.cast("string"))), 1, 1)) + F.ascii(F.substring(F.md5(F.concat("path", i.cast("string"))), 2, 1))) % len(MOOD) + 1
    moods = F.array(*[F.lit(m) for m in MOOD])
    tags = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(moods, at(i)))
    return p.select("path", F.array_join(G.without_excluded(tags, 4), "|").alias("tags"))


@query()
def mutual_exclusion_stored(spark: SparkSession, d: str) -> DataFrame:
    """The stored tags of each classified file, cleaned, reduced to at most four that do not exclude one another."""
    return tagged(spark, d).select("path", "category", F.array_join(G.without_excluded(F.col("tags"), 4), "|").alias("tags"))


def v(name: str, default: float = 0.0) -> str:
    return f"coalesce({name}, {default})"


SH = lambda *c: "(" + " + ".join(f"coalesce(weights['{x}'], 0)" for x in c) + ") / tot"
HAVE = ("vw_score", "neon_score", "pastel_score", "nature_score", "anime_score", "space_score", "skin_fraction", "sharpness", "aesthetic", "texture_entropy")
VIVID = ("Red", "Orange", "Yellow", "Green", "Teal-Cyan", "Blue", "Purple", "Pink-Magenta")
WARM, COOL = SH("Orange", "Yellow", "Red", "Pink-Magenta"), SH("Blue", "Teal-Cyan", "Purple")
RULES = [(f"{v(k)} >= {t}", tag) for k, tag, t in fixed.STYLE_RULES if k in HAVE]
RULES += [(f"{v('skin_fraction')} > 0.12", t) for t in ("portrait", "person", "human")] + [(f"{v('sharpness')} >= 400", "detailed")]
RULES += [(f"{v('aesthetic')} > 0.6", t) for t in ("photo", "photograph")] + [(f"{v('texture_entropy')} > 4.7", "detailed")]
RULES += [(f"painted AND {SH(c)} >= 0.25", t) for c, t in fixed.COLOUR_TAGS.items()]
RULES += [(f"painted AND {SH('Black', 'White', 'Gray')} > 0.78", t) for t in ("grayscale", "monochrome", "black-and-white")]
RULES += [
    (f"painted AND {SH('Black', 'White', 'Gray')} > 0.88", "minimalist"),
    (f"painted AND {WARM} > 0.45 AND {v('space_score')} < 0.4", "sunset"),
    (f"painted AND {COOL} > 0.55 AND {v('space_score')} > 0.35", "night"),
    (f"painted AND {COOL} > 0.55 AND {v('space_score')} <= 0.35", "cool"),
    (f"painted AND {WARM} > 0.30 AND {COOL} < 0.20", "warm"),
]
RULES += [(f"painted AND {v('nature_score')} > 0.25 AND {SH('Green', 'Blue', 'Teal-Cyan')} > 0.35", t) for t in ("nature", "landscape", "outdoor")]
RULES += [(f"painted AND {SH(*VIVID)} > 0.70 AND broad >= 4", t) for t in ("vibrant", "colorful")]
RULES += [("width > 0 AND height > 0 AND height > width", "vertical"), ("width > 0 AND height > 0 AND height > width AND height / width > 1.8", "phone")]
RULES += [("width > 0 AND height > 0 AND height <= width AND width / height > 2.0", t) for t in ("wide", "panoramic")]
RULES += [("width * height >= 8294400", "4k"), ("width * height >= 2073600", "hd"), (f"{v('skin_fraction')} > 0.25", "figure"), (f"{v('skin_fraction')} > 0.25", "human")]
#: Rule tags of each profile, in order, with repeats: (path, tag, i).
RAW = f"""{P_SQL}, p1 AS (SELECT *, coalesce(cardinality(weights), 0) > 0 AS painted, CASE WHEN coalesce(list_sum(map_values(weights)), 0) = 0 THEN 1 ELSE list_sum(map_values(weights)) END AS tot FROM p),
  p2 AS (SELECT *, coalesce(len(list_filter(map_values(weights), lambda x: x / tot > 0.10)), 0) AS broad FROM p1),
  raw AS (SELECT path, list_filter([{", ".join(f"CASE WHEN {rule} THEN '{tag}' END" for rule, tag in RULES)}], lambda x: x IS NOT NULL) AS tags FROM p2)"""
#: ... and after exclusion: (path, kept).
KEPT = """x AS (SELECT a, list(b) AS bs FROM {excl} GROUP BY a),
  r AS (SELECT path, tags, 0 AS i, []::VARCHAR[] AS kept FROM raw UNION ALL
    SELECT r.path, r.tags, r.i + 1, CASE WHEN list_contains(r.kept, r.tags[r.i + 1]) OR len(list_intersect(r.kept, coalesce(x.bs, []))) > 0 OR len(r.kept) >= {most} THEN r.kept ELSE list_append(r.kept, r.tags[r.i + 1]) END
    FROM r LEFT JOIN x ON x.a = r.tags[r.i + 1] WHERE r.i < len(r.tags)),
  st AS (SELECT path, kept AS tags FROM r WHERE i = len(tags))"""
SUGGESTED = lambda most: RAW + ", " + KEPT.format(excl=EXCL, most=most)


@query(f"WITH RECURSIVE {SUGGESTED(20)} SELECT path, array_to_string(tags, '|') AS tags FROM st")
def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.suggested_tags(profiles(spark, d)).select("path", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {RAW}, {CT}, kl AS (SELECT list(DISTINCT tag) AS known FROM ct) SELECT path, array_to_string(list_filter(tags, lambda t: NOT list_contains(known, t))[:10], '|') AS tags FROM raw, kl")
def new_tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Rule tags outside the registry (the tags of all categories), repeats included, the first ten."""
    p = profiles(spark, d)
    vocabulary = sorted({t for _, t, _ in fixed.STYLE_RULES} | {t for _, t in RULES} | {"pixel-art", "centered", "symmetrical", "minimalist", "pattern", "abstract", "tile"})
    known = G.category_tags(cats(spark, d)).where(F.col("tag").isin(*vocabulary)).agg(F.collect_set("tag").alias("known"))
    raw = C.with_shares(p).select("path", G.raw_tags(p.columns).alias("tags")).crossJoin(F.broadcast(known))
    return raw.select("path", F.array_join(F.slice(F.filter("tags", lambda t: ~F.array_contains(F.col("known"), t)), 1, 10), "|").alias("tags"))


@query(f"""WITH RECURSIVE {SUGGESTED(20)}, co(tag, related, weight) AS (VALUES {values(r for r in fixed.COOCCURRENCE if r[2] >= 0.5)}),
  m AS (SELECT st.path, co.related, max(co.weight) AS weight FROM st JOIN co ON list_contains(st.tags, co.tag) WHERE NOT list_contains(st.tags, co.related) GROUP BY ALL)
  SELECT path, related AS tag, weight::DOUBLE AS weight FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY weight DESC, related) <= 5""")
def cooccur_expand(spark: SparkSession, d: str) -> DataFrame:
    return G.expanded_tags(G.suggested_tags(profiles(spark, d)))


MATCH = f"""{DF}, w AS (SELECT ct.category, ct.tag, ln((1 + n) / (1 + df)) + 1 AS idf FROM ct JOIN df USING (tag), nn),
  s AS (SELECT st.path, w.category, sum(idf) + CASE WHEN list_contains(any_value(st.tags), lower(w.category)) THEN 3 ELSE 0 END AS s FROM st JOIN w ON list_contains(st.tags, w.tag) GROUP BY st.path, w.category)"""


@query(f"WITH RECURSIVE {SUGGESTED(24)}, {MATCH} SELECT path, arg_min(category, (-round(s, 9), category)) AS category, round(max(round(s, 9)), 6) AS score FROM s GROUP BY path")
def classify_by_tags(spark: SparkSession, d: str) -> DataFrame:
    return G.tag_match(G.suggested_tags(profiles(spark, d), 24), cats(spark, d))


TAG_SIGNAL = f"""{DF}, wi AS (SELECT tag, ln((1 + n) / (1 + df)) + 1 AS idf, df >= 0.35 * n AS common FROM df, nn), wc AS (SELECT category, tag, idf FROM ct JOIN wi USING (tag) WHERE NOT common),
  sg0 AS (SELECT st.path, wc.category, sum(idf) AS s, avg(idf) AS a, list_contains(any_value(st.tags), lower(wc.category)) AS named FROM st JOIN wc ON list_contains(st.tags, wc.tag) GROUP BY st.path, wc.category),
  sg1 AS (SELECT sg0.path, sg0.category, s * least(a / 2.5, 1) + CASE WHEN named AND coalesce(wi.idf, 1) >= 1.5 AND NOT coalesce(wi.common, false) THEN 2 ELSE 0 END AS raw FROM sg0 LEFT JOIN wi ON wi.tag = lower(sg0.category)),
  sg2 AS (SELECT *, max(raw) OVER (PARTITION BY path) AS best, count(*) OVER (PARTITION BY path) AS active FROM sg1),
  sg_tags AS (SELECT path, category, raw / best AS value FROM sg2, nn WHERE active < n * 0.6)"""


@query(f"WITH RECURSIVE {SUGGESTED(20)}, {TAG_SIGNAL} SELECT path, category, round(value, 6) AS value FROM sg_tags")
def tags_signal(spark: SparkSession, d: str) -> DataFrame:
    return G.tag_signal(G.suggested_tags(profiles(spark, d)), cats(spark, d)).withColumn("value", F.round("value", 6))


@query(f"""WITH RECURSIVE {SUGGESTED(24)}, kc AS (SELECT DISTINCT path, category FROM classified WHERE category IS NOT NULL),
  u AS (SELECT path, category, unnest(tags) AS tag FROM st JOIN kc USING (path)), z AS (SELECT *, round(1 + CASE WHEN contains(lower(category), tag) THEN 0.5 ELSE 0 END - 0.05 * length(tag), 6)::DOUBLE AS score FROM u)
  SELECT path, tag, score FROM z QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, tag) <= 12""")
def rank_tags(spark: SparkSession, d: str) -> DataFrame:
    """A file's rule tags ranked for its category: tags in its name first, then shorter ones; the first twelve."""
    k = table(spark, d, "classified").where("category is not null").select("path", "category").distinct()
    s = G.suggested_tags(profiles(spark, d), 24).join(k, "path")
    ranked = F.transform("tags", lambda t: F.struct((-F.round(1 + F.when(F.contains(F.lower(F.col("category")), t), 0.5).otherwise(0.0) - 0.05 * F.length(t), 6)).alias("s"), t.alias("tag")))
    return s.select("path", F.explode(F.slice(F.array_sort(ranked), 1, 12)).alias("x")).select("path", "x.tag", (-F.col("x.s")).alias("score"))


@query(f"""WITH RECURSIVE {SUGGESTED(12)}, {KT}, a AS (SELECT path, list(tag ORDER BY i) AS tags FROM kt GROUP BY path),
  m AS (SELECT st.path, list_concat(coalesce(a.tags, []), st.tags) AS tags FROM st LEFT JOIN a USING (path)), e AS (SELECT path, tags[i] AS tag, i FROM m, range(1, 60) r(i) WHERE i <= len(tags)),
  f AS (SELECT path, tag, min(i) AS i, tag IN ({names([*fixed.COLOUR_TAGS.values(), 'black', 'white', 'gray', 'grey', 'cyan', 'magenta'])}) AS colour FROM e GROUP BY path, tag),
  t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY colour, i) AS rn FROM f)
  SELECT m.path, coalesce(string_agg(tag, '|' ORDER BY rn) FILTER (rn <= 8), '') AS tags FROM m LEFT JOIN t USING (path) GROUP BY m.path""")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    """Stored tags, then rule tags; content before colours; eight at most."""
    stored = tagged(spark, d).select("path", F.col("tags").alias("stored"))
    s = G.suggested_tags(profiles(spark, d), 12).join(stored, "path", "left")
    merged = G.merged_sources(F.coalesce("stored", F.array().cast("array<string>")), F.col("tags"), most=8)
    return s.select("path", F.array_join(merged, "|").alias("tags"))


@query(f"""WITH {CT}, vocab AS (SELECT DISTINCT tag FROM ct), ww AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,20}}')) AS word FROM documents), wc AS (SELECT word, count(*) AS docs FROM ww GROUP BY word)
  SELECT word, any_value(docs) AS docs, coalesce(max(tag) FILTER (tag = word), min(tag)) AS tag FROM wc JOIN vocab ON length(tag) >= 3 AND (contains(tag, word) OR contains(word, tag)) GROUP BY word""".replace("\\\\", "\\"))
def description_tags(spark: SparkSession, d: str) -> DataFrame:
    """Words of all descriptions with their registered tag: the word itself, else the smallest tag that holds the word or that the word holds.

    The distinct words are matched, not their occurrences; the vocabulary is that of the (fixed) categories.
    """
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.description_words(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    vocabulary = G.category_tags(cats(spark, d)).select("tag").distinct().where(F.length("tag") >= 3)
    # both directions as equi-joins: a word has 3 to 21 characters, so only such parts of a tag and such tags can meet it
    parts = lambda text, most: F.flatten(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.transform(F.sequence(F.lit(3), F.least(F.length(text) - i + 1, F.lit(most))), lambda k: F.substring(F.col(text), i, k))))
    of_tags = vocabulary.select("tag", F.explode(F.array_distinct(parts("tag", 21))).alias("word")).groupBy("word").agg(F.min("tag").alias("holder"))
    of_words = counts.select("word", F.explode(F.array_distinct(parts("word", 21))).alias("tag"))
    held = of_words.join(F.broadcast(vocabulary), "tag").groupBy("word").agg(F.min("tag").alias("held"), F.max(F.when(F.col("tag") == F.col("word"), F.col("tag"))).alias("same"))
    met = counts.join(of_tags, "word", "left").join(held, "word", "left")
    return met.select("word", "docs", F.coalesce("same", F.least("holder", "held")).alias("tag")).where("tag is not null")


@query(f"WITH {DF}, p AS (SELECT tag FROM df, nn WHERE df >= 0.1 * n) SELECT category, count(*) AS tags, count(*) FILTER (tag IN (SELECT tag FROM p) OR tag IN ({names(fixed.GENERIC_TAGS)})) AS dropped FROM ct GROUP BY category")
def clean_tags_dry(spark: SparkSession, d: str) -> DataFrame:
    """How many tags of each category a cleaning would drop: frequent or generic ones."""
    bad = G.polluted(cats(spark, d), 0.1).select("tag", F.lit(True).alias("bad"))
    rows = G.category_tags(cats(spark, d)).join(F.broadcast(bad), "tag", "left")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("tags"), F.count_if(F.coalesce("bad", F.lit(False)) | F.col("tag").isin(*fixed.GENERIC_TAGS)).alias("dropped"))
