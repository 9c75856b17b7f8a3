"""Queries on detectors, the small classifier, expectations and structured replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import detectors as X
from tesserae.functions import fixed
from tesserae.functions import text as T
from tesserae.functions.media import aspect_token
from tesserae.operators import stats as A
from tesserae.operators import tags as G
from tesserae.queries.media import ASPECT, P_SQL, profiles
from tesserae.queries.prompts import P2
from tesserae.queries.registry import names, query, values
from tesserae.queries.scoring import EX, EXT, MEMBERS, SCALED, SMALL, members
from tesserae.queries.tags import CT, KT, cats, tagged, v
from tesserae.session import Scratch, spread, table

SHARES = f"{P2}, sh AS (SELECT *, list_reverse_sort(list_transform(map_values(weights), lambda x: x / tot)) AS s FROM p1)"


@query(f"""WITH {SHARES}, d AS (SELECT path, coalesce(len(s), 0) AS n, coalesce(s[1], 0) AS top1, coalesce(list_sum(s[:3]), 0) AS top3, coalesce(list_sum(list_transform(s, lambda x: least(x, 0.20))), 0) AS soft, {v('skin_fraction')} AS skin, {v('texture_entropy')} AS tex FROM sh),
  e AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE least(1, 1.3 * (1 - top1)) END AS subject FROM d)
  SELECT path, round(CASE WHEN n = 0 OR n > 12 THEN 0 ELSE least(1, top3 * (12 - n) / 6) END, 6) AS blocks, round(CASE WHEN n < 4 OR top1 > 0.5 THEN 0 ELSE least(1, 1.5 * soft / least(n, 12)) END, 6) AS gradient, round(subject, 6) AS subject,
  round(CASE WHEN skin < 0.05 THEN 0 ELSE least(1, least(1, skin / 0.25) * CASE WHEN subject BETWEEN 0.3 AND 0.7 THEN 1 ELSE 0.4 END * 0.8) END, 6) AS portrait,
  round(CASE WHEN skin < 0.08 THEN 0 ELSE least(1, least(1, (skin - 0.05) / 0.30) * CASE WHEN subject >= 0.35 THEN 1 ELSE 0.5 END * CASE WHEN tex < 4.5 THEN 1 ELSE greatest(0, 1 - (tex - 4.5) / 1.5) END) END, 6) AS bare FROM e""")
def detectors(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d).select("path", X.shares(F.col("weights")).alias("s"), F.coalesce("skin_fraction", F.lit(0.0)).alias("skin"), F.coalesce("texture_entropy", F.lit(0.0)).alias("tex"))
    p = p.withColumn("subject", X.subject_area(F.col("s")))
    found = {
        "blocks": X.blocks(F.col("s")), "gradient": X.gradient(F.col("s")), "subject": F.col("subject"),
        "portrait": X.portrait(F.col("skin"), F.col("subject"), F.lit(0.5)), "bare": X.bare_skin(F.col("skin"), F.col("subject"), F.col("tex")),
    }
    return p.select("path", *[F.round(x, 6).alias(k) for k, x in found.items()])


PREDICTED = f"""xf AS (SELECT path, f.feature, CASE f.feature {" ".join(f"WHEN '{f}' THEN {x}" for f, x in SCALED.items())} ELSE 0 END AS x FROM p, (VALUES {values((f,) for f in fixed.FEATURE_RANGES)}) f(feature)),
  ds AS (SELECT path, i, exp(-sqrt(sum(pow(x - y, 2)) / {len(fixed.FEATURE_RANGES)}) / 0.3) AS s FROM xf JOIN (VALUES {values(EX)}) e(i, feature, y) USING (feature) GROUP BY ALL), z AS (SELECT path, sum(s) AS z FROM ds GROUP BY path),
  m AS (SELECT path, tag, round(sum(s / k) / any_value(z), 9) AS m FROM ds JOIN (VALUES {values(EXT)}) t(i, tag, k) USING (i) JOIN z USING (path) GROUP BY ALL), pt AS (SELECT path, tag, round(m, 6) AS mass FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY m DESC, tag) <= 5)"""


@query(f"""WITH {P_SQL}, {MEMBERS}, {PREDICTED}, {CT}, x AS (SELECT path, {", ".join(f"{x} AS {f}" for f, x in SCALED.items())} FROM p),
  md AS (SELECT category, {", ".join(f"round(avg({f}), 9) AS mu_{f}, CASE WHEN round(stddev_pop({f}), 9) > 0 THEN round(stddev_pop({f}), 9) ELSE 0.05 END AS sd_{f}" for f in SMALL)} FROM x JOIN k USING (path) WHERE category IN (SELECT category FROM categories) GROUP BY category),
  bo AS (SELECT path, category, sum(mass * 0.4) AS extra FROM pt JOIN ct USING (tag) GROUP BY ALL), nb AS (SELECT path, category, sum(mass * 0.6) AS extra FROM pt JOIN md ON lower(md.category) = pt.tag GROUP BY ALL),
  s AS (SELECT x.path, md.category, round(({" + ".join(f"greatest(0, 1 - least(abs({f} - mu_{f}) / sd_{f}, 3) / 3.0::DOUBLE)" for f in SMALL)}) / {len(SMALL)} * (1 + coalesce(bo.extra, 0) + coalesce(nb.extra, 0)) * CASE md.category {" ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in fixed.PRIORS.items())} ELSE 1 END, 9) AS s
    FROM x CROSS JOIN md LEFT JOIN bo ON bo.path = x.path AND bo.category = md.category LEFT JOIN nb ON nb.path = x.path AND nb.category = md.category)
  SELECT path, arg_min(category, (-s, category)) AS category, round(max(s) / sum(s), 3) AS confidence, max(s) / sum(s) < 0.30 AS fallback FROM s GROUP BY path""")
def mini_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The category of the best fit of scaled features, raised by shared predicted tags and a soft prior.

    The models are one row per category and are broadcast with the category names;
    scores become one number per row (score, then name), so a path needs two sums.
    """
    scratch = Scratch(spark, "mini")
    p, c = profiles(spark, d), cats(spark, d)
    model = A.fitted(p, members(spark, d), SMALL).join(c.select("category"), "category", "left_semi")
    model = scratch.keep(model, "models")
    order = sorted(r["category"] for r in model.select("category").collect())
    base = len(order) + 1
    place = spark.createDataFrame([(k, len(order) - i) for i, k in enumerate(order)], "category string, place bigint")
    predicted = scratch.keep(A.predicted_tags(p), "predicted")
    shared = predicted.join(F.broadcast(G.category_tags(c)), "tag").select("path", "category", (F.col("mass") * 0.4).alias("extra"))
    named = predicted.join(F.broadcast(place.select("category", F.lower("category").alias("tag"))), "tag").select("path", "category", (F.col("mass") * 0.6).alias("extra"))
    extra = shared.unionByName(named).groupBy("path", "category").agg(F.sum("extra").alias("extra"))
    extra = extra.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("category", "extra"))).alias("extra"))
    rows = spread(p.drop("weights", "clip_scores").join(extra, "path", "left"), "path").crossJoin(F.broadcast(model.join(F.broadcast(place), "category")))
    prior = F.lit(1.0)
    for k, w in fixed.PRIORS.items():
        prior = F.when(F.col("category") == k, w).otherwise(prior)
    s = A.fit_score(p.columns, SMALL) * (1 + F.coalesce(F.try_element_at("extra", F.col("category")), F.lit(0.0))) * prior
    scored = rows.select("path", F.round(s, 9).alias("s"), "place").select("path", "s", (F.round(F.col("s") * 1e9).cast("bigint") * base + F.col("place")).alias("packed"))
    out = scored.groupBy("path").agg(F.max("packed").alias("m"), F.max("s").alias("a"), F.sum("s").alias("t"))
    out = out.select("path", (F.col("m") % base).alias("place"), (F.col("a") / F.col("t")).alias("c")).join(F.broadcast(place), "place")
    return out.select("path", "category", F.round("c", 3).alias("confidence"), (F.col("c") < 0.30).alias("fallback"))


@query(f"""WITH {P2}, {KT}, e AS (SELECT category, map_keys(palette) AS want, list_distinct(list_filter(list_transform(coalesce(style_keywords, []), lambda x: lower(trim(x))), lambda x: x <> '')) AS kw FROM categories),
  j AS (SELECT k0.path, k0.category, e.want, e.kw, p1.weights, p1.tot, p1.painted, p1.width, p1.height FROM k0 JOIN e USING (category) JOIN p1 USING (path)), tg AS (SELECT path, list(tag) AS tags FROM kt GROUP BY path),
  q AS (SELECT j.path, j.category, CASE WHEN len(want) = 0 THEN 0.5 WHEN NOT painted THEN 0 ELSE len(list_filter(want, lambda c: coalesce(weights[c], 0) / tot >= 0.05)) / len(want) END AS pal,
    CASE WHEN len(kw) = 0 THEN 0.5 ELSE len(list_intersect(kw, coalesce(tags, []))) / len(kw) END AS key, CASE WHEN {ASPECT} IN ('horizontal', 'square') THEN 1 ELSE 0 END AS ar, CASE WHEN width >= 100 AND height >= 100 THEN 1 ELSE 0.3 END AS res FROM j LEFT JOIN tg USING (path))
  SELECT path, category, round((pal + key + ar + res) / 4.0::DOUBLE, 6) AS score FROM q""")
def config_match(spark: SparkSession, d: str) -> DataFrame:
    """How well a classified file meets its category's expectations: palette, keywords, aspect, least resolution."""
    e = cats(spark, d).select("category", F.map_keys("palette").alias("want"), T.clean_tags(F.col("style_keywords")).alias("kw"))
    rows = tagged(spark, d).join(F.broadcast(e), "category").join(profiles(spark, d).select("path", "weights", "width", "height"), "path")
    return rows.select("path", "category", F.round(X.config_match(C.palette_match(F.col("weights"), F.col("want")), F.col("kw"), F.array().cast("array<string>"), F.col("tags"), F.col("width"), F.col("height"), ["horizontal", "square"], (100, 100)), 6).alias("score"))


@query(f"""WITH {P2}, {KT}, t AS (SELECT path, list(tag ORDER BY i) AS tags FROM kt GROUP BY path), rk AS (SELECT path, list_transform((list_sort(list_transform(map_entries(weights), lambda e: {{'w': -e.value, 'c': lower(e.key)}})))[:4], lambda x: x.c) AS cols, width, height FROM p1),
  ab(r, k, n) AS (VALUES {values((a / b, k, n) for k, (a, b, n) in enumerate(fixed.ASPECT_BUCKETS))}),
  m AS (SELECT rk.path, list_concat(coalesce(list_filter(list_transform(t.tags, lambda x: trim(regexp_replace(regexp_replace(x, '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-')), lambda x: x <> ''), []), coalesce(cols, []), [CASE WHEN width > 0 AND height > 0 THEN (SELECT arg_min(n, (abs(r - width / height), k)) FROM ab) ELSE 'image' END]) AS al FROM rk LEFT JOIN t USING (path)),
  u AS (SELECT path, al[i] AS tag, min(i) AS i FROM m, range(1, 60) r(i) WHERE i <= len(al) GROUP BY path, al[i]), w AS (SELECT path, tag, i, row_number() OVER (PARTITION BY path ORDER BY i) AS rn FROM u)
  SELECT path, string_agg(tag, '|' ORDER BY i) AS tags FROM w WHERE rn <= 4 GROUP BY path""")
def fallback_tags(spark: SparkSession, d: str) -> DataFrame:
    """Four words for a file name: its tags, then its colours by weight, then its aspect; never empty."""
    stored = tagged(spark, d).select("path", "tags")
    p = profiles(spark, d).select("path", "weights", "width", "height").join(stored, "path", "left")
    none = F.array().cast("array<string>")
    colours = F.coalesce(F.transform(F.slice(C.ranked(F.col("weights")), 1, 4), lambda x: F.lower(x["colour"])), none)
    every = F.concat(T.tag_components(F.coalesce("tags", none), 60), colours, F.array(aspect_token(F.col("width"), F.col("height"))))
    return p.select("path", F.array_join(F.slice(F.array_distinct(every), 1, 4), "|").alias("tags"))


STOP = ("the", "and", "with", "for", "are", "this", "image")


@query(rf"""WITH j AS (SELECT doc_id, regexp_replace(regexp_extract(text, '\{{[\s\S]+\}}'), ',\s*([}}\]])', '\1', 'g') AS b FROM documents WHERE contains(text, '{{')), q AS (SELECT doc_id, json_extract_string(b, '$.tags[*]') AS ts, json_extract_string(b, '$.nsfw') AS ns FROM j WHERE json_valid(b)),
  e AS (SELECT doc_id, rtrim(lower(trim(ts[i])), '.,;:!?') AS tag, i FROM q, range(1, 60) r(i) WHERE i <= len(ts)), f AS (SELECT doc_id, tag, min(i) AS i FROM e WHERE length(tag) BETWEEN 2 AND 29 AND NOT contains(tag, ' ') AND tag NOT IN ({names(STOP)}) GROUP BY ALL),
  g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f) SELECT q.doc_id, coalesce(string_agg(tag, '|' ORDER BY rn) FILTER (rn <= 12), '') AS tags, CASE WHEN TRY_CAST(any_value(ns) AS DOUBLE) IS NOT NULL THEN round(greatest(0, least(1, TRY_CAST(any_value(ns) AS DOUBLE))), 6) END AS nsfw FROM q LEFT JOIN g USING (doc_id) GROUP BY q.doc_id""")
def llm_structured(spark: SparkSession, d: str) -> DataFrame:
    """Tags and a clamped score from structured model replies."""
    block = T.repaired_json(T.json_block(F.col("text")))
    docs = table(spark, d, "documents").where(F.col("text").contains("{")).select("doc_id", block.alias("b")).where(F.try_parse_json("b").isNotNull())
    tags = F.from_json(F.get_json_object("b", "$.tags"), "array<string>")
    tags = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.rtrim(F.lower(F.trim(t)), F.lit(".,;:!?")))
    score = F.get_json_object("b", "$.nsfw").try_cast("double")
    return docs.select("doc_id", F.array_join(T.structured_tags(tags, list(STOP)), "|").alias("tags"), F.round(F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), 6).alias("nsfw"))


@query(f"""WITH c AS (SELECT list(category ORDER BY category) AS cs FROM categories), a AS (SELECT doc_id, rtrim(trim(text, {"||".join(f"chr({ord(x)})" for x in T.BLANKS)}), '.,;:!?') AS t FROM documents),
  n AS (SELECT doc_id, t, TRY_CAST(regexp_extract(t, '^\\s*(\\d+)', 1) AS INT) AS k FROM a), p AS (SELECT doc_id, min(category) AS part FROM n, categories WHERE contains(lower(t), lower(category)) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN k BETWEEN 1 AND len(cs) THEN cs[k] WHEN list_contains(cs, t) THEN t ELSE part END AS category FROM n CROSS JOIN c LEFT JOIN p USING (doc_id)""")
def answer_category(spark: SparkSession, d: str) -> DataFrame:
    """The category that a reply names: by number, exactly, or as a part of it (the first such name); null where it names none."""
    listed = cats(spark, d).agg(F.array_sort(F.collect_list("category")).alias("cs")).withColumn("low", F.transform("cs", F.lower))
    t = F.rtrim(T.strip(F.col("text"), T.BLANKS), F.lit(".,;:!?"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", t.alias("t")).withColumn("lt", F.lower("t")).crossJoin(F.broadcast(listed))
    k = F.regexp_extract("t", r"^\s*(\d+)", 1).try_cast("int")
    part = F.array_min(F.zip_with("cs", "low", lambda c, low: F.when(F.contains(F.col("lt"), low), c)))
    chosen = F.when((k >= 1) & (k <= F.size("cs")), F.get("cs", k - 1)).when(F.array_contains("cs", F.col("t")), F.col("t")).otherwise(part)
    return docs.select("doc_id", chosen.alias("category"))
