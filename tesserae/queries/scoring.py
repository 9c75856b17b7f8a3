"""Queries on feature statistics, fingerprints and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import fixed
from tesserae.functions.media import aspect_class, size_signal
from tesserae.operators import scoring as S
from tesserae.operators import stats as A
from tesserae.operators import tags as G
from tesserae.queries.media import ASPECT, F_SQL, P_SQL, files, profiles
from tesserae.queries.palettes import palette_fallback
from tesserae.queries.prompts import CONCISE, COS, P2, phrase_sql
from tesserae.queries.registry import names, query, values
from tesserae.queries.tags import EXCL, HAVE, KEPT, RAW, SH, TAG_SIGNAL, cats, v
from tesserae.session import Scratch, spread, table

FEATURES = S.FINGERPRINT
MEMBERS = "k AS (SELECT DISTINCT path, category FROM classified WHERE category IS NOT NULL)"
LONGF = f"lf AS (SELECT path, feature, value FROM (UNPIVOT (SELECT path, {', '.join(FEATURES)} FROM p) ON {', '.join(FEATURES)} INTO NAME feature VALUE value) WHERE value IS NOT NULL AND NOT isnan(value))"


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classified").where("category is not null").select("path", "category").distinct()


@query(f"""WITH {P_SQL}, {MEMBERS}, {LONGF} SELECT category, feature, round(avg(value), 10) AS mean, round(coalesce(stddev_samp(value), 0), 10) AS std, round(min(value), 10) AS min, round(max(value), 10) AS max, count(*) AS samples
  FROM lf JOIN k USING (path) GROUP BY ALL""")
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.feature_stats(profiles(spark, d), members(spark, d), FEATURES)


GLOBAL = """gs0 AS (SELECT DISTINCT * FROM category_stats WHERE mean IS NOT NULL), gm AS (SELECT feature, sum(samples * mean) / sum(samples) AS g, sum(samples) AS total FROM gs0 GROUP BY feature),
  gl AS (SELECT feature, g AS mean, sqrt(greatest(sum(samples * pow(mean - g, 2)) / total, 1e-6)) AS std, sqrt(greatest(sum(samples * pow(std, 2)) / total, 1e-6)) AS within_std, total::BIGINT AS samples FROM gs0 JOIN gm USING (feature) GROUP BY feature, g, total)"""


def category_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "category_stats").distinct()


@query(f"WITH {GLOBAL} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(within_std, 6) AS within_std, samples FROM gl")
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    g = A.global_stats(category_stats(spark, d))
    return g.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "within_std")], "samples")


#: Fingerprint similarity of every profile and category: (path, category, value).
FP = f"""{GLOBAL}, bw(feature, bw) AS (VALUES {values(fixed.FEATURE_WEIGHTS.items())}),
  cs0 AS (SELECT s.category, s.feature, s.mean AS m, g.mean AS gm, g.std AS gs, 3 * greatest(CASE WHEN s.std <= 0 THEN g.within_std ELSE sqrt((1 - 5.0::DOUBLE / (5 + samp)) * s.std * s.std + 5.0::DOUBLE / (5 + samp) * g.within_std * g.within_std) END, 0.05) AS sd,
    coalesce(bw, 1) * CASE WHEN g.std > 0.001 THEN least(greatest(0.4, 0.4 + abs(s.mean - g.mean) / g.std * 0.6), 2.5) ELSE 1 END AS w FROM (SELECT *, samples AS samp FROM gs0) s JOIN gl g USING (feature) LEFT JOIN bw USING (feature)),
  fp0 AS (SELECT lf.path, category, sum(greatest(0, 1 - abs(value - m) / sd) * w * CASE WHEN abs(m - gm) > 0.01 AND abs(value - gm) > 0.01 AND (m - gm) * (value - gm) < 0 THEN greatest(0.25, 1 - 0.35 * least(abs(value - gm) / greatest(gs, 0.01), 2)) ELSE 1 END) / sum(w) AS base
    FROM lf JOIN cs0 USING (feature) GROUP BY ALL),
  wsh AS (SELECT path, e.key AS colour, e.value / tot AS share FROM (SELECT path, tot, unnest(map_entries(weights)) AS e FROM p1 WHERE painted)), wno AS (SELECT path, sqrt(sum(share * share)) AS pn FROM wsh GROUP BY path),
  cpl AS (SELECT category, e.key AS colour, e.value AS cw FROM (SELECT category, unnest(map_entries(palette)) AS e FROM categories)), cno AS (SELECT category, sqrt(sum(cw * cw)) AS cn FROM cpl GROUP BY category),
  dots AS (SELECT path, category, sum(share * cw) AS dot FROM wsh JOIN cpl USING (colour) GROUP BY ALL),
  fpv AS MATERIALIZED (SELECT f.path, f.category, greatest(0, least(1, CASE WHEN pn > 0 AND cn > 0 THEN 0.7 * base + 0.3 * coalesce(dot, 0) / (pn * cn) ELSE base END)) AS value
    FROM fp0 f LEFT JOIN wno ON wno.path = f.path LEFT JOIN cno ON cno.category = f.category LEFT JOIN dots ON dots.path = f.path AND dots.category = f.category)"""


@query(f"WITH {P2}, {LONGF}, {FP} SELECT path, category, round(value, 6) AS value FROM fpv QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(value, 9) DESC, category) <= 3")
def fingerprint_score(spark: SparkSession, d: str) -> DataFrame:
    """The three categories whose fingerprint a profile resembles most: a report of `fingerprint_scores`."""
    w = Window.partitionBy("path").orderBy(F.desc_nulls_last(F.round("value", 9)), "category")
    return _fingerprints(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3 and value is not null").select("path", "category", F.round("value", 6).alias("value"))


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """``path, category, value`` of every profile and category; null where they share no feature."""
    scratch = Scratch(spark, "fingerprint")
    rows = spread(scratch.keep(S.profile_rows(profiles(spark, d), cats(spark, d)), "profiles"), "path")
    c = scratch.keep(S.category_rows(cats(spark, d), category_stats(spark, d)), "categories")
    value = F.when(sum((F.col(f"fp_w_{f}") * F.col(f"fh_{f}") for f in FEATURES), F.lit(0.0)) > 0, S.signal_columns()["fingerprint"])
    return rows.crossJoin(F.broadcast(c)).select("path", "category", value.alias("value"))


@query(f"WITH {P2}, {LONGF}, {FP} SELECT path, category, round(value, 6) AS value FROM fpv")
def fingerprint_scores(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint similarity of every profile and category that share a feature."""
    return _fingerprints(spark, d).where("value is not null").withColumn("value", F.round("value", 6))


def any_tag(*ts: str) -> str:
    return "len(list_intersect(ctags, [" + names(ts) + "])) > 0"


def ramp_sql(x: str, t: float, top: float, width: float) -> str:
    return f"CASE WHEN {x} > {t} THEN least({top}, {top} * (({x} - {t}) / {width}::DOUBLE)) ELSE 0 END"


STYLE_TERMS = " + ".join(f"CASE WHEN list_contains(ctags, '{t}') AND list_contains(style_tags, '{t}') THEN {ramp_sql(v(k), th, 1.0, 0.20)} ELSE 0 END" for k, t, th in fixed.STYLE_RULES if k in HAVE)
STYLE_N = [(t, sum(1 for _, x, _ in fixed.STYLE_RULES if x == t)) for t in sorted({t for _, t, _ in fixed.STYLE_RULES})]
SIGNAL_SQL = {
    "style": f"""CASE WHEN len(ctags) > 0 THEN least(({STYLE_TERMS} + CASE WHEN {any_tag('portrait')} THEN {ramp_sql(v('skin_fraction'), 0.10, 1.5, 0.15)} ELSE 0 END
      + CASE WHEN {any_tag('anime', 'illustration')} THEN {ramp_sql(v('anime_score'), 0.25, 1.2, 0.25)} ELSE 0 END
      + CASE WHEN {any_tag('photo', 'photograph')} AND {v('aesthetic')} > 0.5 AND {v('sharpness')} > 200 THEN {ramp_sql(v('aesthetic'), 0.5, 0.7, 0.3)} + {ramp_sql(v('sharpness'), 200, 0.5, 300)} ELSE 0 END) / 3, 1) ELSE 0 END""",
    "content": f"least((CASE WHEN {any_tag(*S.FLAGS['clean'])} THEN {v('minimalist_score')} * 1.4 ELSE 0 END + CASE WHEN {any_tag(*S.FLAGS['gradient'])} THEN {v('gradient_score')} * 0.8 ELSE 0 END) / 2, 1)",
    "quality": f"least((CASE WHEN {any_tag('detailed')} AND {v('sharpness')} > 400 THEN 0.7 ELSE 0 END + CASE WHEN {any_tag('high-quality')} AND {v('aesthetic')} > 0.7 THEN 0.8 ELSE 0 END) / 2.0::DOUBLE, 1)",
    "pattern": f"CASE WHEN {any_tag('minimalist', 'simple')} THEN 0.6 ELSE 0 END",
    "size": f"""least(CASE WHEN {any_tag('phone')} AND shape = 'phone' THEN 1 ELSE 0 END + CASE WHEN {any_tag('vertical')} AND shape = 'vertical' THEN 0.6 ELSE 0 END + CASE WHEN {any_tag('wide', 'panoramic')} AND shape = 'wide' THEN 1 ELSE 0 END, 1)""",
}
SHAPE = "CASE WHEN width = 0 OR height = 0 THEN NULL WHEN height > width AND height / greatest(width, 1) > 1.8 THEN 'phone' WHEN height > width THEN 'vertical' WHEN width / greatest(height, 1) > 2.0 THEN 'wide' ELSE 'landscape' END"
RAWP = RAW.replace("p1 AS", "q1 AS").replace("p2 AS", "q2 AS").replace("FROM p1)", "FROM q1)").replace("FROM p2)", "FROM q2)")
#: Weighted total of every profile and category: (path, category, s, and each signal).
ALL_SIGNALS = f"""{RAWP}, {KEPT.format(excl=EXCL, most=20)}, {TAG_SIGNAL}, {P2.replace('p AS', 'pz AS', 1)}, {LONGF}, {FP}, {phrase_sql('p1', HAVE)}, gen0 AS (SELECT path, {CONCISE} AS text FROM ph), gen AS (SELECT DISTINCT text FROM gen0), {COS('gen')},
  ctl AS (SELECT c.category, coalesce(list(tag) FILTER (tag IS NOT NULL), []) AS ctags FROM categories c LEFT JOIN ct USING (category) GROUP BY c.category),
  sty AS (SELECT coalesce(list(tag), []) AS style_tags FROM df JOIN (VALUES {values(STYLE_N)}) v(tag, times) USING (tag), nn WHERE ln((1 + n) / (1 + df * times)) + 1 >= 1.10),
  xj AS (SELECT p1.*, {SHAPE} AS shape, ctl.category, ctags, style_tags FROM p1, ctl, sty),
  sg AS (SELECT xj.path, xj.category, coalesce(sg_tags.value, 0) AS tags, greatest(0, least(1, coalesce(dot, 0))) AS palette, {", ".join(f"{x} AS {k}" for k, x in SIGNAL_SQL.items())},
    coalesce(cs.score, 0) AS prompt, coalesce(xj.clip_scores[xj.category], 0) AS clip, coalesce(fpv.value, 0) AS fingerprint
    FROM xj LEFT JOIN sg_tags ON sg_tags.path = xj.path AND sg_tags.category = xj.category LEFT JOIN dots ON dots.path = xj.path AND dots.category = xj.category
    LEFT JOIN gen0 ON gen0.path = xj.path LEFT JOIN cs ON cs.text = gen0.text AND cs.category = xj.category LEFT JOIN fpv ON fpv.path = xj.path AND fpv.category = xj.category),
  tot AS MATERIALIZED (SELECT *, {" + ".join(f"{k} * {w}" for k, w in fixed.SIGNAL_WEIGHTS.items() if k in ('tags', 'palette', 'style', 'content', 'quality', 'pattern', 'size', 'prompt', 'clip', 'fingerprint'))} AS s FROM sg)"""


@query(f"""WITH RECURSIVE {ALL_SIGNALS}, a AS (SELECT path, sum(s) AS s1, sum(pow(s, 0.6)) AS s06, sum(pow(s, 1.4)) AS s14 FROM tot GROUP BY path),
  rn AS (SELECT path, category, round(s, 9) AS s, row_number() OVER (PARTITION BY path ORDER BY round(s, 9) DESC, category) AS rn FROM tot),
  w AS (SELECT path, max(CASE WHEN rn = 1 THEN category END) AS category, max(CASE WHEN rn = 1 THEN s END) AS a, max(CASE WHEN rn = 2 THEN s END) AS b FROM rn WHERE rn <= 2 GROUP BY path)
  SELECT path, category, round(a, 6) AS score, round(CASE WHEN (a / s1) / greatest(b / s1, 0.01) > 2 THEN pow(a, 0.6) / s06 WHEN (a / s1) / greatest(b / s1, 0.01) < 1.2 THEN pow(a, 1.4) / s14 ELSE a / s1 END, 3) AS confidence FROM w JOIN a USING (path)""")
def classify_confidence(spark: SparkSession, d: str) -> DataFrame:
    return S.classified(profiles(spark, d), cats(spark, d), category_stats(spark, d), Scratch(spark, "classify"))


@query(f"""WITH RECURSIVE {ALL_SIGNALS}, b AS (SELECT * FROM tot QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(s, 9) DESC, category) = 1)
  SELECT path, category, {", ".join(f"round({k}, 8)::DOUBLE AS {k}" for k in ('tags', 'palette', 'style', 'content', 'quality', 'pattern', 'size', 'prompt', 'clip', 'fingerprint'))} FROM b""")
def combine_signals(spark: SparkSession, d: str) -> DataFrame:
    """All signals of the decided category of each profile."""
    scratch = Scratch(spark, "signals")
    p, c, s = profiles(spark, d), cats(spark, d), category_stats(spark, d)
    rows, signals = S.decided_rows(S.classified(p, c, s, scratch), p, c, s, scratch), S.signal_columns()
    return rows.select("path", "category", *[F.round(signals[k], 8).alias(k) for k in ("tags", "palette", "style", "content", "quality", "pattern", "size", "prompt", "clip", "fingerprint")])


@query()
def explain_topn(spark: SparkSession, d: str) -> DataFrame:
    """The three best categories of every profile, each with its three strongest signals."""
    return S.explained(profiles(spark, d), cats(spark, d), category_stats(spark, d), Scratch(spark, "explain"))


@query(f"""WITH RECURSIVE {RAW}, {KEPT.format(excl=EXCL, most=24)}, {P2.replace('p AS', 'pz AS', 1).replace('p1 AS', 'p9 AS')}, ct AS (SELECT DISTINCT category, lower(trim(t)) AS tag FROM (SELECT category, unnest(tags) AS t FROM categories) WHERE trim(t) <> ''), nn AS (SELECT count(*) AS n FROM categories),
  df AS (SELECT tag, count(*) AS df FROM ct GROUP BY tag), tw AS (SELECT category, tag, ln((1 + n) / (1 + df)) + 1 AS idf FROM ct JOIN df USING (tag), nn),
  ts AS (SELECT st.path, category, sum(idf) + CASE WHEN list_contains(any_value(st.tags), lower(category)) THEN 3 ELSE 0 END AS s FROM st JOIN tw ON list_contains(st.tags, tw.tag) GROUP BY st.path, category),
  tb AS (SELECT path, arg_min(category, (-round(s, 9), category)) AS category FROM ts GROUP BY path),
  sh AS (SELECT path, e.key AS colour, e.value / tot AS share FROM (SELECT path, tot, unnest(map_entries(weights)) AS e FROM p9 WHERE painted)), cp AS (SELECT category, e.key AS colour, e.value AS cw FROM (SELECT category, unnest(map_entries(palette)) AS e FROM categories)),
  ps AS (SELECT path, category, round(sum(share * cw), 9) AS s FROM sh JOIN cp USING (colour) GROUP BY ALL), pb AS (SELECT path, arg_min(category, (-s, category)) AS category, max(s) AS s FROM ps GROUP BY path)
  SELECT p9.path, coalesce(CASE WHEN {SHAPE} = 'phone' AND EXISTS (SELECT 1 FROM categories WHERE category = 'Phone') THEN 'Phone' END, tb.category, CASE WHEN pb.s > 0.15 THEN pb.category END, (SELECT min(category) FROM categories)) AS category
  FROM p9 LEFT JOIN tb USING (path) LEFT JOIN pb USING (path)""")
def legacy_classify(spark: SparkSession, d: str) -> DataFrame:
    """The cascade of single rules: phone shape, tags, palette, first category."""
    p = profiles(spark, d)
    tag = G.tag_match(G.suggested_tags(p, 24), cats(spark, d)).select("path", F.col("category").alias("by_tag"))
    palette = palette_fallback(spark, d).select("path", F.col("category").alias("by_palette"))
    phone = cats(spark, d).agg(F.max(F.when(F.col("category") == "Phone", "Phone")).alias("phone"))
    out = p.select("path", "width", "height").join(tag, "path", "left").join(palette, "path", "left").crossJoin(F.broadcast(phone))
    shaped = F.when(size_signal(F.col("width"), F.col("height")) == "phone", F.col("phone"))
    return out.select("path", F.coalesce(shaped, "by_tag", "by_palette").alias("category"))


SMALL = ("anime_score", "space_score", "nature_score", "neon_score", "pastel_score", "vw_score", "skin_fraction", "sharpness", "aesthetic", "texture_entropy")
SCALED = {f: f"greatest(0, least(1, {v(f)} / {fixed.FEATURE_RANGES[f][1]}::DOUBLE))" for f in SMALL}
EX = [(i, f, max(0.0, min(1.0, x.get(f, 0.0) / fixed.FEATURE_RANGES[f][1]))) for i, (_, x, _) in enumerate(fixed.EXAMPLES) for f in fixed.FEATURE_RANGES]
EXT = [(i, t, len(tags)) for i, (_, _, tags) in enumerate(fixed.EXAMPLES) for t in tags]


@query(f"""WITH {P_SQL}, xf AS (SELECT path, f.feature, CASE f.feature {" ".join(f"WHEN '{f}' THEN {x}" for f, x in SCALED.items())} ELSE 0 END AS x FROM p, (VALUES {values((f,) for f in fixed.FEATURE_RANGES)}) f(feature)),
  ds AS (SELECT path, i, exp(-sqrt(sum(pow(x - y, 2)) / {len(fixed.FEATURE_RANGES)}) / 0.3) AS s FROM xf JOIN (VALUES {values(EX)}) e(i, feature, y) USING (feature) GROUP BY ALL),
  z AS (SELECT path, sum(s) AS z FROM ds GROUP BY path), m AS (SELECT path, tag, round(sum(s / k) / any_value(z), 9) AS m FROM ds JOIN (VALUES {values(EXT)}) t(i, tag, k) USING (i) JOIN z USING (path) GROUP BY ALL)
  SELECT path, tag, round(m, 6) AS mass FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY m DESC, tag) <= 5""")
def tag_predictor(spark: SparkSession, d: str) -> DataFrame:
    return A.predicted_tags(profiles(spark, d))


@query(f"""WITH {P_SQL}, {MEMBERS}, x AS (SELECT path, {", ".join(f"{x} AS {f}" for f, x in SCALED.items())} FROM p),
  m AS (SELECT category, {", ".join(f"round(avg({f}), 9) AS mu_{f}, CASE WHEN round(stddev_pop({f}), 9) > 0 THEN round(stddev_pop({f}), 9) ELSE 0.05 END AS sd_{f}" for f in SMALL)} FROM x JOIN k USING (path) GROUP BY category)
  SELECT x.path, k.category, round(({" + ".join(f"greatest(0, 1 - least(abs({f} - mu_{f}) / sd_{f}, 3) / 3.0::DOUBLE)" for f in SMALL)}) / {len(SMALL)}, 6) AS score FROM x JOIN k USING (path) JOIN m USING (category)""")
def category_scorer(spark: SparkSession, d: str) -> DataFrame:
    """How well each classified file fits the model of its own category."""
    p, k = profiles(spark, d), members(spark, d)
    model = A.fitted(p, k, SMALL)
    rows = p.join(k, "path").join(model, "category")
    return rows.select("path", "category", F.round(A.fit_score(p.columns, SMALL), 6).alias("score"))


@query(f"""WITH {F_SQL}, {MEMBERS}, m AS (SELECT k.category, {ASPECT} AS aspect, f.width, f.height FROM f JOIN k USING (path)), n AS (SELECT category, aspect, count(*) AS n FROM m GROUP BY ALL)
  SELECT category, arg_min(aspect, (-n, aspect)) AS value, max(n) AS n FROM n GROUP BY category""")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select("path", aspect_class(F.col("width"), F.col("height")).alias("aspect"))
    return A.majority(f.join(members(spark, d), "path"), "aspect")


@query(f"""WITH {F_SQL}, {MEMBERS}, m AS (SELECT k.category, {ASPECT} AS aspect, f.width, f.height FROM f JOIN k USING (path)), n AS (SELECT category, count(*) AS total FROM m GROUP BY category),
  c AS (SELECT category, aspect, count(*) AS n FROM m GROUP BY ALL), a AS (SELECT category, list_sort(list(aspect) FILTER (n >= greatest(1, total * 0.20))) AS xs FROM c JOIN n USING (category) GROUP BY category),
  w AS (SELECT category, count(*) FILTER (width > 0) AS nw, list_sort(list(width) FILTER (width > 0)) AS ws, list_sort(list(height) FILTER (height > 0)) AS hs FROM m GROUP BY category)
  SELECT a.category, CASE WHEN len(xs) = 0 OR len(xs) = 3 THEN 'any' ELSE array_to_string(CASE WHEN list_contains(xs, 'any') THEN xs ELSE list_append(xs, 'any') END, ',') END AS aspects,
  coalesce(ws[len(ws) // 10 + 1], 0) AS min_width, coalesce(hs[len(hs) // 10 + 1], 0) AS min_height FROM a JOIN w USING (category)""")
def expected_config(spark: SparkSession, d: str) -> DataFrame:
    """Proposed expectations per category: frequent aspects and the lower tenth of the sizes."""
    m = files(spark, d).select("path", "width", "height", aspect_class(F.col("width"), F.col("height")).alias("aspect")).join(members(spark, d), "path")
    kinds = ("any", "horizontal", "square", "vertical")
    counts = m.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("aspect") == k).alias(f"n_{k}") for k in kinds], F.count_if(F.col("width") > 0).alias("nw"), F.count_if(F.col("height") > 0).alias("nh")
    )
    common = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") >= F.greatest(F.lit(1.0), F.col("n") * 0.20), k) for k in kinds]))
    aspects = F.when(F.size(common).isin(0, 3), "any").otherwise(F.array_join(F.when(F.array_contains(common, "any"), common).otherwise(F.concat(common, F.array(F.lit("any")))), ","))
    # the order statistic from counts per value: no list of a category's sizes is built
    def tenth(c: str, n: str) -> DataFrame:
        per = m.where(F.col(c) > 0).groupBy("category", c).agg(F.count(F.lit(1)).alias("k"))
        run = per.withColumn("upto", F.sum("k").over(Window.partitionBy("category").orderBy(c))).join(counts.select("category", n), "category")
        return run.where(F.col("upto") > F.floor(F.col(n) / 10)).groupBy("category").agg(F.min(c).alias(f"min_{c}"))

    out = counts.join(tenth("width", "nw"), "category", "left").join(tenth("height", "nh"), "category", "left")
    return out.select("category", aspects.alias("aspects"), F.coalesce("min_width", F.lit(0)).alias("min_width"), F.coalesce("min_height", F.lit(0)).alias("min_height"))


RANKED = f"{F_SQL}, r AS (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY coalesce(size_bytes, 0), path) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM f)"


@query(f"WITH {RANKED} SELECT parent, path FROM r WHERE n <= 5 OR i = 0 OR i = n - 1 OR list_contains(list_transform(range(3), lambda j: (least(floor(j * ((n - 2) / 3.0::DOUBLE)), n - 3) + 1)::BIGINT), i)")
def smart_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.smart_sample(files(spark, d), 5, Scratch(spark, "sample"))


@query(f"""WITH {RANKED}, b AS (SELECT *, least(floor(i / n::DOUBLE * 6), 5) AS b FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY parent, b ORDER BY i) AS turn FROM b),
  o AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY turn, b) AS o FROM t) SELECT parent, path FROM o WHERE n <= 8 OR o <= 8""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.stratified_sample(files(spark, d), 8, Scratch(spark, "sample"))


@query(f"""WITH {F_SQL}, r AS (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY path) - 1 AS i, count(*) OVER (PARTITION BY parent) AS n FROM f)
  SELECT parent, path FROM r WHERE n <= 4 OR list_contains(list_transform(range(4), lambda j: floor(j * (n / 4.0::DOUBLE))::BIGINT), i)""")
def uniform_sample(spark: SparkSession, d: str) -> DataFrame:
    return A.uniform_sample(files(spark, d), 4, Scratch(spark, "sample"))
