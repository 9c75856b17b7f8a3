"""Queries on colours and palettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import colour as C
from tesserae.functions import fixed
from tesserae.queries.media import P_SQL, profiles
from tesserae.queries.registry import names, query, values
from tesserae.session import spread, table

#: Long palettes: one row per path and colour with the share.
LONG = f"""{P_SQL}, t AS (SELECT path, weights, CASE WHEN list_sum(map_values(weights)) = 0 THEN 1 ELSE list_sum(map_values(weights)) END AS total FROM p WHERE cardinality(weights) > 0),
  w AS (SELECT path, total, e.key AS colour, e.value AS weight, e.value / total AS share FROM (SELECT path, total, unnest(map_entries(weights)) AS e FROM t))"""
CAT = "c AS (SELECT category, e.key AS colour, e.value AS cw FROM (SELECT category, unnest(map_entries(palette)) AS e FROM categories))"


def painted(spark: SparkSession, d: str) -> DataFrame:
    return profiles(spark, d).where(F.size("weights") > 0)


def category_palettes(spark: SparkSession, d: str) -> DataFrame:
    """The palettes of the categories (a fixed, small table)."""
    return table(spark, d, "categories").where(F.size("palette") > 0).select("category", "palette")


@query(f"WITH {LONG} SELECT path, colour, round(share, 6) AS share FROM w")
def palette_share(spark: SparkSession, d: str) -> DataFrame:
    return painted(spark, d).select("path", F.explode(C.normalised(F.col("weights"))).alias("colour", "share")).withColumn("share", F.round("share", 6))


@query(f"""WITH {LONG}, {CAT}, x AS (SELECT w.path, c.category, least(greatest(sum(share * cw), 0), 1) AS score FROM w JOIN c USING (colour) GROUP BY ALL)
  SELECT path, count(*) AS n, round(max(score), 8) AS best, round(sum(score), 7) AS total FROM x GROUP BY path""")
def palette_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each palette against every category that shares a colour, summed up per path."""
    # the categories are a fixed table: one row with a number per colour is cheaper than a join by colour and its sums
    bits = lambda m: sum((F.when(F.map_contains_key(m, c), 1 << i).otherwise(0) for i, c in enumerate(fixed.COLOURS)), F.lit(0))
    cats = category_palettes(spark, d).select("category", bits("palette").alias("cm"), *[F.coalesce(F.try_element_at("palette", F.lit(c)), F.lit(0.0)).alias(f"cp_{i}") for i, c in enumerate(fixed.COLOURS)])
    p = C.with_shares(painted(spark, d).select("path", "weights")).withColumn("pm", bits("weights")).drop("weights")
    product = sum((F.col(f"share_{i}") * F.col(f"cp_{i}") for i in range(len(fixed.COLOURS))), F.lit(0.0))
    met = spread(p, "path").crossJoin(F.broadcast(cats)).where(F.col("pm").bitwiseAND(F.col("cm")) != 0)
    score = met.select("path", F.least(F.greatest(product, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return score.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 8).alias("best"), F.round(F.sum("score"), 7).alias("total"))


@query(f"""WITH {LONG}, {CAT}, x AS (SELECT w.path, c.category, round(sum(share * cw), 9) AS score FROM w JOIN c USING (colour) GROUP BY ALL),
  b AS (SELECT path, max(score) AS score, arg_min(category, (-score, category)) AS category FROM x GROUP BY path), f AS (SELECT min(category) AS first FROM categories)
  SELECT p.path, CASE WHEN b.score > 0.15 THEN b.category ELSE first END AS category FROM p LEFT JOIN b USING (path), f""")
def palette_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The category of the best palette, if it is above 0.15; else the first category."""
    cats = table(spark, d, "categories").select("category", F.explode("palette").alias("colour", "cw"))
    first = table(spark, d, "categories").agg(F.min("category").alias("first"))
    p = profiles(spark, d).select("path", "weights")
    w = spread(p.where(F.size("weights") > 0), "path").select("path", F.explode(C.normalised(F.col("weights"))).alias("colour", "share"))
    score = w.join(F.broadcast(cats), "colour").groupBy("path", "category").agg(F.round(F.sum(F.col("share") * F.col("cw")), 9).alias("score"))
    best = score.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    out = p.select("path").join(best, "path", "left").crossJoin(F.broadcast(first))
    return out.select("path", F.when(-F.col("b.s") > 0.15, F.col("b.category")).otherwise(F.col("first")).alias("category"))


THEME_ROWS = [(t, c, w) for t, pal in fixed.THEMES.items() for c, w in pal.items()]


@query(f"""WITH {LONG}, th(theme, colour, tw) AS (VALUES {values(THEME_ROWS)}), tn AS (SELECT theme, sqrt(sum(tw * tw)) AS n FROM th GROUP BY theme),
  wn AS (SELECT path, sqrt(sum(share * share)) AS n FROM w GROUP BY path), dt AS (SELECT w.path, th.theme, sum(w.share * th.tw) AS dot FROM w JOIN th USING (colour) GROUP BY ALL)
  SELECT p.path, tn.theme, round(coalesce(CASE WHEN wn.n > 0 THEN least(1, coalesce(dot, 0) / (wn.n * tn.n)) END, 0), 6) AS score FROM p CROSS JOIN tn LEFT JOIN wn USING (path) LEFT JOIN dt ON dt.path = p.path AND dt.theme = tn.theme""")
def theme_cosine(spark: SparkSession, d: str) -> DataFrame:
    p = profiles(spark, d)
    scores = F.array(*[F.struct(F.lit(t).alias("theme"), F.round(F.coalesce(C.theme_score(F.col("weights"), t), F.lit(0.0)), 6).alias("score")) for t in fixed.THEMES])
    return p.select("path", F.explode(scores).alias("x")).select("path", "x.theme", "x.score")


@query(f"WITH {LONG} SELECT path, colour, round(sqrt(share), 4) AS weight FROM w")
def palette_sqrt(spark: SparkSession, d: str) -> DataFrame:
    return painted(spark, d).select("path", F.explode(C.suggested(F.col("weights"))).alias("colour", "weight"))


@query(f"""WITH {LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY weight DESC, colour) AS rn FROM w)
  SELECT path, max(CASE WHEN rn = 1 THEN colour END) AS dominant, max(CASE WHEN rn = 2 AND share > 0.12 THEN colour END) AS secondary FROM r GROUP BY path""")
def dominant_secondary(spark: SparkSession, d: str) -> DataFrame:
    return painted(spark, d).select("path", C.dominant(F.col("weights")).alias("dominant"), C.secondary(F.col("weights")).alias("secondary"))


S = lambda *c: "coalesce(sum(share) FILTER (colour IN (" + names(c) + ")), 0)"
BUCKETS = f"""list_filter([CASE WHEN {S('Black')} + {S('Purple')} * 0.5 + {S('Blue')} * 0.3 > 0.30 THEN 'dark' END, CASE WHEN {S('Red', 'Orange', 'Yellow')} > 0.35 THEN 'warm' END,
  CASE WHEN {S('Blue', 'Teal-Cyan')} + {S('Green')} * 0.5 > 0.30 THEN 'cool' END, CASE WHEN {S('Pink-Magenta', 'Teal-Cyan')} > 0.25 THEN 'neon' END,
  CASE WHEN {S('White')} > 0.40 AND max(share) < 0.50 THEN 'pastel' END, CASE WHEN {S('Black', 'White', 'Gray')} > 0.85 THEN 'monochrome' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {LONG} SELECT path, array_to_string({BUCKETS}, ',') AS buckets FROM w GROUP BY path")
def palette_buckets(spark: SparkSession, d: str) -> DataFrame:
    return painted(spark, d).select("path", F.array_join(C.buckets(F.col("weights")), ",").alias("buckets"))


RGB_SQL = "x AS (SELECT DISTINCT path, frame, (ph >> 16) & 255 AS r, (ph >> 8) & 255 AS g, ph & 255 AS b FROM frames WHERE ph IS NOT NULL)"
HSV_SQL = """h0 AS (SELECT *, r / 255.0::DOUBLE AS rn, g / 255.0::DOUBLE AS gn, b / 255.0::DOUBLE AS bn FROM x), h1 AS (SELECT *, greatest(rn, gn, bn) AS mx, greatest(rn, gn, bn) - least(rn, gn, bn) AS dl FROM h0),
  hsv AS (SELECT *, CASE WHEN dl = 0 THEN 0 WHEN mx = rn THEN 60 * (CASE WHEN (gn - bn) / dl < 0 THEN (gn - bn) / dl + 6 ELSE (gn - bn) / dl END) WHEN mx = gn THEN 60 * ((bn - rn) / dl + 2) ELSE 60 * ((rn - gn) / dl + 4) END AS h,
    CASE WHEN mx = 0 THEN 0 ELSE dl / mx * 100 END AS s, mx * 100 AS v FROM h1)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """A colour per frame: the low three bytes of its hash."""
    byte = lambda k: F.shiftright("ph", k).bitwiseAND(F.lit(255)).cast("int")
    return table(spark, d, "frames").where("ph is not null").select("path", "frame", byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b")).distinct()


@query(f"WITH {RGB_SQL}, {HSV_SQL} SELECT path, frame, r::INT AS r, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v FROM hsv")
def rgb_hsv(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).withColumn("x", C.hsv(F.col("r"), F.col("g"), F.col("b")))
    return p.select("path", "frame", "r", *[F.round(f"x.{c}", 6).alias(c) for c in "hsv"])


LIN = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"
BEND = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0::DOUBLE / 3) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END"
LAB_SQL = f"""l0 AS (SELECT *, {LIN('r')} AS rl, {LIN('g')} AS gl, {LIN('b')} AS bl FROM x),
  l1 AS (SELECT *, (rl * 0.4124564 + gl * 0.3575761 + bl * 0.1804375) / 0.95047 AS xx, rl * 0.2126729 + gl * 0.7151522 + bl * 0.0721750 AS yy, (rl * 0.0193339 + gl * 0.1191920 + bl * 0.9503041) / 1.08883 AS zz FROM l0),
  l2 AS (SELECT *, {BEND('xx')} AS fx, {BEND('yy')} AS fy, {BEND('zz')} AS fz FROM l1), lab AS (SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM l2)"""


@query(f"WITH {RGB_SQL}, {LAB_SQL} SELECT path, frame, round(l, 5) AS l, round(a, 5) AS a, round(bb, 5) AS b, round(sqrt(pow(l - 50, 2) + a * a + bb * bb), 5) AS delta FROM lab")
def rgb_lab_deltae(spark: SparkSession, d: str) -> DataFrame:
    gray = F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    p = pixels(spark, d).withColumn("x", C.lab(F.col("r"), F.col("g"), F.col("b")))
    return p.select("path", "frame", *[F.round(f"x.{c}", 5).alias(c) for c in "lab"], F.round(C.delta_e(F.col("x"), gray), 5).alias("delta"))


HUE = "CASE " + " ".join(f"WHEN floor(h)::INT % 360 < {end} THEN '{name}'" for end, name in fixed.HUES) + " END"
LIGHT, DARK = "(v > 85 AND s < 20)", "(v < 18 OR (v < 25 AND s < 25))"


@query(f"""WITH {RGB_SQL}, {HSV_SQL}, n AS (SELECT path, frame, CASE WHEN {LIGHT} THEN 'White' WHEN {DARK} THEN 'Black' WHEN s < 12 THEN 'Gray' ELSE {HUE} END AS colour,
  (((h >= 280 AND h < 340) OR (h >= 170 AND h < 200)) AND s > 50 AND v > 40 AND v < 90) AS vaporwave, (s > 75 AND v > 50 AND v < 95) AS neon, (s >= 20 AND s <= 45 AND v > 55 AND v < 95 AND NOT {LIGHT}) AS pastel,
  (NOT {LIGHT} AND NOT {DARK} AND s >= 12 AND CASE WHEN h >= 65 AND h < 150 AND v > 30 AND v < 80 THEN s > 15 AND s < 60 ELSE h < 200 END) AS nature FROM hsv)
  SELECT path, frame, colour, vaporwave, neon, pastel, nature FROM n""")
def colour_name(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d).withColumn("x", C.hsv(F.col("r"), F.col("g"), F.col("b")))
    h, s, v = (F.col(f"x.{c}") for c in "hsv")
    p = p.withColumn("f", C.colour_styles(h, s, v))
    return p.select("path", "frame", C.colour_name(h, s, v).alias("colour"), "f.vaporwave", "f.neon", "f.pastel", "f.nature")


@query(f"""WITH {RGB_SQL}, {HSV_SQL}, n AS (SELECT path, CASE WHEN {LIGHT} THEN 'White' WHEN {DARK} THEN 'Black' WHEN s < 12 THEN 'Gray' ELSE {HUE} END AS colour, s, v FROM hsv),
  k AS (SELECT path, count(*) AS n, round(avg((s > 55 AND v > 40)::INT) * 1.5, 6) AS a, round(avg((v < 30)::INT), 6) AS dark, count(DISTINCT colour) AS colours FROM n GROUP BY path)
  SELECT path, n, least(a, 1.0::DOUBLE) AS anime, dark, colours FROM k""")
def pixel_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Shares of bright and dark colours per path and its number of colour names."""
    p = pixels(spark, d).withColumn("x", C.hsv(F.col("r"), F.col("g"), F.col("b")))
    h, s, v = (F.col(f"x.{c}") for c in "hsv")
    p = p.select("path", C.colour_name(h, s, v).alias("colour"), ((s > 55) & (v > 40)).cast("int").alias("bright"), (v < 30).cast("int").alias("dark"))
    return p.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.round(F.avg("bright") * 1.5, 6), F.lit(1.0)).alias("anime"), F.round(F.avg("dark"), 6).alias("dark"), F.count_distinct("colour").alias("colours")
    )


@query(f"""WITH {LONG}, k AS (SELECT DISTINCT path, category FROM classified WHERE category IS NOT NULL),
  s AS (SELECT category, colour, sum(weight) AS m FROM w JOIN k USING (path) WHERE colour IN ({names(fixed.COLOURS)}) GROUP BY ALL)
  SELECT category, colour, round(m / sum(m) OVER (PARTITION BY category), 6) AS share FROM s""")
def palette_avg(spark: SparkSession, d: str) -> DataFrame:
    """The mean palette of each category's files."""
    k = table(spark, d, "classified").where("category is not null").select("path", "category").distinct()
    w = painted(spark, d).select("path", F.explode("weights").alias("colour", "weight")).where(F.col("colour").isin(*fixed.COLOURS))
    s = w.join(k, "path").groupBy("category", "colour").agg(F.sum("weight").alias("m"))
    total = s.groupBy("category").agg(F.sum("m").alias("t"))
    return s.join(total, "category").select("category", "colour", F.round(F.col("m") / F.col("t"), 6).alias("share"))


@query(f"""WITH {LONG}, k AS (SELECT DISTINCT path, category FROM classified), e AS (SELECT category, map_keys(palette) AS want FROM categories),
  j AS (SELECT k.path, k.category, e.want FROM k JOIN e USING (category)), h AS (SELECT j.path, j.category, count(*) AS hit FROM j JOIN w ON w.path = j.path AND list_contains(j.want, w.colour) AND w.share >= 0.05 GROUP BY ALL)
  SELECT j.path, j.category, CASE WHEN len(want) = 0 THEN 0.5 WHEN j.path NOT IN (SELECT path FROM w) THEN 0 ELSE round(coalesce(hit, 0) / len(want), 6) END::DOUBLE AS score FROM j JOIN p USING (path) LEFT JOIN h ON h.path = j.path AND h.category = j.category""")
def palette_match(spark: SparkSession, d: str) -> DataFrame:
    """The part of the category's colours that a classified file shows."""
    k = table(spark, d, "classified").select("path", "category").distinct()
    e = table(spark, d, "categories").select("category", F.map_keys("palette").alias("want"))
    out = k.join(F.broadcast(e), "category").join(profiles(spark, d).select("path", "weights"), "path")
    return out.select("path", "category", F.round(C.palette_match(F.col("weights"), F.col("want")), 6).alias("score"))
