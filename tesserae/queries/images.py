"""Queries on pixels.

The tables hold no images, so these run on pictures that a fixed rule draws; SQL
draws the same pictures and computes the features from single pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import kernels as K
from tesserae.functions import pixels as P
from tesserae.operators import analysis as A
from tesserae.queries.registry import query
from tesserae.session import Scratch, table

N, W, H = 40, 48, 32
PX = f"""px AS (SELECT 'picture-' || lpad(i::VARCHAR, 3, '0') AS path, x, y, (x * 5 + y * 3 * (i % 7) + 17 * i) % 256 AS r, (x * x + y * 7 + i * 29) % 256 AS g, ((x // 8 + y // 8 + i) % 2) * 200 + i % 50 AS b
  FROM range({N}) a(i), range({W}) b(x), range({H}) c(y)), gy AS (SELECT *, ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)::DOUBLE AS l FROM px)"""
#: Every pixel with its mirrored neighbours.
NEAR = f"""nb AS (SELECT p.path, p.x, p.y, dx, dy, q.l FROM gy p, range(-1, 2) a(dx), range(-1, 2) b(dy), gy q WHERE q.path = p.path
  AND q.x = CASE WHEN p.x + dx < 0 THEN 1 WHEN p.x + dx >= {W} THEN {W} - 2 ELSE p.x + dx END AND q.y = CASE WHEN p.y + dy < 0 THEN 1 WHEN p.y + dy >= {H} THEN {H} - 2 ELSE p.y + dy END)"""


def pictures(spark: SparkSession) -> DataFrame:
    return A.drawn_pictures(spark, N, W, H)


def picked(spark: SparkSession, families: tuple, names: tuple[str, ...]) -> DataFrame:
    f = P.image_features(pictures(spark), families)
    return f.select("path", *[F.round(n, 5).alias(n) for n in names])


MOMENTS = ", ".join(
    f"round(avg({c} / 255), 5) AS cm_mean_{c.upper()}, round(stddev_pop({c} / 255), 5) AS cm_std_{c.upper()}, round((avg(pow({c} / 255, 3)) - 3 * avg({c} / 255) * var_pop({c} / 255) - pow(avg({c} / 255), 3)) / pow(stddev_pop({c} / 255), 3), 5) AS cm_skew_{c.upper()}"
    for c in "rgb"
)


@query(f"WITH {PX} SELECT path, {MOMENTS} FROM px GROUP BY path")
def image_colour_moments(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.colours,), tuple(f"cm_{m}_{c}" for c in "RGB" for m in ("mean", "std", "skew")))


@query(f"""WITH {PX}, o AS (SELECT path, (r - g) / 255 AS rg, ((r + g) / 2 - b) / 255 AS yb, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s, 100 * (greatest(r, g, b) - least(r, g, b)) < 30 * greatest(r, g, b, 1) AS low, 100 * (greatest(r, g, b) - least(r, g, b)) > 70 * greatest(r, g, b) AS high FROM px)
  SELECT path, round(sqrt(pow(avg(rg), 2) + pow(avg(yb), 2)) + sqrt(var_pop(rg) + var_pop(yb)), 5) AS colorfulness, round(avg(low::INT), 5) AS sat_low_fraction, round(avg(high::INT), 5) AS sat_high_fraction,
    round(var_pop(s), 5) AS sat_variance, (avg(low::INT) > 0.2 AND avg(high::INT) > 0.2)::INT::DOUBLE AS sat_bimodal, round(avg(s * 100), 5) AS "hsv_S_mean" FROM o GROUP BY path""")
def image_colourfulness(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.colours,), ("colorfulness", "sat_low_fraction", "sat_high_fraction", "sat_variance", "sat_bimodal", "hsv_S_mean"))


@query(f"""WITH {PX}, {NEAR}, sb AS (SELECT path, x, y, sum(l * dx * (2 - abs(dy))) AS gx, sum(l * dy * (2 - abs(dx))) AS gy, sum(l * dx * CASE WHEN dy = 0 THEN 10 ELSE 3 END) AS hx, sum(l * dy * CASE WHEN dx = 0 THEN 10 ELSE 3 END) AS hy FROM nb GROUP BY ALL)
  SELECT path, round(avg(gx * gx + gy * gy), 5) AS tenengrad, round(avg((sqrt(gx * gx + gy * gy) > 50)::INT), 5) AS sobel_density, round(avg((sqrt(hx * hx + hy * hy) > 50)::INT), 5) AS scharr_density FROM sb GROUP BY path""")
def image_focus(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.edges, K.naturalness), ("tenengrad", "sobel_density", "scharr_density"))


@query(f"""WITH {PX}, {NEAR}, f AS (SELECT path, x, y, abs(sum(l * CASE WHEN dx = 0 AND dy = 0 THEN 4 WHEN dx = 0 OR dy = 0 THEN -2 ELSE 1 END)) AS n FROM nb GROUP BY ALL) SELECT path, round(median(n) / 0.6745::DOUBLE, 5) AS noise_estimate FROM f GROUP BY path""")
def image_noise(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.naturalness,), ("noise_estimate",))


def _rolled(dx: int, dy: int) -> str:
    return f"(SELECT p.path, p.l - q.l AS d FROM gy p JOIN gy q ON p.path = q.path AND q.x = (p.x - {dx} + {W}) % {W} AND q.y = (p.y - {dy} + {H}) % {H})"


@query(f"""WITH {PX}, c AS (SELECT path, avg(d * d) AS c FROM (SELECT * FROM {_rolled(1, 0)} UNION ALL SELECT * FROM {_rolled(0, 1)} UNION ALL SELECT * FROM {_rolled(1, 1)} UNION ALL SELECT * FROM {_rolled(1, -1)}) GROUP BY path),
  h AS (SELECT path, avg(1 / (1 + abs(d))) AS h FROM (SELECT * FROM {_rolled(1, 0)} UNION ALL SELECT * FROM {_rolled(0, 1)}) GROUP BY path), b AS (SELECT path, least(floor(l / 255 * 64), 63) AS k, count(*) / {W * H}.0::DOUBLE AS p FROM gy GROUP BY ALL), e AS (SELECT path, -sum(p * ln(p)) AS e FROM b GROUP BY path),
  s AS (SELECT path, avg(l * l) AS q, stddev_pop(l) AS sd, avg(l) AS m FROM gy GROUP BY path)
  SELECT path, round(c, 5) AS texture_contrast, round(q, 5) AS texture_energy, round(e, 5) AS texture_entropy, round(h, 5) AS texture_homogeneity, round(sd, 5) AS intensity_std, round(m, 5) AS intensity_mean FROM c JOIN h USING (path) JOIN e USING (path) JOIN s USING (path)""")
def image_texture(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.textures,), ("texture_contrast", "texture_energy", "texture_entropy", "texture_homogeneity", "intensity_std", "intensity_mean"))


def _alike(on: str, where: str) -> str:
    return f"(SELECT p.path, greatest(0, covar_pop(p.l, q.l) / (stddev_pop(p.l) * stddev_pop(q.l) + 1e-6)) AS v FROM gy p JOIN gy q ON p.path = q.path AND {on} WHERE {where} GROUP BY p.path)"


@query(f"""WITH {PX}, h AS {_alike(f"q.x = {W - 1} - p.x AND q.y = p.y", f"p.x < {W // 2}")}, w AS {_alike(f"q.x = p.x AND q.y = {H - 1} - p.y", f"p.y < {H // 2}")}, t AS {_alike(f"q.x = {W - 1} - p.x AND q.y = {H - 1} - p.y", "true")}
  SELECT path, round(h.v, 5) AS h_symmetry, round(w.v, 5) AS v_symmetry, round(t.v, 5) AS point_symmetry, round(greatest(h.v, w.v, t.v), 5) AS overall_symmetry, (greatest(h.v, w.v, t.v) > 0.7)::INT::DOUBLE AS is_symmetric FROM h JOIN w USING (path) JOIN t USING (path)""")
def image_symmetry(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.mirrors,), ("h_symmetry", "v_symmetry", "point_symmetry", "overall_symmetry", "is_symmetric"))


@query(f"""WITH {PX}, b AS (SELECT path, l, count(*) / {W * H}.0::DOUBLE AS p FROM gy GROUP BY ALL), e AS (SELECT path, -sum(p * log2(p)) AS entropy FROM b GROUP BY path),
  k AS (SELECT path, 'R' AS c, r // 16 AS k FROM px UNION ALL SELECT path, 'G', g // 16 FROM px UNION ALL SELECT path, 'B', b // 16 FROM px), n AS (SELECT path, c, k, count(*) / {W * H}.0::DOUBLE AS p FROM k GROUP BY ALL), s AS (SELECT path, c, -sum(p * log2(p)) AS e, max(p) AS m FROM n GROUP BY ALL)
  SELECT path, round(any_value(entropy), 5) AS entropy, round(avg(s.e), 5) AS hist_overall_entropy, round(avg(m), 5) AS hist_concentration FROM s JOIN e USING (path) GROUP BY path""")
def image_entropy(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.repetition, K.colours), ("entropy", "hist_overall_entropy", "hist_concentration"))


@query(f"""WITH {PX}, m AS (SELECT path, avg(l) AS m, stddev_pop(l) AS s FROM gy GROUP BY path), z AS (SELECT path, avg(x) AS cx, avg(y) AS cy FROM gy JOIN m USING (path) WHERE l > m + s GROUP BY path)
  SELECT path, round(abs(cx / {W} - 0.5) * 2, 5) AS x_offset, round(abs(cy / {H} - 0.5) * 2, 5) AS y_offset, round(1 - sqrt(pow(abs(cx / {W} - 0.5) * 2, 2) + pow(abs(cy / {H} - 0.5) * 2, 2)) / sqrt(2), 5) AS centeredness, round({W} / {H}.0::DOUBLE, 5) AS aspect_ratio, 1.0::DOUBLE AS is_landscape FROM z""")
def image_centre(spark: SparkSession, d: str) -> DataFrame:
    return picked(spark, (K.arrangement,), ("x_offset", "y_offset", "centeredness", "aspect_ratio", "is_landscape"))


@query(f"SELECT path, CASE WHEN m < 64 THEN 'dark' WHEN m > 192 THEN 'bright' ELSE 'mid' END AS brightness FROM (WITH {PX} SELECT path, avg(l) AS m FROM gy GROUP BY path)")
def image_brightness(spark: SparkSession, d: str) -> DataFrame:
    return A.image_words(pictures(spark)).select("path", "brightness")


def _family(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """All features of one family."""
        return P.image_features(pictures(spark), (f,))

    return run


for _f in K.FAMILIES:
    query(None, f"image_family_{_f.__name__}")(_family(_f))


@query()
def image_names(spark: SparkSession, d: str) -> DataFrame:
    """Zone of the subject, colour harmony, average hash, dominant colours, brightness and number of colours."""
    return A.image_words(pictures(spark))


@query()
def image_hashes(spark: SparkSession, d: str) -> DataFrame:
    return P.image_hashes(pictures(spark))


@query()
def image_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile that the scoring takes, from pixels."""
    return A.profiles(pictures(spark))


@query()
def image_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Images to categories: profile, gates, decision and tags in one call."""
    return A.analysed(pictures(spark), table(spark, d, "categories"), table(spark, d, "category_stats"), Scratch(spark, "analysed"))
