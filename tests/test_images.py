"""Feature kernels against brute force, and images to categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels as K
from tesserae.functions import pixels as P
from tesserae.operators import analysis as A
from tesserae.session import Scratch

RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (37, 53, 3)).astype(float)


def flood(mask):
    seen, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            n += 1
            stack = [(y, x)]
            while stack:
                i, j = stack.pop()
                if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not seen[i, j]:
                    seen[i, j] = n
                    stack += [(i + p, j + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
    return seen, n


@pytest.mark.parametrize("share", [0.2, 0.45, 0.8])
def test_parts_of_a_mask(share):
    mask = np.random.default_rng(1).random((40, 60)) < share
    got, (want, n) = K.labelled(mask), flood(mask)
    assert got.max(initial=0) == n and ((got > 0) == mask).all()
    assert len({(a, b) for a, b in zip(got[mask], want[mask], strict=True)}) == n


def test_threshold_of_greatest_variance_between_sides():
    g = K.grey(NOISE)
    best = max(range(255), key=lambda t: (g <= t).mean() * (g > t).mean() * ((g[g <= t].mean() if (g <= t).any() else 0) - (g[g > t].mean() if (g > t).any() else 0)) ** 2)
    assert (K.otsu(g) == (g > best)).all()


def test_box_means_and_filters():
    g = K.grey(NOISE)
    p = np.pad(g, 7, mode="reflect")
    want = np.array([[p[y : y + 15, x : x + 15].mean() for x in range(53)] for y in range(37)])
    assert np.allclose(K._box(g, 15), want)
    q = np.pad(g, 1, mode="reflect")
    assert np.isclose(K._filtered(g, K.LAPLACE)[5, 6], q[5, 7] + q[7, 7] + q[6, 6] + q[6, 8] - 4 * q[6, 7])


def test_gabor_responses_by_direct_convolution():
    g = K.grey(NOISE)
    y, x = np.mgrid[-10:11, -10:11].astype(float)
    k = np.exp(-(x**2 + 0.25 * y**2) / 32) * np.cos(2 * np.pi * 0.1 * x)
    p = np.pad(g, 10, mode="reflect")
    direct = np.array([[(p[i : i + 21, j : j + 21] * k[::-1, ::-1]).sum() for j in range(53)] for i in range(37)])
    assert np.isclose(K._gabor(g)[0], direct.var())


def test_moments_do_not_depend_on_place_and_turn():
    m = np.zeros((60, 60), bool)
    m[5:20, 8:30] = True
    m[20:26, 8:12] = True
    moved = np.roll(m, (17, 11), axis=(0, 1))
    assert np.allclose(K.hu_moments(m), K.hu_moments(moved)) and np.allclose(K.hu_moments(m)[:4], K.hu_moments(np.rot90(m))[:4], atol=1e-6)
    y, x = np.nonzero(m[5:20, 8:30])
    assert K._hull_area(y, x) == 15 * 22


def test_corners_edges_subject_and_period():
    a = np.zeros((80, 100, 3))
    a[20:50, 30:70] = 255.0
    e, s, c = K.edges(a), K.subject(a), K.contours(a)
    assert 0.01 < e["edge_density"] < 0.06 and c["num_contours"] == 1 and c["avg_solidity"] == 1.0 and np.isclose(c["avg_area"], 1200)
    assert K.ZONES[int(s["subject_zone"])] == "center" and np.isclose(s["subject_area_ratio"], 1200 / 8000) and np.isclose(s["subject_w"], 0.4)
    assert 4 <= K.corners(a)["num_corners"] <= 8 and K.corners(np.full((30, 30, 3), 9.0))["num_keypoints"] == 0
    stripes = np.tile((np.arange(128) % 16 < 8)[None, :, None] * 200.0, (128, 1, 3))
    r = K.repetition(stripes)
    assert r["is_periodic"] == 1 and r["period_x"] == 8 or r["period_x"] == 16


def test_mirrors():
    half = RNG.integers(0, 256, (20, 10, 3)).astype(float)
    whole = np.concatenate([half, half[:, ::-1]], axis=1)
    m = K.mirrors(whole)
    assert m["h_symmetry"] > 0.999 and m["overall_symmetry"] == max(m[k] for k in m if k.endswith("symmetry")) and m["is_symmetric"] == 1
    square = NOISE[:30, :30]
    assert K.mirrors((square + square.transpose(1, 0, 2)) / 2)["main_diagonal_symmetry"] > 0.99


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (2, 3), (5, 5), (16, 400), (64, 64)])
@pytest.mark.parametrize("kind", ["flat", "noise"])
def test_every_family_takes_odd_images(shape, kind):
    a = np.full((*shape, 3), 77.0) if kind == "flat" else RNG.integers(0, 256, (*shape, 3)).astype(float)
    for f in K.FAMILIES:
        assert all(np.isfinite(v) for v in f(a).values()), f.__name__
    assert len(K.words(a)["ahash"]) == 16


def images(spark):
    flat = lambda b, g, r: np.tile(np.array([b, g, r], np.uint8), (40, 60, 1)).tobytes()
    rows = [("red", 60, 40, 3, flat(0, 0, 255)), ("black", 60, 40, 3, flat(0, 0, 0)), ("noise", 53, 37, 3, NOISE[:, :, ::-1].astype(np.uint8).tobytes()), ("broken", 9, 9, 3, b"")]
    return spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")


def test_profiles_from_pixels(spark):
    p = {r["path"]: r for r in A.profiles(images(spark)).collect()}
    assert set(p) == {"red", "black", "noise"} and p["red"]["weights"] == {"Red": 1.0} and p["black"]["weights"] == {"Black": 1.0}
    assert p["black"]["space_score"] == 1.0 and p["red"]["anime_score"] == 1.0 and p["black"]["brightness"] == "dark" and p["noise"]["sharpness"] > 80
    wide = A.lowlevel(images(spark))
    assert len(wide.columns) == len(set(wide.columns)) and wide.count() == 3
    clip = spark.createDataFrame([("red", {"A": 0.5})], "path string, clip_scores map<string,double>")
    assert {r["path"]: r["clip_scores"] for r in A.fusion(images(spark), clip).collect()} == {"red": {"A": 0.5}, "black": {}, "noise": {}}
    with pytest.raises(ValueError):
        A.analyzer("nonsense")


def test_images_to_categories(spark, data):
    cats, stats = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("categories", "category_stats"))
    got = {r["path"]: r for r in A.analysed(images(spark), cats, stats, Scratch(spark, "a")).collect()}
    assert got["red"]["category"] == "Low-Quality" and got["noise"]["gate"] is None and got["noise"]["category"] in {r["category"] for r in cats.collect()}
    assert len(got["noise"]["tags"]) <= 8 and (got["noise"]["subject"] is None or got["noise"]["subject"] == got["noise"]["tags"][0])


def test_cleaning_sees_what_earlier_cleaning_left(spark):
    rows = [("a", ["x", "y", "anime"]), ("b", ["x", "anime", "z"]), ("c", ["q", None, " X "]), ("d", None), ("e", [f"t{k:02}" for k in range(30)])]
    got = {r["category"]: (r["before"], r["kept"], r["removed"]) for r in A.cleaned_categories(spark.createDataFrame(rows, "category string, tags array<string>")).collect()}
    # x is in three of five; once it is taken from a it is in fewer than half
    assert got["a"] == (3, 2, ["x"]) and got["b"] == (3, 3, []) and got["c"] == (2, 2, []) and got["d"] == (0, 0, []) and got["e"][:2] == (30, 25)


def test_words_for_a_name_are_never_missing(spark):
    rows = [(["night sky"], {"Red": 0.7, "Blue": 0.3}, 100, 100, "dark"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "t array<string>, w map<string,double>, x int, y int, b string")
    got = [r[0] for r in df.select(A.fallback_name(F.col("t"), F.col("w"), F.col("x"), F.col("y"), F.col("b"), F.lit("0a1b2c3d"))).collect()]
    assert got[0][:3] == ["night-sky", "red", "blue"] and got[1]


def test_rows_through_a_model_are_tried_again(spark, tmp_path):
    mark = str(tmp_path / "mark")

    def apply(model, batch):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("busy")
        return batch.assign(y=batch["x"] * model)

    df = spark.createDataFrame([(1,), (2,)], "x bigint").coalesce(1)
    assert sorted(r["y"] for r in A.mapped_by_model(df, lambda: 10, apply, "x bigint, y bigint").collect()) == [10, 20]


def test_hash_of_a_picture_is_the_average_hash():
    g = K.grey(NOISE)
    eight = P.resized(g, 8, 8)
    bits = "".join("1" if b else "0" for b in (eight > eight.mean()).ravel())
    assert K.words(NOISE)["ahash"] == f"{int(bits, 2):016x}"
