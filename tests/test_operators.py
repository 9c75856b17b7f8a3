"""Operators on literal cases: tiers, majority, closure, plans, kernels, readers, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import detectors, fixed, media, pixels
from tesserae.functions import text as T
from tesserae.operators import duplicates as D
from tesserae.operators import stats
from tesserae.operators.components import closure
from tesserae.operators import hamming
from tesserae.operators.hamming import cross_pairs, near_pairs, near_patterns, plan_for, routed, self_pairs, sides
from tesserae.plans import renames
from tesserae.session import Scratch
from tesserae.sources import readers
from tesserae.streaming import cache as stream

FRAME = "path string, frame int, dh bigint, dh16 int, ph bigint, hist array<int>"
FILE = "path string, parent string, size_bytes bigint, md5 string"


def frames(spark, *rows):
    return spark.createDataFrame([(p, f, dh, 1, ph, h) for p, f, dh, ph, h in rows], FRAME)


FLAT, LEFT, RIGHT = [4] * 16, [0, 0, 0, 9] + [0] * 12, [9] + [0] * 15


@pytest.mark.parametrize(
    ("a", "b", "tier"),
    [
        ((0x1234, 0x5678, FLAT), (0x1234, 0x5678, FLAT), 0),
        ((0, 0, FLAT), (0x3F, (1 << 10) - 1, FLAT), 1),
        ((0, 0, LEFT), (0xFFFF, 0xFFFF, RIGHT), None),
        ((0, 0, FLAT), (0, 0, [0] * 16), None),
    ],
)
def test_tier_of_two_frames(spark, a, b, tier):
    df = frames(spark, ("a", 0, *a), ("b", 0, *b))
    got = [r["tier"] for r in D.matched_paths(df, Scratch(spark, "t")).collect()]
    assert got == ([] if tier is None else [tier])


def test_half_of_the_frame_pairs_is_enough(spark):
    df = frames(spark, ("a", 0, 5, 5, FLAT), ("a", 1, 5, 5, [0] * 16), ("b", 0, 5, 5, FLAT))
    assert [(r["a"], r["b"], r["tier"]) for r in D.matched_paths(df, Scratch(spark, "t")).collect()] == [("a", "b", 0)]


def test_loose_groups_contain_strict_ones(spark, data):
    f, fr = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("files", "frames"))
    group = lambda tier: {r["path"] for r in D.perceptual_groups(f, fr, Scratch(spark, "g"), tier).collect()}
    assert group("reencode") <= group("similar")


def test_empty_tables_give_no_rows(spark):
    f, fr = spark.createDataFrame([], FILE), spark.createDataFrame([], FRAME)
    assert D.exact_groups(f).count() == 0
    assert D.perceptual_groups(f, fr, Scratch(spark, "e")).count() == 0


def test_exact_groups_ignore_spelling_nulls_and_repeats(spark):
    m = "0123456789abcdef0123456789abcdef"
    f = spark.createDataFrame([("a", "x", 5, m), ("a", "x", 5, m), ("b", "y", 9, f" {m.upper()} "), ("c", "y", None, None), ("d", "y", 1, "n/a")], FILE).withColumn("keep", F.lit("clash"))
    rows = D.exact_groups(f).collect()
    assert [(r["n"], r["keep"], r["wasted"], r["size_match"]) for r in rows] == [(2, "b", 5, False)]


def test_closure_of_chain_star_and_loop(spark):
    e = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "z"), (None, "q")], "a string, b string")
    got = {r["node"]: r["component"] for r in closure(e, Scratch(spark, "c")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


@pytest.mark.parametrize(("n", "bits"), [(500, 8), (500, 2), (300, 14), (40_000_000, 8)])
def test_hamming_join_is_exact(spark, n, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    noise = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, bits + 4), replace=False)) for x in base for _ in range(4)]
    v = np.unique(np.array([*base, *noise], dtype=np.int64))
    u = v.view(np.uint64)
    d = np.bitwise_count(u[:, None] ^ u[None, :])
    want = {(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(d <= bits), strict=True) if v[i] < v[j]}
    plan = plan_for(n, bits)
    if n > 30_000_000:  # the plan for large inputs, in numpy only
        assert len(plan.blocks) == 2
        return
    got = {(r["lo"], r["hi"]) for r in near_patterns(spark.createDataFrame([(int(x),) for x in v], "v bigint"), plan).collect()}
    assert got == want
    assert self_pairs(u[:0], 0, plan)[0].size == 0


@pytest.mark.parametrize("n", [10**k for k in range(3, 12)])
def test_groups_of_even_patterns_stay_small(n):
    for bits in (2, 8, 14):
        plan = plan_for(n, bits)
        if bits == 14 and n > 10**8:
            continue  # blocks of 21 bits cannot be routed further; chunks bound the groups there
        assert n * hamming.ball(plan.route, plan.radius) / (1 << plan.route) <= hamming.GROUP_ROWS
        assert all(2 * plan.radius >= bits // len(plan.blocks) and size <= 32 for _, size in plan.blocks)


def near_by_force(v, w, bits, w_bits):
    a, b = np.triu_indices(len(v), 1)
    ok = (np.bitwise_count(v[a] ^ v[b]) <= bits) & (np.bitwise_count(w[a] ^ w[b]) <= w_bits)
    return {frozenset(((int(v[i]), int(w[i])), (int(v[j]), int(w[j])))) for i, j in zip(a[ok], b[ok], strict=True)}


@pytest.mark.parametrize("kind", ["one v", "equal leading bits", "spread"])
def test_hot_groups_are_split_and_stay_exact(spark, kind):
    rng = np.random.default_rng(11)
    v = rng.integers(-(2**63), 2**63 - 1, 1_500).view(np.uint64)
    v = np.concatenate([v, v ^ np.uint64(0b10010001)])
    v = {"one v": v & np.uint64(0), "equal leading bits": v >> np.uint64(30), "spread": v}[kind]
    w = rng.integers(-(2**63), 2**63 - 1, len(v)).view(np.uint64)
    w[1_500:] = w[:1_500] ^ np.uint64(0xFF)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(v.view(np.int64), w.view(np.int64), strict=True)], "v bigint, w bigint").distinct()
    got = near_pairs(df, plan_for(len(v)), 10, most=800).collect()
    found = {frozenset(((r["v1"] % 2**64, r["w1"] % 2**64), (r["v2"] % 2**64, r["w2"] % 2**64))) for r in got}
    assert len(found) == len(got) and found == near_by_force(v, w, 8, 10)


def test_many_patterns_of_one_value_are_not_compared_pair_by_pair():
    rng = np.random.default_rng(4)
    w = np.unique(rng.integers(0, 2**63 - 1, 100_000)).view(np.uint64)
    zero = np.zeros(len(w), np.uint64)
    a, _ = hamming.within([(zero, 8), (w, 10)])
    b, _ = hamming.within([(w >> np.uint64(22), 8)])
    assert len(a) < 1_000 and len(b) < 1_000_000


def test_probing_an_index_finds_what_a_self_join_finds(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(2**63), 2**63 - 1, 200)
    b = np.array([int(x) ^ sum(1 << int(k) for k in rng.choice(63, 8, replace=False)) for x in a])
    plan = plan_for(400)
    p, q = sides(plan)
    df = spark.createDataFrame([(int(x),) for x in a], "v bigint").select("v", F.explode(routed(F.col("v"), plan, p)).alias("g"))
    ix = spark.createDataFrame([(int(x),) for x in b], "v bigint").select("v", F.explode(routed(F.col("v"), plan, q)).alias("g"))
    left, right = df.toPandas(), ix.toPandas()
    found = set()
    for g, l in left.groupby("g"):
        r = right[right.g == g]
        i, j = cross_pairs(l.v.to_numpy().view(np.uint64), r.v.to_numpy().view(np.uint64), int(g), plan)
        found |= set(zip(l.v.to_numpy()[i], r.v.to_numpy()[j], strict=True))
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} <= {(int(x), int(y)) for x, y in found}


def test_formats(spark):
    df = spark.createDataFrame([(bytes.fromhex("89504E470D0A1A0A"),), (b"RIFFxxxxWEBPVP8 ",), (b"",), (b"zzzz",), (None,)], "c binary")
    assert [r[0] for r in df.select(media.detect_format(F.col("c"))).collect()] == ["PNG", "WEBP", None, None, None]


def test_names(spark):
    df = spark.createDataFrame([("Čau světe!! (1)",), ("__a--b__",), ("",), (None,)], "s string")
    rows = df.select(T.sanitize(F.col("s")), T.slugify(F.col("s")), T.sanitize_tag(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("Cau_svete_1", "cau-svete-1", "cau-svete-1"), ("a--b", "a--b", "a--b"), ("", "", ""), (None, None, "")]


def test_title_case_and_archives(spark):
    df = spark.createDataFrame([("foo bar-baz x2y.tar",)], "s string")
    r = df.select(T.title_case(F.col("s")).alias("t"), T.split_extension(F.lit("a.b.tar")).alias("x")).first()
    assert r["t"] == "Foo Bar-Baz X2Y.Tar" and (r["x"]["base"], r["x"]["ext"]) == ("a", ".b.tar")


@pytest.mark.parametrize("strategy", [*renames.PLAIN, *renames.TAGGED])
def test_rename_targets_are_unique_per_plan(spark, strategy):
    rows = [(f"/d/{n}", "d", None, t) for n, t in [("a b.jpg", ["X y", None]), ("A_b.jpg", []), ("007.png", None), (".png", ["sky"]), ("a-b.jpg", ["X y"])]]
    plan = renames.rename_plan(spark.createDataFrame(rows, "path string, parent string, md5 string, tags array<string>"), strategy, Scratch(spark, "r")).collect()
    # a file that keeps its name keeps it even if another one wants it; `apply_plan` numbers the other
    moved = [r["new_path"] for r in plan if r["new_path"] != r["path"]]
    assert len(plan) == len(rows) and len(set(moved)) == len(moved)
    with pytest.raises(ValueError):
        renames.rename_plan(spark.createDataFrame(rows, "path string, parent string, md5 string, tags array<string>"), "nonsense", Scratch(spark, "r"))


def test_plan_is_applied_in_two_phases(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("1"), b.write_text("2")
    plan = spark.createDataFrame([(str(a), str(b)), (str(b), str(a)), ("/nowhere", "/x")], "path string, new_path string")
    assert renames.apply_plan(plan, 10) == {"renamed": 2, "skipped": 1, "errors": 0}
    assert a.read_text() == "2" and b.read_text() == "1"
    with pytest.raises(ValueError):
        renames.apply_plan(plan, 1)


def test_readers(spark, tmp_path):
    d = tmp_path / "lib" / "Night Sky"
    d.mkdir(parents=True)
    (d / "a+b c.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"0" * 9)
    (d / ".hidden.png").write_bytes(b"1")
    (d / "notes.md").write_bytes(b"1")
    readers.write_category(str(tmp_path / "lib"), "Night Sky", {"tags": ["Star"], "prompt": "p", "palette_weights": {"Blue": 1}})
    got = readers.scan(spark, str(tmp_path / "lib")).collect()
    assert [(r["name"], r["parent"], r["ext"], r["size_bytes"]) for r in got] == [("a+b c.png", "Night Sky", ".png", 17)]
    assert {r["format"] for r in readers.contents(spark, str(d)).collect()} >= {"PNG"}
    assert [(r["category"], r["tags"]) for r in readers.categories(spark, str(tmp_path / "lib")).collect()] == [("Night_Sky", ["star"])]
    assert readers.tag_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cache.json").write_text(json.dumps({"/p": {"sig": "1-2", "md5": "x", "size": [3, 4]}}))
    assert [tuple(r) for r in readers.read_json_cache(spark, str(tmp_path / "cache.json")).collect()] == [("/p", "1-2", "x", None, [3, 4])]
    assert readers.settings({"a": 1, "b": True}, None) == {"a": 1, "b": True}


def test_pixel_kernels(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    rows = [("noise", 50, 40, 3, a.tobytes()), ("gray", 8, 8, 1, bytes(range(64))), ("broken", 9, 9, 3, b"")]
    images = spark.createDataFrame(rows, "path string, width int, height int, channels int, data binary")
    h = {r["path"]: r for r in pixels.image_hashes(images).collect()}
    assert sum(h["noise"]["hist"]) == 64 * 64 and h["broken"]["dh"] is None
    f = {r["path"]: r for r in pixels.image_features(images).collect()}
    assert f["noise"]["entropy"] > 5 and f["broken"]["sharpness"] is None and 0 <= f["gray"]["overall_symmetry"] <= 1
    p = pixels.image_palettes(images).groupBy("path").agg(F.round(F.sum("share"), 6).alias("s")).collect()
    assert {r["path"]: r["s"] for r in p} == {"noise": 1.0, "gray": 1.0}
    m = pixels.dct(8)
    assert np.allclose(m @ m.T, np.eye(8))


def test_image_hash_does_not_depend_on_size():
    x = np.kron(np.arange(64).reshape(8, 8, 1) * np.ones(3) * 4.0, np.ones((16, 16, 1)))
    assert pixels.hashes(x)["dh"] == pixels.hashes(np.kron(x, np.ones((2, 2, 1))))["dh"]


def test_stream_keeps_the_newest_entry(spark, tmp_path, data):
    cache = spark.read.parquet(f"{data}/hash_cache.parquet")
    for k in range(2):
        cache.where(F.pmod(F.col("batch_id"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.upsert(stream.entry_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    got = spark.read.parquet(str(tmp_path / "out" / last))
    want = D.latest_entries(cache).select("path", "entry_id")
    assert got.select("path", "entry_id").exceptAll(want).isEmpty() and got.count() == want.count()


def test_shrunk_deviation(spark):
    r = spark.range(1).select(stats.shrunk(F.lit(0.2), F.lit(0.4), F.lit(5)).alias("a"), stats.shrunk(F.lit(0.0), F.lit(0.01), F.lit(5)).alias("b")).first()
    assert abs(r["a"] - (0.5 * 0.04 + 0.5 * 0.16) ** 0.5) < 1e-12 and r["b"] == 0.05


def test_signal_weights_are_complete():
    assert abs(sum(fixed.SIGNAL_WEIGHTS.values()) - 1.13) < 1e-9


def targets(plan):
    return {r[0]: r[1] for r in plan.collect()}


def test_move_plan_has_no_collisions(spark):
    moves = spark.createDataFrame([(f"/i/{k}/{n}", "c", n) for k, n in enumerate(["a.jpg", "a.jpg", "a_1.jpg", "a.jpg", "b", "b"])], "path string, category string, name string")
    there = spark.createDataFrame([("/r/c/a_2.jpg",), ("/r/c/b_1",), (None,)], "path string")
    got = targets(renames.move_plan(moves, there, "/r", Scratch(spark, "m")))
    assert got == {"/i/0/a.jpg": "/r/c/a.jpg", "/i/1/a.jpg": "/r/c/a_3.jpg", "/i/2/a_1.jpg": "/r/c/a_1.jpg", "/i/3/a.jpg": "/r/c/a_4.jpg", "/i/4/b": "/r/c/b", "/i/5/b": "/r/c/b_2"}
    there = spark.createDataFrame([("/r/c/a.jpg",), ("/r/c/a_1.jpg",)], "path string")
    assert set(targets(renames.move_plan(moves, there, "/r", Scratch(spark, "m"))).values()) == {"/r/c/a_2.jpg", "/r/c/a_3.jpg", "/r/c/a_1_1.jpg", "/r/c/a_4.jpg", "/r/c/b", "/r/c/b_1"}


def test_plans_of_random_names_are_free_of_collisions(spark):
    rng = np.random.default_rng(9)
    names = [f"{rng.choice(['a', 'A', 'a_1', 'a_2', 'x_a', 'a_10', '.a', 'b.tar'])}{rng.choice(['', '.jpg', '.gz'])}" for _ in range(300)]
    rows = sorted({(f"/d{k % 9}/{n}", n, f"d{k % 9}", None) for k, n in enumerate(names)})
    f = spark.createDataFrame(rows, "path string, name string, parent string, md5 string")
    there = spark.createDataFrame([(f"/flat/{n}",) for n in set(names[::3])], "path string")
    flat = targets(renames.flatten_plan(f, there, "/flat", Scratch(spark, "f")))
    assert len(flat) == len(rows) == len(set(flat.values())) and not set(flat.values()) & {f"/flat/{n}" for n in names[::3]}
    paths = {r[0] for r in rows}
    for strategy in ("lowercase", "truncate", "reverse", "sequential", "ai_classification"):
        new = targets(renames.rename_plan(f, strategy, Scratch(spark, "r")))
        assert len(new) == len(set(new.values())) and all(t == p or t not in paths for p, t in new.items())


def test_gates_in_their_order(spark):
    rows = [(200 << 20, True, 500.0, 0.9, 0.0, 0.0), (1, True, 79.9, 0.9, 0.9, 0.0), (1, True, 80.0, 0.1, 0.5, 0.0), (1, True, 90.0, 0.1, 0.49, 0.69), (1, True, 90.0, 0.1, 0.0, 0.70), (1, None, None, None, None, 0.9), (None, True, 90.0, 0.1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "size bigint, seen boolean, sharp double, nice double, bare double, reply double")
    cols = [F.col(c) for c in df.columns]
    assert [r[0] for r in df.select(detectors.gate(*cols)).collect()] == ["Discarded", "Low-Quality", "NSFW", None, "NSFW", None, None]
    assert [r[0] for r in df.select(detectors.gate(*cols, 0.2, False)).collect()] == ["Discarded", "Low-Quality", "Low-Quality", "Low-Quality", "Low-Quality", None, "Low-Quality"]
