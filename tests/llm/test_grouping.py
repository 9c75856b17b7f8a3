"""Problems 1 and 4: groups of linked files, new batches against history."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm.components import connected_components
from tesserae.llm.grouping import linked_groups
from tesserae.llm.history import History, repeated_entries
from tesserae.session import Scratch

FRAME = "path string, frame int, dh bigint, ph bigint, hist array<int>, note string"
FILE = "path string, md5 string, note string"
ENTRY = "entry_id bigint, path string, sig string, md5 string, batch_id int, frames string"
H = [1] * 16
M = "0123456789abcdef0123456789abcdef"


def groups(files, frames):
    return {r["path"]: r["group_id"] for r in linked_groups(files, frames).collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_long_chain_becomes_one_component(spark, n):
    e = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(n)], "src string, dst string")
    got = connected_components(e, Scratch(spark, "cc")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(f"{k:03}", "000") for k in range(n + 1)}


def test_components_of_random_graphs_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 120, (90, 2))] + [(7, k) for k in range(200, 260)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), Scratch(spark, "cc")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string"), Scratch(spark, "cc")).count() == 0


def test_chain_of_digest_and_frames(spark):
    files = spark.createDataFrame([("a", f" {M.upper()} ", "x"), ("b", M, "x"), ("b", M, "x"), ("c", None, "x"), ("d", "n/a", "x"), ("e", "n/a", "x"), (None, M, "x")], FILE)
    frames = spark.createDataFrame([("b", 0, 0, 0, H, ""), ("c", 0, 0xFF, 0x3FF, H, ""), ("c", 0, 0xFF, 0x3FF, H, ""), ("d", 0, 0x1FF, 0, H, ""), ("gone", 0, 0, 0, H, ""), ("e", 0, 0, 0, [0] * 16, "")], FRAME)
    # b and c: exactly 8 and 10 bits; c and d: 1 and 10 bits; b and d: 9 bits, but both hang on c
    assert groups(files, frames) == dict.fromkeys("abcd", "a")


def test_half_of_all_frame_pairs(spark):
    files = spark.createDataFrame([(p, None, "") for p in "abc"], FILE)
    far = 0x5555555555555555
    frames = spark.createDataFrame([("a", 0, 0, 0, H, ""), ("a", 1, far, far, H, ""), ("b", 0, 0, 0, H, ""), ("c", 0, 0, 0, None, ""), ("c", 1, None, 0, H, "")], FRAME)
    assert groups(files, frames) == {"a": "a", "b": "a"}


def test_copies_of_several_frames_do_not_match_themselves(spark):
    # three unlike frames: 3 of 9 pairs match, which is less than half
    files = spark.createDataFrame([(p, None, "") for p in "ab"], FILE)
    three = [0, 0x5555555555555555, -1]
    frames = spark.createDataFrame([(p, k, v, v, H, "") for p in "ab" for k, v in enumerate(three)], FRAME)
    assert groups(files, frames) == {}
    assert groups(files, frames.where("frame < 2")) == {"a": "a", "b": "a"}


def test_many_copies_of_one_frame(spark):
    files = spark.createDataFrame([(f"p{k:03}", None, "") for k in range(300)], FILE)
    frames = spark.createDataFrame([(f"p{k:03}", 0, 9, 9, H, "") for k in range(300)], FRAME)
    got = groups(files, frames)
    assert len(got) == 300 and set(got.values()) == {"p000"}


def test_empty_tables(spark):
    assert groups(spark.createDataFrame([], FILE), spark.createDataFrame([], FRAME)) == {}


def history(spark, entries, frames=()):
    got = repeated_entries(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(list(frames), FRAME)).collect()
    return {(r["batch_id"], r["entry_id"]) for r in got}


def test_history_by_signature_and_digest(spark):
    e = [
        (1, "p", "1-1", None, 0, ""), (2, "p", "1-1", None, 1, ""), (3, "p", "1-2", None, 1, ""), (4, "q", "1-1", None, 1, ""), (5, "r", "", M, 1, ""), (6, "r", "", f"{M.upper()} ", 1, ""),
        (7, "s", None, M, 2, ""), (8, "r", "", "n/a", 2, ""), (9, None, "1-1", None, 2, ""), (10, "z", "1-1", None, None, ""), (2, "p", "1-1", None, 1, ""),
    ]
    assert history(spark, e) == {(1, 2), (2, 7)}


def test_repeats_do_not_bring_further_repeats(spark):
    # b repeats a by frames; c looks like b but not like a, and b was not accepted
    f = [("a", 0, 0, 0, H, ""), ("b", 0, 0xFF, 0, H, ""), ("c", 0, 0xFFFF, 0, H, "")]
    e = [(1, "a", "1", None, 0, ""), (2, "b", "2", None, 1, ""), (3, "c", "3", None, 2, ""), (4, "a", "9", None, 3, "")]
    assert history(spark, e, f) == {(1, 2), (3, 4)}


def test_history_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 12)]
    frames, paths = [], [f"p{k:02}" for k in range(60)]
    for p in paths:
        for k in range(int(rng.integers(1, 8))):
            flip = lambda m: sum(1 << int(b) for b in rng.choice(62, rng.integers(0, m), replace=False))
            # the first pattern is in a third of all frames
            b = base[rng.integers(0, 12) if rng.random() > 0.3 else 0]
            frames.append((p, k, b ^ flip(6), b ^ flip(7), H if rng.random() > 0.1 else [0] * 16, ""))
    entries = [(k, paths[rng.integers(0, 60)], f"{rng.integers(0, 5)}", None, int(rng.integers(0, 4)), "") for k in range(120)]
    by = {p: [f for f in frames if f[0] == p] for p in paths}
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    same = lambda x, y: bits(x[2], y[2]) <= 8 and bits(x[3], y[3]) <= 10 and x[4] == H and y[4] == H
    match = {(p, q) for p, q in itertools.product(paths, paths) if 2 * sum(same(x, y) for x in by[p] for y in by[q]) >= len(by[p]) * len(by[q])}
    accepted, want = [], set()
    for batch in range(4):
        new = []
        for e in (e for e in entries if e[4] == batch):
            if any((e[1], a[1]) in match or (e[1], e[2]) == (a[1], a[2]) for a in accepted):
                want.add((batch, e[0]))
            else:
                new.append(e)
        accepted += new
    assert history(spark, entries, frames) == want
    # the same from an index that is opened anew for each batch and laid out anew as it grows
    index, found = Scratch(spark, "index"), set()
    f = spark.createDataFrame(frames, FRAME)
    for batch in range(4):
        h = History.open(spark, index) if batch else History.create(spark, index, 1, buckets=3)
        e = spark.createDataFrame([e for e in entries if e[4] == batch], ENTRY).drop("frames")
        found |= {(batch, r["entry_id"]) for r in h.check(e, f).collect() if r["repeats"]}
        assert batch == 0 or h.state["version"] > 0
        h.close()
    assert found == want
    links = linked_groups(spark.createDataFrame([(p, None, "") for p in paths], FILE), f).collect()
    edges = spark.createDataFrame([(p, q) for p, q in match if p != q], "src string, dst string")
    assert {(r[0], r[1]) for r in links} == {(r[0], r[1]) for r in connected_components(edges, Scratch(spark, "cc")).collect()}


def test_a_batch_does_not_shuffle_the_index(spark):
    probes = spark.createDataFrame([((1, 2), 1, 1, 5, 6)], "cid struct<h: bigint, i: bigint>, nf bigint, u int, v bigint, w bigint")
    index = History.create(spark, Scratch(spark, "index"), 1, buckets=3)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.candidates(probes, 1)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        index.close()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    scans = [k for k, x in enumerate(plan) if "FileScan" in x and "t_" in x]
    assert scans
    for k in scans:
        above, at = [], depth[k]
        for j in range(k, -1, -1):
            if depth[j] < at:
                above, at = [*above, plan[j]], depth[j]
        assert not any("Exchange" in x for x in above[: next(n for n, x in enumerate(above) if "Join" in x)])


def test_frames_of_a_class_count_once(spark):
    # a and b hold equal frames under different numbers; c matches one of four pairs of theirs
    far = [0, 0x5555555555555555, -1]
    f = [("a", 0, far[0], far[0], H, ""), ("a", 1, far[1], far[1], H, ""), ("b", 5, far[0], far[0], H, ""), ("b", 6, far[1], far[1], H, "")]
    f += [("c", 0, far[0], far[0], H, ""), ("c", 1, far[2], far[2], H, "")]
    e = [(1, "a", "1", None, 0, ""), (2, "b", "2", None, 1, ""), (3, "c", "3", None, 2, "")]
    assert history(spark, e, f) == {(1, 2)}


def test_one_pattern_in_very_many_paths(spark):
    # a third of all frames share dh; their ph differ, and each has one near partner
    n = 3_000
    rng = np.random.default_rng(8)
    ph = [int(x) for x in rng.integers(0, 2**62, n)]
    rows = [(f"p{k:05}", 0, 5, ph[k], H, "") for k in range(n)] + [(f"q{k:05}", 0, 5, ph[k] ^ 3, H, "") for k in range(n)]
    files = spark.createDataFrame([(r[0], None, "") for r in rows], FILE)
    got = groups(files, spark.createDataFrame(rows, FRAME))
    assert got == {f"{s}{k:05}": f"p{k:05}" for s in "pq" for k in range(n)}


def test_history_of_nothing(spark):
    assert history(spark, []) == set()
    assert F is not None
