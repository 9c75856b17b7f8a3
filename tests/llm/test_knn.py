"""Problem 5: most similar vectors."""

import numpy as np
import pytest

from tesserae.llm.knn import Tree, _projection, _search, chi_square_quantile, nearest

ROW = "path string, frame int, vec array<int>, cos string"


def brute(rows, k):
    rows = sorted(set(rows))
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-s[i, j], rows[j][0], rows[j][1]))
        out |= {(rows[i][0], rows[i][1], rows[j][0], rows[j][1]) for j in order[:k]}
    return out


def run(spark, rows, k, **kw):
    df = spark.createDataFrame([(*r[:2], list(r[2]), "clash") for r in rows], ROW)
    return {(r["path"], r["frame"], r["near_path"], r["near_frame"]) for r in nearest(df, k, **kw).collect()}


@pytest.mark.parametrize("leaf_rows", [60, 3000])
def test_recall_against_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(0)
    centres = rng.integers(1, 900, (25, 16))
    rows = [(f"p{k:04}", int(rng.integers(0, 3)), tuple(int(v) for v in np.maximum(0, centres[rng.integers(0, 25)] + rng.integers(-25, 26, 16)) + 1)) for k in range(900)]
    got, want = run(spark, rows, 3, leaf_rows=leaf_rows), brute(rows, 3)
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99


def as_table(spark, x, kind):
    return spark.createDataFrame([(f"{i:05}", 0, [v.item() for v in row], "clash") for i, row in enumerate(x)], f"path string, frame int, vec array<{kind}>, cid string")


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("clustered", [False, True])
def test_recall_on_real_numbers(spark, kind, clustered):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    if clustered:
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 600)] + 0.05 * x
    x = x.astype(np.float32 if kind == "float" else np.float64)
    got = {(r["path"], r["near_path"]) for r in nearest(as_table(spark, x, kind), 3, leaf_rows=50, visitor_rows=40).collect()}
    want = {(a, b) for a, _, b, _ in brute([(f"{i:05}", 0, tuple(row)) for i, row in enumerate(x.astype(float))], 3)}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99


def test_a_leaf_with_more_than_its_share_is_cut(spark):
    # all but a few vectors lie so close together that the sample's cuts cannot part them evenly
    rng = np.random.default_rng(6)
    x = np.concatenate([1 + 1e-3 * rng.normal(size=(500, 16)), rng.normal(size=(40, 16))])
    got = {(r["path"], r["near_path"]) for r in nearest(as_table(spark, x, "double"), 3, leaf_rows=20, visitor_rows=30).collect()}
    want = {(a, b) for a, _, b, _ in brute([(f"{i:05}", 0, tuple(row)) for i, row in enumerate(x)], 3)}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.99


def test_vectors_that_take_no_part_and_rows_that_are_not_asked_for(spark):
    rows = [("a", 0, [1.0, 2.0], True), ("b", 0, [2.0, 1.0], False), ("c", 0, [0.0, 0.0], True), ("d", 0, None, True), ("e", 0, [1.0], True), ("f", 0, [float("nan"), 1.0], True), ("g", 0, [None, 1.0], True), ("h", 0, [1.0, 2.1], None)]
    df = spark.createDataFrame(rows, "path string, frame int, vec array<double>, asked boolean")
    assert {(r["path"], r["near_path"]) for r in nearest(df, 2).collect()} == {("a", "h"), ("a", "b")}


def test_embeddings_against_brute_force(spark, data):
    from tesserae.llm.queries import p5_embeddings

    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r["embedding"]}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for n, i in enumerate(ids):
        if i % 100 == 0:
            cos = x @ x[n]
            cos[n] = -2
            want |= {(i, ids[j]) for j in np.argsort(-cos)[:3]}
    got = {(r["vec_id"], r["near_id"]) for r in p5_embeddings(spark, data).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_a_leaf_gives_each_visitor_its_k_best_only():
    # a loose bound lets all vectors of the leaf in; no more than k may be sent on, and the bound shrinks to the k-th
    rng = np.random.default_rng(9)
    x = rng.integers(1, 900, (60, 16))[rng.integers(0, 60, 1500)] + rng.integers(0, 60, (1500, 16)).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, cos, bound = _search(x[:500], x[500:], _projection(16), 16, np.full(500, -1.0), 3, cell_rows=50)
    s = x[:500] @ x[500:].T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, int(b)) for a in range(500) for b in np.argsort(-s[a])[:3]}
    assert np.allclose(cos, s[i, j], atol=1e-12) and np.allclose(bound, np.sort(s, axis=1)[:, -3], atol=1e-8)


@pytest.mark.parametrize("size", [1, 5, 16, 64])
def test_the_projection_stretches_nothing_beyond_the_size(size):
    p = _projection(size)
    assert p.shape == (size, min(size, 8)) and np.linalg.norm(p, 2) <= np.sqrt(size) * (1 + 1e-12)


def test_copies_and_ties(spark):
    a, b, c = (1,) * 16, (2,) * 16, (1,) * 15 + (9,)
    rows = [(f"c{k:02}", 0, a) for k in range(30)] + [("a", 0, b), ("z", 1, c), ("z", 0, c), ("z", 0, c)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_small_tables(spark):
    assert run(spark, [], 3) == set()
    assert run(spark, [("a", 0, (1, 2))], 3) == set()
    assert run(spark, [("a", 0, (1, 2)), ("b", 0, (2, 1))], 3) == {("a", 0, "b", 0), ("b", 0, "a", 0)}


def test_tree_visits_every_leaf_within_the_radius():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(500, 8))
    tree = Tree(p, 5)
    leaf = tree.leaf(p)
    seen = dict(tree.within(p[:50], np.full(50, 1.5**2)))
    d = np.linalg.norm(p[:50, None] - p[None], axis=2)
    for i, j in zip(*np.nonzero(d <= 1.5), strict=True):
        assert i in seen[leaf[j]]


def test_chi_square_quantile():
    assert abs(chi_square_quantile(0.999, 8) - 26.124) < 0.01 and abs(chi_square_quantile(0.5, 2) - 1.3863) < 0.001
