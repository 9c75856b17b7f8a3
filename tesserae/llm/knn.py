"""Problem 5: the k most similar vectors of every vector.

Vectors are projected to a few dimensions with a 2-stable (Gaussian) projection,
orthonormal by columns, and indexed by a kd-tree over the projected space.  The
tree's splits come from a bounded sample; every vector is indexed.  The search runs
in two rounds instead of one vector at a time:

1. each vector is searched for inside its own leaf; the k-th best gives a bound d on
   the distance of the true neighbours;
2. a neighbour within d has, with probability ``confidence``, a projected
   distance within d * sqrt(chi-square quantile), and always one within
   d * sqrt(size), as columns of that length without correlation stretch nothing
   further.  The smaller is the stopping test of the incremental search: leaves beyond
   it need no visit, all others are visited and their vectors verified with the full
   cosine.  Up to 26 numbers the test is therefore exact.

Within a leaf the search is incremental too: a small tree over its vectors is gone
through cell by cell, nearest first, and the bound shrinks with what is found.

Leaves and their visitors are split where they grow beyond their bounds, so no task
holds more than a bounded number of vectors.

Equal vectors form one class that is searched once and keeps its k + 1 smallest
keys, so copies, however many, cost nothing in the search.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch

DIMENSIONS, CONFIDENCE = 8, 0.999
#: Distinct vectors that a leaf should hold: for small tables, and at most; leaves of more than twice as many are cut into chunks.
LEAF_ROWS = 3_000, 24_000
#: Leaves that a table of middle size should have, so that there is work for all tasks.
LEAVES = 24
#: Vectors of a cell of the small tree inside a leaf.
CELL_ROWS = 400
#: Visitors that are compared with a leaf in one task; more are split.
VISITOR_ROWS = 200_000
#: Size of the sample of projected vectors that places the splits: for small tables, and at most.
SAMPLE_ROWS = 40_000, 400_000
#: Cosines are compared after rounding to this many decimals.
DECIMALS = 9


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile for an even number m of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 200.0 + 10 * m
    for _ in range(100):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


class Tree:
    """A complete kd-tree: node n has the children 2n+1 and 2n+2, leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, depth: int):
        m = sample.shape[1]
        nodes = (1 << (depth + 1)) - 1
        self.depth, self.dim, self.cut = depth, np.zeros(nodes, np.int32), np.zeros(nodes)
        self.lo, self.hi = np.full((nodes, m), -np.inf), np.full((nodes, m), np.inf)
        held = {0: sample}
        for n in range((1 << depth) - 1):
            part = held.pop(n)
            if len(part):
                self.dim[n] = np.argmax(part.max(0) - part.min(0))
                self.cut[n] = np.median(part[:, self.dim[n]])
            left = part[:, self.dim[n]] <= self.cut[n]
            for child, rows in ((2 * n + 1, part[left]), (2 * n + 2, part[~left])):
                held[child] = rows
                self.lo[child], self.hi[child] = self.lo[n], self.hi[n]
            self.hi[2 * n + 1, self.dim[n]] = self.cut[n]
            self.lo[2 * n + 2, self.dim[n]] = self.cut[n]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        n = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            n = 2 * n + 1 + (points[np.arange(len(points)), self.dim[n]] > self.cut[n])
        return n - ((1 << self.depth) - 1)

    def within(self, points: np.ndarray, radius2: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The leaves whose cell comes within the radius, each with the numbers of those points."""
        out, stack, first = [], [(0, np.arange(len(points)))], (1 << self.depth) - 1
        while stack:
            n, at = stack.pop()
            if n >= first:
                out.append((n - first, at))
                continue
            for child in (2 * n + 1, 2 * n + 2):
                p = points[at]
                away = np.maximum(np.maximum(self.lo[child] - p, p - self.hi[child]), 0.0)
                near = at[(away * away).sum(1) <= radius2[at]]
                if len(near):
                    stack.append((child, near))
        return out


#: Numbers of a vector as they are sent between tasks, by Spark type.
PACKED = {"tinyint": "int8", "smallint": "int16", "int": "int32", "float": "float32"}


def _unit(packed: pd.Series, kind: str, size: int) -> np.ndarray:
    """Rows of unit length from packed vectors."""
    x = np.frombuffer(b"".join(packed.tolist()), dtype=kind).reshape(len(packed), size).astype(np.float64)
    # scaled first, so that very small or large numbers keep their square
    x = x / np.abs(x).max(1, keepdims=True, initial=0.0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _projection(size: int) -> np.ndarray:
    """Orthogonal columns of Gaussian directions, of length sqrt(size): distances grow sqrt(DIMENSIONS) times on average, sqrt(size) times at most."""
    return np.linalg.qr(np.random.default_rng(20_240_101).standard_normal((size, min(size, DIMENSIONS))))[0] * math.sqrt(size)


SLACK = 2 * 10.0**-DECIMALS
#: What a cosine of single precision may be off; pairs within it are computed again in double precision.
SINGLE_SLACK = 4e-6
#: Numbers of a block of cosines.
BLOCK = 4_000_000


def _radius2(bound: np.ndarray, reach: float) -> np.ndarray:
    """The square of the projected distance within which vectors of a cosine of ``bound`` are looked for."""
    return np.maximum(2 - 2 * bound + 4 * SLACK, 0.0) * reach * (1 + 1e-9)


def _search(
    x: np.ndarray, y: np.ndarray, projection: np.ndarray, reach: float, least: np.ndarray, k: int, skip: np.ndarray | None = None, cell_rows: int = CELL_ROWS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, cos`` of the k rows of y (more if equal) that are closest to each row of x, if at least as close as ``least``; and the bounds reached.

    ``skip``: the row of y that is the row of x itself.
    """
    places, seeds = y @ projection, x @ projection
    depth = max(0, math.ceil(math.log2(max(1.0, len(y) / cell_rows))))
    tree = Tree(places, depth)
    cell = tree.leaf(places)
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(cell[order]) > 0])
    last = np.r_[first[1:], len(y)]
    lo, hi = np.minimum.reduceat(places[order], first), np.maximum.reduceat(places[order], first)
    # the distance to each cell, rounded down
    away = np.empty((len(x), len(first)), np.float32)
    for c in range(len(first)):
        gap = np.maximum(np.maximum(lo[c] - seeds, seeds - hi[c]), 0.0)
        away[:, c] = (gap * gap).sum(1) * (1 - 1e-6)
    middle = (lo + hi) / 2
    apart = ((middle[:, None] - middle[None]) ** 2).sum(2)
    x32, y32 = x.astype(np.float32), y[order].astype(np.float32)
    position = None
    if skip is not None:
        position = np.empty(len(y), np.int64)
        position[order] = np.arange(len(y))
        position = position[skip]
    best = np.repeat(least.astype(np.float32)[:, None], k, axis=1)
    bound, found = least.astype(np.float64), []

    def visit(rows: np.ndarray, c: int) -> None:
        a, b = first[c], last[c]
        cos = x32[rows] @ y32[a:b].T
        if position is not None:
            own = np.flatnonzero((position[rows] >= a) & (position[rows] < b))
            cos[own, position[rows[own]] - a] = -3.0
        some = np.flatnonzero(cos.max(1) >= bound[rows] - SINGLE_SLACK)
        if len(some) < len(rows):
            rows, cos = rows[some], cos[some]
        if not len(rows):
            return
        top = np.partition(cos, b - a - k, axis=1)[:, b - a - k :] if b - a > k else cos
        merged = np.concatenate([best[rows], top], axis=1)
        best[rows] = np.partition(merged, merged.shape[1] - k, axis=1)[:, merged.shape[1] - k :]
        bound[rows] = np.maximum(bound[rows], best[rows].min(1).astype(np.float64) - SINGLE_SLACK)
        i, j = np.nonzero(cos >= np.maximum(bound[rows] - SINGLE_SLACK, -2.5)[:, None])
        found.append((rows[i], order[j + a], cos[i, j]))

    home = away.argmin(1)
    by_home = np.argsort(home, kind="stable")
    for rows in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
        if not len(rows):
            continue
        for c in np.argsort(apart[home[rows[0]]], kind="stable"):
            near = rows[away[rows, c] <= _radius2(bound[rows], reach)]
            step = max(16, BLOCK // int(last[c] - first[c]))
            for s in range(0, len(near), step):
                visit(near[s : s + step], c)
    i, j, cos = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    kept = cos >= bound[i] - SINGLE_SLACK
    i, j = i[kept], j[kept]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + BLOCK]], y[j[s : s + BLOCK]]) for s in range(0, max(1, len(i)), BLOCK)])
    # the k-th in double precision is the last word
    at = np.lexsort((-exact, i))
    i, j, exact = i[at], j[at], exact[at]
    start = np.searchsorted(i, np.arange(len(x)))
    whole = np.flatnonzero(np.searchsorted(i, np.arange(len(x)), "right") - start >= k)
    bound[whole] = np.maximum(bound[whole], exact[start[whole] + k - 1] - SLACK)
    kept = exact >= bound[i] - SLACK
    return i[kept], j[kept], exact[kept], bound


def _tree(placed: DataFrame, n: int, leaf_rows: int, dimensions: int) -> Tree:
    """The tree over a sample of 16 or more projected vectors per leaf, at most about ``SAMPLE_ROWS[1]``."""
    wanted = min(SAMPLE_ROWS[1], max(SAMPLE_ROWS[0], 16 * n // leaf_rows))
    every = max(1, -(-n // wanted))
    sample = placed.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).select("point").limit(2 * SAMPLE_ROWS[1]).toPandas()
    points = np.array(sample["point"].tolist()) if len(sample) else np.zeros((0, dimensions))
    depth = 0
    while (n >> depth) > leaf_rows and (len(points) >> depth) > 16:
        depth += 1
    return Tree(points, depth)


def near_classes(
    classes: DataFrame, k: int, n: int, size: int, scratch: Scratch, confidence: float = CONFIDENCE, leaf_rows: int | None = None, visitor_rows: int = VISITOR_ROWS
) -> DataFrame:
    """``cid, other, cos``: for each class that is asked for at least its k most similar other ones (all of equal rounded cosine).

    ``classes``: ``cid`` (bigint, unique), ``vec`` (of ``size`` numbers), ``asked``.
    """
    kind = PACKED.get(classes.schema["vec"].dataType.elementType.simpleString(), "float64")
    leaf_rows = leaf_rows or max(LEAF_ROWS[0], min(LEAF_ROWS[1], n // LEAVES))
    projection, reach = _projection(size), min(chi_square_quantile(confidence, DIMENSIONS), size)

    @F.pandas_udf("binary")
    def pack(vec: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, dtype=kind).tobytes() for v in vec])

    @F.pandas_udf("array<float>")
    def project(vec: pd.Series) -> pd.Series:
        return pd.Series(list((_unit(vec, kind, size) @ projection).astype(np.float32)))

    packed = scratch.keep(classes.select("cid", "asked", pack(F.col("vec").cast("array<double>") if kind == "float64" else F.col("vec")).alias("vec")), "packed")
    tree = _tree(packed.select("cid", project("vec").alias("point")), n, leaf_rows, projection.shape[1])

    @F.pandas_udf("int")
    def place(vec: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf((_unit(vec, kind, size) @ projection)).astype(np.int32))

    placed = scratch.keep(packed.select(place("vec").alias("leaf"), "cid", "asked", "vec"), "placed")
    # a leaf that got more than its share is cut into chunks, each of which is visited on its own; one number per leaf
    parts = np.ones(1 << tree.depth, np.int64)
    for r in placed.groupBy("leaf").count().where(F.col("count") > 2 * leaf_rows).collect():
        parts[r["leaf"]] = -(-r["count"] // leaf_rows)
    chunks = F.lit(1)
    if parts.max() > 1:
        chunks = F.element_at(F.create_map(*[F.lit(int(x)) for leaf in np.flatnonzero(parts > 1) for x in (leaf, parts[leaf])]), F.col("leaf"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.coalesce(chunks, F.lit(1))).cast("int"))

    def inside(members: pd.DataFrame) -> pd.DataFrame:
        x, cid, asked = _unit(members["vec"], kind, size), members["cid"].to_numpy(), members["asked"].to_numpy(bool)
        own, chunk, who = int(members["leaf"].iloc[0]), int(members["chunk"].iloc[0]), np.flatnonzero(asked)
        i, j, cos, bound = _search(x[who], x, projection, reach, np.full(len(who), -2.0), k, who)
        out = [pd.DataFrame({"leaf": -1, "chunk": 0, "cid": cid[who[i]], "bound": 0.0, "other": cid[j], "cos": np.round(cos, DECIMALS)})]
        for leaf, at in tree.within(x[who] @ projection, _radius2(bound, reach)):
            for part in range(parts[leaf]):
                if (leaf, part) != (own, chunk):
                    out.append(pd.DataFrame({"leaf": leaf, "chunk": part, "cid": cid[who[at]], "bound": bound[at], "other": 0, "cos": 0.0}))
        return pd.concat(out, ignore_index=True)

    columns = "leaf int, chunk int, cid bigint, bound double, other bigint, cos double"
    first_round = scratch.keep(placed.groupBy("leaf", "chunk").applyInPandas(inside, columns), "round-1")

    def verify(visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(visitors) or not len(members):
            return pd.DataFrame({"cid": [], "other": [], "cos": []}).astype({"cid": "int64", "other": "int64", "cos": "float64"})
        ids, cid = visitors["cid"].to_numpy(), members["cid"].to_numpy()
        i, j, cos, _ = _search(_unit(visitors["vec"], kind, size), _unit(members["vec"], kind, size), projection, reach, visitors["bound"].to_numpy(), k)
        return pd.DataFrame({"cid": ids[i], "other": cid[j], "cos": np.round(cos, DECIMALS)})

    # visits are narrow; the vectors join them here
    visits = first_round.where("leaf >= 0").select("leaf", "chunk", "cid", "bound")
    members = placed.select("leaf", "chunk", "cid", "vec")
    crowded = visits.groupBy("leaf", "chunk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > visitor_rows)
    keys = ["leaf", "chunk"]
    if not crowded.isEmpty():
        # too many visitors of one leaf are split, and the leaf is sent to each part
        keys, share = [*keys, "part"], crowded.select("leaf", "chunk", F.ceil(F.col("n") / visitor_rows).cast("int").alias("parts"))
        share = scratch.keep(share, "crowded")
        visits = visits.join(share, ["leaf", "chunk"], "left").withColumn("part", F.pmod(F.xxhash64("cid"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        members = members.join(share, ["leaf", "chunk"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    visits = visits.join(packed.select("cid", "vec"), "cid")
    second = visits.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(verify, "cid bigint, other bigint, cos double")
    return first_round.where("leaf < 0").select("cid", "other", "cos").unionByName(second)


def nearest(
    vectors: DataFrame, k: int = 3, scratch: Scratch | None = None, confidence: float = CONFIDENCE, leaf_rows: int | None = None, size: int | None = None, visitor_rows: int = VISITOR_ROWS
) -> DataFrame:
    """``path, frame, near_path, near_frame, cos``: the k rows of highest cosine of every row of ``path, frame, vec``.

    ``vec`` is an array of ``size`` numbers (if not given, of the greatest length
    there is).  Null vectors, others of another length, without a number other than
    0, or with nulls or numbers that aren't finite take no part.  A boolean column
    ``asked`` restricts the rows to search for, not those to find.  Cosines are
    rounded to 9 decimals; among equals the smaller path, then the smaller frame
    goes first.  Repeated rows count once; a table of k rows or fewer gives fewer
    than k neighbours, an empty one no rows.  Integers beyond 53 bits lose precision.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "knn")
    asked = F.coalesce("asked", F.lit(False)) if "asked" in vectors.columns else F.lit(True)
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    size = size or vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    rows = vectors.where((F.size("vec") == size) & fine).groupBy("path", "frame", "vec").agg(F.max(asked).alias("asked"))
    # equal vectors by two hashes
    rows = rows.select("path", "frame", "vec", "asked", F.struct(F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(7), "vec").alias("i")).alias("same"))
    # the limit per group is applied on the map side first, so a frequent vector is never gathered
    rank = F.row_number().over(Window.partitionBy("same").orderBy("path", "frame"))
    heads = rows.withColumn("rn", rank).where(F.col("rn") <= k + 1)
    if "asked" in vectors.columns:
        wanted = rows.groupBy("same").agg(F.max("asked").alias("wanted"))
        heads = heads.join(wanted, "same")
    else:
        heads = heads.withColumn("wanted", F.lit(True))
    heads = scratch.keep(heads.select("same", "path", "frame", "rn", "wanted", F.when(F.col("rn") == 1, F.col("vec")).alias("vec")), "heads")
    # the number of a class, fixed by being written
    classes = scratch.keep(heads.where("rn = 1").select("same", "path", "frame", "vec", F.col("wanted").alias("asked")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    near = near_classes(classes.select("cid", "vec", "asked"), k, n, size, scratch, confidence, leaf_rows, visitor_rows)
    best = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cos"), "other_path", "other_frame"))
    # only k classes (by their first key) can give neighbours: a later class is behind k keys already
    leads = classes.select(F.col("cid").alias("other"), F.col("path").alias("other_path"), F.col("frame").alias("other_frame"))
    kept = near.join(leads, "other").withColumn("b", best).where(F.col("b") <= k).select("cid", "other", "cos")
    number = heads.join(classes.select("same", "cid"), "same")
    own = number.where("rn = 2").select("cid", F.col("cid").alias("other"), F.lit(1.0).alias("cos"))
    members = number.select(F.col("cid").alias("other"), F.col("path").alias("near_path"), F.col("frame").alias("near_frame"))
    offers = kept.unionByName(own).join(members, "other")
    place = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cos"), "near_path", "near_frame"))
    offers = offers.withColumn("o", place).where(F.col("o") <= k + 1)
    offers = offers.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("o", "near_path", "near_frame", "cos"))).alias("offers"))
    offers = offers.join(classes.select("cid", "same"), "cid").select("same", "offers")
    joined = rows.where("asked").select("path", "frame", "same").join(offers, "same")
    others = F.filter("offers", lambda x: (x["near_path"] != F.col("path")) | (x["near_frame"] != F.col("frame")))
    out = joined.select("path", "frame", F.explode(F.slice(others, 1, k)).alias("x"))
    return out.select("path", "frame", F.col("x.near_path").alias("near_path"), F.col("x.near_frame").alias("near_frame"), F.col("x.cos").alias("cos"))
