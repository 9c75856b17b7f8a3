"""Exact Hamming-distance joins of 64-bit patterns.

A pattern is cut into ``blocks`` blocks.  Two patterns within ``max_bits`` of
each other agree to within ``2 * radius`` bits in at least one block, so if both
sides list every value within ``radius`` bits of their block, they meet in at
least one listed value.  Listing them all in a shuffle would multiply the rows
by about 66; instead each pattern is only sent to the groups given by the first
``route`` bits of those values (15 to 30 rows of eight bytes) and the rest of
the listing happens with numpy inside the group.

Everything is exact.  ``plan_for`` chooses blocks and route bits from the number
of distinct patterns, so that a group of evenly spread patterns holds at most
``GROUP_ROWS``.  Patterns are not evenly spread, so larger groups are counted and
split into chunks that meet pair by pair; and inside a group, values that many
patterns list are not compared pair by pair but by blocks of the bits that vary.

A pattern may have a second word ``w`` with a distance of its own: pairs must then
be near in both, and a ``v`` that very many patterns share is searched by ``w``.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct patterns that one group should hold at most, on average; groups of more than twice as many are split.
GROUP_ROWS = 120_000
#: Patterns that list one value and are compared pair by pair; more are searched by blocks of their varying bits.
RUN_ROWS = 512


class Plan(NamedTuple):
    """Blocks of the pattern as (shift, bits), the radius listed by each side, routed bits, largest distance, patterns."""

    blocks: tuple[tuple[int, int], ...]
    radius: int
    route: int
    max_bits: int
    n: int = 0

    @property
    def groups(self) -> int:
        return len(self.blocks) << self.route


def plan_for(n: int, max_bits: int = 8, bits: int = 64, index: bool = False) -> Plan:
    """``index``: for the groups of an index, which lists fewer values than either side of a self-join.

    Three blocks of radius 1 up to about 30 million patterns, two blocks of radius 2 beyond (for 8 bits)."""
    count = max(1, -(-max_bits // 3)) if n <= 30_000_000 else max(1, -(-max_bits // 5))
    # listed values are packed with row numbers into 64 bits, so a block has 32 bits at most
    count = max(count, -(-bits // 32))
    while (max_bits // count) > 4:
        count += 1
    per_block = max_bits // count
    radius = -(-per_block // 2)
    sizes = [bits // count + (k < bits % count) for k in range(count)]
    shifts = np.cumsum([0, *sizes[:-1]]).tolist()
    route = 2
    listed = max(0, 2 * radius - 2) if index else radius
    while route < min(sizes) - 2 and n * ball(route, listed) / (1 << route) > GROUP_ROWS:
        route += 1
    return Plan(tuple(zip(shifts, sizes, strict=True)), radius, route, max_bits, n)


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


@cache
def _flips(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def routed(value: Column, plan: Plan, radius: int | None = None) -> Column:
    """The array of group numbers that a pattern is sent to by a side that lists values within ``radius`` bits."""
    radius = plan.radius if radius is None else radius
    out = []
    for j, (shift, size) in enumerate(plan.blocks):
        top = F.shiftrightunsigned(value, shift + size - plan.route).bitwiseAND(F.lit((1 << plan.route) - 1)).cast("int")
        out += [(top.bitwiseXOR(F.lit(flip)) + F.lit(j << plan.route)).cast("int") for flip in _flips(plan.route, radius)]
    return F.array(*out)


def _keys(v: np.ndarray, group: int, plan: Plan, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Listed low parts of the block in this group, and the index of the pattern each belongs to."""
    shift, size = plan.blocks[group >> plan.route]
    low_bits = size - plan.route
    block = (v >> np.uint64(shift)) & np.uint64((1 << size) - 1)
    away = np.bitwise_count((block >> np.uint64(low_bits)) ^ np.uint64(group & ((1 << plan.route) - 1)))
    low = block & np.uint64((1 << low_bits) - 1)
    keys, owner = [], []
    for spent in range(radius + 1):
        at = np.flatnonzero(away == spent)
        if len(at):
            flips = np.array(_flips(low_bits, radius - spent), dtype=np.uint64)
            keys.append((low[at][:, None] ^ flips[None, :]).ravel())
            owner.append(np.repeat(at, len(flips)))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owner)


def _first_block(x: np.ndarray, group: int, plan: Plan) -> np.ndarray:
    """Whether this group's block is the first one in which the pair agrees closely enough."""
    ok = np.ones(len(x), bool)
    for shift, size in plan.blocks[: group >> plan.route]:
        ok &= np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << size) - 1)) > 2 * plan.radius
    return ok


def _runs(keys: np.ndarray, owner: np.ndarray, near, hot) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of owners that share a key: short runs by ``near`` (of two index arrays), long ones by ``hot`` (of the members)."""
    packed = np.sort((keys << np.uint64(32)) | owner.astype(np.uint64))
    keys, owner = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(keys)])
    found_a, found_b = [], []
    for s, n in zip(start[length > RUN_ROWS], length[length > RUN_ROWS], strict=True):
        members = np.unique(owner[s : s + n])
        a, b = hot(members)
        found_a.append(members[a])
        found_b.append(members[b])
    short = np.repeat(length <= RUN_ROWS, length)
    left = np.repeat(start + length, length) - np.arange(len(keys)) - 1
    at, step = np.flatnonzero(short & (left > 0)), 1
    while len(at):
        a, b = owner[at], owner[at + step]
        ok = near(a, b)
        found_a.append(a[ok])
        found_b.append(b[ok])
        step += 1
        at = at[left[at] >= step]
    return found_a, found_b


def _varying(v: np.ndarray) -> list[int]:
    mask = int(np.bitwise_or.reduce(v ^ v[0])) if len(v) else 0
    return [k for k in range(64) if mask >> k & 1]


def within(words: list[tuple[np.ndarray, int]], level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the patterns whose every word is within its largest distance.

    ``words``: arrays and distances.  One word after the other is cut into blocks of
    its varying bits; patterns that agree in a block are compared if they are few,
    else the next word is taken, and in the end all remaining ones are compared.
    """
    n = len(words[0][0])

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = a != b
        for x, most in words:
            ok[ok] = np.bitwise_count(x[a[ok]] ^ x[b[ok]]) <= most
        return ok

    bits = _varying(words[level][0]) if level < len(words) and n > 2 * RUN_ROWS else []
    if level < len(words) and n > 2 * RUN_ROWS and len(bits) < 12:
        return within(words, level + 1)
    if not bits:
        found_a, found_b = [], []
        step = max(1, 4_000_000 // max(1, n))
        for s in range(0, n, step):
            rows = np.arange(s, min(n, s + step))
            a, b = np.repeat(rows, n), np.tile(np.arange(n), len(rows))
            a, b = a[a < b], b[a < b]
            ok = near(a, b)
            found_a.append(a[ok])
            found_b.append(b[ok])
        return _unique(found_a, found_b)
    x, most = words[level]
    count = max(1, -(-most // 3), -(-len(bits) // 30))
    radius = 1 if most // count else 0
    found_a, found_b = [], []
    for j in range(count):
        block, low = bits[j::count], np.zeros(n, np.uint64)
        for k, bit in enumerate(block):
            low |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        flips = np.array(_flips(len(block), radius), dtype=np.uint64)
        keys, owner = (low[:, None] ^ flips[None, :]).ravel(), np.repeat(np.arange(n), len(flips))

        def deeper(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return within([(y[members], m) for y, m in words], level + 1)

        a, b = _runs(keys, owner, near, deeper)
        found_a += a
        found_b += b
    return _unique([np.minimum(a, b) for a, b in zip(found_a, found_b, strict=True)], [np.maximum(a, b) for a, b in zip(found_a, found_b, strict=True)])


def self_pairs(v: np.ndarray, group: int, plan: Plan, w: np.ndarray | None = None, w_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct patterns of one group within the distance."""
    keys, owner = _keys(v, group, plan, plan.radius)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = v[a] ^ v[b]
        ok = (np.bitwise_count(x) <= plan.max_bits) & (a != b)
        if w is not None:
            ok[ok] = np.bitwise_count(w[a[ok]] ^ w[b[ok]]) <= w_bits
        ok[ok] = _first_block(x[ok], group, plan)
        return ok

    def hot(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the pattern itself first: its varying bits differ from the block that is shared
        words = [(v[members], plan.max_bits)] + ([(w[members], w_bits)] if w is not None else [])
        a, b = within(words)
        ok = _first_block(v[members[a]] ^ v[members[b]], group, plan)
        return a[ok], b[ok]

    found_a, found_b = _runs(keys, owner, near, hot)
    return _unique([np.minimum(a, b) for a, b in zip(found_a, found_b, strict=True)], [np.maximum(a, b) for a, b in zip(found_a, found_b, strict=True)])


def cross_pairs(probe: np.ndarray, index: np.ndarray, group: int, plan: Plan, words: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (probe, index) of one group within the distance, equal patterns included.

    ``words``: the second words of both sides and their largest distance.

    The sides share the work unevenly, as `sides` says: an index stays small, each
    probe lists more values.
    """
    probe_radius, index_radius = sides(plan)
    pk, po = _keys(probe, group, plan, probe_radius)
    ik, io = _keys(index, group, plan, index_radius)
    low_bits = plan.blocks[group >> plan.route][1] - plan.route
    if low_bits <= 22:
        present = np.zeros(1 << low_bits, bool)
        present[ik] = True
        seen = present[pk]
        pk, po = pk[seen], po[seen]
    order = np.argsort(ik, kind="stable")
    ik, io = ik[order], io[order]
    at, end = np.searchsorted(ik, pk, "left"), np.searchsorted(ik, pk, "right")
    found_a, found_b = [], []
    while len(at):
        open_ = at < end
        at, end, po = at[open_], end[open_], po[open_]
        b = io[at]
        x = probe[po] ^ index[b]
        near = np.bitwise_count(x) <= plan.max_bits
        if words:
            near[near] = np.bitwise_count(words[0][po[near]] ^ words[1][b[near]]) <= words[2]
        near[near] = _first_block(x[near], group, plan)
        found_a.append(po[near])
        found_b.append(b[near])
        at = at + 1
    return _unique(found_a, found_b)


def sides(plan: Plan) -> tuple[int, int]:
    """The radii that a probe and the index list; their sum covers the distance within a block."""
    index_radius = max(0, 2 * plan.radius - 2)
    return 2 * plan.radius - index_radius, index_radius


def _unique(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = np.unique((np.concatenate(a).astype(np.uint64) << np.uint64(32)) | np.concatenate(b).astype(np.uint64))
    return (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def chunked(rows: DataFrame, most: int = 2 * GROUP_ROWS) -> DataFrame:
    """``rows`` (with ``v, g``) with ``chunk, i, j``: groups of more than ``most`` rows are cut into chunks, and each two chunks meet as (i, j).

    Sizes are counted before the rows are sent, with map-side sums; a chunk of a
    hot group is sent once for each other chunk of that group.
    """
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most)
    parts = F.ceil(F.col("size") * 2 / most).cast("int")
    met = rows.join(sizes.select("g", parts.alias("parts")), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("v", *[c for c in ("w",) if c in rows.columns]), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")).drop("parts", "other")


def near_pairs(patterns: DataFrame, plan: Plan, w_bits: int, most: int = 2 * GROUP_ROWS) -> DataFrame:
    """Pairs ``v1, w1, v2, w2`` of the distinct bigint columns ``v, w``, (v1, w1) < (v2, w2) as signed numbers.

    ``v`` differs in at most ``plan.max_bits``, ``w`` in at most ``w_bits`` bits.  Rows with a null never match.
    """
    rows = patterns.where("v is not null and w is not null").select("v", "w", F.explode(routed(F.col("v"), plan)).alias("g"))
    split = plan.n == 0 or plan.n > most
    rows = chunked(rows, most) if split else rows.withColumn("chunk", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        v, w = pdf["v"].to_numpy(), pdf["w"].to_numpy()
        a, b = self_pairs(v.view(np.uint64), int(pdf["g"].iloc[0]), plan, w.view(np.uint64), w_bits)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            chunk = pdf["chunk"].to_numpy()
            a, b = a[chunk[a] != chunk[b]], b[chunk[a] != chunk[b]]
        turn = (v[a] > v[b]) | ((v[a] == v[b]) & (w[a] > w[b]))
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        return pd.DataFrame({"v1": v[a], "w1": w[a], "v2": v[b], "w2": w[b]})

    return rows.groupBy("g", "i", "j").applyInPandas(local, "v1 bigint, w1 bigint, v2 bigint, w2 bigint").distinct()


def near_patterns(patterns: DataFrame, plan: Plan, most: int = 2 * GROUP_ROWS) -> DataFrame:
    """Pairs ``lo < hi`` (as signed numbers) of the distinct bigint column ``v`` within ``plan.max_bits``.

    Nulls never match.  Equal patterns are no pair: the input is distinct.
    """
    pairs = near_pairs(patterns.select("v", F.lit(0).cast("bigint").alias("w")), plan, 0, most)
    return pairs.select(F.col("v1").alias("lo"), F.col("v2").alias("hi"))
