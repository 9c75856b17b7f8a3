"""Problem 7: filling containers of fixed capacity.

Bin completion works on sizes, and there are at most ``capacity`` different
sizes: the driver gets the number of items per size, never items.  Best fit
decreasing and a greedy completion give the first solutions; unless one meets the
lower bound, a branch and bound goes over the undominated fillings of the
container of the largest size left and cuts branches whose waste or lower bound
cannot beat the best solution.  The fillings go back as a small table, and items
find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import Scratch

#: Search nodes spent on one filling of the greedy completion at most; the best one found so far is used then.
NODES = 4_000
#: Elementary steps of the branch and bound at most; the best solution found so far is used then.
STEPS = 10_000_000
#: Parts in which one size is ranked, so that no task ranks all items of a frequent size.
SALTS = 64


def completion(counts: list[int], below: list[int], room: int, nodes: int = NODES) -> list[int]:
    """Sizes (descending) that fill ``room`` with the least waste found, using each size at most ``counts[size]`` times.

    ``below[s]`` is the largest size up to ``s`` that has items, 0 if none.  Fillings
    are tried from large items to small; one that fits a larger item in the same
    place dominates, so the first of equal waste is kept.
    """
    best, best_waste, budget = [], room, nodes
    # all that sizes up to s could fill
    most = list(accumulate(s * n for s, n in enumerate(counts[: room + 1])))

    def search(room: int, top: int, chosen: list[int]) -> bool:
        # depth is bounded by the number of different sizes that fit into one container
        nonlocal best, best_waste, budget
        if room < best_waste:
            best, best_waste = chosen.copy(), room
            if not room:
                return True
        size = below[min(room, top)]
        while size and room - most[size] < best_waste:
            for times in range(min(counts[size], room // size), 0, -1):
                budget -= 1
                if budget < 0:
                    return True
                if search(room - times * size, size - 1, chosen + [size] * times):
                    return True
            size = below[size - 1]
        return False

    search(room, room, [])
    return best


def greedy_fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``(times, sizes)``: the least waste for the largest size left, as often as the counts allow, until all items are placed."""
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    below = [0] * (capacity + 1)
    for size in range(1, capacity + 1):
        below[size] = size if left[size] else below[size - 1]
    out = []
    top = below[capacity]
    while top:
        left[top] -= 1
        filling = [top, *completion(left, below, capacity - top)]
        left[top] += 1
        use = {s: filling.count(s) for s in filling}
        times = min(left[s] // k for s, k in use.items())
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                for t in range(s, capacity + 1):
                    if below[t] != s:
                        break
                    below[t] = below[s - 1]
        out.append((times, filling))
        top = below[capacity]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit decreasing: each item goes to the fullest container that takes it; containers of equal content are counted."""
    have: dict[tuple[int, tuple[int, ...]], int] = {}
    order: list[tuple[int, tuple[int, ...]]] = []

    def add(key: tuple[int, tuple[int, ...]], n: int) -> None:
        if n and key not in have:
            insort(order, key)
        if n:
            have[key] = have.get(key, 0) + n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(order, (size,))
            key = order.pop(i) if i < len(order) else (capacity, ())
            bins = have.pop(key, n)
            room, inside = key
            k = min(room // size, n)
            full = min(bins, n // k)
            add((room - k * size, inside + (size,) * k), full)
            n -= full * k
            rest = min(n, k - 1) if full < bins else 0
            if rest:
                add((room - rest * size, inside + (size,) * rest), 1)
                n -= rest
            if inside:
                add(key, bins - full - bool(rest))
    return [(times, list(inside)) for (_, inside), times in have.items()]


def least_containers(sizes: list[int], left: dict[int, int], capacity: int) -> int:
    """A lower bound: all items, and what containers of sizes above one half must waste, as only small enough items join them.

    ``sizes``: those with items, descending.
    """
    waste, spare, i = 0, 0, len(sizes) - 1
    for x in sizes:
        if 2 * x <= capacity:
            break
        while sizes[i] <= capacity - x:
            spare += sizes[i] * left[sizes[i]]
            i -= 1
        need = left[x] * (capacity - x)
        waste += max(0, need - spare)
        spare = max(0, spare - need)
    return -(-(sum(s * left[s] for s in sizes) + waste) // capacity)


class Spent(Exception):
    """No steps are left."""


def search_fillings(counts: dict[int, int], capacity: int, known: int, steps: int = STEPS) -> tuple[list[tuple[int, list[int]]] | None, bool]:
    """A solution of fewer than ``known`` containers or None, and whether the search was complete."""
    left, found, seen = dict(counts), None, {}
    goal = least_containers(sorted(counts, reverse=True), counts, capacity)

    def spend(n: int) -> None:
        nonlocal steps
        steps -= n
        if steps < 0:
            raise Spent

    def undominated(sizes: list[int], most_waste: int) -> list[dict[int, int]]:
        """Fillings of a container of the largest size, the least waste first.

        Left out are those to which an item could be added or in which an item, or two, could give way to a larger one.
        """
        top, out = sizes[0], []
        left[top] -= 1
        rest = [s for s in sizes if left[s]]
        tail = [*accumulate((s * left[s] for s in reversed(rest)), initial=0)][::-1]

        def dominated(chosen: dict[int, int], waste: int) -> bool:
            spend(len(rest))
            free = [s for s in rest if left[s] > chosen.get(s, 0)]
            if free and free[-1] <= waste:
                return True
            own = [s for s, k in chosen.items() for _ in range(min(k, 2))]
            spend(len(own) ** 2 * max(1, len(free).bit_length()))
            free.reverse()
            at = lambda low, high: (j := bisect_left(free, low)) < len(free) and free[j] <= high
            return any(at(s + 1, s + waste) for s in chosen) or any(at(a + b, a + b + waste) for j, a in enumerate(own) for b in own[:j])

        def place(i: int, room: int, chosen: dict[int, int]) -> None:
            spend(1)
            if room <= most_waste and not dominated(chosen, room):
                out.append((room, {**chosen, top: chosen.get(top, 0) + 1}))
            for j in range(i, len(rest)):
                spend(1)
                if room - tail[j] > most_waste:
                    break
                s = rest[j]
                for times in range(min(left[s], room // s), 0, -1):
                    place(j + 1, room - times * s, {**chosen, s: times})

        try:
            place(0, capacity - top, {})
        finally:
            left[top] += 1
        return [f for _, f in sorted(out, key=lambda x: x[0])]

    def branches(used: int) -> Iterator[tuple[int, dict[int, int]]]:
        sizes = [s for s in sorted(left, reverse=True) if left[s]]
        spend(2 * len(left))
        if used + least_containers(sizes, left, capacity) >= known:
            return
        state = tuple(left[s] for s in sizes), tuple(sizes)
        if seen.get(state, known) <= used:
            return
        if len(seen) < 100_000:
            seen[state] = used
        # a solution of one container less can waste so much from here on
        for f in undominated(sizes, (known - 1 - used) * capacity - sum(s * left[s] for s in sizes)):
            # as often as possible is a short way, once is the complete one
            for times in sorted({min(left[s] // k for s, k in f.items()), 1}, reverse=True):
                yield times, f

    def move(times: int, f: dict[int, int]) -> None:
        for s, k in f.items():
            left[s] -= times * k

    path, used, stack = [], 0, [branches(0)]
    try:
        while stack and known > goal:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    times, f = path.pop()
                    move(-times, f)
                    used -= times
                continue
            spend(1)
            times, f = step
            if used + times >= known:
                continue
            move(times, f)
            if any(left.values()):
                path.append(step)
                used += times
                stack.append(branches(used))
            else:
                known, found = used + times, [*path, step]
                move(-times, f)
    except Spent:
        return _listed(found), False
    return _listed(found), True


def _listed(found: list[tuple[int, dict[int, int]]] | None) -> list[tuple[int, list[int]]] | None:
    return found and [(times, sorted(Counter(f).elements(), reverse=True)) for times, f in found]


def fillings(counts: dict[int, int], capacity: int, steps: int = STEPS) -> list[tuple[int, list[int]]]:
    """``(times, sizes)``: how often a container is filled with which sizes, all items placed; never worse than best fit decreasing."""
    counts = {s: n for s, n in counts.items() if n}
    n = lambda solution: sum(times for times, _ in solution)
    best = min((best_fit(counts, capacity), greedy_fillings(counts, capacity)), key=n)
    better, _ = search_fillings(counts, capacity, n(best), steps)
    return better or best


def pack(sized: DataFrame, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``container, doc_id, token_from, n_tokens, token_at``: where each stretch of tokens of each text lies.

    ``sized``: ``doc_id`` (unique), ``n_tokens``.  Only texts above ``capacity``
    are cut: into full containers of their own and one rest.  Texts of no tokens
    or of unknown size lie nowhere.  Containers ``mix-N`` are numbered from 0,
    ``cut-DOC-K`` hold one full stretch.  An empty table gives no rows.
    """
    scratch = scratch or Scratch(sized.sparkSession, "pack")
    spark = sized.sparkSession
    sized = scratch.keep(sized.select("doc_id", F.col("n_tokens").cast("bigint").alias("n")).where("n > 0"), "sized")
    cuts = F.floor(F.col("n") / capacity).cast("bigint")
    full = sized.where(cuts > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), cuts - 1)).alias("k"))
    full = full.select(
        F.concat_ws("-", F.lit("cut"), "doc_id", "k").alias("container"), "doc_id", (F.col("k") * capacity).alias("token_from"), F.lit(capacity).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("token_at")
    )
    rest = F.col("n") % capacity
    items = sized.where(rest > 0).select("doc_id", (F.col("n") - rest).alias("token_from"), rest.cast("int").alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))

    # at most capacity * SALTS rows, whatever the number of texts
    part = items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["size", "salt"])
    part["before"] = part.groupby("size")["n"].cumsum() - part["n"]
    counts = {int(s): int(n) for s, n in part.groupby("size")["n"].sum().items()}
    start, rows, container = dict.fromkeys(counts, 0), [], 0
    for times, sizes in fillings(counts, capacity):
        at = 0
        for size in dict.fromkeys(sizes):
            k = sizes.count(size)
            rows.append((size, start[size], start[size] + k * times, k, container, at))
            start[size] += k * times
            at += k * size
        container += times
    places = spark.createDataFrame(rows, "size int, lo bigint, hi bigint, k bigint, first bigint, at bigint")
    before = spark.createDataFrame(part[["size", "salt", "before"]], "size int, salt int, before bigint")

    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "token_from")) - 1)
    ranked = ranked.join(F.broadcast(before), ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    met = ranked.alias("r").join(F.broadcast(places).alias("p"), F.expr("r.size = p.size and r.rank >= p.lo and r.rank < p.hi"))
    step = F.col("rank") - F.col("lo")
    mixed = met.select(
        F.concat_ws("-", F.lit("mix"), (F.col("first") + F.floor(step / F.col("k"))).cast("bigint")).alias("container"),
        "doc_id",
        "token_from",
        F.col("r.size").cast("bigint").alias("n_tokens"),
        (F.col("at") + (step % F.col("k")) * F.col("r.size")).alias("token_at"),
    )
    return full.unionByName(mixed)
