"""Filling containers of fixed capacity with texts: pattern packing by non-negative least squares.

Only the histogram of lengths, at most one entry per token of capacity, reaches the driver. There patterns of few
lengths that fill a container are enumerated on a grid, their repeat counts are fitted to the histogram by non-negative
least squares and rounded to what the histogram holds; where few texts do not fill a container, patterns of many are
drawn and fitted likewise. The lengths left over are packed best-fit, longest first, by classes of equal containers. The plan is as large as the capacity allows, whatever the number of texts. The texts are
then ranked within their length by one global sort, and rank and plan give container, place and offset.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import range_sorted, rescan, summarise

GRID = 192
DEPTH = 3
#: Long patterns: growth of the classes of lengths, most patterns of one round, and the share of each class that stays out.
STEP, DRAWN, SPARE = 1.02, 192, 0.1
#: The share of the texts that is left for the room within patterns.
REST = 0.1


def enumerate_patterns(present: np.ndarray, cells: int, slack: int) -> np.ndarray:
    """Rows of ``DEPTH`` cells (0: none), descending, that sum to cells - slack .. cells; only present cells take part."""
    have = np.zeros(cells + 1, dtype=bool)
    have[present] = True
    a = present[present > 0]
    out = [np.stack([a, np.zeros_like(a), np.zeros_like(a)], 1)[(a >= cells - slack)]]
    x, y = np.meshgrid(a, a, indexing="ij")
    x, y = x[x >= y], y[x >= y]
    fits = x + y <= cells
    x, y = x[fits], y[fits]
    full = x + y >= cells - slack
    out.append(np.stack([x[full], y[full], np.zeros(full.sum(), dtype=x.dtype)], 1))
    for miss in range(slack + 1):
        z = cells - miss - x - y
        ok = (z > 0) & (z <= y)
        ok[ok] &= have[z[ok]]
        out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(out)


def least_squares(counts: Callable[[np.ndarray], np.ndarray], back: Callable[[np.ndarray], np.ndarray], n: int, want: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 of length ``n`` that brings ``counts(x)`` close to ``want``: accelerated projected gradient; ``back`` is the transpose of ``counts``."""
    if not n:
        return np.zeros(0)
    v, top = np.ones(n), 1.0
    for _ in range(20):  # largest eigenvalue by power iteration
        v = back(counts(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    scale = max(float(want.max()), 1.0)
    goal = want / scale
    x = z = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(z - back(counts(z) - goal) / top, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


class Stock:
    """The lengths left, by class; a class may be asked for any of its lengths and gives the longest."""

    def __init__(self, left: dict[int, int], classes: dict[int, list[int]]) -> None:
        self.left, self.classes = left, {c: sorted(x) for c, x in classes.items()}
        self.free = {c: sum(left[x] for x in lengths) for c, lengths in classes.items()}

    def take(self, pattern: dict[int, int], times: int) -> list[tuple[tuple[int, ...], int]]:
        """[(lengths, repeats)] of up to ``times`` containers with so many of each class, as far as the stock goes."""
        made, k = [], min(times, *(self.free.get(c, 0) // m for c, m in pattern.items()))
        while k > 0:
            lengths, run = [], k
            for c, m in pattern.items():
                mine = self.classes[c]
                while not self.left[mine[-1]]:
                    mine.pop()
                have = self.left[mine[-1]]
                if have >= m:
                    lengths += [mine[-1]] * m
                    run = min(run, have // m)
                else:  # the longest length of the class runs out within one container
                    run, need = 1, m
                    for x in reversed(mine):
                        some = min(need, self.left[x])
                        lengths += [x] * some
                        need -= some
                        if not need:
                            break
            for x in lengths:
                self.left[x] -= run
            for c, m in pattern.items():
                self.free[c] -= m * run
            made.append((tuple(sorted(lengths, reverse=True)), run))
            k -= run
        return made


def _round(stock: Stock, patterns: list[dict[int, int]], repeats: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as their rounded repeats say, the frequent ones first."""
    made: list[tuple[tuple[int, ...], int]] = []
    for p in np.argsort(-repeats, kind="stable"):
        if repeats[p] < 0.5:
            break
        made += stock.take(patterns[p], round(float(repeats[p])))
    return made


def _short(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of up to ``DEPTH`` texts. A length takes the grid cells it needs, so a pattern always fits."""
    width = -(-capacity // GRID)
    cells = capacity // width
    classes: dict[int, list[int]] = defaultdict(list)
    for length in left:
        if length > 0 and -(-length // width) <= cells:
            classes[-(-length // width)].append(length)
    stock = Stock(left, classes)
    want = np.zeros(cells + 1)
    for cell, n in stock.free.items():
        want[cell] = n
    rows = enumerate_patterns(np.array(sorted(classes), dtype=np.int64), cells, 1)
    flat = rows.ravel()

    def counts(x: np.ndarray) -> np.ndarray:
        c = np.bincount(flat, weights=np.repeat(x, DEPTH), minlength=cells + 1)
        c[0] = 0
        return c

    def back(r: np.ndarray) -> np.ndarray:
        r = np.concatenate([[0.0], r[1:]])
        return r[rows].sum(axis=1)

    repeats = least_squares(counts, back, len(rows), want)
    some = np.where(repeats >= 0.5)[0]
    return _round(stock, [dict(Counter(c for c in row.tolist() if c)) for row in rows[some]], repeats[some])


def _long(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of many texts, for capacities that few of them do not fill.

    Lengths fall into classes of ``STEP`` times the length, each as long as its longest. Patterns are drawn from the
    histogram of the classes by an even sequence and filled up with the longest that fit; their repeats are fitted like
    those of the short ones. A share of ``SPARE`` of every class stays out, for the room that the classes leave.
    """
    tops = [1]
    while tops[-1] < capacity:
        tops.append(min(capacity, max(tops[-1] + 1, int(tops[-1] * STEP))))
    classes: dict[int, list[int]] = defaultdict(list)
    for length, n in left.items():
        if n and 0 < length <= capacity:
            classes[bisect_left(tops, length)].append(length)
    stock = Stock(left, classes)
    stock.free = {c: int(n * (1 - SPARE)) for c, n in stock.free.items()}
    present = [c for c in sorted(classes) if stock.free[c] > 0]
    want = np.array([stock.free[c] for c in present], dtype=float)
    boxes = int(sum(n * x for x, n in left.items()) // capacity)
    if not present or boxes < 1:
        return []
    size, upto = [tops[c] for c in present], np.cumsum(want) / want.sum()
    drawn: list[dict[int, int]] = []
    for t in range(min(DRAWN, max(16, boxes // 4))):
        room, mine, at = capacity, Counter(), ((t + 1) * 0.7548776662466927) % 1.0
        while room >= size[0]:
            at = (at + 0.6180339887498949) % 1.0
            pick = min(int(np.searchsorted(upto, at, side="right")), len(present) - 1)
            if size[pick] > room:
                pick = bisect_right(size, room) - 1
            mine[present[pick]] += 1
            room -= size[pick]
        drawn.append(dict(mine))
    index = {c: i for i, c in enumerate(present)}
    matrix = np.zeros((len(drawn), len(present)))
    for t, mine in enumerate(drawn):
        for c, m in mine.items():
            matrix[t, index[c]] = m
    repeats = least_squares(lambda x: matrix.T @ x, lambda r: matrix @ r, len(drawn), want)
    return _round(stock, drawn, repeats)


def fit_patterns(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths, repeats)], lengths left over): short patterns first, then long ones on what these leave, as long as they
    place a tenth of it and more than ``REST`` of all is left, which goes into the room within the patterns."""
    left = {x: n for x, n in counts.items() if n and x > 0}
    total = sum(left.values())
    made = _short(left, capacity)
    while (before := sum(left.values())) > REST * total:
        made += _long(left, capacity)
        if sum(left.values()) > 0.9 * before:
            break
    return made, {x: n for x, n in left.items() if n}


@dataclass
class Group:
    """Equal containers: ``runs`` of (length, how many), their number, and the space each has left."""

    runs: dict[int, int]
    n: int
    space: int


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Group]:
    """Containers for all lengths 1..capacity of the histogram, as groups of equal ones."""
    made, left = fit_patterns(counts, capacity)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for lengths, k in made:
        merged[lengths] += k
    spaces: list[int] = []
    by_space: dict[int, list[Group]] = defaultdict(list)

    def put(g: Group) -> None:
        if not by_space[g.space]:
            insort(spaces, g.space)
        by_space[g.space].append(g)

    for lengths, k in merged.items():
        runs: dict[int, int] = {}
        for x in lengths:
            runs[x] = runs.get(x, 0) + 1
        put(Group(runs, k, capacity - sum(lengths)))
    for length in sorted(left, reverse=True):
        todo = left[length]
        while todo:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                per = capacity // length
                if todo >= per:
                    put(Group({length: per}, todo // per, capacity - per * length))
                if todo % per:
                    put(Group({length: todo % per}, 1, capacity - todo % per * length))
                break
            space = spaces[at]
            group = by_space[space].pop()
            if not by_space[space]:
                spaces.pop(at)
            each = min(space // length, max(1, todo // group.n))
            used = min(group.n, todo // each)
            if used < group.n:
                put(Group(dict(group.runs), group.n - used, space))
            group.runs[length] = group.runs.get(length, 0) + each
            put(Group(group.runs, used, space - each * length))
            todo -= used * each
    return [g for groups in by_space.values() for g in groups]


@dataclass
class Slots:
    """The plan by length: ranks from ``start`` on go to the containers from ``base`` on, ``per`` of them into each, the
    first at place ``place`` and token ``offset``."""

    length: np.ndarray
    start: np.ndarray
    base: np.ndarray
    per: np.ndarray
    place: np.ndarray
    offset: np.ndarray
    containers: int
    group_base: np.ndarray
    group_items: np.ndarray
    group_used: np.ndarray


def slots(groups: list[Group]) -> Slots:
    groups = sorted(groups, key=lambda g: (g.space, sorted(g.runs.items(), reverse=True), g.n))
    used: dict[int, int] = defaultdict(int)
    rows, base, heads = [], 0, []
    for g in groups:
        place = offset = 0
        heads.append(base)
        for length, per in sorted(g.runs.items(), reverse=True):
            rows.append((length, used[length], base, per, place, offset))
            used[length] += per * g.n
            place += per
            offset += per * length
        base += g.n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    items = np.array([sum(g.runs.values()) for g in groups], dtype=np.int64)
    tokens = np.array([sum(x * m for x, m in g.runs.items()) for g in groups], dtype=np.int64)
    return Slots(*cols, base, np.array(heads, dtype=np.int64), items, tokens)


def place(plan: Slots, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container, place and offset of the items with the given lengths and ranks within their length."""
    out = [np.zeros(len(length), dtype=np.int64) for _ in range(3)]
    real = length > 0
    if real.any():
        n, r = length[real], rank[real]
        top = int(max(plan.start.max(initial=0), r.max(initial=0))) + 1
        first = np.searchsorted(plan.length * top + plan.start, n * top + r, side="right") - 1
        inside = r - plan.start[first]
        copy, slot = inside // plan.per[first], inside % plan.per[first]
        for o, v in zip(out, (plan.base[first] + copy, plan.place[first] + slot, plan.offset[first] + slot * n)):
            o[real] = v
    if not real.all():  # items without tokens go round after the others
        r, total = rank[~real], max(plan.containers, 1)
        out[0][~real] = r % total
        if plan.containers:
            g = np.searchsorted(plan.group_base, r % total, side="right") - 1
            out[1][~real] = plan.group_items[g] + r // total
            out[2][~real] = plan.group_used[g]
        else:
            out[1][~real] = r
    return out[0], out[1], out[2]


def pack(sizes: DataFrame, key: str, tokens: str, plans: DataFrame) -> DataFrame:
    """(plan_id, *key, piece_no, container_id, place, offset, tokens) of every text for every plan (plan_id, capacity_tokens).

    A text longer than the capacity is cut into pieces of the capacity and a last one; no other is split. Texts of 0 or
    null tokens are dealt round to the containers (container 0 if there is no other). Plans with a null or
    non-positive capacity, and empty tables, give no rows. Repeated keys are texts of their own. The plans are a configuration table and are collected.
    """
    chosen = {r.plan_id: int(r.capacity_tokens) for r in plans.select("plan_id", "capacity_tokens").collect() if r.capacity_tokens and r.capacity_tokens > 0}
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)[key]
    if not chosen:
        return spark.createDataFrame([], f"plan_id string, {key} {kind}, piece_no bigint, container_id bigint, place bigint, `offset` bigint, tokens bigint")
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0))
    config = F.array(*[F.struct(F.lit(p).alias("plan_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in sorted(chosen.items())])
    items = sizes.select(F.col(key).alias("key"), n.alias("n"), F.explode(config).alias("p")).select("key", "n", "p.plan_id", "p.capacity")
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)) - 1)))
    items = items.select("plan_id", F.least(F.col("n") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("length"), "key", "piece")
    ordered = range_sorted(items, "plan_id", "length", "key", "piece")
    counts: dict[str, dict[int, int]] = {p: {} for p in chosen}
    for r in ordered.groupBy("plan_id", "length").count().collect():  # at most capacity + 1 rows per plan
        counts[r.plan_id][r.length] = r["count"]
    made = {p: slots(pack_histogram({x: c for x, c in counts[p].items() if x > 0}, chosen[p])) for p in chosen}
    shared = spark.sparkContext.broadcast(made)

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Heads of the runs of equal (plan, length), and each row's number within its run."""
        length = batch.column(1).to_numpy(zero_copy_only=False)
        plan = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(len(length), dtype=bool)
        new[1:] = (length[1:] != length[:-1]) | (plan[1:] != plan[:-1])
        heads = np.where(new)[0]
        return heads, np.arange(len(length)) - heads[np.cumsum(new) - 1]

    def step(state: tuple | None, batch: pa.RecordBatch) -> tuple[np.ndarray, tuple]:
        """Ranks of a batch after ``state`` = (plan, length, rows so far)."""
        heads, rank = runs(batch)
        first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        if state is not None and state[:2] == first:
            rank[: heads[1] if len(heads) > 1 else len(rank)] += state[2]
        return rank, (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py(), int(rank[-1]) + 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        first, state = None, None
        for batch in batches:
            first = first or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            _, state = step(state, batch)
        return None if state is None else {"p0": first[0], "l0": first[1], "p1": state[0], "l1": state[1], "rows": state[2]}

    carry, state = {}, None
    found = summarise(ordered, fold, "p0 string, l0 bigint, p1 string, l1 bigint, rows bigint")
    for part in sorted(found):
        s = found[part]
        carry[part] = state
        more = state is not None and state[:2] == (s["p0"], s["l0"]) == (s["p1"], s["l1"])
        state = (s["p1"], s["l1"], s["rows"] + (state[2] if more else 0))

    def scan(state: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, state = step(state, batch)
            length = batch.column(1).to_numpy(zero_copy_only=False)
            codes = batch.column(0).dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            out = np.zeros((3, len(length)), dtype=np.int64)
            for i, plan_id in enumerate(codes.dictionary.to_pylist()):
                mine = which == i
                out[:, mine] = place(shared.value[plan_id], length[mine], rank[mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), *(pa.array(o) for o in out), batch.column(1)],
                names=["plan_id", "key", "piece_no", "container_id", "place", "offset", "tokens"],
            )

    placed = rescan(ordered, carry, scan, f"plan_id string, key {kind}, piece_no bigint, container_id bigint, place bigint, `offset` bigint, tokens bigint")
    return placed.withColumnRenamed("key", key)


def violations(placed: DataFrame, sizes: DataFrame, key: str, tokens: str, plans: DataFrame) -> DataFrame:
    """One row per plan (plan_id, n_texts, split, wrong_size, over_capacity, gaps): texts placed, texts split although they
    fit, texts whose pieces do not add up to them, containers with more than the capacity, and containers whose pieces do
    not lie end to end from 0. The last four are 0 for every packing; keys must be unique."""
    room = F.broadcast(plans.select("plan_id", "capacity_tokens").where("capacity_tokens > 0"))  # a configuration table
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0))
    per = placed.groupBy("plan_id", key).agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("placed"))
    per = per.join(sizes.select(F.col(key), n.alias("wanted")), key).join(room, "plan_id").groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("wanted") <= F.col("capacity_tokens"))).alias("split"), F.count_if(F.col("placed") != F.col("wanted")).alias("wrong_size")
    )
    # sums over places tell a tiling: distinct places 0 .. n - 1, and every piece begins where those before it end
    boxes = placed.groupBy("plan_id", "container_id").agg(
        F.sum("tokens").alias("used"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.min("offset").alias("start"), F.count(F.lit(1)).alias("n"), (F.max("place") + 1).alias("places"),
        F.sum(F.col("tokens") * (2 * F.col("offset") + F.col("tokens"))).alias("area"),
    )
    whole = (F.col("used") == F.col("end")) & (F.col("start") == 0) & (F.col("n") == F.col("places")) & (F.col("area") == F.col("used") * F.col("used"))
    boxes = boxes.join(room, "plan_id").groupBy("plan_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_capacity"), F.count_if(~whole).alias("gaps"))
    return per.join(boxes, "plan_id")


def pattern_report(sizes: DataFrame, key: str, tokens: str, plans: DataFrame) -> DataFrame:
    """(plan_id, n_pieces, in_patterns, share): pieces of texts, and those that the fitted patterns place; the rest are residuals."""
    chosen = {r.plan_id: int(r.capacity_tokens) for r in plans.select("plan_id", "capacity_tokens").collect() if r.capacity_tokens and r.capacity_tokens > 0}
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0))
    rows = []
    for plan, capacity in sorted(chosen.items()):
        counts: dict[int, int] = defaultdict(int)
        whole = sizes.groupBy(F.least(n, F.lit(capacity)).alias("n"), (n / capacity).cast("bigint").alias("full"), (n % capacity).alias("rest")).count()
        per_length = whole.select("count", F.explode(F.when(F.col("full") > 0, F.array(F.struct(F.lit(capacity).cast("bigint").alias("x"), F.col("full").alias("k")), F.struct(F.col("rest").alias("x"), F.lit(1).cast("bigint").alias("k")))).otherwise(F.array(F.struct(F.col("rest").alias("x"), F.lit(1).cast("bigint").alias("k"))))).alias("p"))
        for r in per_length.where("p.x > 0").groupBy("p.x").agg(F.sum(F.col("count") * F.col("p.k")).alias("m")).collect():  # at most capacity rows
            counts[r.x] += r.m
        made, _ = fit_patterns(dict(counts), capacity)
        inside = sum(len(lengths) * k for lengths, k in made)
        rows.append((plan, sum(counts.values()), inside, inside / sum(counts.values()) if counts else None))
    return sizes.sparkSession.createDataFrame(rows, "plan_id string, n_pieces bigint, in_patterns bigint, share double")


def fill(placed: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, container_id, capacity_tokens, n_items, used_tokens, fill) of every container."""
    used = placed.groupBy("plan_id", "container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("used_tokens"))
    return used.join(F.broadcast(plans.select("plan_id", "capacity_tokens")), "plan_id").select(
        "plan_id", "container_id", "capacity_tokens", "n_items", "used_tokens", (F.col("used_tokens") / F.col("capacity_tokens")).alias("fill")
    )


__all__ = ["pack", "fill", "violations", "pattern_report", "pack_histogram", "slots", "place"]
