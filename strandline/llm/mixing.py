"""Mixing sources to target weights: Pfair scheduling of source blocks.

A mix gets its token targets from the weights; a source that may not be repeated often enough gives all it may, the
others keep their own targets, and the mix is that much smaller: so no source stands further from its share than the
caps force. Every source is laid out in one fixed shuffled order, repeated as often
as its target asks, and cut into blocks of equal size. Block j of a source with weight w is released at slot floor(j/w)
and due at ceil((j+1)/w); earliest deadline first over the released blocks puts each source within one block of its
share at every point of the mix.

No block has more than ``block_tokens`` tokens, whatever the size of the mix. Weights are shares of one hyperperiod of at most
``period_blocks`` slots and one more per source: every source is cut into as many equal blocks per hyperperiod, the
schedule of one hyperperiod is computed on the driver, and it is repeated until the sources are used up, which all are
at the end of the last one. The documents get their positions by one global sort.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import range_sorted, rescan, summarise


@dataclass
class Share:
    """What one source gives to one mix."""

    weight: float
    cap: int | None
    supply: int
    wanted: float = 0.0
    tokens: int = 0
    limited_by: str | None = None
    slots: np.ndarray | None = None  # of one hyperperiod


@dataclass
class Part:
    """A source's part of a mix as the tasks need it: ``tokens`` in ``periods`` times ``len(slots)`` equal blocks."""

    mix: str
    tokens: int
    supply: int
    periods: int
    width: int
    slots: np.ndarray

    def at(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and place of the pieces that start at the given tokens of the source."""
        per = len(self.slots)
        total = self.periods * per
        block = np.minimum((start.astype(object) * total // self.tokens if self.tokens * total > 2**62 else start * total // self.tokens).astype(np.int64), total - 1)
        first = -(-(block.astype(object) * self.tokens if self.tokens * total > 2**62 else block * self.tokens) // total)
        return block // per * self.width + self.slots[block % per], start - np.asarray(first, dtype=np.int64)


def targets(sources: dict[str, Share], total: float) -> None:
    """Sets wanted and tokens: each source its weight's share of the total size, or all that its cap allows."""
    weight = sum(s.weight for s in sources.values())
    if not weight or not total > 0:
        return
    for s in sources.values():
        s.wanted = total * s.weight / weight
        most = math.inf if s.cap is None and s.supply else s.supply * (s.cap or 0)
        s.tokens = round(min(s.wanted, most))
        if most < s.wanted:
            s.limited_by = "max_repeats" if s.supply else "no documents"


def schedule(blocks: dict[str, int]) -> dict[str, np.ndarray]:
    """Slots of the blocks of each source by earliest deadline first; ties go to the larger source, then by name."""
    total = sum(blocks.values())
    out = {k: np.zeros(n, dtype=np.int64) for k, n in blocks.items()}
    waiting = [(0, k, 0) for k, n in blocks.items() if n]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    for slot in range(total):
        while waiting and (waiting[0][0] <= slot or not ready):
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // blocks[k]), -blocks[k], k, j))
        _, _, k, j = heapq.heappop(ready)
        out[k][j] = slot
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * total // blocks[k], k, j + 1))
    return out


def plan_mixes(mixes: list, supply: dict[str, int], everything: int, block_tokens: int, period_blocks: int) -> tuple[dict[str, dict[str, Share]], dict[str, int]]:
    """({mix: {source: share}}, {mix: hyperperiods}). Rows of a mix with the same source add their weights, the
    smallest cap holds; null, negative and NaN weights count as 0; a null cap is none, a negative one is 0."""
    plans: dict[str, dict[str, Share]] = defaultdict(dict)
    size: dict[str, float] = {}
    for r in mixes:
        if r.mix_id is None or r.source is None:
            continue
        w = r.target_weight if r.target_weight is not None and r.target_weight > 0 and math.isfinite(r.target_weight) else 0.0
        cap = None if r.max_repeats is None else max(int(r.max_repeats), 0)
        s = plans[r.mix_id].setdefault(r.source, Share(0.0, None, supply.get(r.source, 0)))
        s.weight += w
        s.cap = cap if s.cap is None else s.cap if cap is None else min(s.cap, cap)
        size[r.mix_id] = max(size.get(r.mix_id, 0.0), r.size_share or 0.0)
    periods: dict[str, int] = {}
    for mix, sources in plans.items():
        targets(sources, size[mix] * everything)
        chosen = sum(s.tokens for s in sources.values())
        periods[mix] = max(1, -(-chosen // (block_tokens * period_blocks)))
        slots = schedule({k: -(-s.tokens // (block_tokens * periods[mix])) for k, s in sorted(sources.items())})
        for k, s in sources.items():
            s.slots = slots[k]
    return dict(plans), periods


def mix(sizes: DataFrame, key: str, source: str, tokens: str, mixes: DataFrame, *, block_tokens: int = 4096, period_blocks: int = 65_536, repeats: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: (mix_id, slot, place, *key, source, repeat_no, tokens): in order of (mix_id, slot, place) the mix itself;
    ``repeat_no`` counts the uses of a document from 0. Documents of 0 tokens and of null source are in no mix; the
    size of a mix is its ``size_share`` of the tokens of all documents. The selection differs from the target of a
    source by less than one document. ``repeats``: so many uses of a document are made by one task; where a source asks
    for more, the uses are spread over the cluster. Neither it nor ``period_blocks`` changes what is chosen. shares: one row per mix and source with wanted and reached tokens and shares,
    also for sources that give nothing. ``mixes`` is a configuration table and is collected.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)[key]
    wanted = [r for r in mixes.select("mix_id", "source", "target_weight", "max_repeats", "size_share").collect()]
    names = sorted({r.source for r in wanted if r.source is not None})
    rows = sizes.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"))
    few = spark.createDataFrame([(n,) for n in names], "source string")
    used = rows.where("tokens > 0").join(F.broadcast(few), "source", "left_semi")
    everything = rows.agg(F.sum("tokens")).first()[0] or 0
    ordered = range_sorted(used.select("source", F.xxhash64("key").alias("h"), "key", "tokens"), "source", "h", "key")
    supply = {r.source: r.n for r in ordered.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # sources of the targets only
    plans, periods = plan_mixes(wanted, supply, everything, block_tokens, period_blocks)
    by_source: dict[str, list[Part]] = defaultdict(list)
    for m in sorted(plans):
        width = sum(len(s.slots) for s in plans[m].values())
        for k, s in plans[m].items():
            if s.tokens:
                by_source[k].append(Part(m, s.tokens, supply[k], periods[m], width, s.slots))
    shared = spark.sparkContext.broadcast(dict(by_source))

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        first = last = None
        total = 0
        for b in batches:
            codes, n = b.column(0).to_pylist(), b.column(3).to_numpy(zero_copy_only=False)
            first = codes[0] if first is None else first
            if codes[0] == codes[-1]:
                total = int(n.sum()) + (total if codes[0] == last else 0)
            else:
                total = int(n[np.array([c == codes[-1] for c in codes])].sum())
            last = codes[-1]
        return None if first is None else {"first": first, "last": last, "total": total}

    carry, state = {}, None
    found = summarise(ordered, fold, "first string, last string, total bigint")
    for part in sorted(found):
        s = found[part]
        carry[part] = state
        state = (s["last"], s["total"] + (state[1] if state is not None and state[0] == s["first"] == s["last"] else 0))

    uses = f"number int, source string, key {kind}, tokens bigint, before bigint, first bigint, n bigint"

    def scan(state: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Uses of each document by each mix, at most ``repeats`` in a row; ``number`` is the mix's place among the source's."""
        for b in batches:
            codes = np.array(b.column(0).to_pylist(), dtype=object)
            n = b.column(3).to_numpy(zero_copy_only=False)
            ends = np.where(np.append(codes[1:] != codes[:-1], True))[0] + 1
            at = 0
            for end in ends:
                name, size = codes[at], n[at:end]
                before = np.cumsum(size) - size + (state[1] if state is not None and state[0] == name else 0)
                state = (name, int(before[-1] + size[-1]))
                for number, part in enumerate(shared.value.get(name, ())):
                    passes, rest = divmod(part.tokens, part.supply)
                    times = passes + (2 * before + size < 2 * rest)
                    first = 0
                    while (row := np.where(times > first)[0]).size:  # a document with many uses goes on in further batches
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(row), number), pa.int32()), pa.array([name] * len(row), pa.string()), b.column(2).take(pa.array(row + at)), pa.array(size[row], pa.int64()),
                                pa.array(before[row], pa.int64()), pa.array(np.full(len(row), first), pa.int64()), pa.array(np.minimum(times[row] - first, repeats), pa.int64()),
                            ],
                            names=["number", "source", "key", "tokens", "before", "first", "n"],
                        )
                        first += repeats
                at = end

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per use, from no more than some 100,000 at a time."""
        for b in batches:
            b = b.take(pa.compute.sort_indices(b, [("source", "ascending"), ("number", "ascending")]))
            number, size, before, first, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5, 6))
            source = b.column(1).to_numpy(zero_copy_only=False)
            change = np.where(np.append((source[1:] != source[:-1]) | (number[1:] != number[:-1]), True))[0] + 1
            at = 0
            for end in change:
                part = shared.value[source[at]][number[at]]
                while at < end:
                    stop = at + max(1, int(np.searchsorted(np.cumsum(n[at:end]), 100_000, side="right")))
                    row = np.repeat(np.arange(at, stop), n[at:stop])
                    repeat = np.arange(len(row)) - np.repeat(np.cumsum(n[at:stop]) - n[at:stop], n[at:stop]) + first[row]
                    slot, place = part.at(repeat * part.supply + before[row])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.mix] * len(row), pa.string()), pa.array(slot, pa.int64()), pa.array(place, pa.int64()), b.column(2).take(pa.array(row)),
                            pa.array([source[at]] * len(row), pa.string()), pa.array(repeat, pa.int64()), pa.array(size[row], pa.int64()),
                        ],
                        names=["mix_id", "slot", "place", "key", "source", "repeat_no", "tokens"],
                    )
                    at = stop

    used_by = rescan(ordered, carry, scan, uses)
    if any(part.tokens // part.supply >= repeats for parts in by_source.values() for part in parts):
        used_by = used_by.repartition("key", "first")  # a small source asked for often lies in few tasks
    chosen = used_by.mapInArrow(expand, f"mix_id string, slot bigint, place bigint, key {kind}, source string, repeat_no bigint, tokens bigint")
    config = [(m, k, float(s.weight), s.cap, int(s.supply), float(s.wanted), s.limited_by) for m, sources in sorted(plans.items()) for k, s in sorted(sources.items())]
    plan = spark.createDataFrame(config, "mix_id string, source string, weight double, max_repeats int, supply_tokens bigint, wanted_tokens double, limited_by string")
    reached = chosen.groupBy("mix_id", "source").agg(F.sum("tokens").alias("reached_tokens"), F.count(F.lit(1)).alias("n_uses"), (F.max("repeat_no") + 1).alias("most_uses"))
    both = plan.join(reached, ["mix_id", "source"], "left").fillna(0, ["reached_tokens", "n_uses", "most_uses"])
    sums = both.groupBy("mix_id").agg(F.sum("weight").alias("w"), F.sum("reached_tokens").alias("t"), F.sum("wanted_tokens").alias("whole"))  # a few rows per mix
    shares = both.join(F.broadcast(sums), "mix_id").select(
        "mix_id", "source", F.try_divide("weight", "w").alias("wanted_share"), F.try_divide(F.col("reached_tokens").cast("double"), F.col("t").cast("double")).alias("reached_share"),
        F.try_divide(F.col("reached_tokens").cast("double"), F.col("whole")).alias("share_of_wanted_size"), "wanted_tokens", "reached_tokens", "supply_tokens", "max_repeats", "n_uses", "most_uses", "limited_by",
    )
    return chosen.withColumnRenamed("key", key), shares


def violations(chosen: DataFrame, sizes: DataFrame, key: str, source: str, tokens: str, mixes: DataFrame) -> DataFrame:
    """One row per mix and source of ``mixes`` (mix_id, source, over_cap, repeated_use, wrong_source, off_target): documents used more often
    than allowed, uses counted twice, uses under another source than the document's, and whether the source's tokens differ
    from its target, or from all that its cap allows, by a document or more. All are 0 for every mix; keys must be unique."""
    n = F.greatest(F.coalesce(F.col(tokens), F.lit(0)).cast("bigint"), F.lit(0))
    docs = sizes.select(F.col(key), F.col(source).alias("own"), n.alias("n"))
    per = docs.where("own IS NOT NULL").groupBy(F.col("own").alias("source")).agg(F.sum("n").alias("supply"), F.max("n").alias("longest"))
    total = F.broadcast(docs.agg(F.sum("n").alias("everything")))  # one row
    weight = F.when((F.col("target_weight") > 0) & (F.col("target_weight") < float("inf")), F.col("target_weight")).otherwise(0.0)
    want = mixes.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.sum(weight).alias("w"), F.min("max_repeats").alias("cap"), F.max("size_share").alias("size_share"))
    whole = want.groupBy("mix_id").agg(F.sum("w").alias("weights"), F.max("size_share").alias("share"))
    want = F.broadcast(want.drop("size_share").join(whole, "mix_id"))  # a configuration table
    uses = chosen.groupBy("mix_id", "source", key).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("repeat_no").alias("different"), F.sum("tokens").alias("reached"))
    uses = uses.join(docs, key, "left").join(want.select("mix_id", "source", "cap"), ["mix_id", "source"], "left").groupBy("mix_id", "source").agg(
        F.count_if(F.col("uses") > F.col("cap")).alias("over_cap"), F.count_if(F.col("uses") != F.col("different")).alias("repeated_use"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("wrong_source"), F.sum("reached").alias("reached")
    )
    both = want.join(per, "source", "left").crossJoin(total).join(uses, ["mix_id", "source"], "left").fillna(0, ["supply", "longest", "over_cap", "repeated_use", "wrong_source", "reached"])
    goal = F.coalesce(F.try_divide(F.col("everything") * F.col("share") * F.col("w"), F.col("weights")), F.lit(0.0))
    most = F.when(F.col("cap").isNotNull(), F.col("supply") * F.greatest(F.col("cap"), F.lit(0))).when(F.col("supply") == 0, F.lit(0))
    off = F.abs(F.col("reached") - F.least(goal, most)) > F.col("longest") + 1
    return both.select("mix_id", "source", "over_cap", "repeated_use", "wrong_source", off.cast("int").alias("off_target"))
