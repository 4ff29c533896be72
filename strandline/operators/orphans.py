"""References to records that do not exist, with the reason, by a skew-aware split.

References are counted per key and period first. The few keys that hold a large share of them are checked against a
broadcast extract of the target; the rest goes through a shuffle anti-join. Both sides' orphans, as rows or as counts,
are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.intervals import merge_spans
from strandline.session import cut

FAR_US = 9_000_000_000_000_000_000


def alive_periods(targets: DataFrame, keys: list[str], loaded: str, deleted: str) -> DataFrame:
    """(*keys, from_us, to_us): when at least one record of the key was there, from ``loaded`` up to, but without, ``deleted``.

    A record without ``loaded`` never was; one without ``deleted`` still is. The periods of a key come from the
    interval merge, which gathers no key in one task.
    """
    lives = targets.select(*keys, F.unix_micros(loaded).alias("from_us"), F.coalesce(F.unix_micros(deleted), F.lit(FAR_US)).alias("to_us"))
    return merge_spans(lives.where("from_us IS NOT NULL"), keys, "from_us", "to_us").where("kind = 'period'").select(*keys, "from_us", "to_us")


def heavy_keys(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys with more than ``share`` of all references that ``counts`` (*keys, n) holds: never more than ``1 / share`` rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") > total * share).select(*keys)


@dataclass
class Split:
    """References and target, each as the part of the heavy keys and the rest, under names that clash with none."""

    keys: list[str]
    target_keys: list[str]
    at_us: str
    from_us: str
    to_us: str
    first_us: str
    known: str
    hot: DataFrame
    alive: DataFrame
    info: DataFrame
    broadcast_rows: int

    def same(self, left: DataFrame, right: DataFrame) -> Column:
        cond = F.lit(True)
        for k, t in zip(self.keys, self.target_keys):
            cond = cond & (left[k] == right[t])
        return cond

    def parts(self, rows: DataFrame) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
        """(rows, live periods, info) of the heavy keys and of the rest."""
        hot = F.broadcast(self.hot)
        alive, info = self.alive.join(hot, self.target_keys, "left_semi"), self.info.join(hot, self.target_keys, "left_semi")
        small = alive.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows
        heavy = (rows.join(hot, self.same(rows, hot), "left_semi"), F.broadcast(alive) if small else alive, F.broadcast(info))
        return [heavy, (rows.join(hot, self.same(rows, hot), "left_anti"), self.alive, self.info)]

    def reasons(self, orphans: DataFrame, info: DataFrame, first: str, last: str) -> DataFrame:
        """``orphans`` with ``reason``, null where it changes between the times ``first`` and ``last``."""
        known, loaded = F.col(self.known), F.col(self.first_us)
        reason = F.when(known.isNull(), "missing").when(loaded <= F.col(first), "deleted").when(loaded.isNull() | (loaded > F.col(last)), "late")
        return orphans.join(info, self.same(orphans, info), "left").withColumn("reason", reason)


def _split(refs: DataFrame, targets: DataFrame, keys: list[str], at: str, loaded: str, deleted: str, share: float, broadcast_rows: int) -> tuple[DataFrame, Split]:
    taken = {c.lower() for c in refs.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        return name

    at_us, from_us, to_us, first_us, known = (free(x) for x in ("at_us", "from_us", "to_us", "first_us", "known"))
    tk = [free(f"t_{k}") for k in keys]
    rows = refs.withColumn(at_us, F.unix_micros(at)).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) + f" AND `{at_us}` IS NOT NULL")
    there = targets.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    as_target = [F.col(k).cast("string").alias(t) for k, t in zip(keys, tk)]
    alive = alive_periods(there, keys, loaded, deleted).select(*as_target, F.col("from_us").alias(from_us), F.col("to_us").alias(to_us))
    info = there.groupBy(*keys).agg(F.min(F.unix_micros(loaded)).alias(first_us)).select(*as_target, first_us, F.lit(True).alias(known))
    counts = rows.groupBy(*[F.col(k).cast("string").alias(k) for k in keys], F.trunc(at, "month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    hot = cut(heavy_keys(counts, keys, share).select(*[F.col(k).alias(t) for k, t in zip(keys, tk)]))
    return rows, Split(keys, tk, at_us, from_us, to_us, first_us, known, hot, alive, info, broadcast_rows)


def find_orphans(
    refs: DataFrame, targets: DataFrame, keys: list[str], at: str, loaded: str, deleted: str, *, share: float = 1e-4, broadcast_rows: int = 200_000
) -> DataFrame:
    """The rows of ``refs`` whose key has no live record in ``targets`` at the time ``at``, with ``period`` (month) and ``reason``.

    ``missing``: the target never holds the key; ``deleted``: some record of it had been loaded by then; ``late``: all
    were loaded afterwards (a record without load time counts as never loaded by then). References with a null key or a
    null time are no orphans. Repeated references count each. A key is heavy by its ``share`` of the references alone, so
    at most ``1 / share`` keys are, each about as much as one of as many shuffle partitions. ``broadcast_rows`` is a memory bound: with more live periods the heavy keys take a shuffle join, where adaptive
    execution splits their partitions; rows are the same either way. Columns of ``targets`` beside those named are
    ignored; ``refs`` keeps all of its own.
    """
    rows, split = _split(refs, targets, keys, at, loaded, deleted, share, broadcast_rows)
    found = None
    for part, alive, info in split.parts(rows):
        lives = split.same(part, alive) & (part[split.at_us] >= alive[split.from_us]) & (part[split.at_us] < alive[split.to_us])
        made = split.reasons(part.join(alive, lives, "left_anti"), info, split.at_us, split.at_us)
        found = made if found is None else found.unionByName(made)
    return found.withColumn("period", F.trunc(at, "month")).select(*refs.columns, "period", "reason")


def count_orphans(
    refs: DataFrame, targets: DataFrame, keys: list[str], at: str, loaded: str, deleted: str, by: list[str], *, share: float = 1e-4, broadcast_rows: int = 200_000
) -> DataFrame:
    """(*by, period, reason, n): the orphans of :func:`find_orphans` counted.

    References are aggregated per ``by``, key and period before any join; a group whose times all lie within one live
    period has no orphan, one whose times lie in none is counted whole. Only groups in which that, or the reason,
    changes between their first and last time are looked at by row.
    """
    rows, split = _split(refs.select(*dict.fromkeys([*by, *keys, at])), targets, keys, at, loaded, deleted, share, broadcast_rows)
    rows = rows.withColumn("period", F.trunc(at, "month"))
    key = list(dict.fromkeys([*by, *keys, "period"]))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(split.at_us).alias("_low"), F.max(split.at_us).alias("_high"))
    whole = None
    for part, alive, info in split.parts(groups):
        meets = split.same(part, alive) & (part["_high"] >= alive[split.from_us]) & (part["_low"] < alive[split.to_us])
        inside = (F.col(split.from_us) <= F.col("_low")) & (F.col(split.to_us) > F.col("_high"))
        met = part.join(alive, meets, "left").groupBy(*key, "n", "_low", "_high").agg(F.coalesce(F.max(inside), F.lit(False)).alias("_inside"), F.count(split.from_us).alias("_met"))
        made = split.reasons(met.where("NOT _inside"), info, "_low", "_high").withColumn("reason", F.when(F.col("_met") == 0, F.col("reason")))
        made = made.select(*key, "n", "reason")
        whole = made if whole is None else whole.unionByName(made)
    out = [*by, "period", "reason"]
    unsure = whole.where("reason IS NULL").select(*[F.col(c).alias(f"_g_{i}") for i, c in enumerate(key)])
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    some = rows.join(unsure, same, "left_semi").drop(split.at_us, "period")
    by_row = find_orphans(some, targets, keys, at, loaded, deleted, share=share, broadcast_rows=broadcast_rows).select(*out, F.lit(1).alias("n"))
    return whole.where("reason IS NOT NULL").select(*out, "n").unionByName(by_row).groupBy(*out).agg(F.sum("n").alias("n"))
