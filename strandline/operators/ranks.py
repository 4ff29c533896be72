"""Places, percentiles and rolling windows over globally sorted rows: no group, however hot, is gathered in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import range_sorted, rescan, summarise


def _codes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from that of the row before; the first row is True."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def _key(batch: pa.RecordBatch, row: int, keys: list[str]) -> list[str | None]:
    return [None if (v := batch.column(k)[row].as_py()) is None else str(v) for k in keys]


def ranked(df: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place from 0 of each row among those with its ``keys``, in the ascending order of ``by``.

    Null keys are one group; rows that are equal in ``by`` get their places in any order. Without keys: one group.
    """
    ordered = range_sorted(df, *keys, *by)

    def step(state: tuple | None, batch: pa.RecordBatch) -> tuple[np.ndarray, tuple]:
        new = _codes(batch, keys)
        heads = np.where(new)[0]
        place = np.arange(batch.num_rows) - heads[np.cumsum(new) - 1]
        if state is not None and state[0] == _key(batch, 0, keys):
            place[: heads[1] if len(heads) > 1 else batch.num_rows] += state[1]
        return place, (_key(batch, batch.num_rows - 1, keys), int(place[-1]) + 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        first, state = None, None
        for batch in batches:
            first = _key(batch, 0, keys) if first is None else first
            _, state = step(state, batch)
        return None if state is None else {"first": first, "last": state[0], "n": state[1]}

    carry, state = {}, None
    found = summarise(ordered, fold, "first array<string>, last array<string>, n bigint")
    for part in sorted(found):
        s = found[part]
        carry[part] = state
        more = state is not None and state[0] == s["first"] == s["last"]
        state = (s["last"], s["n"] + (state[1] if more else 0))

    def scan(state: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, state = step(state, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    return rescan(ordered, carry, scan, f"{schema}, `{name}` bigint")


def running_sum(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum (bigint) of ``value`` over all rows up to each one in the ascending order of ``by``; null counts as 0."""
    ordered = range_sorted(df, *by)
    of = lambda b: b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = summarise(ordered, lambda batches: {"n": sum(parts)} if (parts := [int(of(b).sum()) for b in batches]) else None, "n bigint")
    carry, total = {}, 0
    for part in sorted(found):
        carry[part] = total
        total += found[part]["n"]

    def scan(state: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = state or 0
        for b in batches:
            sums = upto + np.cumsum(of(b))
            upto = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.int64())], names=[*b.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes)
    return rescan(ordered, carry, scan, f"{schema}, `{name}` bigint")


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row (n, *shares): the smallest value that at least the share of the non-null values does not exceed; null for an
    empty column. Values are counted first, so a value that many rows hold is one row of the sort."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ordered = range_sorted(counts, "v")
    found = summarise(ordered, lambda batches: {"n": n} if (n := sum(int(b.column("n").to_numpy().sum()) for b in batches)) else None, "n bigint")
    carry, total = {}, 0
    for part in sorted(found):
        carry[part] = total
        total += found[part]["n"]
    wanted = dict(shares)

    def scan(state: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = state or 0
        for b in batches:
            ends = upto + np.cumsum(b.column("n").to_numpy())
            rows = [(k, float(b.column("v")[i].as_py())) for k, p in wanted.items() if upto < (need := max(p * total, 1e-9)) <= ends[-1] for i in [int(np.searchsorted(ends, need - 1e-9))]]
            upto = int(ends[-1])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["name", "v"])

    picked = rescan(ordered, carry, scan, "name string, v double")
    return picked.agg(F.lit(total).cast("bigint").alias("n"), *[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted])


def rolling(df: DataFrame, key: str, by: list[str], row: str, value: str, width: int) -> DataFrame:
    """(*row, median, top, mean) over the last ``width`` values of a row's ``key`` up to it, in the ascending order of ``by``:
    the lower median, the maximum and the mean. Null and NaN values take a place but no part."""
    ordered = range_sorted(df.select(F.col(key).cast("string").alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(by)], F.col(row).alias("r"), F.col(value).cast("double").alias("v")), "k", *[f"o{i}" for i in range(len(by))])
    kind = dict(df.dtypes)[row]
    tail = width - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        ks: list[str | None] = []
        vs: list[float | None] = []
        for b in batches:
            ks, vs = (ks + b.column("k").to_pylist())[-tail:] if tail else [], (vs + b.column("v").to_pylist())[-tail:] if tail else []
        return {"k": ks, "v": vs} if ks else None

    carry: dict[int, tuple[list, list]] = {}
    ks, vs = [], []
    found = summarise(ordered, fold, "k array<string>, v array<double>")
    for part in sorted(found):
        carry[part] = (ks, vs)
        ks, vs = (ks + list(found[part]["k"]))[-tail:], (vs + list(found[part]["v"]))[-tail:]

    def scan(state: tuple[list, list] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, vs = state or ([], [])
        for b in batches:
            k = pa.array([*[None] * (tail - len(ks)), *ks], pa.string())
            both = pa.concat_arrays([k, b.column("k").cast(pa.string())])
            codes = both.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes[: tail - len(ks)] = -2  # no row
            v = np.concatenate([np.full(tail - len(ks), np.nan), np.array([np.nan if x is None else x for x in vs], dtype=float), b.column("v").to_numpy(zero_copy_only=False).astype(float)])
            window = np.lib.stride_tricks.sliding_window_view
            mine = np.where(window(codes, width) == codes[tail:, None], window(v, width), np.nan)
            ordered_ = np.sort(mine, axis=1)  # NaN last
            n = np.sum(~np.isnan(mine), axis=1)
            at = np.arange(len(n))
            low = np.where(n > 0, ordered_[at, np.maximum((n - 1) // 2, 0)], np.nan)
            top = np.where(n > 0, ordered_[at, np.maximum(n - 1, 0)], np.nan)
            mean = np.nansum(mine, axis=1) / np.maximum(n, 1)
            no = n == 0
            yield pa.RecordBatch.from_arrays([b.column("r"), *(pa.array(x, pa.float64(), mask=no) for x in (low, top, mean))], names=["r", "median", "top", "mean"])
            ks, vs = (both.to_pylist()[-tail:], v.tolist()[-tail:]) if tail else ([], [])

    return rescan(ordered, carry, scan, f"r {kind}, median double, top double, mean double").withColumnRenamed("r", row)
