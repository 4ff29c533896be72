"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Method: the spans are range-sorted by entity and start over the whole cluster, every partition yields its
maximum end, the maxima are combined from left to right, and a second scan carries them in to label the islands. An
island that runs over several partitions comes out as parts with the same label and is put together by one small
aggregation. No entity, however hot, is gathered in one task. Equal spans lie side by side in the order and are told
apart by the partition they were read in, so that the bounds cut also through many copies of one span; the scan counts
them once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.ordered_scan import range_sorted, rescan, summarise

LIMIT_MS = 9_000_000_000_000_000


def milliseconds(seconds: Column) -> Column:
    """Rounded half up, kept within bigint; null for null and NaN."""
    return F.when(~F.isnan(seconds), F.floor(F.greatest(F.least(seconds * 1000, F.lit(float(LIMIT_MS))), F.lit(float(-LIMIT_MS))) + 0.5))


def known_ms(duration: Column) -> Column:
    """A duration that is known (not null, not NaN, above 0), else the greatest there is."""
    return F.when(duration > 0, F.coalesce(milliseconds(duration), F.lit(LIMIT_MS))).otherwise(F.lit(LIMIT_MS))


def cut_ms(start: Column, end: Column, top: Column) -> Column:
    """struct(start_ms, end_ms) of two milliseconds, none null, put in order and cut to 0 and ``top``; without length where nothing is left."""
    return F.struct(F.greatest(F.least(start, end), F.lit(0)).alias("start_ms"), F.least(F.greatest(start, end), top).alias("end_ms"))


def span_ms(start: Column, end: Column, duration: Column) -> Column:
    """A span of seconds as struct(start_ms, end_ms): rounded to milliseconds, put in order, cut to 0 and to the
    duration where that is known (not null, not NaN, above 0). Null or NaN endpoints, and what has no length then, give null.
    """
    span = cut_ms(milliseconds(start), milliseconds(end), known_ms(duration))
    return F.when(start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (span["start_ms"] < span["end_ms"]), span)


def _changes(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """True where the entity differs from that of the row before; the first row is False."""
    out = np.zeros(batch.num_rows, dtype=bool)
    for k in range(n_keys):
        col = batch.column(k).dictionary_encode()
        codes = col.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _with_length(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The spans with start < end. Here and not as a filter of the query, which would be evaluated before, and so with, all
    the arithmetic that makes the ends."""
    for batch in batches:
        batch = batch.filter(pc.less(batch.column(n_keys), batch.column(n_keys + 1)))
        if batch.num_rows:
            yield batch


def _entity(batch: pa.RecordBatch, row: int, n_keys: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in range(n_keys))


def _running_max(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Running maximum that starts anew with each segment; exact for any int64, as it runs on ranks."""
    known, rank = np.unique(values, return_inverse=True)
    top = np.maximum.accumulate(segment * len(known) + rank)
    return known[top - segment * len(known)]


def _label(batch: pa.RecordBatch, state: tuple | None, n_keys: int) -> tuple[dict, tuple]:
    """Islands of one batch after ``state`` = (entity, maximum end, island start, last start, last end)."""
    start = batch.column(n_keys).to_numpy(zero_copy_only=False)
    end = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
    change = _changes(batch, n_keys)
    goes_on = state is not None and state[0] == _entity(batch, 0, n_keys)
    change[0] = not goes_on
    segment = np.cumsum(change)
    top = _running_max(end, segment)
    if goes_on:
        top = np.where(segment == 0, np.maximum(top, state[1]), top)
    before = np.empty_like(top)
    before[1:] = top[:-1]
    before[0] = state[1] if goes_on else 0
    gap = ~change & (start > before)
    copy = np.zeros(len(end), dtype=bool)
    copy[1:] = ~change[1:] & (start[1:] == start[:-1]) & (end[1:] == end[:-1])
    copy[0] = goes_on and (int(start[0]), int(end[0])) == state[3:]
    opens = change | gap
    at = np.where(opens)[0]
    island = np.where(opens, start, 0)
    idx = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), -1))
    island = np.where(idx >= 0, start[np.maximum(idx, 0)], state[2] if goes_on else 0)
    heads = at if len(at) and at[0] == 0 else np.concatenate([[0], at])
    found = {"heads": heads, "island": island[heads], "end": np.maximum.reduceat(end, heads), "n": np.add.reduceat((~copy).astype(np.int64), heads), "gap_rows": np.where(gap)[0], "gap_start": before[gap], "gap_end": start[gap]}
    return found, (_entity(batch, len(end) - 1, n_keys), int(top[-1]), int(island[-1]), int(start[-1]), int(end[-1]))


def _fold(n_keys: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> dict | None:
        first, state = None, None
        for batch in _with_length(batches, n_keys):
            first = first if first is not None else _entity(batch, 0, n_keys)
            _, state = _label(batch, state, n_keys)
        return None if state is None else {"first": list(map(_text, first)), "last": list(map(_text, state[0])), "top": state[1], "island": state[2], "s": state[3], "e": state[4]}

    return fold


def _text(x: object) -> str | None:
    return None if x is None else str(x)


def _combine(summaries: dict[int, dict]) -> dict[int, tuple]:
    """The state each partition starts with. All starts of a partition lie at or after those before it, so a partition
    of one entity leaves either its own last island (it starts after everything before it ended) or the carried one."""
    carry, state = {}, None
    for part in sorted(summaries):
        s = summaries[part]
        if state is not None:
            carry[part] = state
        entity, top, island = tuple(s["last"]), s["top"], s["island"]
        if state is not None and tuple(s["first"]) == entity == state[0]:
            island = island if island > state[1] else state[2]
            top = max(top, state[1])
        state = (entity, top, island, s["s"], s["e"])
    return carry


def merge_spans(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows (*keys, kind, start, end, n_spans): a ``period`` for each union of spans that overlap or touch, with the
    number of different spans in it, and a ``gap`` (n_spans 0) from the end of a period to the start of the next.

    ``start`` and ``end`` are bigint with start < end (other rows drop out); equal spans count once; null keys form
    their own entity; columns beside those named are ignored. An empty frame gives no rows.
    """
    slim = spans.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).alias("s"), F.col(end).alias("e"))
    n = len(keys)
    ordered = range_sorted(slim.withColumn("read", F.spark_partition_id()), *[f"k{i}" for i in range(n)], "s", "e", "read")
    carry = _combine(summarise(ordered, _fold(n), "first array<string>, last array<string>, top bigint, island bigint, s bigint, e bigint"))

    def scan(state: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_length(batches, n):
            made, state = _label(batch, state, n)
            rows = np.concatenate([made["heads"], made["gap_rows"]])
            take = pa.array(rows)
            m, g = len(made["heads"]), len(made["gap_rows"])
            cols = [batch.column(k).take(take) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *cols,
                    pa.array(["period"] * m + ["gap"] * g, pa.string()),
                    pa.array(np.concatenate([made["island"], made["gap_start"]]), pa.int64()),
                    pa.array(np.concatenate([made["end"], made["gap_end"]]), pa.int64()),
                    pa.array(np.concatenate([made["n"], np.zeros(g, dtype=np.int64)]), pa.int64()),
                ],
                names=[f"k{i}" for i in range(n)] + ["kind", "s", "e", "n"],
            )

    schema = ", ".join(f"k{i} string" for i in range(n)) + ", kind string, s bigint, e bigint, n bigint"
    parts = rescan(ordered, carry, scan, schema)
    whole = parts.groupBy(*[f"k{i}" for i in range(n)], "kind", "s").agg(F.max("e").alias("e"), F.sum("n").alias("n"))
    return whole.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "kind", F.col("s").alias(start), F.col("e").alias(end), F.col("n").alias("n_spans"))
