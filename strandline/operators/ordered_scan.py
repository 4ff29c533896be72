"""Scans over globally sorted rows: the frame is range-sorted once, each partition is summarised, the summaries (one
per partition, so bounded by their number and not by the rows) are combined on the driver, and a second pass over the
same partitions starts each one with the state that its predecessors leave behind.

A hot key is no special case: the range bounds cut through it as through any other run of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandline.session import cut


def range_sorted(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in one global order, kept in the shared folder so that two passes see the same partitions."""
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by))


def summarise(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], dict | None], schema: str) -> dict[int, dict]:
    """One row for each partition that has rows; ``fold`` makes it. Collected: at most one row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = fold(b for b in batches if b.num_rows)
        if made is not None:
            yield pa.RecordBatch.from_pylist([made | {"part": part}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(f"part int, {schema}"))
    return {row["part"]: row.asDict() for row in df.mapInArrow(run, f"part int, {schema}").collect()}


def rescan(df: DataFrame, carry: dict[int, object], scan: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Second pass: ``scan`` gets the carried state of its partition and the partition's batches in order."""
    shared = df.sparkSession.sparkContext.broadcast(carry)  # as many entries as partitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(shared.value.get(TaskContext.get().partitionId()), (b for b in batches if b.num_rows))

    return df.mapInArrow(run, schema)
