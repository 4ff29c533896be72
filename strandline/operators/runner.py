"""Calls to something outside of the engine, one per row, with the caller injected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delay(attempt: int, most: float = 30.0) -> float:
    """Seconds to wait after a failed attempt, counted from 1: twice as long each time, up to ``most``."""
    return min(2.0**attempt, most)


def call(df: DataFrame, key: str, payload: str, make: Callable[[], Callable[[str | None], str | None]], *, at_once: int = 8, attempts: int = 1, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(*key, status, reply, attempts): ``make`` builds the client once per task, the client takes a payload and returns a reply.

    A failing call is tried again, ``attempts`` times in all, after growing waits. One that fails to the end gives ``error`` with the message as
    reply and fails nothing else; so a later run repeats just these. Up to ``at_once`` calls of a task run side by side; order is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()

        def one(p: str | None) -> tuple[str, str | None, int]:
            for attempt in range(1, attempts + 1):
                try:
                    return "ok", client(p), attempt
                except Exception as e:  # noqa: BLE001 - whatever the client raises is this row's result
                    if attempt == attempts:
                        return "error", f"{type(e).__name__}: {e}", attempt
                    sleep(delay(attempt))
            return "error", "no attempt", 0

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                made = list(pool.map(one, b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int32())], names=["key", "status", "reply", "attempts"])

    kind = dict(df.dtypes)[key]
    made = df.select(F.col(key).alias("key"), F.col(payload).cast("string").alias("payload")).mapInArrow(run, f"key {kind}, status string, reply string, attempts int")
    return made.withColumnRenamed("key", key)


def distinct_call(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], str | None]], out: str) -> DataFrame:
    """``df`` with the reply for each value of ``column``; every distinct value is asked once."""
    asked = df.select(column).where(F.col(column).isNotNull()).distinct()
    got = call(asked.withColumn("_p", F.col(column)), column, "_p", make).select(column, F.when(F.col("status") == "ok", F.col("reply")).alias(out))
    return df.join(got, column, "left")
