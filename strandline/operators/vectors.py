"""Similarity of a stated set of query vectors to all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, size)


def top_matches(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *, block: int = 4096) -> DataFrame:
    """(query_*key, *key, score, place): the k rows with the greatest dot product to each query, itself left out; ties by key.

    The queries go to every task in blocks of ``block`` vectors, which bounds what is sent at once; each task keeps its
    k best per query, so at most k rows per query and task are shuffled. Null and odd-sized vectors take no part.
    """
    spark = rows.sparkSession
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    kind = dict(rows.dtypes)[key]
    schema = f"query_{key} {kind}, {key} {kind}, score double"
    if first is None:
        return spark.createDataFrame([], schema + ", place bigint")
    size = first["n"]
    good = lambda df: df.where((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).select(F.col(key).alias("key"), F.col(vector).alias("vec"))
    numbered = good(queries).orderBy("key")
    total = numbered.count()
    parts: list[DataFrame] = []
    for low in range(0, total, block):
        some = numbered.offset(low).limit(block).collect()  # one block of vectors
        ids, mat = [r.key for r in some], np.array([r.vec for r in some], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, mat = shared.value
            best: list[list[tuple]] = [[] for _ in ids]
            for b in batches:
                if not b.num_rows:
                    continue
                keys = b.column(0).to_pylist()
                scores = mat @ _matrix(b.column(1), size).T
                take = min(k + 1, len(keys))
                for q, s in enumerate(scores):
                    edge = np.partition(s, -take)[-take]
                    found = best[q] + [(-float(s[i]), keys[i]) for i in np.where(s >= edge)[0] if keys[i] != ids[q]]
                    best[q] = sorted(found)[:k]
            rows_ = [(ids[q], key_, -score) for q, found in enumerate(best) for score, key_ in found]
            cols = list(zip(*rows_)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], like), pa.array(cols[1], like), pa.array(cols[2], pa.float64())], names=[f"query_{key}", key, "score"])

        from pyspark.sql.pandas.types import to_arrow_type

        like = to_arrow_type(rows.schema[key].dataType)
        parts.append(good(rows).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", place bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy(f"query_{key}").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("key")))).alias("m"))  # k per task and query
    return best.select(f"query_{key}", F.posexplode(F.slice("m", 1, k)).alias("p", "x")).select(f"query_{key}", F.col("x.key").alias(key), (-F.col("x.s")).alias("score"), (F.col("p") + 1).cast("bigint").alias("place"))


def target_ranks(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, *, block: int = 1024) -> DataFrame:
    """(target, n_above, n_ties) of each query: rows that score above its target and rows that score the same, counted over all rows.

    The target ``self`` is the row of the query's own key, as on the diagonal of a similarity matrix; ``label`` is the best
    other row of its label, the query itself left out of the count. Queries without a target give no row. The queries go
    to every task in blocks of ``block`` vectors, once for the targets' scores and once for the counts; what is shuffled is
    one row per query and batch of rows. Null and odd-sized vectors take no part. Scores are summed in one order, so that
    both passes agree to the last bit.
    """
    spark = rows.sparkSession
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    schema = "target string, n_above bigint, n_ties bigint"
    if first is None:
        return spark.createDataFrame([], schema)
    size = first["n"]
    good = lambda df: df.where((F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).select(F.col(key).alias("key"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    numbered, whole = good(queries).orderBy("key"), good(rows)
    parts: list[DataFrame] = []
    for low in range(0, numbered.count(), block):
        some = numbered.offset(low).limit(block).collect()  # one block of vectors
        mine = (np.array([r.key for r in some]), np.array([r.vec for r in some], dtype=np.float64), np.array([r.label for r in some], dtype=object))

        def scored(batches: Iterator[pa.RecordBatch], mine: tuple) -> Iterator[tuple]:
            ids, mat, labels = mine
            for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
                vecs = _matrix(batch.column(1), size)
                scores = np.zeros((len(ids), len(vecs)))
                for d in range(size):
                    scores += mat[:, d : d + 1] * vecs[:, d]
                own = ids[:, None] == np.array(batch.column(0).to_pylist())[None, :]
                theirs = np.array(batch.column(2).to_pylist(), dtype=object)
                alike = np.array([[a is not None and a == b for b in theirs] for a in labels]).reshape(own.shape) if len(theirs) else own
                yield scores, own, alike & ~own

        shared = spark.sparkContext.broadcast(mine)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            top = np.full((2, len(shared.value[0])), -np.inf)
            for scores, own, alike in scored(batches, shared.value):
                for t, which in enumerate((own, alike)):
                    top[t] = np.maximum(top[t], np.where(which, scores, -np.inf).max(axis=1, initial=-np.inf))
            t, q = np.nonzero(top > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(q, pa.int64()), pa.array(top[t, q], pa.float64())], names=["t", "q", "score"])

        goal = np.full((2, len(some)), np.nan)
        for r in whole.mapInArrow(best, "t bigint, q bigint, score double").groupBy("t", "q").agg(F.max("score").alias("score")).collect():  # two rows a query of the block
            goal[r.t, r.q] = r.score
        goals = spark.sparkContext.broadcast(goal)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, goals=goals) -> Iterator[pa.RecordBatch]:
            goal = goals.value
            above, ties = np.zeros(goal.shape, dtype=np.int64), np.zeros(goal.shape, dtype=np.int64)
            for scores, own, _ in scored(batches, shared.value):
                for t, among in enumerate((np.ones_like(own), ~own)):
                    above[t] += ((scores > goal[t][:, None]) & among).sum(axis=1)
                    ties[t] += ((scores == goal[t][:, None]) & among).sum(axis=1)
            t, q = np.nonzero(above + ties)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(q, pa.int64()), pa.array(above[t, q], pa.int64()), pa.array(ties[t, q], pa.int64())], names=["t", "q", "above", "ties"])

        counts = whole.mapInArrow(count, "t bigint, q bigint, above bigint, ties bigint").groupBy("t", "q").agg(F.sum("above").alias("n_above"), F.sum("ties").alias("n_ties"))
        parts.append(counts.select(F.when(F.col("t") == 0, "self").otherwise("label").alias("target"), "n_above", "n_ties"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
