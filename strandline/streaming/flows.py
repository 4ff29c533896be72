"""Incremental flows: windowed counts with late data, messages kept once, a resumable work log.

The windowed counts are an extension of the engine; the other two put the append-and-resume behaviour of the batch side on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, folder: str, name: str, schema, *, files_per_batch: int = 8) -> DataFrame:
    """A Parquet table as a stream, be it one file in ``folder`` or a folder of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def window_counts(events: DataFrame, at: str, by: str, value: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and summed value per window and ``by``; a window is final once the watermark has passed it."""
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), by, "n", "total")


def once(messages: DataFrame, keys: list[str], at: str, *, late: str = "30 days") -> DataFrame:
    """The first arrival of each message within the watermark."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, target: str, checkpoint: str, *, mode: str = "append") -> None:
    """All that is there now, written as Parquet; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()


def work_log(tasks: DataFrame, keys: list[str], log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``work`` on the tasks of each micro-batch that the log does not hold yet and appends what it returns.

    ``work`` returns the keys and its results as rows; rows it leaves out are tried again when they come again. A
    micro-batch that is replayed after a failure finds its keys in the log and adds nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        todo = batch.dropDuplicates(keys)
        if there:
            todo = todo.join(spark.read.parquet(log).select(*keys), keys, "left_anti")
        work(todo).write.mode("append").parquet(log)

    return tasks.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
