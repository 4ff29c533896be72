"""Writers: JSON, JSON lines, delimited files, reports, one output per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object per line, non-ASCII as it is; ``append`` adds files, so finished work is never written again."""
    df.write.mode(mode).json(path)


def json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """One indented JSON array in the single file ``array.json`` of the folder ``path``, in order.

    The elements are sorted and formatted by all tasks, as parts of the folder; the parts are then copied behind one
    another as a stream, so that no task and no driver holds more than a buffer of them.
    """
    spark = df.sparkSession
    rows = df.orderBy(*order).select(F.concat(F.lit(",\n"), F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})).alias("value"))
    rows.write.text(f"{path}/_parts")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder, "_parts")) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(folder, "array.json"))
    out.write(bytearray(b"[\n"))
    for i, part in enumerate(parts):
        into = fs.open(part)
        if i == 0:
            into.skip(2)  # the comma before the first element
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, conf, False)
        into.close()
    out.write(bytearray(b"]"))
    out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder, "_parts"), True)


def csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.option("header", header).option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def pairs(df: DataFrame, path: str, keys: list[str]) -> None:
    """Keys separated by tabs, without header."""
    csv(df.select(*keys), path, "\t", False)


def per_shard(df: DataFrame, path: str, shard: str) -> None:
    """One folder per shard."""
    df.write.partitionBy(shard).json(path)


def report(counts: DataFrame, name: str, value: str, title: str):
    """A counter table as one text: title, then ``name: value`` by falling value."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("o"), F.col(name).alias("n"), F.col(value).alias("v")))), lambda x: F.concat_ws(": ", x["n"], x["v"].cast("string")))
    return counts.agg(F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")).alias("text"))
