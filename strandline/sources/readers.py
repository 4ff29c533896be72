"""Readers for annotation files and model results: JSON arrays and maps, line-wise JSON, delimited files, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BadSource(ValueError):
    """A file that is not what the reader needs."""


def first_mark(spark: SparkSession, path: str) -> str:
    """The first line with text of a file, without outer blanks; only that line is read to the driver."""
    row = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return row[0][0].strip() if row else ""


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file of one JSON array, a row per element; anything but an array is an error."""
    if first_mark(spark, path)[:1] != "[":
        raise BadSource(f"{path}: a JSON array is needed")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file of one JSON object with keys that are data; ``value``: type of the values."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    if text.where("m IS NULL").limit(1).count():
        raise BadSource(f"{path}: a JSON object is needed")
    return text.select(F.explode("m").alias("key", "value"))


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; the first bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): of rows with the same keys the one greatest in ``order`` is kept; lines that do not parse or lack
    a key come out apart. A hot key is reduced to one row per task before the shuffle."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    whole = F.col("_bad").isNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    good = raw.where(whole).drop("_bad")
    last = good.groupBy(*keys).agg(F.max_by(F.struct(*good.columns), F.col(order)).alias("r")).select("r.*")
    return last, raw.where(~whole)


def json_or_jsonl(spark: SparkSession, path: str, schema: str, holders: tuple[str, ...] = ("data", "results", "items", "samples")) -> DataFrame:
    """A JSON array, an object that holds the list under one of ``holders``, a single object, or JSON lines; an empty file has no rows.

    The first line with text decides: a line that is a whole object means JSON lines, so that large files stay splittable.
    """
    head = first_mark(spark, path)
    if not head:
        return spark.createDataFrame([], schema)
    if head[0] == "[":
        return json_array(spark, path, schema)
    line_wise = spark.range(1).select(F.try_parse_json(F.lit(head)).isNotNull().alias("ok")).first().ok
    if line_wise and spark.read.text(path).where(F.trim("value") != "").limit(2).count() > 1:
        return jsonl_strict(spark, path, schema)
    text = spark.read.text(path, wholetext=True)
    lists = [F.from_json(F.get_json_object("value", f"$.{h}"), f"array<struct<{schema}>>") for h in holders]
    return text.select(F.explode(F.coalesce(*lists, F.array(F.from_json("value", schema)))).alias("r")).select("r.*")


def template_keys(spark: SparkSession, path: str) -> DataFrame:
    """(field) of the first record of a JSON array that is not empty."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<map<string, string>>").alias("a"))
    keys = text.select(F.explode(F.map_keys(F.get("a", F.lit(0)))).alias("field"))
    if keys.limit(1).count() == 0:
        raise BadSource(f"{path}: the template has no record")
    return keys


def key_differences(records: DataFrame, text: str, want: list[str]) -> DataFrame:
    """(field, kind, n_records): keys of ``want`` that records lack (``missing``) and keys beyond them (``extra``)."""
    keys = F.json_object_keys(text)
    known = F.array(*map(F.lit, want)).cast("array<string>")
    both = F.concat(F.transform(F.array_except(known, keys), lambda k: F.struct(k.alias("field"), F.lit("missing").alias("kind"))), F.transform(F.array_except(keys, known), lambda k: F.struct(k.alias("field"), F.lit("extra").alias("kind"))))
    return records.select(F.explode(both).alias("d")).groupBy("d.field", "d.kind").agg(F.count(F.lit(1)).alias("n_records"))


def validate_keys(records: DataFrame, text: str, want: list[str]) -> None:
    """Every record must have exactly the keys of ``want``; no records pass."""
    wrong = key_differences(records, text, want).orderBy("kind", "field").limit(20).collect()  # the message's head
    if wrong:
        raise BadSource("; ".join(f"{r.kind} {r.field} in {r.n_records} records" for r in wrong))


def csv_required(spark: SparkSession, path: str, required: list[str], **options: str) -> DataFrame:
    """A delimited file with a header that has at least the required columns, all as text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').options(**options).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise BadSource(f"{path}: columns missing: {', '.join(missing)}")
    return df


def csv_named(spark: SparkSession, path: str, names: list[str], sep: str = ",") -> DataFrame:
    """A delimited file without header under the given names."""
    return spark.read.option("sep", sep).schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.rtrim("value").alias("line"))


def dir_index(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, stem) of the files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"))


def json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file in a tree of folders."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def zip_plan(files: DataFrame) -> DataFrame:
    """Chunks ``name.zip.001`` in the order of their numbers, per archive; what to join and to extract, not the work itself."""
    at = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    base = F.regexp_replace("name", r"[._-]?\d+$", "")
    return files.select(base.alias("archive"), at.alias("chunk"), "name").withColumn("place", F.row_number().over(Window.partitionBy("archive").orderBy("chunk", "name")).cast("bigint"))
