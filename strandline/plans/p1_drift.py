"""Problem 1: result files whose fields change within a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.schema_drift import drift, unify
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


@R.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(table(spark, sf_dir, "result_lines")).select("file_id", "field", "change_kind")


@R.add("p1_change_report")
def p1_change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per kind and field name, with the number of files and streams they occur in."""
    files = table(spark, sf_dir, "result_lines").select("file_id", "stream_id").distinct()
    found = drift(table(spark, sf_dir, "result_lines")).join(files, "file_id")
    return found.groupBy("change_kind", "field").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("stream_id").alias("n_streams"))


@R.add("p1_results")
def p1_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All result lines as one table of one schema."""
    return unify(table(spark, sf_dir, "result_lines"))


@R.add(
    "p1_check",
    """WITH v AS (SELECT r.row_id, count(*) AS n FROM result_lines r, json_tree(r.line_text::JSON) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%' GROUP BY ALL)
SELECT file_id, count(*) AS n_lines, sum(coalesce(n, 0))::BIGINT AS n_values FROM result_lines LEFT JOIN v USING (row_id) GROUP BY file_id""",
)
def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file in the one table, and their values in any column or in ``extra``: none may be lost or doubled."""
    rows = p1_results(spark, sf_dir)
    values = [c for c in rows.columns if c not in ("row_id", "file_id", "stream_id", "line_no", "extra")]
    inside = F.size(F.filter(F.map_values(F.from_json("extra", "map<string, string>")), lambda v: v.isNotNull()))
    n = sum((F.col(f"`{c}`").isNotNull().cast("bigint") for c in values), F.lit(0).cast("bigint")) + F.coalesce(inside, F.lit(0))
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(n).alias("n_values"))
