"""Problem 2: candidate and coverage rows that name anchors which were not there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import QID_SQL, VIDEO_SQL, qid_key, video_key
from strandline.operators.orphans import count_orphans, find_orphans
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, ref_id: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("ref_table"), F.col(ref_id).alias("ref_id"), video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"), "created_at"
        )

    return of("suff_correct_insuff_wrong", "cand_id").unionByName(of("uniform_coverage_report", "report_id"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cgbench_filtered").select(video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"), "loaded_at", "deleted_at")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(references(spark, sf_dir), anchors(spark, sf_dir), ["video_id", "qid"], "created_at", "loaded_at", "deleted_at")


ORPHANS_SQL = f"""
refs AS (
  SELECT 'suff_correct_insuff_wrong' AS ref_table, cand_id AS ref_id, {VIDEO_SQL.format('video_id')} AS video_id, CAST(qid AS VARCHAR) AS qid, created_at FROM suff_correct_insuff_wrong
  UNION ALL
  SELECT 'uniform_coverage_report', report_id, {VIDEO_SQL.format('video_id')}, {QID_SQL.format('qid')}, created_at FROM uniform_coverage_report
),
anchors AS (SELECT {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid, loaded_at, deleted_at FROM cgbench_filtered),
checked AS (
  SELECT r.*, n.video_id IS NOT NULL AS known, n.first <= r.created_at AS loaded
  FROM refs r LEFT JOIN (SELECT video_id, qid, min(loaded_at) AS first FROM anchors GROUP BY ALL) n ON n.video_id = r.video_id AND n.qid = r.qid
  WHERE r.video_id IS NOT NULL AND r.qid IS NOT NULL AND r.created_at IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM anchors a WHERE a.video_id = r.video_id AND a.qid = r.qid AND a.loaded_at <= r.created_at AND (a.deleted_at IS NULL OR a.deleted_at > r.created_at))
),
orphans AS (SELECT ref_table, ref_id, created_at, CASE WHEN NOT known THEN 'missing' WHEN loaded THEN 'deleted' ELSE 'late' END AS reason FROM checked)
"""


@R.add("p2_found", f"WITH {ORPHANS_SQL} SELECT ref_table, ref_id, reason FROM orphans")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("ref_table", "ref_id", "reason")


@R.add(
    "p2_counts",
    f"""WITH {ORPHANS_SQL}
SELECT ref_table, strftime(date_trunc('month', created_at AT TIME ZONE 'UTC'), '%Y-%m') AS month, reason, count(*) AS n FROM orphans GROUP BY ALL""",
)
def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per referring table, month and reason."""
    made = count_orphans(references(spark, sf_dir), anchors(spark, sf_dir), ["video_id", "qid"], "created_at", "loaded_at", "deleted_at", ["ref_table"])
    return made.select("ref_table", F.date_format("period", "yyyy-MM").alias("month"), "reason", "n")
