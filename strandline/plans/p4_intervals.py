"""Problem 4: continuous periods and gaps of the evidence spans per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import QID_SQL, VIDEO_SQL, qid_key, video_key
from strandline.operators.intervals import cut_ms, known_ms, merge_spans, milliseconds
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()

KEYS = ["src_table", "video_id", "qid"]


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, video_id, qid, start_ms, end_ms) of both tables, normalised; one row per pair of endpoints, also of those that leave no length."""
    ends = F.arrays_zip(F.col("evidence_intervals.start").alias("a"), F.col("evidence_intervals.end").alias("b"))  # only the endpoints are read
    cg = (
        table(spark, sf_dir, "cgbench_filtered")
        .select(video_key("video_id").alias("video_id"), qid_key("qid").alias("qid"), known_ms(F.col("video_duration")).alias("top"), ends.alias("p"))
        .select(F.lit("cgbench_filtered").alias("src_table"), "video_id", "qid", "top", F.explode("p").alias("p"))
        .select("src_table", "video_id", "qid", "top", "p.a", "p.b")
    )
    gsub = (
        table(spark, sf_dir, "gsub_test")
        .select(video_key("video_id").alias("video_id"), known_ms(F.col("duration")).alias("top"), F.explode("location").alias("qid", "pairs"))
        .select(F.lit("gsub_test").alias("src_table"), "video_id", qid_key("qid").alias("qid"), "top", "pairs")
        .select("src_table", "video_id", "qid", "top", F.explode("pairs").alias("p"))
        .select("src_table", "video_id", "qid", "top", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    )
    both = cg.unionByName(gsub).where("a IS NOT NULL AND b IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")
    spans = both.select(*KEYS, "top", milliseconds(F.col("a")).alias("a"), milliseconds(F.col("b")).alias("b")).select(*KEYS, cut_ms(F.col("a"), F.col("b"), F.col("top")).alias("span"))
    return spans.select(*KEYS, "span.start_ms", "span.end_ms")


SPANS_SQL = f"""
raw AS (
  SELECT 'cgbench_filtered' AS src_table, {VIDEO_SQL.format('video_id')} AS video_id, {QID_SQL.format('qid')} AS qid, iv.start AS a, iv."end" AS b, video_duration AS d
  FROM (SELECT video_id, qid, video_duration, unnest(evidence_intervals) AS iv FROM cgbench_filtered)
  UNION ALL
  SELECT 'gsub_test', {VIDEO_SQL.format('video_id')}, {QID_SQL.format('qid')}, p[1], p[2], duration
  FROM (SELECT video_id, duration, qid, unnest(pairs) AS p
        FROM (SELECT video_id, duration, unnest(map_keys(location)) AS qid, unnest(map_values(location)) AS pairs FROM gsub_test))
),
ms AS (
  SELECT src_table, video_id, qid, CAST(round(a * 1000) AS BIGINT) AS a, CAST(round(b * 1000) AS BIGINT) AS b,
    CASE WHEN d > 0 THEN CAST(round(d * 1000) AS BIGINT) ELSE 9000000000000000 END AS d
  FROM raw WHERE a IS NOT NULL AND b IS NOT NULL
),
spans AS (
  SELECT DISTINCT src_table, video_id, qid, greatest(least(a, b), 0) AS s, least(greatest(a, b), d) AS e
  FROM ms WHERE greatest(least(a, b), 0) < least(greatest(a, b), d)
),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY src_table, video_id, qid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM spans
),
grouped AS (
  SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY src_table, video_id, qid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked
),
periods AS (SELECT src_table, video_id, qid, g, min(s) AS s, max(e) AS e, count(*) AS n FROM grouped GROUP BY ALL),
gaps AS (SELECT src_table, video_id, qid, lag(e) OVER (PARTITION BY src_table, video_id, qid ORDER BY s) AS s, s AS e FROM periods)
"""


@R.add(
    "p4_found",
    f"""WITH {SPANS_SQL}
SELECT src_table, video_id, qid, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods WHERE n > 1
UNION ALL SELECT src_table, video_id, qid, 'gap', s, e FROM gaps WHERE s IS NOT NULL""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merge_spans(evidence_spans(spark, sf_dir), KEYS, "start_ms", "end_ms")
    return made.where("kind = 'gap' OR n_spans > 1").select(*KEYS, "kind", "start_ms", "end_ms")


@R.add(
    "p4_timeline",
    f"""WITH {SPANS_SQL}
SELECT src_table, video_id, qid, 'period' AS kind, s AS start_ms, e AS end_ms, n AS n_spans FROM periods
UNION ALL SELECT src_table, video_id, qid, 'gap', s, e, 0 FROM gaps WHERE s IS NOT NULL""",
)
def p4_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period, also those of one span, and every gap."""
    return merge_spans(evidence_spans(spark, sf_dir), KEYS, "start_ms", "end_ms")
