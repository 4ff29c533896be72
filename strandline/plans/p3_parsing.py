"""Problem 3: raw question records and parsed replies that do not parse."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.parse_rows import parse_records, parse_replies
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()

FIELDS = ["video_id", "frame_count", "width", "height", "question", "answer", "qid", "type", "a0", "a1", "a2", "a3", "a4"]
TYPES = ("CW", "CH", "TN", "TC", "TP", "DL", "DC", "DO", "DB")
_WHOLE = re.compile(r"[ \t]*0*[1-9][0-9]*[ \t]*")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def question_problem(row: list[str]) -> tuple[int, str] | None:
    for k in (1, 2, 3):
        if not _WHOLE.fullmatch(row[k]):
            return k, "not a whole number above 0"
    for k in (0, 6, 4, 8):
        if not row[k].strip():
            return k, "blank"
    for k in (4, 8):
        if _CONTROL.search(row[k]):
            return k, "control character"
    return None if row[7] in TYPES else (7, "unknown type")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(table(spark, sf_dir, "test_raw"), "row_id", "raw_line", FIELDS, question_problem)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_replies(table(spark, sf_dir, "eval_result"), "row_id", "model_parsed")


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
QUESTIONS_SQL = f"""
lines AS (SELECT row_id, coalesce(raw_line, '') AS raw, regexp_full_match(coalesce(raw_line, ''), '(?s){_FIELD}(?:,{_FIELD})*') AS ok FROM test_raw),
cut AS (
  SELECT row_id, ok, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || raw, '(?s),({_FIELD})', 1),
    lambda f: CASE WHEN starts_with(f, '"') THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) END AS f FROM lines
),
questions AS (
  SELECT row_id, f, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> 13 THEN 'column_count'
    WHEN NOT (regexp_full_match(f[2], '[ \\t]*0*[1-9][0-9]*[ \\t]*') AND regexp_full_match(f[3], '[ \\t]*0*[1-9][0-9]*[ \\t]*') AND regexp_full_match(f[4], '[ \\t]*0*[1-9][0-9]*[ \\t]*'))
      OR regexp_full_match(f[1], '\\s*') OR regexp_full_match(f[7], '\\s*') OR regexp_full_match(f[5], '\\s*') OR regexp_full_match(f[9], '\\s*')
      OR regexp_matches(f[5], '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') OR regexp_matches(f[9], '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')
      OR f[8] NOT IN {TYPES} THEN 'bad_value' END AS reason
  FROM cut
)
"""


@R.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def failed(name: str, made: DataFrame) -> DataFrame:
        return made.where("reason IS NOT NULL").select(F.lit(name).alias("raw_table"), "row_id", "reason")

    return failed("test_raw", questions(spark, sf_dir)).unionByName(failed("eval_result", replies(spark, sf_dir)))


@R.add("p3_failed_questions", f"WITH {QUESTIONS_SQL} SELECT row_id, reason FROM questions WHERE reason IS NOT NULL")
def p3_failed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).where("reason IS NOT NULL").select("row_id", "reason")


@R.add(
    "p3_questions",
    f"""WITH {QUESTIONS_SQL} SELECT row_id, f[1] AS video_id, TRY_CAST(trim(f[2], E' \\t') AS BIGINT) AS frame_count, TRY_CAST(trim(f[3], E' \\t') AS BIGINT) AS width,
TRY_CAST(trim(f[4], E' \\t') AS BIGINT) AS height, f[5] AS question, f[6] AS answer, f[7] AS qid, f[8] AS "type", f[9] AS a0, f[10] AS a1, f[11] AS a2, f[12] AS a3, f[13] AS a4
FROM questions WHERE reason IS NULL""",
)
def p3_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid question records, typed; a whole number beyond bigint gives null."""
    whole = {k: F.btrim(F.col(k), F.lit(" \t")).try_cast("bigint") for k in ("frame_count", "width", "height")}
    return questions(spark, sf_dir).where("reason IS NULL").withColumns(whole).select("row_id", *FIELDS)


@R.add("p3_failures")
def p3_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failing row with reason, byte offset and detail."""

    def failed(name: str, made: DataFrame) -> DataFrame:
        return made.where("reason IS NOT NULL").select(F.lit(name).alias("raw_table"), "row_id", "reason", "at", "detail")

    return failed("test_raw", questions(spark, sf_dir)).unionByName(failed("eval_result", replies(spark, sf_dir)))


@R.add("p3_replies")
def p3_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid replies, typed, one row per span of evidence (or one without)."""
    good = replies(spark, sf_dir).where("reason IS NULL AND label IS NOT NULL")
    return good.select("row_id", "label", "answer", "evidence", "reply_reason", F.explode_outer("spans").alias("span")).select(
        "row_id", "label", "answer", "evidence", "reply_reason", F.col("span.start").alias("start_s"), F.col("span.end").alias("end_s")
    )
