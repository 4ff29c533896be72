"""Problem 5: replies that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import QID_SQL, VIDEO_SQL, alpha_key, qid_key, video_key
from strandline.operators.message_store import ID, MessageStore, message_id, surplus
from strandline.plans.registry import Registry
from strandline.session import fresh_dir, table

R = Registry()

#: Deliveries of so many last days are merged into the store that the earlier ones built.
INCOMING_DAYS = 7


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b, row_id, delivered_at, part): identifier, winner's order and day of production of each delivered row."""
    return table(spark, sf_dir, "eval_result").select(
        *message_id(F.col("run_id"), video_key("video_id"), qid_key("qid"), alpha_key("alpha")), "row_id", "delivered_at", F.date_format("produced_at", "yyyy-MM").alias("part")
    )


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All deliveries, and the winners that the store holds after the history was loaded and the last days were merged."""
    rows = deliveries(spark, sf_dir)
    store = MessageStore(spark, fresh_dir(spark, "replies"), ["delivered_at", "row_id"])
    last = rows.agg(F.max("delivered_at")).first()[0]
    if last is not None:
        old = F.coalesce(F.col("delivered_at") < F.lit(last) - F.make_dt_interval(F.lit(INCOMING_DAYS)), F.lit(True))
        store.merge(rows.where(old))
        store.merge(rows.where(~old))
    return rows, store.winners(rows)


KEPT_SQL = f"""
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, {VIDEO_SQL.format('video_id')}, {QID_SQL.format('qid')}, round(alpha, 2) ORDER BY delivered_at DESC, row_id DESC) AS place FROM eval_result
)
"""


@R.add("p5_found", f"WITH {KEPT_SQL} SELECT row_id FROM keyed WHERE place > 1")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, winners = stored(spark, sf_dir)
    return surplus(rows, winners, "row_id").select("row_id")


@R.add("p5_replies", f"WITH {KEPT_SQL} SELECT row_id, run_id, video_id, qid, alpha, delivered_at FROM keyed WHERE place = 1")
def p5_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one row per reply, as delivered."""
    _, winners = stored(spark, sf_dir)
    kept = winners.select("row_id")
    return table(spark, sf_dir, "eval_result").join(kept, "row_id", "left_semi").select("row_id", "run_id", "video_id", "qid", "alpha", "delivered_at")
