"""Problem 6: texts put together into containers of each capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.packing import fill, pack, pattern_report, violations
from strandline.llm.tokens import RANKS, token_sizes
from strandline.plans.registry import Registry
from strandline.session import cut, table

R = Registry()


def sizes(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return cut(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ranks=ranks))  # the range sort reads them twice


def packed(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return pack(sizes(spark, sf_dir, ranks), "doc_id", "tokens", table(spark, sf_dir, "pack_sizes"))


@R.add("p6_packed")
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, place and offset of every text (and piece of an over-long one) per plan."""
    return packed(spark, sf_dir)


@R.add("p6_fill")
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


@R.add("p6_summary")
def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers per plan beside the least number that the tokens need."""
    per = fill(packed(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))
    need = F.ceil(F.sum("used_tokens") / F.first("capacity_tokens"))
    return per.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_containers"), need.alias("least_containers"), F.sum("used_tokens").alias("used_tokens"), F.avg("fill").alias("mean_fill")
    )


@R.add("p6_check", "SELECT plan_id, (SELECT count(*) FROM documents) AS n_texts, 0 AS split, 0 AS wrong_size, 0 AS over_capacity, 0 AS gaps FROM pack_sizes")
def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every packing, counted over all texts and containers."""
    n, plans = sizes(spark, sf_dir), table(spark, sf_dir, "pack_sizes")
    return violations(pack(n, "doc_id", "tokens", plans), n, "doc_id", "tokens", plans)


@R.add("p6_patterns")
def p6_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the texts that the fitted patterns place, per plan."""
    return pattern_report(sizes(spark, sf_dir), "doc_id", "tokens", table(spark, sf_dir, "pack_sizes"))
