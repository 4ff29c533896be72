"""Problem 7: documents mixed from sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.mixing import mix, violations
from strandline.llm.tokens import RANKS, token_sizes
from strandline.plans.registry import Registry
from strandline.session import cut, table

R = Registry()


def sizes(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    return cut(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"], ranks))


def mixed(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    return mix(sizes(spark, sf_dir, ranks), "doc_id", "source", "tokens", table(spark, sf_dir, "mix_targets"))


@R.add("p7_mixed")
def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes in the order of slot and place."""
    return mixed(spark, sf_dir)[0]


@R.add("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached beside the shares wanted."""
    return mixed(spark, sf_dir)[1]


@R.add("p7_check", "SELECT DISTINCT mix_id, source, 0 AS over_cap, 0 AS repeated_use, 0 AS wrong_source, 0 AS off_target FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL")
def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for every mix, counted over all uses."""
    n, targets = sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return violations(mix(n, "doc_id", "source", "tokens", targets)[0], n, "doc_id", "source", "tokens", targets)
