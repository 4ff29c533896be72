"""Problem 8: documents that were read in a wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.mojibake import find_garbled, restore
from strandline.plans.registry import Registry
from strandline.session import table

R = Registry()


@R.add("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


@R.add("p8_restored")
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with their text as far as it can be restored."""
    return restore(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("p8_chains")
def p8_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affected documents and garbled words per chain of encodings."""
    found = find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("chain", "lossless").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("word").alias("n_words"))
