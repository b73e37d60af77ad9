"""Queries on leaked evaluation items (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import leaks
from tessellum.session import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_entries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, documents, exact): the leaked items with the number of documents that hold them."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("edits") == 0).alias("exact"))


QUERIES = {"p6_found": p6_found, "p6_items": p6_items}
ORACLE: dict[str, str] = {}
