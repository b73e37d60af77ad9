"""Queries on broken pairs (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import pairs
from tessellum.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, defect) of each defective pair."""
    return pairs.defective(table(spark, sf_dir, "eval_events")).select("event_id", "defect")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(defect, pairs)."""
    return pairs.defective(table(spark, sf_dir, "eval_events")).groupBy("defect").agg(F.count("*").alias("pairs"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
ORACLE: dict[str, str] = {}
