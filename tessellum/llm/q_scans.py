"""Queries on scanned texts (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import scans
from tessellum.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, line_no, noise) of every noisy line."""
    return scans.clean(table(spark, sf_dir, "analyze_results"), table(spark, sf_dir, "eval_events"))[0]


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every text."""
    return scans.clean(table(spark, sf_dir, "analyze_results"), table(spark, sf_dir, "eval_events"))[1]


QUERIES = {"p4_found": p4_found, "p4_paragraphs": p4_paragraphs}
ORACLE: dict[str, str] = {}
