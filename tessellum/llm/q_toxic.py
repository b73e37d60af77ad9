"""Queries on abusive, hateful and sexual content (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import toxic
from tessellum.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, category) of every document that holds such content."""
    return toxic.found(_scored(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of each category per source."""
    return toxic.rates(_scored(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
ORACLE: dict[str, str] = {}
