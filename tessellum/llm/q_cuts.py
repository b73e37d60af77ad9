"""Queries on cut-off values (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import cuts
from tessellum.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, field, pos) of every value that was cut."""
    return cuts.cut_values(table(spark, sf_dir, "eval_events")).select("event_id", "field", "pos")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut values per tool_name and per model_config."""
    return cuts.cut_rates(table(spark, sf_dir, "eval_events"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
ORACLE: dict[str, str] = {}
