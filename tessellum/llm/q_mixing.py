"""Queries on mixing sources (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import mixing
from tessellum.session import table


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document is used in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and the actual share of each source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares}
ORACLE: dict[str, str] = {}
