"""Queries over nested evaluation events (problem 2)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessellum.operators import nested
from tessellum.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, entity, parent_pos, pos) of every child record in eval_jsonl."""
    return nested.found_children(table(spark, sf_dir, "eval_jsonl"))


def flat_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One flat table of the event log."""
    return nested.event_tables(table(spark, sf_dir, "eval_jsonl"))[name]


QUERIES = {"p2_found": p2_found} | {f"p2_{name}": partial(flat_table, name=name) for name in ("events", "sources", "tool_calls", "issues", "filters")}
ORACLE: dict[str, str] = {}
