"""Conversations and agent messages: last messages, nesting, pruning, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.session import materialize


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation with their place, oldest first as 1. Ties in time go by id.

    The window is limited to n rows a conversation before the shuffle (WindowGroupLimit), so long conversations cost
    no more than short ones.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = messages.where(F.col("conversation_id").isNotNull()).dropDuplicates(["id"]).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= n)
    oldest = Window.partitionBy("conversation_id").orderBy(F.desc("_r"))
    return kept.withColumn("place", F.row_number().over(oldest)).drop("_r")


def last_of_role(messages: DataFrame, role: str) -> DataFrame:
    """(conversation_id, content) of the last message of a role; a partial ``max_by``."""
    m = messages.where((F.upper(F.trim("role")) == role) & F.col("conversation_id").isNotNull() & F.col("created_at").isNotNull())
    return m.groupBy("conversation_id").agg(F.max_by("content", F.struct("created_at", "id")).alias("content"))


def nest(conversations: DataFrame, messages: DataFrame, n: int = 1000) -> DataFrame:
    """(conversation_id, title, messages): conversations with their last n messages as an array, oldest first."""
    one = conversations.groupBy("id").agg(F.max_by("title", F.struct("updated_at", "title")).alias("title"))
    m = last_messages(messages, n).groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "content"))).alias("messages"))
    return one.join(m, one.id == m.conversation_id, "left").select(F.col("id").alias("conversation_id"), "title", F.coalesce("messages", F.array().cast("array<struct<place:int,role:string,content:string>>")).alias("messages"))


def prune(messages: DataFrame, budget: int, tokens: Column, prunable: Column, order: list[Column], keep: int = 2) -> DataFrame:
    """Messages that stay when a conversation exceeds its budget of tokens. Ids must be unique and not null.

    Prunable ones go in the given order (oldest, or least relevant first) until the rest fits, but never the last
    ``keep`` of them. What goes is told by running sums, without a loop: prunable messages are range-partitioned by
    conversation and order, so that a conversation of any size is summed in blocks and no task holds it whole.
    """
    m = messages.withColumn("_t", tokens).withColumn("_p", F.coalesce(prunable, F.lit(False)))
    recent = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    late = m.where("_p").select("conversation_id", "id", "created_at").withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= keep).select("id")
    total = m.groupBy("conversation_id").agg(F.sum("_t").alias("_total"))
    free = m.where("_p").join(late, "id", "left_anti")
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = materialize(free.repartitionByRange(parts, F.col("conversation_id"), *order).withColumn("_b", F.spark_partition_id()), "prune")
    by_block = Window.partitionBy("conversation_id").orderBy("_b")  # at most one row per range partition
    upto = blocked.groupBy("conversation_id", "_b").agg(F.sum("_t").alias("_s")).withColumn("_before", F.sum("_s").over(by_block) - F.col("_s")).drop("_s")
    inside = Window.partitionBy("conversation_id", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.col("_total") - F.col("_before") - F.coalesce(F.sum("_t").over(inside), F.lit(0)) > budget
    kept = blocked.join(upto, ["conversation_id", "_b"]).join(total, "conversation_id").withColumn("_gone", gone).where(~F.col("_gone")).select(*messages.columns)
    rest = m.where(~F.col("_p")).unionByName(m.where("_p").join(late, "id", "left_semi").select(*m.columns))
    return kept.unionByName(rest.select(*messages.columns))


def traces(messages: DataFrame) -> DataFrame:
    """(conversation_id, iterations, calls, failed): tool calls with the answer to each by call id; the last duplicate wins.

    A call without an answer has an empty one.
    """
    calls = messages.where(F.upper(F.trim("role")) == "TOOL").select("conversation_id", F.col("id").alias("message_id"), F.explode(F.from_json("content", "array<struct<id:string,name:string,arguments:string>>")).alias("c"))
    answers = messages.where(F.upper(F.trim("role")) == "TOOL_RESPONSE").groupBy("conversation_id", F.col("tool_call_id").alias("call_id")).agg(F.max_by("content", F.struct("created_at", "id")).alias("answer"))
    one = calls.select("conversation_id", "message_id", F.col("c.id").alias("call_id")).distinct()
    j = one.join(answers, ["conversation_id", "call_id"], "left")
    return j.groupBy("conversation_id").agg(F.countDistinct("message_id").alias("iterations"), F.count("*").alias("calls"), F.count_if(tx.tool_failed(F.coalesce("answer", F.lit("")))).alias("failed"))
