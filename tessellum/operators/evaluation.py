"""Scores of retrieval and answers, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import text as tx

#: Operation types; any other name counts as ``query``.
OPERATIONS = ("query", "agentic_run", "ingestion_pdf", "ingestion_mp4")


def operation(kind: Column) -> Column:
    """The clean operation type."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin(*OPERATIONS), k).otherwise("query")


def context_recall(expected: Column, pages: Column) -> Column:
    """Share of the expected pages that were retrieved, repeats counted; 1.0 where none is expected."""
    hit = F.size(F.filter(expected, lambda p: F.coalesce(F.array_contains(pages, p), F.lit(False))))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).otherwise(hit / F.size(expected))


def report(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: count, mean of each score without nulls and NaN, number below the threshold."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    return results.agg(F.count("*").alias("total_evaluated"), F.avg(ok("faithfulness")).alias("mean_faithfulness"), F.avg(ok("context_recall")).alias("mean_context_recall"), F.count_if(ok("faithfulness") < threshold).alias("failed_count"))


def ingestion_score(answer: Column, samples: Column, judged: Column) -> Column:
    """Score of an ingestion event: 0.0 without chunks, 1.0 for chunks without samples, else what the judge gave."""
    chunks = F.coalesce(F.trim(answer).try_cast("int"), F.lit(0))
    return F.when(chunks <= 0, 0.0).when(F.coalesce(F.size(samples), F.lit(0)) <= 0, 1.0).otherwise(judged)


def score_events(events: DataFrame, judge) -> DataFrame:
    """(id, operation, faithfulness) of every event. ``judge`` is a Column -> Column plug-in (prompt to reply).

    The three kinds are separate branches, so no prompt is judged whose score the counts already tell.
    """
    e = events.withColumn("operation", operation(F.col("operation_type")))
    ingest = e.where(F.col("operation").startswith("ingestion_"))
    chunks = F.coalesce(F.trim("generated_answer").try_cast("int"), F.lit(0))
    free = ingest.where((chunks <= 0) | (F.coalesce(F.size("retrieved_sources"), F.lit(0)) <= 0)).select("id", "operation", F.when(chunks <= 0, 0.0).otherwise(1.0).alias("faithfulness"))
    paid = ingest.where((chunks > 0) & (F.size("retrieved_sources") > 0)).unionByName(e.where(~F.col("operation").startswith("ingestion_")))
    prompt = F.concat_ws("\n\n", F.lit("Rate from 0 to 1 how far the sources support the answer."), numbered(F.col("retrieved_sources.text"), "Source"), F.concat(F.lit("Answer:\n"), F.coalesce("generated_answer", F.lit(""))))
    return free.unionByName(paid.select("id", "operation", tx.parse_score(judge(prompt)).alias("faithfulness")))


def lexical_scores(events: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, operation, faithfulness, relevancy, precision, below_threshold) by the terms that texts share, without a model.

    ``faithfulness`` is the share of the answer's terms in its evidence: the sources, or for an agent's run with tool
    calls their results. ``relevancy`` is the share of the question's terms in the answer. ``precision`` is the share of
    the pieces of evidence that have a term of the answer; null for a run without calls. Ingestion events have
    0.0 without chunks, 1.0 for chunks without samples, else the share of samples with any term; no relevancy and
    precision. Null texts and lists are empty; NaN never occurs.
    """
    e = events.withColumn("operation", operation(F.col("operation_type")))
    none = F.array().cast("array<string>")
    sources = F.coalesce(F.transform("retrieved_sources", lambda s: F.coalesce(s["text"], F.lit(""))), none)
    results = F.coalesce(F.transform("agentic_trace.tool_calls", lambda c: F.coalesce(c["result_preview"], F.lit(""))), none)
    called = (F.col("operation") == "agentic_run") & (F.size(results) > 0)
    e = e.select("id", "operation", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("generated_answer", F.lit("")).alias("a"), sources.alias("sources"), called.alias("called"), F.when(called, results).otherwise(sources).alias("evidence"))
    ingest = F.col("operation").startswith("ingestion_")
    answer = F.array_distinct(tx.terms(F.col("a")))
    hits = lambda texts, words: F.size(F.filter(texts, lambda t: F.arrays_overlap(tx.terms(t), words)))
    samples = F.size(F.filter("sources", lambda t: F.size(tx.terms(t)) > 0)) / F.greatest(F.size("sources"), F.lit(1))
    faithful = F.when(ingest, ingestion_score(F.col("a"), F.col("sources"), samples)).otherwise(tx.share_of_terms(F.col("a"), F.array_join("evidence", "\n")))
    precise = F.when(ingest | (F.col("operation") == "agentic_run") & ~F.col("called"), F.lit(None)).when(F.size("evidence") > 0, hits(F.col("evidence"), answer) / F.size("evidence")).otherwise(0.0)
    out = e.select("id", "operation", faithful.alias("faithfulness"), F.when(~ingest, tx.share_of_terms(F.col("q"), F.col("a"))).alias("relevancy"), precise.cast("double").alias("precision"))
    return out.withColumn("below_threshold", F.col("faithfulness") < threshold)


def numbered(texts: Column, label: str) -> Column:
    """Texts under numbered labels, blank lines between."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), F.coalesce(t, F.lit("")))), "\n\n")


def tool_rollup(events: DataFrame) -> DataFrame:
    """(tool_name, calls, failed) over the traces of events."""
    c = events.select(F.explode("agentic_trace.tool_calls").alias("c")).where("c is not null")
    return c.groupBy(F.col("c.tool_name").alias("tool_name")).agg(F.count("*").alias("calls"), F.count_if(~F.coalesce(F.col("c.success"), F.lit(False)) | tx.tool_failed(F.col("c.result_preview"))).alias("failed"))
