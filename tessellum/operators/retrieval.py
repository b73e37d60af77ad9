"""Dense, sparse and fused retrieval over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.functions import vectors as vec
from tessellum.session import join_small, spread

#: Queries that one pass over the points holds in memory; larger query sets take several passes.
QUERY_BLOCK = 20_000
METRICS = ("cosine", "dot", "euclid")


class Best:
    """The k best of each query that a task has seen; ties go to the smaller id."""

    def __init__(self, k: int):
        self.k, self.parts = k, []
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))

    def cut(self) -> None:
        """Keep the best of what was kept and added."""
        if not self.parts:
            return
        ids = np.concatenate([x[1] for x in self.parts] + ([self.id] if len(self.id) else []))
        query, score = (np.concatenate([*(x[c] for x in self.parts), mine]) for c, mine in ((0, self.query), (2, self.score)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.flatnonzero(np.r_[True, np.diff(query) != 0]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.query, self.id, self.score, self.parts = query[keep], ids[order][keep], score[order][keep], []


def knn(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact top k for each query. ``points`` (id, vector), ``queries`` (query_id, vector).

    Each task multiplies its points with a block of queries and keeps the k best of each over all its points, so k rows
    per task and query are shuffled, never all pairs. Higher is better (distances are negated); ties go to the smaller id. Null and invalid
    vectors (not finite, or zero) match nothing; vectors of another length than the query's score 0 and are left out.
    """
    assert metric in METRICS
    good = lambda df: df.where(F.col("vector").isNotNull() & ~vec.is_invalid(F.col("vector")))
    q = good(queries.select("query_id", "vector")).withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))))
    parts = [r.part for r in q.select("part").distinct().collect()]
    pts = spread(good(points.select("id", "vector")))
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, id {points.schema['id'].dataType.simpleString()}, score double"
    out = None
    for part in parts:
        rows = q.where(F.col("part") == part).select("query_id", "vector").toPandas()
        shared = points.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), np.array(rows["vector"].tolist(), dtype=np.float64)))

        def top(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            mn = np.linalg.norm(m, axis=1)
            best = Best(k)
            for pdf in batches:
                pdf = pdf[pdf["vector"].map(len) == m.shape[1]]
                if pdf.empty:
                    continue
                p = np.array(pdf["vector"].tolist(), dtype=np.float64)
                pid = pdf["id"].to_numpy()
                for at in range(0, len(ids), 512):
                    s = m[at : at + 512] @ p.T
                    if metric == "cosine":
                        s = s / (mn[at : at + 512, None] * np.linalg.norm(p, axis=1)[None, :])
                    elif metric == "euclid":
                        s = -np.sqrt(np.maximum((mn[at : at + 512, None] ** 2) + (p**2).sum(1)[None, :] - 2 * s, 0))
                    n = min(k, s.shape[1])
                    edge = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                    i, j = np.nonzero(s >= edge)
                    best.add(i + at, pid[j], s[i, j])
                best.cut()
            yield pd.DataFrame({"query_id": ids[best.query], "id": best.id, "score": best.score})

        found = pts.mapInPandas(top, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return points.sparkSession.createDataFrame([], schema + ", rank int")
    return ranked(out, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tf_postings(docs: DataFrame) -> DataFrame:
    """(id, term, weight): sparse vectors of ``docs`` (id, text). A weight is a term's share of the text's kept words."""
    words = docs.select("id", tx.terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    one = words.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    return one.select("id", F.col("word").alias("term"), (F.col("c") / F.col("n")).alias("weight"))


def sparse_search(postings: DataFrame, query_postings: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): sum of weight products over shared terms. ``query_postings`` (query_id, term, weight).

    The query side is broadcast where it is proven small; products are summed per task before the shuffle.
    """
    q = query_postings.select("query_id", "term", F.col("weight").alias("qw"))
    s = join_small(postings, q, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))
    return ranked(s, k)


def text_search(docs: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): ``sparse_search`` of texts, for query sets that grow with the documents.

    ``docs`` (id, text) and ``queries`` (query_id, text) have unique ids. Each task sums the weight products of its
    documents with a block of queries over an inverted index of the batch and keeps the k best of each, so products are
    never shuffled. Scores are rounded to 12 digits before they are ranked; ties go to the smaller id.
    """
    words = lambda df, key: df.select(key, tx.terms(F.col("text")).alias("words")).where(F.size("words") > 0)
    q = words(queries, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // block)))))
    parts = [r.part for r in q.select("part").distinct().collect()]
    pts = spread(words(docs, "id"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"
    out = None
    for part in parts:
        rows = q.where(F.col("part") == part).select("query_id", "words").toPandas()
        vocab: dict[str, int] = {}
        vectors = []
        for ws in rows["words"]:
            t, c = np.unique([vocab.setdefault(w, len(vocab)) for w in ws], return_counts=True)
            vectors.append((t.astype(np.int32), c / len(ws)))
        shared = docs.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), vocab, vectors))

        def top(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, vocab, vectors = shared.value
            best = Best(k)
            for pdf in batches:
                pid = pdf["id"].to_numpy()
                sizes = pdf["words"].map(len).to_numpy()
                terms = np.fromiter((vocab.get(w, -1) for ws in pdf["words"] for w in ws), np.int64, sizes.sum())
                cell, count = np.unique((terms * len(pid) + np.repeat(np.arange(len(pid)), sizes))[terms >= 0], return_counts=True)  # by term, then document
                doc = cell % len(pid)
                weight = count / sizes[doc]
                at = np.searchsorted(cell, np.arange(len(vocab) + 1) * len(pid))
                found = []
                for i, (t, qw) in enumerate(vectors):
                    s = np.zeros(len(pid))
                    for a, b, x in zip(at[t].tolist(), at[t + 1].tolist(), qw.tolist(), strict=True):
                        s[doc[a:b]] += weight[a:b] * x
                    s = np.round(s, 12)
                    edge = np.partition(s, -k)[-k] if len(s) > k else 0.0
                    j = np.flatnonzero((s >= edge) & (s > 0))
                    found.append((np.full(len(j), i), j, s[j]))
                i, j, s = map(np.concatenate, zip(*found, strict=True))
                best.add(i, pid[j], s)
                best.cut()
            yield pd.DataFrame({"query_id": qid[best.query], "id": best.id, "score": best.score})

        scores = pts.mapInPandas(top, schema)
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema + ", rank int")
    return ranked(out.withColumn("score", F.round("score", 12)), k)


def rrf(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion of ranked lists; a point may be in one list only."""
    every = None
    for x in lists:
        part = x.select("query_id", "id", (1.0 / (F.lit(constant) + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return ranked(every.groupBy("query_id", "id").agg(F.sum("part").alias("score")), k)


def prefetch(k: int) -> int:
    """Candidates of each branch before the fusion."""
    return max(2 * k, 10)


def apply_threshold(results: DataFrame, threshold: float) -> DataFrame:
    """Results with a score of the threshold or more; NaN scores go."""
    return results.where(~F.isnan("score") & (F.col("score") >= threshold))


def hybrid_search(points: DataFrame, docs: DataFrame, dense_queries: DataFrame, text_queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score, rank): the fusion of a dense and a sparse branch, each with ``prefetch(k)`` candidates.

    ``points`` (id, vector) and ``docs`` (id, text) are the two vectors of one collection; queries likewise. A query or a
    point that one branch lacks is ranked by the other alone. Scores are rounded to 12 digits before the ranking.
    """
    p = prefetch(k)
    dense = knn(points, dense_queries, p, metric)
    sparse = text_search(docs, text_queries, p)
    fused = rrf([dense, sparse], 2 * p).drop("rank")
    return ranked(fused.withColumn("score", F.round("score", 12)), k)


def with_fallback(queries: DataFrame, answers: DataFrame, message: str) -> DataFrame:
    """(query_id, answer) of every query, the message where it has none."""
    return queries.select("query_id").distinct().join(answers.select("query_id", "answer"), "query_id", "left").select("query_id", F.coalesce("answer", F.lit(message)).alias("answer"))


def token_budget(results: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """The results of each query by rank, up to the first that exceeds the budget of tokens."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def assemble_context(results: DataFrame) -> DataFrame:
    """(query_id, context, chunks): the texts by rank, blank lines between, and their number."""
    x = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return results.groupBy("query_id").agg(x.alias("x")).select("query_id", F.array_join(F.col("x.text"), "\n\n").alias("context"), F.size("x").cast("long").alias("chunks"))


def zip_vectors(chunks: DataFrame, embeddings: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with their vectors by key; a chunk or vector without partner fails the job, as a count mismatch must."""
    j = chunks.join(embeddings.withColumn("_v", F.lit(True)), key, "full")
    return j.withColumn("_ok", F.assert_true(F.col("_v").isNotNull() & F.col("text").isNotNull(), "chunks and vectors do not match")).where(F.col("_ok").isNull()).drop("_v", "_ok")
