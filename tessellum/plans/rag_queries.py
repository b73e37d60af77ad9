"""Queries over retrieval with two vectors, ingestion, evaluation, lists and stores, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.operators import chunking, evaluation, files, retrieval, store
from tessellum.plans.core_queries import _DOCS, _E1, _EVERY_50, _LINES, _P, _STOP, BUDGET, K, THRESHOLD, _dense_sql, _docs, _events, _ranked_sql, _terms_of, _terms_sql
from tessellum.session import join_small, materialize, spread, table
from tessellum.streaming import workers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- two vectors: embeddings and documents of one id are one point ----
_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"


@query(f"""WITH postings AS ({_terms_sql(_DOCS)}), a AS ({_dense_sql(_COSINE).replace(f"rank <= {K}", f"rank <= {_P}")}), b AS ({_ranked_sql(_EVERY_50, _P)}),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM a UNION ALL SELECT query_id, id, rank FROM b) GROUP BY 1, 2)
SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= {K}""")
def hybrid_search(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    every = lambda df: df.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return retrieval.hybrid_search(e, t, every(e), every(t), K).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"""WITH t AS (SELECT id, count(*) AS n, arg_max(term, (weight, term)) AS top, round(max(weight), 9) AS weight FROM ({_terms_sql(_DOCS)}) GROUP BY 1)
SELECT coalesce(t.id, vec_id) AS id, len(embedding) AS dims, coalesce(n, 0) AS terms, top, weight FROM embeddings FULL JOIN t ON t.id = vec_id""")
def hybrid_points(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    p = store.two_vector_points(e, retrieval.tf_postings(_docs(spark, d)))
    best = F.array_max(F.transform("terms", lambda t: F.struct(t["weight"], t["term"])))
    n = F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms"))
    return p.select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).cast("long").alias("dims"), n.cast("long").alias("terms"), best["term"].alias("top"), F.round(best["weight"], 9).alias("weight"))


# ---- ingestion as one plan: chunk, contextual text, sparse vector, upsert over the chunks that were there ----
_TITLE = "regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1')"


@query(f"""WITH c AS (SELECT doc_id, filename, p - 1 AS chunk_index, substring(text, CAST((p - 1) * 400 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, filename, text, unnest(range(1, CAST(ceil(length(text) / 400.0) AS BIGINT) + 1)) AS p FROM documents WHERE length(text) > 0)),
x AS (SELECT doc_id::VARCHAR || ':' || chunk_index AS chunk_id, CASE WHEN filename IS NULL THEN text ELSE 'Title: ' || {_TITLE} || chr(10) || 'Page: N/A' || chr(10) || 'Content: ' || text END AS text FROM c),
t AS (SELECT id, count(*) AS terms FROM ({_terms_sql("SELECT chunk_id AS id, text FROM x")}) GROUP BY 1)
SELECT chunk_id, md5(text) AS text_md5, coalesce(terms, 0) AS terms, octet_length(encode(text)) // 4 AS tokens FROM x LEFT JOIN t ON t.id = chunk_id""")
def ingested_chunks(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text", tx.strip_extension(F.col("filename")).alias("title")))
    chunks = chunking.fixed_chunks(docs).join(docs.select("doc_id", "title"), "doc_id")
    text = tx.contextual(F.col("text"), F.col("title"), F.lit(None).cast("int"), F.lit(None).cast("double"))
    c = chunks.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), text.alias("text"))
    new = c.select("chunk_id", F.md5("text").alias("text_md5"), F.size(F.array_distinct(tx.terms(F.col("text")))).cast("long").alias("terms"), tx.token_estimate(F.col("text")).alias("tokens"))
    old = c.select("chunk_id", F.lit("").alias("text_md5"), F.lit(0).cast("long").alias("terms"), F.lit(0).cast("long").alias("tokens"))  # what an earlier run left
    return store.upsert(old, new, "chunk_id")


@query("""WITH e AS (SELECT DISTINCT ON (id) * FROM eval_events ORDER BY id, ts), t AS (SELECT id, list_filter(list_transform(retrieved_sources, lambda s: regexp_replace(s.text, '^\\s+|\\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '') AS l, retrieved_sources[1].page AS start FROM e),
j AS (SELECT id, array_to_string(l, ' ') AS text, start FROM t WHERE len(l) > 0)
SELECT id, p - 1 AS chunk_index, md5(substring(text, CAST((p - 1) * 400 + 1 AS BIGINT), 500)) AS text_md5, CAST(start AS DOUBLE) AS start_time FROM (SELECT id, text, start, unnest(range(1, CAST(ceil(length(text) / 400.0) AS BIGINT) + 1)) AS p FROM j)""")
def segment_chunks(spark, d):
    s = F.col("retrieved_sources")
    e = _events(spark, d).select(F.col("id").alias("doc_id"), F.transform(s, lambda x: x["text"]).alias("texts"), F.get(s, F.lit(0))["page"].cast("double").alias("start"))
    return chunking.fixed_segments(e).select(F.col("doc_id").alias("id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"), "start_time")


# ---- evaluation ----
_OPERATION = "CASE WHEN lower(trim(operation_type)) IN ('query', 'agentic_run', 'ingestion_pdf', 'ingestion_mp4') THEN lower(trim(operation_type)) ELSE 'query' END"
_SCORES = f"""WITH e AS (SELECT DISTINCT ON (id) * FROM eval_events ORDER BY id, ts),
s AS (SELECT id, {_OPERATION} AS operation, generated_answer AS a, coalesce(list_transform(retrieved_sources, lambda s: coalesce(s.text, '')), []) AS sources, coalesce(list_transform(agentic_trace.tool_calls, lambda c: coalesce(c.result_preview, '')), []) AS results,
 list_distinct({_terms_of("coalesce(generated_answer, '')")}) AS ta, list_distinct({_terms_of("coalesce(question, '')")}) AS tq FROM e),
v AS (SELECT *, operation = 'agentic_run' AND len(results) > 0 AS called, CASE WHEN operation = 'agentic_run' AND len(results) > 0 THEN results ELSE sources END AS evidence FROM s),
w AS (SELECT *, {_terms_of("array_to_string(evidence, chr(10))")} AS te FROM v),
f AS (SELECT id, operation, CASE WHEN starts_with(operation, 'ingestion_') THEN CASE WHEN coalesce(TRY_CAST(trim(a) AS INTEGER), 0) <= 0 THEN 0.0 WHEN len(sources) = 0 THEN 1.0 ELSE len(list_filter(sources, lambda t: len({_terms_of("t")}) > 0)) / len(sources)::DOUBLE END
 WHEN len(ta) = 0 THEN 0.0 ELSE len(list_intersect(ta, te)) / len(ta)::DOUBLE END AS faithfulness,
 CASE WHEN NOT starts_with(operation, 'ingestion_') THEN CASE WHEN len(tq) = 0 THEN 0.0 ELSE len(list_intersect(tq, ta)) / len(tq)::DOUBLE END END AS relevancy,
 CASE WHEN starts_with(operation, 'ingestion_') OR (operation = 'agentic_run' AND NOT called) THEN NULL WHEN len(evidence) = 0 THEN 0.0 ELSE len(list_filter(evidence, lambda t: list_has_any({_terms_of("t")}, ta))) / len(evidence)::DOUBLE END AS precision FROM w)
SELECT id, operation, round(faithfulness, 6) AS faithfulness, round(relevancy, 6) AS relevancy, round(precision, 6) AS precision, faithfulness < 0.7 AS below_threshold FROM f"""


def _scores(events):
    s = evaluation.lexical_scores(events)
    return s.select("id", "operation", *[F.round(c, 6).alias(c) for c in ("faithfulness", "relevancy", "precision")], "below_threshold")


@query(_SCORES)
def lexical_scores(spark, d):
    return _scores(spread(_events(spark, d)))


@query(_SCORES)
def stream_scores(spark, d):
    first = _events(spark, d)  # of repeated rows the first counts, so a stream of them in any order scores alike
    path = materialize(first.where(F.col("id").isNotNull()), "events").inputFiles()[0].rsplit("/", 1)[0]
    return workers.outbox(workers.read_table(spark, path), _scores)


_PASSAGES = "SELECT DISTINCT id || ':' || (p - 1) AS id, text, page FROM (SELECT id, generate_subscripts(retrieved_sources, 1) AS p, unnest(retrieved_sources).text AS text, unnest(retrieved_sources).page AS page FROM (SELECT DISTINCT ON (id) * FROM eval_events ORDER BY id, ts))"


@query(f"""WITH s AS ({_PASSAGES}), postings AS ({_terms_sql("SELECT id, text FROM s")}), r AS ({_ranked_sql("SELECT item_id AS id, question AS text FROM eval_entries", K)}),
g AS (SELECT query_id, list(page) FILTER (page IS NOT NULL) AS pages FROM r JOIN s USING (id) GROUP BY 1)
SELECT item_id, round(CASE WHEN coalesce(len(expected_source_pages), 0) = 0 THEN 1.0 ELSE len(list_filter(expected_source_pages, lambda p: list_contains(coalesce(pages, []), p))) / len(expected_source_pages)::DOUBLE END, 6) AS recall FROM eval_entries LEFT JOIN g ON query_id = item_id""")
def entry_recall(spark, d):
    """Recall of the pages that each evaluation entry expects, among the sources that a search for its question ranks first."""
    s = _events(spark, d).select("id", F.posexplode("retrieved_sources").alias("pos", "s")).select(F.concat_ws(":", "id", F.col("pos").cast("string")).alias("id"), "s.text", "s.page")
    s = materialize(s, "passages")
    entries = table(spark, d, "eval_entries")
    r = retrieval.text_search(s.select("id", "text"), entries.select(F.col("item_id").alias("query_id"), F.col("question").alias("text")), K)
    pages = join_small(s, materialize(r.select("query_id", "id"), "ranked"), "id").groupBy(F.col("query_id").alias("item_id")).agg(F.collect_list("page").alias("pages"))
    expected, found = F.col("expected_source_pages"), F.coalesce("pages", F.array().cast("array<int>"))
    return entries.join(pages, "item_id", "left").select("item_id", F.round(evaluation.context_recall(expected, found), 6).alias("recall"))


@query(f"""WITH e AS ({_E1}), t AS (SELECT id, 1 AS side, unnest({_terms_of("coalesce(question, '')")}) AS w FROM e UNION ALL SELECT id, 2, unnest({_terms_of("coalesce(generated_answer, '')")}) FROM e),
c AS (SELECT id, w, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM t GROUP BY 1, 2), s AS (SELECT id, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS x FROM c GROUP BY 1)
SELECT e.id, round(CASE WHEN isfinite(x) THEN x ELSE 0.0 END, 6) AS similarity FROM e LEFT JOIN s USING (id)""")
def answer_similarity(spark, d):
    return spread(_events(spark, d)).select("id", F.round(tx.tf_cosine(F.coalesce("question", F.lit("")), F.coalesce("generated_answer", F.lit(""))), 6).alias("similarity"))


@query(f"SELECT id, len(agentic_trace.tool_calls) AS calls, len(list_filter(agentic_trace.tool_calls, lambda c: coalesce(c.success, false))) = 0 AS all_failed, list_transform(agentic_trace.tool_calls, lambda c: c.tool_name) AS tools, agentic_trace.iterations AS iterations FROM ({_E1}) WHERE len(agentic_trace.tool_calls) > 0")
def agent_runs(spark, d):
    calls = F.col("agentic_trace.tool_calls")
    failed = ~F.exists(calls, lambda c: F.coalesce(c["success"], F.lit(False)))
    return _events(spark, d).where(F.size(calls) > 0).select("id", F.size(calls).cast("long").alias("calls"), failed.alias("all_failed"), F.transform(calls, lambda c: c["tool_name"]).alias("tools"), F.col("agentic_trace.iterations").alias("iterations"))


@query(f"SELECT id, coalesce(len(retrieved_sources), 0) AS retrieved, coalesce(len(list_filter(retrieved_sources, lambda s: s.page IS NOT NULL)), 0) AS placed, coalesce(len(list_filter(retrieved_sources, lambda s: isnan(s.score))), 0) AS no_score, CASE WHEN coalesce(len(list_filter(retrieved_sources, lambda s: NOT isnan(s.score) AND s.score >= {THRESHOLD}::FLOAT)), 0) > 0 THEN generated_answer ELSE '{{fallback}}' END AS reply FROM ({_E1})".replace("{fallback}", "I cannot answer this based on the available lecture notes."))
def source_counts(spark, d):
    """Counts of sources, and the answer or, where no source reaches the threshold, the service's fallback."""
    e = _events(spark, d)
    s = F.col("retrieved_sources")
    n = lambda f: F.coalesce(F.when(s.isNotNull(), F.size(F.filter(s, f))), F.lit(0)).cast("long")
    counts = e.select(F.col("id").alias("query_id"), n(lambda x: F.lit(True)).alias("retrieved"), n(lambda x: x["page"].isNotNull()).alias("placed"), n(lambda x: F.isnan(x["score"])).alias("no_score"))
    rows = e.select(F.col("id").alias("query_id"), F.col("generated_answer").alias("answer"), F.explode(s).alias("s")).select("query_id", "answer", F.col("s.score").alias("score"))
    kept = retrieval.apply_threshold(rows, F.lit(THRESHOLD).cast("float")).select("query_id", "answer").distinct()
    return counts.join(retrieval.with_fallback(counts, kept, "I cannot answer this based on the available lecture notes."), "query_id").select(F.col("query_id").alias("id"), "retrieved", "placed", "no_score", F.col("answer").alias("reply"))


@query(f"WITH e AS ({_E1}) SELECT id, list_concat(coalesce(list_transform(retrieved_sources, lambda s: s.text), []), coalesce(list_transform(list_filter(agentic_trace.tool_calls, lambda c: c.success), lambda c: c.result_preview), [])) AS texts FROM e")
def merged_sources(spark, d):
    """Sources of the user's search and results of successful tool calls, in order."""
    none = F.array().cast("array<string>")
    calls = F.filter("agentic_trace.tool_calls", lambda c: c["success"])
    return _events(spark, d).select("id", F.concat(F.coalesce(F.col("retrieved_sources.text"), none), F.coalesce(F.transform(calls, lambda c: c["result_preview"]), none)).alias("texts"))


@query(f"""WITH q AS ({_terms_sql(f"SELECT id, question AS text FROM ({_E1}) WHERE lower(trim(operation_type)) = 'agentic_run'")}), c AS (SELECT unnest(agentic_trace.tool_calls) AS c FROM ({_E1})),
w AS (SELECT lower(trim(c.tool_name)) AS tool, unnest({_terms_of("coalesce(c.arguments, '')")}) AS term FROM c WHERE c.tool_name IS NOT NULL), t AS (SELECT tool, term, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2),
l AS (SELECT tool, sqrt(sum(n * n)) AS l FROM t GROUP BY 1), ql AS (SELECT id, sqrt(sum(weight * weight)) AS l FROM q GROUP BY 1),
s AS (SELECT q.id, t.tool, round(sum(q.weight * t.n) / any_value(l.l) / any_value(ql.l), 9) AS score FROM q JOIN t USING (term) JOIN l USING (tool) JOIN ql ON ql.id = q.id GROUP BY 1, 2)
SELECT id, tool, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, tool) AS rank FROM s) WHERE rank <= 3""")
def ranked_tools(spark, d):
    """The three tools closest to the question of each agent's run, by the cosine with the terms of all their calls."""
    e = _events(spark, d)
    calls = e.select(F.explode("agentic_trace.tool_calls").alias("c")).where(F.col("c.tool_name").isNotNull())
    t = calls.select(F.lower(F.trim("c.tool_name")).alias("tool"), F.explode(tx.terms(F.col("c.arguments"))).alias("term")).groupBy("tool", "term").agg(F.count("*").cast("double").alias("n"))
    t = materialize(t, "tools")  # a row for each tool and term
    t = join_small(t, t.groupBy("tool").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l")), "tool").select("tool", "term", (F.col("n") / F.col("l")).alias("n"))
    q = retrieval.tf_postings(e.where(F.lower(F.trim("operation_type")) == "agentic_run").select("id", F.col("question").alias("text")))
    length = q.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("ql"))
    s = join_small(q, t, "term").groupBy("id", "tool").agg(F.sum(F.col("weight") * F.col("n")).alias("s")).join(length, "id")
    s = s.select(F.col("id").alias("query_id"), F.col("tool").alias("id"), F.round(F.col("s") / F.col("ql"), 9).alias("score"))
    return retrieval.ranked(s, 3).select(F.col("query_id").alias("id"), F.col("id").alias("tool"), F.round("score", 6).alias("score"), "rank")


# ---- lists and samples: the limit is the feature ----
@query("SELECT id, ts FROM (SELECT id, max(ts) AS ts FROM eval_events WHERE id IS NOT NULL GROUP BY 1) ORDER BY ts DESC NULLS LAST, id LIMIT 100")
def newest_events(spark, d):
    e = table(spark, d, "eval_events").where(F.col("id").isNotNull()).groupBy("id").agg(F.max("ts").alias("ts"))
    return store.newest(e, "ts", "id", 100)


@query("SELECT line_no, line FROM eval_jsonl ORDER BY line_no LIMIT 100")
def first_lines(spark, d):
    return table(spark, d, "eval_jsonl").select("line_no", "line").orderBy("line_no").limit(100)


@query("SELECT id FROM (SELECT DISTINCT id FROM eval_events WHERE id IS NOT NULL) ORDER BY md5('7:' || id), id LIMIT 100")
def sampled_events(spark, d):
    return store.sample_of(table(spark, d, "eval_events").where(F.col("id").isNotNull()).select("id").distinct(), "id", 100, 7)


@query("SELECT id, document_id, filename FROM (SELECT DISTINCT ON (id) * FROM analyze_results WHERE id IS NOT NULL ORDER BY id, created_at DESC NULLS LAST, status DESC NULLS LAST, filename DESC NULLS LAST) WHERE lower(trim(status)) = 'failed'")
def failed_results(spark, d):
    r = table(spark, d, "analyze_results").where(F.col("id").isNotNull())
    last = r.groupBy("id").agg(F.max(F.struct("created_at", "status", "filename", "document_id")).alias("r")).select("id", "r.*")
    return last.where(F.lower(F.trim("status")) == "failed").select("id", "document_id", "filename")


# ---- stores ----
@query("SELECT c.id, c.title, greatest(c.updated_at, m.last) AS updated_at FROM conversations c LEFT JOIN (SELECT conversation_id, max(created_at) AS last FROM messages GROUP BY 1) m ON m.conversation_id = c.id WHERE c.id IS NOT NULL")
def touched_conversations(spark, d):
    c = table(spark, d, "conversations").where(F.col("id").isNotNull())
    return store.touch(c, table(spark, d, "messages"), "id", "conversation_id").select("id", "title", "updated_at")


@query("""SELECT id, min(created_at) AS created_at, 'known' AS origin FROM conversations WHERE id IS NOT NULL GROUP BY 1
UNION ALL SELECT conversation_id, min(created_at), 'message' FROM messages m WHERE conversation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.id = m.conversation_id) GROUP BY 1""")
def inserted_conversations(spark, d):
    """Conversations, and those that only messages name: of several messages of one the first wins."""
    c = table(spark, d, "conversations").where(F.col("id").isNotNull()).groupBy("id").agg(F.min("created_at").alias("created_at")).withColumn("origin", F.lit("known"))
    m = table(spark, d, "messages").where(F.col("conversation_id").isNotNull()).select(F.col("conversation_id").alias("id"), "created_at", F.lit("message").alias("origin"))
    late = m.withColumn("no_time", F.col("created_at").isNull())  # a message without time comes last
    return store.insert_if_absent(c.withColumn("no_time", F.lit(False)), late, "id", "no_time").drop("no_time")


@query(f"WITH l AS ({_LINES}) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE line_no BETWEEN 2 AND 4")
def read_lines(spark, d):
    f = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return files.read_range(f, 2, 4)
