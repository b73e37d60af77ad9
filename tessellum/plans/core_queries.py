"""Queries over the reference's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.functions import vectors as vec
from tessellum.operators import chunking, evaluation, files, messages, retrieval, store
from tessellum.session import join_small, materialize, spread, table
from tessellum.streaming import workers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Settings of the queries below.
K, THRESHOLD, BUDGET = 10, 0.45, 3072


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- dense retrieval: every 50th vector against all ----
def _dense(spark: SparkSession, d: str, metric: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    points = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.knn(points, queries, K, metric).withColumn("score", F.round("score", 6)).select("query_id", "id", "score", "rank")


def _dense_sql(expr: str) -> str:
    return f"""
WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, {expr} AS score FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}"""


@query(_dense_sql("list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"))
def dense_knn_cosine(spark, d):
    return _dense(spark, d, "cosine")


@query(_dense_sql("list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])"))
def dense_knn_dot(spark, d):
    return _dense(spark, d, "dot")


def dense_knn_euclid(spark, d):
    return _dense(spark, d, "euclid").withColumn("score", F.round("score", 4))


query(_dense_sql("-list_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[])").replace("round(score, 6)", "round(score, 4)"))(dense_knn_euclid)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, NOT list_bool_and(list_transform(embedding, lambda x: isfinite(x))) OR list_bool_and(list_transform(embedding, lambda x: x = 0)) AS invalid FROM embeddings")
def vector_check(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vec.norm(v), 6).alias("norm"), vec.is_invalid(v).alias("invalid"))


# ---- sparse and fused retrieval over documents ----
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms_sql(source: str) -> str:
    return f"SELECT id, term, count(*) / sum(count(*)) OVER (PARTITION BY id) AS weight FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM ({source})) WHERE octet_length(encode(term)) > 1 AND term NOT IN ({_STOP}) GROUP BY id, term"


_DOCS = "SELECT doc_id AS id, text FROM documents"
_ITEMS = "SELECT item_id AS id, question AS text FROM eval_entries"
_ANSWERS = "SELECT item_id AS id, expected_answer AS text FROM eval_entries"


def _docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _items(spark, d, column="question"):
    return table(spark, d, "eval_entries").select(F.col("item_id").alias("id"), F.col(column).alias("text"))


@query(f"SELECT id, term, round(weight, 9) AS weight FROM ({_terms_sql(_DOCS)})")
def sparse_postings(spark, d):
    return retrieval.tf_postings(_docs(spark, d)).select("id", "term", F.round("weight", 9).alias("weight"))


def _ranked_sql(queries: str, k: int) -> str:
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT q.id AS query_id, p.id AS id, round(sum(p.weight * q.weight), 12) AS score FROM postings p JOIN ({_terms_sql(queries)}) q USING (term) GROUP BY 1, 2)) WHERE rank <= {k}"""


def _rounded(scores: DataFrame, digits: int = 12) -> DataFrame:
    return scores.withColumn("score", F.round("score", digits))


def _search(spark, d, column, k):
    """Ranked by the rounded score, so that sums of another order rank alike."""
    return retrieval.text_search(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _items(spark, d, column).withColumnRenamed("id", "query_id"), k)


@query(f"WITH postings AS ({_terms_sql(_DOCS)}) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_ranked_sql(_ITEMS, K)})")
def sparse_search(spark, d):
    return _search(spark, d, "question", K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_P = retrieval.prefetch(K)
_FUSED = f"""WITH postings AS ({_terms_sql(_DOCS)}), a AS ({_ranked_sql(_ITEMS, _P)}), b AS ({_ranked_sql(_ANSWERS, _P)}),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) """


def _fuse(spark, d):
    lists = [_search(spark, d, c, _P) for c in ("question", "expected_answer")]
    return retrieval.ranked(_rounded(retrieval.rrf(lists, 2 * _P).drop("rank")), K)


@query(_FUSED + f"SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def fused_search(spark, d):
    return _fuse(spark, d).withColumn("score", F.round("score", 9)).select("query_id", "id", "score", "rank")


@query(
    _FUSED
    + f""", t AS (SELECT r.query_id, r.rank, d.text, sum(octet_length(encode(coalesce(d.text, ''))) // 4) OVER (PARTITION BY r.query_id ORDER BY rank) AS used FROM r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= {K} AND d.text IS NOT NULL)
SELECT query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS context_md5, count(*) AS chunks FROM t WHERE used <= {BUDGET} GROUP BY 1"""
)
def budgeted_context(spark, d):
    return _context(spark, d, _fuse(spark, d))


def _context(spark, d, fused):
    fused = materialize(fused, "fused")  # k rows a query, read by the join and as its bound
    texts = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text")
    r = retrieval.token_budget(join_small(texts, fused, "id"), BUDGET, tx.token_estimate(F.col("text")))
    return retrieval.assemble_context(r).select("query_id", F.md5("context").alias("context_md5"), "chunks")


# every 50th document as a query: its text, and for the fusion its lead of 200 characters too
_EVERY_50 = "SELECT doc_id AS id, text FROM documents WHERE doc_id % 50 = 0"
_LEADS = "SELECT doc_id AS id, substring(text, 1, 200) AS text FROM documents WHERE doc_id % 50 = 0"


def _document_search(spark, d, k, chars=None):
    text = F.col("text") if chars is None else F.substring("text", 1, chars)
    q = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), text.alias("text"))
    return retrieval.text_search(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), q, k)


@query(f"WITH postings AS ({_terms_sql(_DOCS)}) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ({_ranked_sql(_EVERY_50, K)})")
def sparse_search_documents(spark, d):
    return _document_search(spark, d, K).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_FUSED_DOCUMENTS = _FUSED.replace(_ITEMS, _EVERY_50).replace(_ANSWERS, _LEADS)


def _fuse_documents(spark, d):
    lists = [_document_search(spark, d, _P, c) for c in (None, 200)]
    return retrieval.ranked(_rounded(retrieval.rrf(lists, 2 * _P).drop("rank")), K)


@query(_FUSED_DOCUMENTS + f"SELECT query_id, id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def fused_search_documents(spark, d):
    return _fuse_documents(spark, d).withColumn("score", F.round("score", 9)).select("query_id", "id", "score", "rank")


@query(ORACLE["budgeted_context"].replace(_FUSED, _FUSED_DOCUMENTS))
def budgeted_context_documents(spark, d):
    return _context(spark, d, _fuse_documents(spark, d))


@query(f"SELECT id, count(*) AS kept, round(sum(CAST(s.score AS DOUBLE)), 3) AS total FROM (SELECT id, unnest(retrieved_sources) AS s FROM (SELECT DISTINCT ON (id) id, retrieved_sources FROM eval_events ORDER BY id, ts)) WHERE NOT isnan(s.score) AND s.score >= {THRESHOLD}::FLOAT GROUP BY id")
def above_threshold(spark, d):
    e = table(spark, d, "eval_events").groupBy("id").agg(F.min_by("retrieved_sources", "ts").alias("s"))
    x = e.select("id", F.explode("s").alias("s")).select("id", F.col("s.score").alias("score"))
    x = x.where(~F.isnan("score") & (F.col("score") >= F.lit(THRESHOLD).cast("float")))
    return x.groupBy("id").agg(F.count("*").alias("kept"), F.round(F.sum(F.col("score").cast("double")), 3).alias("total"))


# ---- text ----
@query("SELECT doc_id, p - 1 AS chunk_index, substring(text, CAST((p - 1) * 400 + 1 AS BIGINT), 500) AS text, (p - 1) * 400 AS offset FROM (SELECT doc_id, text, unnest(range(1, CAST(ceil(length(text) / 400.0) AS BIGINT) + 1)) AS p FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "offset")


@query()
def packed_chunks(spark, d):
    return chunking.packed_chunks(spread(table(spark, d, "documents").select("doc_id", "text", "content_type")))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])([\\s])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(regexp_replace(x, '\\s+', '', 'g')) > 0)) AS sentences, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: length(regexp_replace(x, '\\s+', '', 'g')) > 0)) AS paragraphs FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"), F.size(tx.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query()
def sanitized(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.sanitize(F.col("text")).alias("text"))


@query(f"SELECT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(term))), lambda i: ('0x' || substr(hex(encode(term)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)), lambda a, b: ((xor(a, b) * 16777619::BIGINT) & 4294967295::BIGINT)) AS hash FROM (SELECT DISTINCT term FROM ({_terms_sql(_DOCS)}))")
def term_hashes(spark, d):
    t = _docs(spark, d).select(F.explode(tx.terms(F.col("text"))).alias("term")).distinct()
    return t.select("term", tx.fnv1a32(F.col("term")).alias("hash"))


@query("SELECT doc_id, regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') AS title, content_type, CASE content_type WHEN 'Pdf' THEN 'application/pdf' WHEN 'Audio' THEN 'audio/mpeg' WHEN 'Video' THEN 'video/mp4' WHEN 'Text' THEN 'text/plain' END AS mime, CASE WHEN filename IS NULL THEN text ELSE 'Title: ' || regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1') || chr(10) || 'Page: N/A' || chr(10) || 'Content: ' || text END AS contextual FROM documents")
def contextual_documents(spark, d):
    t = table(spark, d, "documents")
    title = tx.strip_extension(F.col("filename"))
    return t.select("doc_id", title.alias("title"), "content_type", tx.mime_of(F.col("content_type")).alias("mime"), tx.contextual(F.col("text"), title, F.lit(None).cast("int"), F.lit(None).cast("double")).alias("contextual"))


_LINES = "SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@query(f"WITH l AS ({_LINES}), h AS (SELECT *, regexp_matches(line, '(?i)lease_seconds') AS hit FROM l), w AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_no AS INTEGER) AS line_no, line, hit FROM w WHERE near")
def grep_lines(spark, d):
    f = spread(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))
    return files.grep(f, "(?i)lease_seconds", context=1)


# ---- messages ----
_DEDUP = "SELECT DISTINCT ON (id) * FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL ORDER BY id, created_at"


def _messages(spark, d):
    m = table(spark, d, "messages").where(F.col("conversation_id").isNotNull() & F.col("created_at").isNotNull())
    cols = [c for c in m.columns if c not in ("id", "created_at")]
    return m.groupBy("id").agg(F.min(F.struct("created_at", *cols)).alias("r")).select("id", "r.*")


@query(f"WITH m AS ({_DEDUP}), r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY conversation_id) AS n FROM m) SELECT conversation_id, id, content, CAST(least(n, 3) - back + 1 AS INTEGER) AS place FROM r WHERE back <= 3")
def last_messages(spark, d):
    return messages.last_messages(_messages(spark, d), 3).select("conversation_id", "id", "content", "place")


@query(f"WITH m AS ({_DEDUP}) SELECT conversation_id, arg_max(content, (created_at, id)) AS content FROM m WHERE upper(trim(role)) = 'USER' GROUP BY 1")
def last_user_message(spark, d):
    return messages.last_of_role(_messages(spark, d), "USER")


@query(f"""WITH m AS ({_DEDUP}), t AS (SELECT *, octet_length(encode(coalesce(content, ''))) // 4 AS tok, upper(trim(role)) IN ('TOOL', 'TOOL_RESPONSE') AS p FROM m),
w AS (SELECT *, sum(tok) OVER (PARTITION BY conversation_id) AS total, row_number() OVER (PARTITION BY conversation_id, p ORDER BY created_at DESC, id DESC) <= 2 AS late FROM t),
x AS (SELECT *, coalesce(sum(CASE WHEN p AND NOT late THEN tok ELSE 0 END) OVER (PARTITION BY conversation_id, p ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT conversation_id, count(*) AS messages, CAST(sum(tok) AS BIGINT) AS tokens FROM x WHERE NOT (p AND NOT late AND total - before > 200) GROUP BY 1""")
def pruned_messages(spark, d):
    m = _messages(spark, d)
    tok = tx.token_estimate(F.col("content"))
    kept = messages.prune(m, 200, tok, F.upper(F.trim("role")).isin("TOOL", "TOOL_RESPONSE"), [F.col("created_at"), F.col("id")])
    return kept.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.sum(tok).alias("tokens"))


@query(f"""WITH m AS ({_DEDUP}), c AS (SELECT DISTINCT conversation_id, id AS message_id, c.id AS call_id FROM (SELECT conversation_id, id, unnest(from_json(content, '[{{"id": "VARCHAR"}}]')) AS c FROM m WHERE upper(trim(role)) = 'TOOL' AND json_valid(content) AND json_type(content) = 'ARRAY')),
a AS (SELECT conversation_id, tool_call_id AS call_id, arg_max(content, (created_at, id)) AS answer FROM m WHERE upper(trim(role)) = 'TOOL_RESPONSE' GROUP BY 1, 2)
SELECT conversation_id, count(DISTINCT message_id) AS iterations, count(*) AS calls, count(*) FILTER (coalesce(starts_with(answer, '[tool_error]') OR starts_with(answer, '[tool_timeout]'), false)) AS failed FROM c LEFT JOIN a USING (conversation_id, call_id) GROUP BY 1""")
def conversation_traces(spark, d):
    return messages.traces(_messages(spark, d))


@query(f"""WITH m AS ({_DEDUP}), c AS (SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST) AS rn FROM conversations WHERE id IS NOT NULL) WHERE rn = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS back, count(*) OVER (PARTITION BY conversation_id) AS n FROM m),
l AS (SELECT conversation_id, list(struct_pack(place := CAST(least(n, 1000) - back + 1 AS INTEGER), role := role, content := content) ORDER BY back DESC) AS messages FROM r WHERE back <= 1000 GROUP BY 1)
SELECT c.id AS conversation_id, c.title, coalesce(l.messages, []) AS messages FROM c LEFT JOIN l ON l.conversation_id = c.id""")
def nested_conversations(spark, d):
    return messages.nest(table(spark, d, "conversations").where(F.col("id").isNotNull()), _messages(spark, d))


@query("SELECT m.id, m.conversation_id FROM messages m WHERE m.conversation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.id = m.conversation_id)")
def orphan_messages(spark, d):
    return store.orphans(table(spark, d, "messages"), table(spark, d, "conversations"), "conversation_id", "id").select("id", "conversation_id")


# ---- evaluation ----
_E1 = "SELECT DISTINCT ON (id) * FROM eval_events ORDER BY id, ts"


def _events(spark, d):
    e = table(spark, d, "eval_events")
    return e.groupBy("id").agg(F.min_by(F.struct(*[c for c in e.columns if c != "id"]), "ts").alias("r")).select("id", "r.*")


@query("""WITH e AS (SELECT id, list_filter(list_transform(retrieved_sources, lambda s: CASE WHEN NOT isnan(s.score) AND s.score >= 0.5 THEN s.page END), lambda x: x IS NOT NULL) AS expected, list_transform(retrieved_sources[1:3], lambda s: s.page) AS pages FROM (SELECT DISTINCT ON (id) * FROM eval_events ORDER BY id, ts))
SELECT id, round(CASE WHEN coalesce(len(expected), 0) = 0 THEN 1.0 ELSE len(list_filter(expected, lambda p: list_contains(pages, p))) / len(expected)::DOUBLE END, 6) AS recall FROM e""")
def context_recall(spark, d):
    s = F.col("retrieved_sources")
    expected = F.filter(F.transform(s, lambda x: F.when(~F.isnan(x["score"]) & (x["score"] >= 0.5), x["page"])), lambda p: p.isNotNull())
    return _events(spark, d).select("id", F.round(evaluation.context_recall(expected, F.transform(F.slice(s, 1, 3), lambda x: x["page"])), 6).alias("recall"))


@query(f"SELECT CASE WHEN lower(trim(operation_type)) IN ('query', 'agentic_run', 'ingestion_pdf', 'ingestion_mp4') THEN lower(trim(operation_type)) ELSE 'query' END AS operation, count(*) AS events, count(agentic_trace.reflection_score) AS reflected, round(avg(CAST(agentic_trace.reflection_score AS DOUBLE)), 6) AS mean_reflection, count(*) FILTER (agentic_trace.reflection_score < 0.7::FLOAT) AS below FROM ({_E1}) GROUP BY 1")
def operation_report(spark, d):
    r = F.col("agentic_trace.reflection_score")
    e = _events(spark, d).withColumn("operation", evaluation.operation(F.col("operation_type")))
    return e.groupBy("operation").agg(F.count("*").alias("events"), F.count(r).alias("reflected"), F.round(F.avg(r.cast("double")), 6).alias("mean_reflection"), F.count_if(r < F.lit(0.7).cast("float")).alias("below"))


@query(f"SELECT c.tool_name AS tool_name, count(*) AS calls, count(*) FILTER (NOT coalesce(c.success, false) OR coalesce(starts_with(c.result_preview, '[tool_error]') OR starts_with(c.result_preview, '[tool_timeout]'), false)) AS failed FROM (SELECT unnest(agentic_trace.tool_calls) AS c FROM ({_E1})) WHERE c IS NOT NULL GROUP BY 1")
def tool_rollup(spark, d):
    return evaluation.tool_rollup(_events(spark, d))


def _overlap_judge(prompt):
    """A deterministic stand-in for a judge: the share of the answer's words that the sources hold."""
    parts = F.split(prompt, "Answer:\n")
    answer, rest = F.array_distinct(tx.terms(F.element_at(parts, -1))), tx.terms(F.get(parts, 0))
    return F.concat(F.lit("Score: "), F.round(F.size(F.array_intersect(answer, rest)) / F.greatest(F.size(answer), F.lit(1)), 4).cast("string"), F.lit("."))


def _terms_of(text: str) -> str:
    """SQL for the terms of a text that is not null."""
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: octet_length(encode(w)) > 1 AND w NOT IN ({_STOP}))"


@query(f"""WITH e AS ({_E1}), p AS (SELECT id, CASE WHEN lower(trim(operation_type)) IN ('query', 'agentic_run', 'ingestion_pdf', 'ingestion_mp4') THEN lower(trim(operation_type)) ELSE 'query' END AS operation, coalesce(TRY_CAST(trim(generated_answer) AS INTEGER), 0) AS chunks, coalesce(len(retrieved_sources), 0) AS n,
 list_distinct({_terms_of("coalesce(generated_answer, '')")}) AS a, {_terms_of("'Rate from 0 to 1 how far the sources support the answer. ' || array_to_string(list_transform(coalesce(retrieved_sources, []), lambda s, i: 'Source ' || i || ': ' || coalesce(s.text, '')), ' ')")} AS r FROM e)
SELECT id, operation, CASE WHEN starts_with(operation, 'ingestion_') AND chunks <= 0 THEN 0.0 WHEN starts_with(operation, 'ingestion_') AND n = 0 THEN 1.0 ELSE round(len(list_intersect(a, r)) / greatest(len(a), 1)::DOUBLE, 4) END AS faithfulness FROM p""")
def scored_events(spark, d):
    return evaluation.score_events(_events(spark, d), _overlap_judge)


# ---- stores ----
@query("SELECT id, arg_max(status, (created_at, status)) AS status FROM analyze_results WHERE id IS NOT NULL GROUP BY 1")
def latest_status(spark, d):
    return workers.latest_states(table(spark, d, "analyze_results").where(F.col("id").isNotNull()), "id", "created_at", "status")


_OLD, _NEW = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0", "SELECT o_orderkey, 'N' AS o_orderstatus, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


def _old_new(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.round(F.col("o_totalprice") * 2, 2).alias("o_totalprice"))


@query(f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}))")
def upserted_orders(spark, d):
    return store.upsert(*_old_new(spark, d), "o_orderkey")


@query(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_OLD}))")
def inserted_orders(spark, d):
    return store.insert_if_absent(*_old_new(spark, d), "o_orderkey", "o_totalprice")


@query(f"SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}))")
def kept_orders(spark, d):
    old, new = _old_new(spark, d)
    return store.delete_ids(old, new, "o_orderkey")


@query("SELECT id, created_at FROM (SELECT DISTINCT id, created_at FROM analyze_results WHERE lower(status) <> 'succeeded' AND id IS NOT NULL) ORDER BY created_at, id LIMIT 10")
def claimed_results(spark, d):
    q = table(spark, d, "analyze_results").where((F.lower("status") != "succeeded") & F.col("id").isNotNull()).select("id", "created_at").distinct().withColumn("status", F.lit("pending"))
    return store.claim(q, 10).select("id", "created_at")


# ---- streaming ----
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    return workers.drain(workers.window_counts(workers.read_table(spark, f"{d}/events.parquet")), "update", ("bucket", "event_type"))


@query("SELECT DISTINCT id FROM eval_events")
def stream_outbox(spark, d):
    events = workers.read_table(spark, f"{d}/eval_events.parquet").where(F.col("id").isNotNull())
    return workers.outbox(events, lambda b: evaluation.score_events(b, _overlap_judge)).select("id")


# ---- relational extensions ----
@query("SELECT n_name, CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def ext_revenue_by_nation(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)").alias("v"))
    per = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("v").alias("v"))  # one row an order before any join
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")).join(per, "o_orderkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return o.join(c, "o_custkey").groupBy("n_name", "year").agg(F.sum("v").cast("double").alias("revenue"), F.count("*").alias("orders"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_lineitem_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
