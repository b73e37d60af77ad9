import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum import session
from tessellum.functions import text as tx
from tessellum.operators import chunking, evaluation, files, messages, retrieval, store
from tessellum.streaming import workers

WORDS = str.split


def count(t):
    return len(t.split())


@pytest.mark.parametrize(("limit", "overlap"), [(10, 0), (10, 3), (6, 5), (4, 2)])
def test_packing_loses_nothing_and_keeps_the_limit(limit, overlap):
    text = " ".join(f"w{i} x y z." if i % 3 else f"long{i} " + "a " * 12 + "end." for i in range(30))
    chunks = chunking.semantic(text, limit, overlap, count)
    assert all(count(c) <= limit for c, _ in chunks)
    assert set(text.split()) == {w for c, _ in chunks for w in c.split()}
    offs = [o for _, o in chunks]
    assert offs == sorted(offs) and all(text.encode()[o:].decode().startswith(c.split()[0]) for c, o in chunks)


def test_short_paragraphs_become_one_chunk():
    assert [c for c, _ in chunking.semantic("One two.\n\nThree four.", 50, 5, count)] == ["One two. Three four."]


def test_markdown_sections_fences_and_trail():
    md = "Intro text.\n# Root\n## Branch\n### Leaf\nContent here.\n\n```\na = 1\n\nb = 2\n```\n| a | b |\n| 1 | 2 |\n## Empty\n## Next\nDr. Who met Mr. X. Second one."
    got = chunking.markdown(md, 100, count)
    assert got == ["Intro text.", "# Root > ## Branch > ### Leaf\nContent here.\n```\na = 1\n\nb = 2\n```\n| a | b |\n| 1 | 2 |", "# Root > ## Next\nDr. Who met Mr. X. Second one."]
    long = "## Big\n" + " ".join(f"Sentence number {i} is here." for i in range(20))
    parts = chunking.markdown(long, 25, count)
    assert len(parts) > 2 and all(p.startswith("## Big\n") and count(p) <= 27 for p in parts)
    assert chunking.markdown("", 10, count) == [] and chunking.markdown("# A\n## B", 10, count) == []
    assert chunking.sentences("See e.g. this. 1. First. Done") == ["See e.g. this.", "1. First.", "Done"]


def test_segments():
    parts = [("one two", 10.0), ("three four five six seven", 20.0), ("eight", 30.0), (" ", 40.0)]
    assert chunking.segments(parts, 50, 5, count) == [("one two three four five six seven eight", 0, 10.0)]
    assert [c[2] for c in chunking.segments(parts, 3, 0, count)] == [10.0, 20.0, 30.0]
    assert chunking.segments([], 5, 0, count) == []


def test_chunk_frames(spark):
    df = spark.createDataFrame([(1, "abcdefghij", "Text"), (2, "", "Text"), (3, None, "Pdf"), (4, "# H\ntext", "Pdf"), (5, "[01:05] hello there\n[02:00] bye", "Audio"), (6, "x", None)], "doc_id long, text string, content_type string")
    got = {(r.doc_id, r.offset): r.text for r in chunking.fixed_chunks(df.where("doc_id <= 3"), 4, 1).collect()}
    assert got == {(1, 0): "abcd", (1, 3): "defg", (1, 6): "ghij", (1, 9): "j"}
    rows = {(r.doc_id, r.chunk_index): (r.text, r.offset, r.start_time) for r in chunking.packed_chunks(df).collect()}
    assert rows == {(1, 0): ("abcdefghij", 0, None), (4, 0): ("# H\ntext", None, None), (5, 0): ("hello there bye", 0, 65.0), (6, 0): ("x", 0, None)}


@pytest.mark.parametrize("metric", retrieval.METRICS)
def test_knn_against_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(300, 8))
    p[5] = p[6]
    rows = [(i, v.tolist()) for i, v in enumerate(p)] + [(900, [0.0] * 8), (901, [float("nan")] * 8), (902, None), (903, [1.0, 2.0])]
    pts = spark.createDataFrame(rows, "id long, vector array<double>")
    qs = pts.where("id % 50 = 0 and id < 300").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(5000, [0.0] * 8)], "query_id long, vector array<double>"))
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.knn(pts, qs, 7, metric, block=3).collect()}
    for q in range(0, 300, 50):
        s = p @ p[q] if metric == "dot" else -np.linalg.norm(p - p[q], axis=1) if metric == "euclid" else p @ p[q] / np.linalg.norm(p, axis=1) / np.linalg.norm(p[q])
        want = sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:7]
        assert [got[q, k + 1][0] for k in range(7)] == want
        assert [got[q, k + 1][1] for k in range(7)] == pytest.approx([s[i] for i in want], abs=1e-6)
    assert len(got) == 42


def test_sparse_weights_and_search(spark):
    df = spark.createDataFrame([(1, "rust rust rust other"), (2, "the is a an to for"), (3, ""), (4, None), (5, "other rust")], "id long, text string")
    w = {(r.id, r.term): r.weight for r in retrieval.tf_postings(df).collect()}
    assert w == {(1, "rust"): 0.75, (1, "other"): 0.25, (5, "rust"): 0.5, (5, "other"): 0.5}
    q = spark.createDataFrame([(7, "rust", 1.0), (8, "none", 1.0)], "query_id long, term string, weight double")
    assert [(r.id, r.score) for r in retrieval.sparse_search(retrieval.tf_postings(df), q, 1).collect()] == [(1, 0.75)]


def test_fusion_threshold_budget_and_context(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    got = [(r.id, round(r.score, 6)) for r in retrieval.rrf([a, b], 3).orderBy("rank").collect()]
    assert got == [(11, round(1 / 61 + 1 / 62, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]
    res = spark.createDataFrame([(1, 1, 0.95, "aaaa", 5), (1, 2, 0.7, "bb", 4), (1, 3, 0.8, "c", 1), (2, 1, 0.3, "d", 1), (3, 1, float("nan"), "e", 1)], "query_id long, rank int, score double, text string, tok int")
    kept = retrieval.apply_threshold(res, 0.7)
    assert kept.count() == 3
    in_budget = retrieval.token_budget(kept, 8, F.col("tok"))
    assert [r["rank"] for r in in_budget.collect()] == [1]
    ctx = retrieval.assemble_context(kept).withColumnRenamed("context", "answer")
    assert {r.query_id: r.answer for r in retrieval.with_fallback(res, ctx, "none").collect()} == {1: "aaaa\n\nbb\n\nc", 2: "none", 3: "none"}


def test_zip_vectors_fails_on_mismatch(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "k long, text string")
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k long, vector array<double>")
    assert retrieval.zip_vectors(c, v, ["k"]).count() == 2
    with pytest.raises(Exception, match="do not match"):
        retrieval.zip_vectors(c, v.where("k = 1"), ["k"]).collect()


def msgs(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, c, r, x, k, t + dt.timedelta(seconds=s)) for i, c, r, x, k, s in rows], "id string, conversation_id string, role string, content string, tool_call_id string, created_at timestamp_ntz")


def test_messages(spark):
    call = '[{"id": "k1", "name": "n", "arguments": "{}"}, {"id": "k2", "name": "n", "arguments": "{}"}]'
    m = msgs(spark, [("a", "c", "USER", "Message 1", None, 1), ("b", "c", "TOOL", call, None, 2), ("d", "c", "TOOL_RESPONSE", "ok", "k1", 3), ("e", "c", "TOOL_RESPONSE", "[tool_error] x", "k1", 4), ("f", "c", "user ", "Message 5", None, 5), ("g", None, "USER", "x", None, 6)])
    assert [(r.place, r.id) for r in messages.last_messages(m, 3).orderBy("place").collect()] == [(1, "d"), (2, "e"), (3, "f")]
    assert messages.last_of_role(m, "USER").collect()[0].content == "Message 5"
    assert tuple(messages.traces(m).collect()[0]) == ("c", 1, 2, 1)
    conv = spark.createDataFrame([("c", "t", 1), ("c", "t2", 2), ("z", None, 1)], "id string, title string, updated_at int")
    got = {r.conversation_id: (r.title, [x.content for x in r.messages]) for r in messages.nest(conv, m, 2).collect()}
    assert got == {"c": ("t2", ["[tool_error] x", "Message 5"]), "z": (None, [])}


def test_pruning(spark):
    m = msgs(spark, [(f"m{i}", "c", "TOOL" if i % 2 else "USER", "x" * 10, None, i) for i in range(10)])
    kept = lambda budget, order: {r.id for r in messages.prune(m, budget, F.length("content"), F.col("role") == "TOOL", order).collect()}
    users, late = {f"m{i}" for i in range(0, 10, 2)}, {"m7", "m9"}
    old = [F.col("created_at")]
    assert kept(100, old) == users | {f"m{i}" for i in range(1, 10, 2)}
    assert kept(85, old) == users | late | {"m5"}
    assert kept(10, old) == users | late
    assert kept(95, [F.desc("created_at")]) == users | late | {"m1", "m3"}


def test_stores(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, at int")
    b = spark.createDataFrame([(2, "B", 2), (3, "C", 2)], "k long, v string, at int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(store.upsert(t, b, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(store.insert_if_absent(t, b.unionByName(spark.createDataFrame([(3, "D", 1)], b.schema)), "k", "at")) == [(1, "a"), (2, "b"), (3, "D")]
    assert rows(store.delete_ids(t, b, "k")) == [(1, "a")]
    assert rows(store.latest(t.unionByName(b), "k", "at")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(store.upsert(t, b.limit(0), "k")) == rows(t)
    e = spark.createDataFrame([("x", 1), ("y", 9)], "entry string, k long")
    ok, missing = store.resolve(e, t, "k", "k")
    assert ok.count() == 1 and missing.collect()[0].error == "event 9 not found"
    q = spark.createDataFrame([("c", "pending", 3), ("a", "done", 1), ("b", "pending", 2)], "id string, status string, created_at int")
    assert [r.id for r in store.claim(q, 1).collect()] == ["b"]


@pytest.mark.parametrize(("expected", "pages", "want"), [([3, 5], [3, 5], 1.0), ([3, 5, 7], [3, 5, None], 2 / 3), (None, [1], 1.0), ([], [1], 1.0), ([1], [], 0.0), ([1], [None], 0.0)])
def test_context_recall(spark, expected, pages, want):
    df = spark.createDataFrame([(expected, pages)], "e array<int>, p array<int>")
    assert df.select(evaluation.context_recall(F.col("e"), F.col("p"))).first()[0] == pytest.approx(want)


def test_scored_events(spark):
    rows = [("a", "ingestion_pdf", "0", []), ("b", "ingestion_mp4", "12", []), ("c", "ingestion_pdf", "12", [("x",)]), ("d", "Query", "ans", [("x",)]), ("e", "odd", None, None)]
    df = spark.createDataFrame(rows, "id string, operation_type string, generated_answer string, retrieved_sources array<struct<text:string>>")
    got = {r.id: (r.operation, r.faithfulness) for r in evaluation.score_events(df, lambda p: F.lit("Score: 0.95")).collect()}
    assert got == {"a": ("ingestion_pdf", 0.0), "b": ("ingestion_mp4", 1.0), "c": ("ingestion_pdf", 0.95), "d": ("query", 0.95), "e": ("query", 0.95)}
    rep = evaluation.report(spark.createDataFrame([(0.3, 1.0), (0.9, None), (float("nan"), 0.5)], "faithfulness double, context_recall double")).first()
    assert (rep.total_evaluated, rep.mean_faithfulness, rep.mean_context_recall, rep.failed_count) == (3, pytest.approx(0.6), 0.75, 1)


def test_files(spark):
    f = spark.createDataFrame([("a.txt", "alpha\nbeta\ngamma\ndelta\nepsilon"), ("b.rs", "// fn no\npub fn add() {}\nfn private() {}\nlet x;"), ("c.py", "async def fetch():\n  x\ndef greet():"), ("n.txt", None)], "path string, text string")
    assert [(r.line_no, r.line, r.hit) for r in files.grep(f, "gamma", 1).orderBy("line_no").collect()] == [(2, "beta", False), (3, "gamma", True), (4, "delta", False)]
    assert {(r.path, r.line_no) for r in files.signatures(f).collect()} == {("b.rs", 2), ("b.rs", 3), ("c.py", 1), ("c.py", 3)}
    assert [r.line for r in files.read_range(f.where("path = 'a.txt'"), 2, 3).orderBy("line_no").collect()] == ["beta", "gamma"]
    assert [r.path for r in files.listing(f, 2).collect()] == ["a.txt", "b.rs"]


@pytest.mark.parametrize(
    ("ext", "hits", "others"),
    [
        ("rs", ["pub fn add(a: i32) {", "    async fn run() {", "pub(crate) struct Node;", "enum Kind {", "impl<T> Store<T> {", "pub type Id = u64;"], ["let fnord = 3;", "// fn no()", "    run(x);", "use a::b;"]),
        ("py", ["def greet(name):", "    async def fetch():"], ["class A:", "# def no():", "greet(1)", "default = 2"]),
        ("go", ["func main() {", "func (s *Server) Close() error {"], ["var x = 1", "go run()"]),
        ("js", ["function load(a) {", "async function go() {", "export const f = (x) => x", "let g = async () => 1", "run(a, b) {"], ["const n = 3;", "run(a);"]),
        ("tsx", ["export async function load() {", "  private find(id: string) {", "export const f = (x) => x", "  inner(a) {"], ["const n = 3;", "let m = n;"]),
        ("java", ["public static void main(String[] a) {", "  int size() {", "public Node(int x) {"], ["int x = 3;", "}"]),
        ("cpp", ["int main(int argc) {", "std::vector<int> read(const char *p)", "static char *name(void) {"], ["run(a);", "int next(int x);", "int x = 3;"]),
        ("txt", [], ["foo(bar)", "def greet(name):"]),
        ("", [], ["foo(bar)"]),
    ],
)
def test_signatures_of_each_language(spark, ext, hits, others):
    text = "\n".join([*hits, *others])
    f = spark.createDataFrame([(f"a.{ext}" if ext else "a", text), ("b.rs", None)], "path string, text string")
    assert [r.line for r in files.signatures(f).orderBy("line_no").collect()] == hits


def test_salted_join_equals_the_plain_one(spark, monkeypatch):
    big = spark.createDataFrame([(i % 3 if i % 9 else None, i) for i in range(90)], "k int, v int")
    side = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (7, "d"), (None, "e")], "k int, w string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(session.salted_join(big, side, ["k"], how)) == rows(big.join(side, "k", how)), how
    assert session.small_enough(side) and not session.small_enough(side, rows=4)
    wide = spark.createDataFrame([(1, "x" * 10_000)] * 20, "k int, w string")
    assert not session.small_enough(wide, size=100_000)  # few rows, many bytes
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100_000)
    plan = session.join_small(big, wide, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan and "_salt" in plan


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert session.shared_dir(spark)
    conf, ctx = type("C", (), {"get": lambda *_: None})(), spark.sparkContext
    none = type("N", (), {"isDefined": lambda _: False})()
    jsc = type("J", (), {"sc": lambda _: type("S", (), {"getCheckpointDir": lambda _: none})()})()
    far = type("X", (), {"conf": conf, "sparkContext": type("Y", (), {"master": "spark://host:7077", "_jsc": jsc})()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(far)
    assert ctx.master.startswith("local")


def test_streams_equal_batch(spark, sf):
    batch = {tuple(r) for r in workers.window_counts(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    assert {tuple(r) for r in workers.drain(workers.window_counts(workers.read_table(spark, f"{sf}/events.parquet")), "complete").collect()} == batch
    out = workers.outbox(workers.read_table(spark, f"{sf}/eval_events.parquet"), lambda b: b.select("id"))
    ids = [r.id for r in out.collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{sf}/eval_events.parquet").select("id").distinct().count()


def test_numbered_sources_and_term_shares(spark):
    src = "sources array<struct<text:string,page:int,score:float>>, title string, a string, b string"
    long = "é" * 500
    rows = [([("one", 3, 0.5), (long, None, 0.126)], "Doc", "red red blue", "red green"), ([], None, "", None), (None, "x", "the is", "red")]
    df = spark.createDataFrame(rows, src)
    got = [r[0] for r in df.select(tx.numbered_sources(F.col("sources"), F.col("title"))).collect()]
    assert got[0] == "Found 2 relevant sources:\n1. [Doc - Page 3, score: 0.50]: one\n2. [Doc - Page ?, score: 0.13]: " + "é" * 400
    assert got[1] == got[2] == "No relevant documents found in the knowledge base."
    cos = [r[0] for r in df.select(tx.tf_cosine(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")))).collect()]
    assert cos == [pytest.approx(2 / (5**0.5 * 2**0.5)), 0.0, 0.0]
    assert [r[0] for r in df.select(tx.share_of_terms(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def test_lexical_scores_of_each_kind(spark):
    call = "struct<tool_name:string,arguments:string,result_preview:string,success:boolean>"
    schema = f"id string, question string, generated_answer string, operation_type string, retrieved_sources array<struct<text:string,page:int,score:float>>, agentic_trace struct<iterations:int,tool_calls:array<{call}>>"
    s = [("red cars", 1, 0.5), ("green", 2, 0.1)]
    rows = [
        ("q", "red bikes", "red cars", "Query", s, None), ("i0", "f", "0", "ingestion_pdf", s, None), ("i1", "f", "12", "ingestion_pdf", [], None), ("i2", "f", "12", "ingestion_mp4", [*s, ("", 1, 0.1), (None, 1, 0.1)], None),
        ("a0", "red", "red", "agentic_run", [("red", 1, 0.9)], (1, [])), ("a1", "red", "red sky", "agentic_run", None, (1, [("t", "{}", "a red box", True), ("t", "{}", None, False)])), ("n", None, None, None, None, None),
    ]
    got = {r.id: tuple(r)[1:] for r in evaluation.lexical_scores(spark.createDataFrame(rows, schema)).collect()}
    assert got["q"] == ("query", 1.0, 0.5, 0.5, False)
    assert got["i0"] == ("ingestion_pdf", 0.0, None, None, True) and got["i1"] == ("ingestion_pdf", 1.0, None, None, False) and got["i2"] == ("ingestion_mp4", 0.5, None, None, True)
    assert got["a0"] == ("agentic_run", 1.0, 1.0, None, False) and got["a1"] == ("agentic_run", 0.5, 1.0, 0.5, True) and got["n"] == ("query", 0.0, 0.0, 0.0, True)
