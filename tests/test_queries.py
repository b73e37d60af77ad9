import datetime as dt
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tessellum.operators import retrieval
from tessellum.plans import core_queries as cq


def plain(x):
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def both(spark, name, folder, *tables):
    """Sorted rows of a query, and of its SQL."""
    con = duckdb.connect()
    for t in tables:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if Path(path).is_dir() else ''}')")
    rows = lambda x: sorted(map(plain, x), key=repr)
    return rows(cq.QUERIES[name](spark, str(folder)).collect()), rows(con.execute(cq.ORACLE[name]).fetchall())


def test_nested_conversations_hold_the_last_thousand(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    sizes = {"short": 3, "middle": 45, "long": 1005}
    rows = [(f"{c}{i:04d}", c, "USER", f"m{i}", None, None, t + dt.timedelta(seconds=i)) for c, n in sizes.items() for i in range(n)]
    spark.createDataFrame(rows + rows[:2], "id string, conversation_id string, role string, content string, tool_call_id string, tool_name string, created_at timestamp_ntz").write.parquet(f"{tmp_path}/messages.parquet")
    conv = [(c, c.upper(), t, t) for c in sizes] + [("short", None, t, t + dt.timedelta(1)), ("none", "x", t, None), (None, "y", t, t)]
    spark.createDataFrame(conv, "id string, title string, created_at timestamp_ntz, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = both(spark, "nested_conversations", tmp_path, "messages", "conversations")
    assert got == want
    by_id = {c: [x[2] for x in m] for c, _, m in got}
    assert {c: len(m) for c, m in by_id.items()} == {"short": 3, "middle": 45, "long": 1000, "none": 0}
    assert by_id["long"] == [f"m{i}" for i in range(5, 1005)]


@pytest.mark.parametrize("name", ["sparse_search_documents", "fused_search_documents", "budgeted_context_documents"])
def test_every_50th_document_is_a_query(spark, sf, name):
    got, want = both(spark, name, Path(sf), "documents")
    every = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 50 = 0 and length(text) > 0").collect()}
    assert got == want
    assert {r[0] for r in got} == every


def test_text_search_in_blocks_equals_sparse_search(spark):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1 + i % 9))) for i in range(60)] + [(90, None), (91, ""), (92, "the is a")]
    docs = spark.createDataFrame(texts, "id long, text string")
    qs = docs.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    want = retrieval.sparse_search(retrieval.tf_postings(docs), retrieval.tf_postings(docs.where("id % 5 = 0")).withColumnRenamed("id", "query_id"), 100)
    rows = lambda df: sorted((r.query_id, r.id, round(r.score, 9)) for r in df.collect())
    got = retrieval.text_search(docs, qs, 100, block=4)
    assert rows(got) == rows(want)
    assert rows(retrieval.text_search(docs, qs, 3, block=4)) == rows(got.where("rank <= 3"))
    assert retrieval.text_search(docs, qs.limit(0)).count() == 0


def test_best_keeps_what_a_full_sort_keeps():
    rng = np.random.default_rng(2)
    q, i, s = rng.integers(0, 9, 3000), rng.permutation(3000), rng.integers(0, 40, 3000).astype(float)
    best = retrieval.Best(5)
    for at in range(0, 3000, 170):
        best.add(q[at : at + 170], i[at : at + 170].astype(object), s[at : at + 170])
        best.cut()
    want = [(int(a), -int(c), int(b)) for a in range(9) for c, b in sorted((-s[k], i[k]) for k in np.flatnonzero(q == a))[:5]]
    assert list(zip(best.query.tolist(), best.score.astype(int).tolist(), best.id.tolist(), strict=True)) == want


@pytest.mark.parametrize("name", ["hybrid_search", "entry_recall", "lexical_scores", "ranked_tools", "ingested_chunks", "conversation_traces", "stream_event_windows"])
def test_queries_equal_their_sql(spark, sf, name):
    import __spark_entry__ as entry

    tables = [p.stem for p in Path(sf).glob("*.parquet")]
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf)
    names = sorted(got.columns)
    sql = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in sql.description].index(n) for n in names]
    assert sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in sql.fetchall()), key=repr)
