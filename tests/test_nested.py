import json

import pytest
from pyspark.sql import types as T

from tessellum.operators import nested

SCHEMA = "line_no long, line string, id string"


def found(spark, lines):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], SCHEMA)
    return {tuple(r) for r in nested.found_children(df).collect()}


@pytest.mark.parametrize(
    ("value", "pairs"),
    [
        (None, []),
        ("", []),
        ({}, []),
        ([], []),
        ("[]", []),
        ([1, None, 3], [(0, 1), (2, 3)]),
        ({"0": "a", "5": "b"}, [(0, "a"), (5, "b")]),
        ({"10": "b", "9": "a"}, [(9, "a"), (10, "b")]),
        ('[{"a": 1}]', [(0, {"a": 1})]),
        ("wrong page", [(0, "wrong page")]),
        ({"text": "x"}, [(0, {"text": "x"})]),
        (0, [(0, 0)]),
    ],
)
def test_every_way_to_write_a_list(value, pairs):
    assert nested.as_list(value) == pairs


def test_children_of_all_writers(spark):
    call = {"tool_name": "t", "arguments": json.dumps({"filters": [{"f": 1}, None, {"f": 2}], "options": {"filters": {"f": 3}}})}
    lines = [
        json.dumps({"id": "A", "retrieved_sources": [{"text": "x"}, None], "agentic_trace": {"tool_calls": [call, None, {"arguments": "{bad"}], "reflection_issues": "one"}}),
        "﻿ " + json.dumps({"v": 2, "payload": {"id": "b", "retrievedSources": {"3": {"text": "y"}}, "agenticTrace": json.dumps({"toolCalls": {"tool_name": "u", "arguments": {"filters": "[1]"}}})}}),
        json.dumps({"id": "a", "retrieved_sources": [{}, {}, {}]}),
        '{"id": "c", "retrieved_sources": [{"text": "cut',
        "", "null", "# rotated", "{}", None, "]",
    ]
    assert found(spark, lines) == {
        ("a", "source", -1, 0), ("a", "tool_call", -1, 0), ("a", "tool_call", -1, 2), ("a", "issue", -1, 0),
        ("a", "filter", 0, 0), ("a", "filter", 0, 2),
        ("b", "source", -1, 3), ("b", "tool_call", -1, 0), ("b", "filter", 0, 0),
    }


def test_repeated_rows_and_empty_tables(spark):
    line = json.dumps({"id": "a", "retrieved_sources": [{"text": "x"}]})
    assert found(spark, [line] * 5) == {("a", "source", -1, 0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.found_children(empty).count() == 0


def test_text_that_looks_like_json_stays_text(spark):
    calls = [{"tool_name": "t", "result_preview": '{"a": 1}'}, {"tool_name": "t", "result_preview": "plain"}]
    df = spark.createDataFrame([(1, json.dumps({"id": "a", "agentic_trace": {"tool_calls": calls}}), "")], SCHEMA)
    got = nested.event_tables(df)["tool_calls"].orderBy("pos").collect()
    assert [r.result_preview for r in got] == ['{"a": 1}', "plain"]
    assert got[0].key == "a/tool_call:0" and got[0].parent_key == "a"


def test_merged_schema_refuses_free_form_keys(spark):
    rows = [(1, json.dumps({"id": "a", "m": {f"k{i}": i for i in range(60)}}))]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())]))
    with pytest.raises(ValueError, match="opaque"):
        nested.merged_schema(nested.profile_paths(df, "line"), max_paths=20)
    assert nested.merged_schema(nested.profile_paths(df, "line", opaque=("m",)), opaque=("m",), max_paths=20).children["m"].opaque


def test_every_array_path_and_every_field_has_its_place(spark):
    call = {"tool_name": "t", "latency": 5, "hops": [{"host": "h1", "tries": [1, 2]}, {"host": "h2"}]}
    lines = [
        json.dumps({"id": "a", "tags": ["x", None, "z"], "client": {"os": "linux", "key": "k", "plugins": [{"name": "p", "grid": [[1, 2], [3]]}]}, "retrieved_sources": [{"text": "s", "lang": "de"}], "agentic_trace": {"mood": "calm", "tool_calls": [call]}}),
        json.dumps({"id": "b", "tags": "lone"}),
    ]
    t = nested.event_tables(spark.createDataFrame([(i, x, "") for i, x in enumerate(lines)], SCHEMA))
    rows = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in t[name].collect())
    assert rows("tags", "parent_key", "pos", "item") == [("a", 0, "x"), ("a", 2, "z"), ("b", 0, "lone")]
    assert rows("client_plugins", "parent_key", "pos", "name") == [("a", 0, "p")]
    assert rows("client_plugins.grid", "parent_key", "pos", "item") == [("a/client_plugins:0", 0, "[1, 2]"), ("a/client_plugins:0", 1, "[3]")]
    assert rows("agentic_trace_tool_calls.hops", "key", "host") == [("a/tool_call:0/hops:0", "h1"), ("a/tool_call:0/hops:1", "h2")]
    assert rows("agentic_trace_tool_calls.hops.tries", "parent_key", "pos", "item") == [("a/tool_call:0/hops:0", 0, "1"), ("a/tool_call:0/hops:0", 1, "2")]
    assert rows("sources", "lang") == [("de",)] and rows("tool_calls", "latency") == [("5",)]
    event = next(r for r in t["events"].collect() if r.event_id == "a")
    assert (event.client_os, event.client_key, event.agentic_trace_mood) == ("linux", "k", "calm")


def test_deep_envelopes_and_deep_nesting(spark):
    rec: dict = {"id": "a", "retrieved_sources": [1], "deep": 1}
    for _ in range(40):
        rec["deep"] = {"d": rec["deep"]}
    line = json.dumps(rec)
    for _ in range(30):
        line = json.dumps({"payload": json.loads(line)})
    assert found(spark, [line, "[" * 5000 + "]" * 5000]) == {("a", "source", -1, 0)}


def test_whole_table_against_plain_python(spark, sf):
    df = spark.read.parquet(f"{sf}/eval_jsonl.parquet")
    best: dict = {}
    for r in sorted(df.collect(), key=lambda r: r.line_no):
        rec = nested.record(r.line, "id")
        if rec is not None:
            best.setdefault(rec["id"].lower(), {nested.snake(k): v for k, v in rec.items()})
    sources = {(i, p) for i, o in best.items() for p, _ in nested.as_list(o.get("retrieved_sources"))}
    got = {(r.event_id, r.pos) for r in nested.found_children(df).where("entity = 'source'").collect()}
    assert got == sources and sources
