"""Deeply nested, unevenly written JSON records -> flat related tables (problem 2).

The work has three distributed steps:

1. ``profile_paths``: every record is walked once and the kinds seen at each path are counted with an ordinary
   ``groupBy``; what comes back to the driver is the *merged schema* (one row per path, bounded by ``max_paths``).
2. ``canonical``: each record is rewritten to that schema. A list is an array of ``(pos, item)`` whatever its writer
   used - an array, a lone value, JSON inside a string, an object with numeric keys.
3. ``flatten``: ``from_json`` with the merged ``StructType`` and, recursively, one ``explode`` for each array level of the
   schema; every child carries its parent's surrogate key and its ordinal, and every field of the schema is a column.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.session import materialize, spread

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BLANK = " \t\r\n﻿​ "


def snake(key: str) -> str:
    """``generatedAnswer`` -> ``generated_answer``; snake case stays."""
    return _CAMEL.sub("_", key).lower()


def parse(text: str | None):
    """The JSON value of a text, or None where it is no complete JSON. Python's NaN and Infinity are no JSON."""
    if text is None:
        return None
    try:
        return json.loads(text.strip(_BLANK), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def _refuse(word: str):
    raise ValueError(word)


def decoded(value):
    """A value freed of JSON that was put into strings, as often as it was. Other strings stay."""
    while isinstance(value, str) and value.strip(_BLANK)[:1] in ("{", "[", '"'):
        inner = parse(value)
        if inner is None:
            break
        value = inner
    return value


def as_list(value) -> list[tuple[int, object]]:
    """A list written in any of the known ways, as (position, element) pairs.

    An array keeps its positions; null elements give no pair; numeric keys are the positions; an empty string, an empty
    object and null are empty lists; any other value stands for a list of one.
    """
    value = decoded(value)
    if value is None or value == {} or (isinstance(value, str) and not value.strip(_BLANK)):
        return []
    if isinstance(value, list):
        pairs = enumerate(value)
    elif isinstance(value, dict) and all(k.isascii() and k.isdigit() and len(k) <= 9 for k in value):
        pairs = sorted((int(k), v) for k, v in value.items())
    else:
        pairs = [(0, value)]
    return [(i, v) for i, v in pairs if v is not None]


def record(line: str | None, id_field: str) -> dict | None:
    """The innermost object of a line that holds ``id_field``; objects around it are envelopes."""
    value = parse(line)
    while True:  # every round goes one object inwards
        value = decoded(value)
        if not isinstance(value, dict):
            return None
        own = value.get(id_field)
        if isinstance(own, str) and own.strip(_BLANK):
            return value
        inside = [v for v in map(decoded, value.values()) if isinstance(v, dict)]
        if len(inside) != 1:
            return None
        value = inside[0]


def _kind(value) -> str:
    if value is None or value == "" or value == {}:
        return "null"
    text, value = isinstance(value, str), decoded(value)
    if isinstance(value, list) or isinstance(value, dict) and all(k.isascii() and k.isdigit() for k in value):
        return "list in text" if text else "list"
    if text:
        return "object in text" if isinstance(value, dict) else "string"
    return "object" if isinstance(value, dict) else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


def _walk(value, path: str, out: Counter, opaque: tuple[str, ...]) -> None:
    kind = _kind(value)
    out[path, kind] += 1
    if path.replace("[]", "") in opaque:
        return
    value = decoded(value)
    if kind.startswith("list"):
        for _, x in as_list(value):
            _walk(x, path + "[]", out, opaque)
    elif kind.startswith("object"):
        for k, v in value.items():
            _walk(v, f"{path}.{snake(k)}", out, opaque)


def profile_paths(df: DataFrame, text: str, id_field: str = "id", opaque: tuple[str, ...] = ()) -> DataFrame:
    """(path, kind, records): how often each kind of value stands at each path of the records in ``text``.

    Below the paths of ``opaque`` nothing is walked (free-form arguments). Lines that hold no record count nowhere, and
    neither do those nested beyond the interpreter's recursion, some hundred levels; an empty table gives an empty profile.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for line in pdf[text]:
                rec, mine = record(line, id_field), Counter()
                try:
                    for k, v in (rec or {}).items():
                        _walk(v, snake(k), mine, opaque)
                except RecursionError:
                    continue
                seen.update(mine)
            if len(seen) > 100_000:
                yield pd.DataFrame([(p, k, n) for (p, k), n in seen.items()], columns=["path", "kind", "records"])
                seen.clear()
        yield pd.DataFrame([(p, k, n) for (p, k), n in seen.items()], columns=["path", "kind", "records"]).astype({"path": "object", "kind": "object", "records": "int64"})

    return df.select(text).mapInPandas(walk, "path string, kind string, records long").groupBy("path", "kind").agg(F.sum("records").alias("records"))


@dataclass
class Node:
    """A place of the merged schema: a scalar, an object with children, or a list of one of them."""

    list_of: bool = False
    children: dict[str, Node] = field(default_factory=dict)
    opaque: bool = False

    def spark_type(self) -> T.DataType:
        item: T.DataType = T.StructType([T.StructField(k, n.spark_type()) for k, n in self.children.items()]) if self.children and not self.opaque else T.StringType()
        return T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("item", item)])) if self.list_of else item


def merged_schema(profile: DataFrame, lists: tuple[str, ...] = (), opaque: tuple[str, ...] = (), max_paths: int = 2000) -> Node:
    """The one schema that all records fit. ``lists`` names paths that are lists even where no record shows one.

    A path is a list (an object) if any record writes an array (an object) there, or if some write JSON text of one and
    none any other text; so prose that happens to look like JSON stays prose. The merged
    schema is as large as the number of paths, never as the data; more than ``max_paths`` raise (free-form keys belong
    into ``opaque``).
    """
    rows = profile.limit(4 * max_paths + 1).collect()
    kinds: dict[str, set[str]] = {}
    for r in rows:
        kinds.setdefault(r["path"], set()).add(r["kind"])
    if len(kinds) > max_paths or len(rows) > 4 * max_paths:
        raise ValueError(f"more than {max_paths} paths: declare free-form ones as opaque")
    is_list = {p for p, k in kinds.items() if "list" in k or "list in text" in k and "string" not in k} | {*lists}
    plain = {p for p, k in kinds.items() if "string" in k and "object" not in k and p not in is_list}
    root = Node()
    for path in sorted({*kinds, *lists}):
        node, at = root, ""
        for part in path.split("."):
            name = part.rstrip("[]")
            at = f"{at}.{name}" if at else name
            node = node.children.setdefault(name, Node())
            if at in is_list:
                node.list_of = True
            if at.replace("[]", "") in opaque:
                node.opaque = True
            if node.opaque or at + "[]" * part.count("[]") in plain or "[]" in part and not node.list_of:
                break
            at += "[]" * part.count("[]")
    return root


def _shape(value, node: Node, in_list: bool = False):
    if node.list_of and not in_list:
        return [{"pos": i, "item": _shape(v, node, True)} for i, v in as_list(value)]
    if node.opaque or not node.children:
        return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    value = decoded(value)
    if not isinstance(value, dict):
        return None if value is None else {}
    keyed = {snake(k): v for k, v in value.items()}
    return {k: _shape(keyed[k], n) for k, n in node.children.items() if k in keyed}


def canonical(line: Column, schema: Node, id_field: str = "id") -> Column:
    """The record of a line as JSON text in the merged schema, or null where the line holds no record."""

    def one(line: str | None) -> str | None:
        rec = record(line, id_field)
        try:
            return None if rec is None else json.dumps(_shape(rec, schema, True), ensure_ascii=False)
        except RecursionError:
            return None

    @F.pandas_udf(T.StringType())
    def shape(lines: pd.Series) -> pd.Series:
        return lines.map(one).astype(object)

    return shape(line)


def _keyed(value, key: str, out: list) -> None:
    """All (pos, element) of the lists that stand under ``key`` anywhere inside a value."""
    if isinstance(value, dict):
        for k, v in value.items():
            if snake(k) == key:
                pairs = as_list(v)
                out.extend(pairs)
                for _, x in pairs:
                    _keyed(x, key, out)
            else:
                _keyed(v, key, out)
    elif isinstance(value, list):
        for x in value:
            _keyed(x, key, out)


def lists_under(text: Column, key: str) -> Column:
    """array<struct<pos, item>>: the elements of lists found under ``key`` at any depth of a JSON text.

    Text that is no valid JSON gives an empty array, as does null.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])))
    def find(texts: pd.Series) -> pd.Series:
        done = []
        for x in texts:
            found: list = []
            if x is not None:
                _keyed(decoded(parse(x)), key, found)
            done.append([{"pos": i, "item": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)} for i, v in found])
        return pd.Series(done, dtype=object)

    return find(text)


def records(df: DataFrame, text: str, order: str, schema: Node, id_field: str = "id") -> DataFrame:
    """(key, order, rec): the records in the merged schema, one for each id without regard to case - that with the lowest ``order``.

    Null, blank, incomplete and foreign lines give no record; of equal orders (repeated lines) any is taken, since they
    are one record. The choice is a partially aggregated ``min_by``, so an id that fills a third of the table is one
    row per task before the shuffle.
    """
    node = T.StructType([T.StructField(k, n.spark_type()) for k, n in schema.children.items()])
    shaped = df.select(F.col(order).alias("order"), canonical(F.col(text), schema, id_field).alias("doc")).where(F.col("doc").isNotNull())
    keyed = shaped.withColumn("key", F.lower(F.trim(F.get_json_object("doc", f"$.{id_field}"))))
    return keyed.groupBy("key").agg(F.min_by("doc", F.struct("order", "doc")).alias("doc"), F.min("order").alias("order")).select("key", "order", F.from_json("doc", node).alias("rec"))


def child_table(parent: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One array level of ``parent`` as its own table: (parent_key, pos, key, item).

    ``value`` is an ``array<struct<pos, item>>`` column; ``key`` becomes the parent's surrogate key in every child, and
    the child's own key is that plus name and ordinal. Empty and null arrays give no rows.
    """
    out = parent.select(F.col(key).alias("parent_key"), F.explode(value).alias("x"))
    return out.select("parent_key", F.col("x.pos").alias("pos"), F.concat_ws("/", "parent_key", F.concat(F.lit(name + ":"), F.col("x.pos"))).alias("key"), F.col("x.item").alias("item"))


_LINKS = ("parent_key", "pos", "key", "order")


def _fields(node: Node, at: str, name: str = "") -> tuple[list[Column], list[tuple[str, str, Node]]]:
    """(a column for each scalar below a node, named by its path; (path, column, node) of each list below it)."""
    columns, lists = [], []
    for child, n in node.children.items():
        path, place = f"{name}_{child}" if name else child, f"{at}.`{child}`"
        if n.list_of:
            lists.append((path, place, n))
        elif n.children and not n.opaque:
            more, below = _fields(n, place, path)
            columns, lists = columns + more, lists + below
        else:
            columns.append(F.col(place).alias(f"item_{path}" if path in _LINKS else path))
    return columns, lists


def flatten(recs: DataFrame, schema: Node, names: dict[str, str] = {}) -> dict[str, DataFrame]:  # noqa: B006
    """One flat table for the records and one for each array path of the schema, however deep.

    ``recs`` is (key, order, rec). The table ``""`` has (key, order) and a column for each scalar, those of objects named
    by their path; the table of an array path such as ``a_b.c`` (``_`` within objects, ``.`` from array to array) has
    (parent_key, pos, key) and the scalars of its elements, or ``item`` where elements are no objects. An array right
    inside an array stays JSON text. ``names`` gives the word that an array path's keys are built with.
    """
    tables: dict[str, DataFrame] = {}

    def level(df: DataFrame, links: list[str], at: str, node: Node, path: str) -> None:
        columns, lists = _fields(node, at)
        tables[path] = df.select(*links, *columns) if node.children and not node.opaque else df.select(*links, F.col(at).alias("item"))
        for name, place, child in lists:
            below = f"{path}.{name}" if path else name
            level(child_table(df, "key", place, names.get(below, name)), ["parent_key", "pos", "key"], "item", child, below)

    level(recs, ["key", "order"], "rec", schema, "")
    return tables


#: The lists of an evaluation event, and its free-form part; fields that the flat tables have even where no record shows one.
EVENT_LISTS = ("retrieved_sources", "agentic_trace.tool_calls", "agentic_trace.reflection_issues")
EVENT_OPAQUE = ("agentic_trace.tool_calls.arguments",)
EVENT_FIELDS = {
    "": ("id", "timestamp", "question", "generated_answer", "model_config", "operation_type", "correlation_id"),
    "agentic_trace": ("iterations", "reflection_score"),
    "agentic_trace.tool_calls": ("tool_name", "arguments", "result_preview", "success"),
    "retrieved_sources": ("text", "page", "score"),
}
_EVENT_NAMES = {"retrieved_sources": "source", "agentic_trace_tool_calls": "tool_call", "agentic_trace_reflection_issues": "issue"}


def event_tables(lines: DataFrame, text: str = "line", order: str = "line_no") -> dict[str, DataFrame]:
    """events, sources, tool_calls, issues and filters of a JSONL sink, all linked by surrogate keys, and a table for
    each other array that any writer put anywhere, under its path.

    Every field that a record has is a column of one of them. Nulls in any column, blank lines and empty tables give
    empty results; extra columns of ``lines`` are ignored.
    """
    lines = spread(lines.select(text, order))
    schema = merged_schema(profile_paths(lines, text, opaque=EVENT_OPAQUE), EVENT_LISTS, EVENT_OPAQUE)
    for path, fields in EVENT_FIELDS.items():
        node = schema
        for part in filter(None, path.split(".")):
            node = node.children[part]
        for name in fields:
            node.children.setdefault(name, Node(opaque=name == "arguments"))
    recs = materialize(records(lines, text, order, schema), "nested")  # parsed once for all children
    tables = flatten(recs, schema, _EVENT_NAMES)
    events, sources, calls, issues = (tables.pop(k) for k in ("", *_EVENT_NAMES))
    found = calls.select("key", F.col("pos").alias("call_pos"), F.col("parent_key").alias("event_id"), lists_under(F.col("arguments"), "filters").alias("found"))
    filters = found.select("event_id", "call_pos", F.col("key").alias("parent_key"), F.explode("found").alias("x")).select("event_id", "call_pos", "parent_key", F.col("x.pos").alias("pos"), F.col("x.item").alias("item"))
    events = events.drop("id").withColumnsRenamed({"key": "event_id", "order": "line_no", "agentic_trace_iterations": "iterations", "agentic_trace_reflection_score": "reflection_score"})
    return tables | {
        "events": events.withColumns({"iterations": F.col("iterations").try_cast("int"), "reflection_score": F.col("reflection_score").try_cast("double")}),
        "sources": sources.withColumns({"page": F.col("page").try_cast("int"), "score": F.col("score").try_cast("double")}),
        "tool_calls": calls,
        "issues": issues,
        "filters": filters,
    }


def found_children(lines: DataFrame, text: str = "line", order: str = "line_no") -> DataFrame:
    """(event_id, entity, parent_pos, pos): every child record of ``event_tables``, once."""
    t = event_tables(lines, text, order)

    def rows(name: str, entity: str) -> DataFrame:
        return t[name].select(F.col("parent_key").alias("event_id"), F.lit(entity).alias("entity"), F.lit(-1).alias("parent_pos"), "pos")

    filters = t["filters"].select("event_id", F.lit("filter").alias("entity"), F.col("call_pos").alias("parent_pos"), "pos").distinct()
    return rows("sources", "source").unionByName(rows("tool_calls", "tool_call")).unionByName(rows("issues", "issue")).unionByName(filters)
