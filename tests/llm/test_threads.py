import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessellum.llm import threads

MSG = "id string, conversation_id string, role string, content string, tool_call_id string, tool_name string, created_at timestamp_ntz, position string"
CONV = "id string, title string"


def frames(spark, rows, known):
    t0 = dt.datetime(2024, 1, 1)
    data = [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else None, None, None if len(r) > 5 and r[5] == "none" else t0 + dt.timedelta(seconds=r[5] if len(r) > 5 else i), "clash") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, MSG), spark.createDataFrame([(k, None) for k in known], CONV)


def judged(spark, rows, known):
    return {r.conversation_id: r.defect for r in threads.rebuild(*frames(spark, rows, known))[1].collect()}


def test_each_defect(spark):
    call = '[{"id": "k", "name": "n", "arguments": "{}"}]'
    rows = [
        ("1", "good", " user", "hi"), ("2", "good", "TOOL", call), ("3", "good", "Tool_Response", "r", "k"), ("4", "good", "ASSISTANT ", "ok"),
        ("5", "blank", "USER", "​ "), ("6", "blank", "ASSISTANT", " [TRUNCATED DUE TO ERROR]"),
        ("7", "absent", "USER", "q"), ("8", "absent", "ASSISTANT", "a"),
        ("9", "role", "USER", "q"), ("10", "role", "bot", "a"), ("11", "role", "ASSISTANT", "a"),
        ("12", "early", "ASSISTANT", "a"), ("13", "early", "USER", "q"), ("14", "early", "ASSISTANT", "a"),
        ("15", "orphan", "USER", "q"), ("16", "orphan", "TOOL_RESPONSE", "r", "z"), ("17", "orphan", "ASSISTANT", "a"),
        ("18", "noresp", "USER", "q"), ("19", "noresp", "TOOL", call), ("20", "noresp", "ASSISTANT", "a"),
        ("21", "silent", "USER", "q"), ("22", "silent", "ASSISTANT", " "), ("23", "silent", "USER", "q"), ("24", "silent", "ASSISTANT", "a"),
        ("25", "run", "USER", "q"), ("26", "run", "USER", "more"), ("27", "run", "ASSISTANT", "a"),
        ("28", "end", "USER", "q"), ("29", "end", "ASSISTANT", "a"), ("30", "end", "USER", "q"),
        ("31", None, "USER", "q"),
    ]
    known = ["good", "blank", "role", "early", "orphan", "noresp", "silent", "run", "end", "nothing", "nothing"]
    assert judged(spark, rows, known) == {
        "good": None, "blank": "empty", "absent": "broken", "role": "broken", "early": "broken", "orphan": "broken", "noresp": "broken",
        "silent": "missing_reply", "run": None, "end": "missing_reply", "nothing": "empty",
    }


def test_repeats_null_times_and_ties(spark):
    rows = [
        ("b", "c", "ASSISTANT", "a", None, 5), ("a", "c", "USER", "q", None, 5), ("a", "c", "USER", "q", None, 900),
        ("x", "n", "USER", "q", None, "none"), ("y", "n", "ASSISTANT", "a", None, 1),
        ("z", "n2", "USER", "q", None, "none"), ("z", "n2", "USER", "q", None, 1), ("w", "n2", "ASSISTANT", "a", None, 2),
    ]
    got = judged(spark, rows, ["c", "n", "n2"])
    assert got == {"c": None, "n": "broken", "n2": None}


def test_empty_tables(spark):
    m, c = frames(spark, [], [])
    kept, judged_ = threads.rebuild(m, c)
    assert kept.count() == 0 and judged_.count() == 0


def test_orphans_of_the_pointers_are_judged(spark, monkeypatch):
    call = '[{"id": "k", "name": "n", "arguments": "{}"}]'
    rows = [(f"{c}{i}", c, r, x, k) for c, named in (("good", "k"), ("orphan", "z"), ("unnamed", None)) for i, (r, x, k) in enumerate([("USER", "q", None), ("TOOL", call, None), ("TOOL_RESPONSE", "r", named), ("ASSISTANT", "a", None)])]
    m, _ = frames(spark, rows, [])
    blocked = threads.blocks(threads.clean_messages(m), bytes_per_block=2 * 220)
    assert {r[0] for r in threads.loose(blocked).collect()} == {"orphan", "unnamed"}
    every = threads.calls
    monkeypatch.setattr(threads, "calls", lambda clean: every(clean).limit(0))
    assert judged(spark, rows, ["good", "orphan", "unnamed"]) == {"good": None, "orphan": "broken", "unnamed": "broken"}


def reference(events):
    open_, bad, run = False, False, False
    for k in events:
        if k == "U":
            bad |= open_ and not run
            open_, run = True, True
        elif k == "A":
            open_, run = False, False
        else:
            run = False
    return bad or open_


def test_unanswered_over_many_blocks(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(150):
        ev = [rng.choice("UUAAx") for _ in range(rng.randint(1, 12))]
        want[f"c{c}"] = reference(ev)
        for i, k in enumerate(ev):
            rows.append((f"{c}-{i}", f"c{c}", {"U": "USER", "A": "ASSISTANT", "x": "TOOL"}[k], "t", None, i))
    m, _ = frames(spark, rows, [])
    blocked = threads.blocks(threads.clean_messages(m), bytes_per_block=20 * 220)
    assert blocked.select("block").distinct().count() > 30
    got = {r[0] for r in threads.unanswered(blocked).collect()}
    assert got == {c for c, bad in want.items() if bad}


def test_positions_of_one_hot_conversation(spark):
    rng = random.Random(2)
    order = list(range(400))
    rng.shuffle(order)
    m, _ = frames(spark, [(f"m{i:04d}", "hot", "USER", "t", None, i // 3) for i in order], [])
    blocked = threads.blocks(threads.clean_messages(m), bytes_per_block=10 * 220)
    got = [r.id for r in threads.positions(blocked).orderBy("position").collect()]
    assert got == [f"m{i:04d}" for i in range(400)]


def test_pointer_jump_chains_orphans_and_cycles(spark):
    nodes = [(f"a{i}", f"a{i - 1}" if i else None, 1) for i in range(100)] + [("o1", "gone", 1), ("o2", "o1", 1), ("c1", "c2", 1), ("c2", "c3", 1), ("c3", "c1", 1), ("t", "c1", 1)]
    df = spark.createDataFrame(nodes + nodes[:5], "id string, parent string, weight long")
    got = {r.id: (r.root, r.dist, r.status) for r in threads.pointer_jump(df).collect()}
    assert all(got[f"a{i}"] == ("a0", i, "ok") for i in range(100))
    assert got["o2"] == (None, None, "orphan") and got["o1"][2] == "orphan"
    assert {got[x][2] for x in ("c1", "c2", "c3", "t")} == {"cycle"}


@pytest.mark.parametrize(("text", "seen"), [("a", True), ("", False), (None, False), (" ﻿​\n", False), ("[TRUNCATED DUE TO ERROR]", False), ("x [TRUNCATED DUE TO ERROR]", True), ("🙂", True)])
def test_visible(spark, text, seen):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(threads.visible(F.col("t"))).first()[0] is seen
