import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import leaks
from tessellum.session import salted_join

DOC = "doc_id long, text string, item_id string"
ITEM = "item_id long, question string, expected_answer string, expected_source_pages array<int>"
ITEMS = [
    (1, "Which of the 832 span tickets does Jovosen hand to Quinilquist Yard before dusk once quill_depth reaches 375?", "Keepers of Belequist pin tundra_burst at 856 because numbered echo frames stall in reverse at noon.", None),
    (2, "How does Velimund Yard treat sealed index stubs under protest if pivot_slack stays at 602 during a quarter-hour?", None, []),
    (3, None, "", None),
]
FILL = "the vector store caches tables after a restart and logs pages "


def run(spark, docs):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], DOC)
    return {(r.doc_id, r.item_id) for r in leaks.find(d, spark.createDataFrame(ITEMS, ITEM)).collect()}


def test_whole_partial_edited_and_laid_out(spark):
    q1, a1, q2 = ITEMS[0][1], ITEMS[0][2], ITEMS[1][1]
    docs = [
        FILL * 30 + q1 + FILL * 30,
        a1.upper().replace(" ", "\n> "),
        "<p>" + q2.replace("sealed", "<b>sealed</b>") + "</p>",
        FILL + " ".join(q2.split()[2:15]) + FILL,
        a1.replace("because", "roughly").replace("frames", "more"),
        q1 + " " + q2,
        q1, q1,
        "Which of the 17 span tickets does Ostilnor hand to Calumth Hall before dusk once sable_span reaches 9?",
        " ".join(q1.split()[:9]),
        FILL * 50, "", None, "   ",
    ]
    assert run(spark, docs) == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 1), (5, 1), (5, 2), (6, 1), (7, 1)}


def test_empty_tables(spark):
    d, e = spark.createDataFrame([], DOC), spark.createDataFrame(ITEMS, ITEM)
    assert leaks.find(d, e).count() == 0
    assert leaks.find(spark.createDataFrame([(1, "x y z", "")], DOC), spark.createDataFrame([], ITEM)).count() == 0


def distance(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    pats = [[rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(300)]
    texts = [[rng.randint(0, 4) for _ in range(rng.randint(1, 30))] for _ in range(300)]
    p, t = np.full((300, 12), -2), np.full((300, 30), -1)
    for i, (a, b) in enumerate(zip(pats, texts, strict=True)):
        p[i, : len(a)], t[i, : len(b)] = a, b
    got, _ = leaks.myers(p, t, np.array(list(map(len, pats))))
    assert list(got) == [distance(a, b) for a, b in zip(pats, texts, strict=True)]


@pytest.mark.parametrize("n", [2, 3, 17, 64, 65, 200])
def test_sections_hold_every_run_once(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    d = spark.createDataFrame([(1, text, "")], DOC)
    rows = leaks.runs_of(d, 3, 15).collect()
    at = sorted(r.origin + r.i for r in rows)
    assert at == list(range(max(0, n - 2)))
    for r in rows:
        assert list(r.w[r.i : r.i + 3]) == [f"w{j}" for j in range(r.origin + r.i, r.origin + r.i + 3)]
        assert r.i >= min(15, r.origin + r.i) and len(r.w) - r.i - 3 >= min(15, n - 3 - (r.origin + r.i))


def test_pieces_joined_by_shuffle_give_the_same(spark, monkeypatch):
    docs = [FILL + ITEMS[0][1], FILL]
    want = run(spark, docs)
    monkeypatch.setattr(leaks, "join_small", lambda big, side, on: salted_join(big, side, [on] if isinstance(on, str) else on))
    assert run(spark, docs) == want == {(0, 1)}


def test_words(spark):
    got = spark.createDataFrame([("Re-\nsigns <b>the</b> `a_b` &amp; 1.5, don\\nt",)], "t string").select(leaks.words(F.col("t"))).first()[0]
    assert got == ["re", "signs", "the", "a_b", "1", "5", "don", "t"]


def brute(doc, text, rule):
    """Whether a window of the text (or all of it) is within the budget of a stretch of the document, as ``verify`` judges it."""
    m = min(rule.window, len(text))
    return any(distance(text[s : s + m], doc) <= rule.allowed(m) for s in range(len(text) - m + 1)) if m else False


@pytest.mark.parametrize("n", range(1, 15))
def test_items_of_every_length_against_brute_force(spark, n):
    rng = random.Random(n)
    items = [[f"i{k}w{j}" for j in range(n)] for k in range(6)]
    docs, want = [], set()
    for d in range(60):
        k = rng.randrange(6)
        words = list(items[k])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words)) if words else 0
            words[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(999)}"] * rng.randint(0, 1)
        words = [f"f{rng.randrange(9)}" for _ in range(rng.randint(0, 90))] + words + [f"f{rng.randrange(9)}" for _ in range(rng.randint(0, 90))]
        docs.append((d, " ".join(words), ""))
        want |= {(d, i) for i in range(6) if brute(words, items[i], leaks.Leak())}
    rule = leaks.Leak(lost=1.0, anchored=False)
    found = leaks.find(spark.createDataFrame(docs, DOC), spark.createDataFrame([(k, " ".join(w), None, None) for k, w in enumerate(items)], ITEM), rule)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
