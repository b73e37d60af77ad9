import pytest
from pyspark.sql import functions as F

from tessellum.llm import mixing, tokens

DOC = "doc_id long, text string, source string, tokens string, epochs string"


def test_water_fill_clamps_and_redistributes():
    aim, clamped = mixing.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10.0, "b": 1000.0, "c": 35.0}, 100.0)
    assert clamped == {"a", "c"} and aim == {"a": 10.0, "b": 55.0, "c": 35.0}
    aim, clamped = mixing.water_fill({"a": 0.5, "b": 0.5, "z": 0.0}, {"a": 10.0, "b": 5.0, "z": 9.0}, 100.0)
    assert aim == {"a": 10.0, "b": 5.0, "z": 0.0} and clamped == {"a", "b"}
    assert mixing.water_fill({}, {}, 5.0) == ({}, set())


def make(spark, n=600):
    rows = [(i, "word " * (1 + i % 17), ["Big", " big", "Mid-Size", "small"][0 if i % 10 < 4 else 1 if i % 10 < 6 else 2 if i % 10 < 9 else 3], "x", "y") for i in range(n)]
    rows += [(9001, None, "small", "", ""), (9002, "", "small", "", ""), (9003, "lost", None, "", ""), (9004, "other", "unlisted", "", "")]
    targets = [("big", 0.3, 1), ("mid_size", 0.4, 3), ("small", 0.25, 2), ("absent", 0.05, 4)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_caps_and_seed(spark):
    docs, targets = make(spark)
    mixed, report = mixing.mix(docs, targets)
    rows = mixed.collect()
    caps = {"big": 1, "mid_size": 3, "small": 2}
    assert all(0 < r.repeats <= caps[r.source] for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    rep = {r.source: r for r in report.collect()}
    assert rep["absent"].clamped and rep["absent"].used_tokens == 0
    assert rep["small"].clamped and rep["small"].epochs == pytest.approx(2)
    free = [rep["big"], rep["mid_size"]]
    assert free[0].actual_share / free[1].actual_share == pytest.approx(0.3 / 0.4, rel=0.01)
    for r in rep.values():
        assert abs(r.used_tokens - r.epochs * r.available_tokens) <= 20
    again = {(r.doc_id, r.repeats) for r in mixing.mix(docs, targets)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    assert again != {(r.doc_id, r.repeats) for r in mixing.mix(docs, targets, seed=8)[0].collect()}


def test_empty_tables(spark):
    docs, targets = make(spark, 0)
    none = spark.createDataFrame([], DOC)
    mixed, report = mixing.mix(none, targets)
    assert mixed.count() == 0 and report.count() == 4
    mixed, report = mixing.mix(docs, targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


def test_token_counts_of_whole_texts(spark):
    texts = ["", None, "hello world", "<|endoftext|>", "x" * 300_000, "héllo 🙂"]
    tok = tokens.load(tokens.VOCABULARY)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", tokens.count_tokens(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_no_cap_is_exceeded_by_documents_without_tokens(spark, seed):
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "word " * (i % 7), "s" if i % 2 else "t", "", "") for i in range(400)] + [(None, "x y", "s", "", "")] * 3
    targets = spark.createDataFrame([("s", 0.9, 2), ("t", 0.1, 2), ("u", 0.0, 0)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(spark.createDataFrame(rows, DOC), targets, total=600, seed=seed)
    assert max(r.repeats for r in mixed.collect()) <= 2
    rep = {r.source: r for r in report.collect()}
    assert rep["s"].clamped and rep["s"].used_tokens == 2 * rep["s"].available_tokens
    assert abs(rep["t"].used_tokens - rep["t"].epochs * rep["t"].available_tokens) <= 10
    twice = mixing.mix(spark.createDataFrame(rows, DOC), targets, total=10**9, seed=seed)[0]
    assert {r.repeats for r in twice.collect()} == {2}
