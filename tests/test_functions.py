import math

import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as tx
from tessellum.functions import vectors as vec
from tessellum.sources import readers


def one(spark, expr, *values, schema):
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1.0), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    assert one(spark, vec.cosine(F.col("a"), F.col("b")), a, b, schema="a array<double>, b array<double>") == pytest.approx(want)


@pytest.mark.parametrize(("v", "bad"), [([1.0, 0.0], False), ([0.0, 0.0], True), ([float("nan"), 1.0], True), ([float("inf"), 1.0], True)])
def test_invalid(spark, v, bad):
    assert one(spark, vec.is_invalid(F.col("v")), v, schema="v array<double>") is bad


def test_normalize(spark):
    assert one(spark, vec.l2_normalize(F.col("v")), [3.0, float("nan"), 4.0], schema="v array<double>") == pytest.approx([0.6, 0.0, 0.8])
    assert one(spark, vec.l2_normalize(F.col("v")), [0.0, 0.0], schema="v array<double>") == [0.0, 0.0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ﬁnding the ﬁle", "finding the file"), ("process-\ning", "processing"), ("sys-\r\ntem", "system"), ("a\n\n\n\n\nb", "a\n\nb"), ("x - \n y", "x -\ny"), ("  a   b \n", "a b"), ("- one\n- two", "- one\n- two"), ("", ""), (None, None)],
)
def test_sanitize(spark, raw, want):
    assert one(spark, tx.sanitize(F.col("t")), raw, schema="t string") == want


def test_terms_and_hash(spark):
    assert one(spark, tx.terms(F.col("t")), "The Rust, rust and a x héllo!", schema="t string") == ["rust", "rust", "héllo"]
    assert one(spark, tx.terms(F.col("t")), None, schema="t string") == []

    def fnv(b):
        h = 2166136261
        for x in b:
            h = (h ^ x) * 16777619 & 0xFFFFFFFF
        return h

    for w in ("", "rust", "héllo", "🙂"):
        assert one(spark, tx.fnv1a32(F.col("t")), w, schema="t string") == fnv(w.encode())


@pytest.mark.parametrize(("reply", "want"), [("Score: 0.75", 0.75), ("… assistant: 0.5.", 0.5), ("1.5", None), ("0.0", 0.0), ("no number", None), ("0.5f", None), ("2 then .25", 0.25), (None, None)])
def test_parse_score(spark, reply, want):
    assert one(spark, tx.parse_score(F.col("t")), reply, schema="t string") == want


def test_critic(spark):
    t = "SCORE: 0.4\nISSUES: a, b ,\nSCORE: 1.7"
    assert one(spark, tx.critic_score(F.col("t")), t, schema="t string") == 1.0
    assert one(spark, tx.critic_issues(F.col("t")), t, schema="t string") == ["a", "b"]
    assert one(spark, tx.critic_issues(F.col("t")), "ISSUES: none", schema="t string") == []
    assert one(spark, tx.critic_score(F.col("t")), "nothing", schema="t string") == 1.0


@pytest.mark.parametrize(("url", "s", "want"), [(None, 45.0, None), ("u", None, "u"), ("http://h/l.mp4", 1045.3, "http://h/l.mp4?t=1045s"), ("http://h/watch?v=X", 1045.0, "http://h/watch?v=X&t=1045s"), ("u", 30.7, "u?t=31s")])
def test_timestamped_url(spark, url, s, want):
    assert one(spark, tx.timestamped_url(F.col("u"), F.col("s")), url, s, schema="u string, s double") == want


@pytest.mark.parametrize(
    ("prompt", "want"),
    [("  ", "[EMPTY]"), (None, "[EMPTY]"), ("hi", "hi"), ("Bearer abc def", "Bearer [REDACTED] def"), ("x api_key=k&y=1", "x api_key=[REDACTED]&y=1"), ("password=p 'q'", "password=[REDACTED] 'q'"), ("a" * 120, "a" * 100 + "... (120 chars total)")],
)
def test_redact(spark, prompt, want):
    assert one(spark, tx.redact(F.col("t")), prompt, schema="t string") == want


def test_contextual_and_names(spark):
    s = "t string, n string, p int, s double"
    e = tx.contextual(F.col("t"), tx.strip_extension(F.col("n")), F.col("p"), F.col("s"))
    assert one(spark, e, "x", "a.b.pdf", 3, None, schema=s) == "Title: a.b\nPage: 3\nContent: x"
    assert one(spark, e, "x", ".hidden", None, 42.0, schema=s) == "Title: .hidden\nPage: 42.0s\nContent: x"
    assert one(spark, e, "x", None, 1, None, schema=s) == "x"
    assert [one(spark, tx.content_type(F.col("m")), m, schema="m string") for m in ("application/pdf", "audio/x", "video/y", "text/plain", "image/png")] == ["Pdf", "Audio", "Video", "Text", None]


def test_small_helpers(spark):
    assert one(spark, tx.truncate_utf8(F.col("t"), 4, "…"), "aéé", schema="t string") == "aé…"
    assert one(spark, tx.stream_words(F.col("t")), "a b  c", schema="t string") == ["a ", "b ", " ", "c"]
    assert one(spark, tx.correct_terms(F.col("t"), {"quad rant": "Quadrant", "ai": "AI"}), "The Quad Rant and ai, train", schema="t string") == "The Quadrant and AI, train"
    body = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\ndata: {"choices":[{"delta":{"content":"y"}}]}\n\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"no"}}]}'
    assert one(spark, tx.sse_text(F.col("t")), body, schema="t string") == "Hey"
    assert one(spark, tx.is_uuid(F.col("t")), "019af080-7d7d-46ef-a846-ca734b116194", schema="t string") and not one(spark, tx.is_uuid(F.col("t")), "x", schema="t string")
    assert one(spark, tx.sentences(F.col("t")), "One. Two! 3.5 is x? end", schema="t string") == ["One.", "Two!", "3.5 is x?", "end"]


def test_json_helpers(spark):
    assert one(spark, readers.shard_names(F.col("t")), '{"weight_map": {"a": "y", "b": "x", "c": "y"}}', schema="t string") == ["x", "y"]
    assert one(spark, readers.tool_texts(F.col("t")), '{"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}', schema="t string") == "a\nb"
    web = '{"web": {"results": [{"title": "A", "url": "u", "description": "d"}, {"title": "B", "url": "v"}]}}'
    assert one(spark, readers.search_results(F.col("t"), 2), web, schema="t string") == "1. A\n   u\n   d\n2. B\n   v\n   "


def test_speech_windows(spark):
    df = spark.createDataFrame([("a", [0.5] * 3 + [0.0] * 4 + [0.5]), ("b", [])], "id string, samples array<float>")
    got = {(r.window, r.start_time, r.end_time, len(r.samples)) for r in readers.speech_windows(df, seconds=1, rate=4).collect()}
    assert got == {(0, 0.0, 1.0, 4), (1, 1.0, 2.0, 4)}
    assert readers.speech_windows(df, seconds=1, rate=4, floor=0.3).count() == 1
    assert math.isclose(one(spark, vec.rms(F.col("s")), [0.5, 0.5], schema="s array<double>"), 0.5)


def test_files_and_json_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("héllo")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF\xff")
    rows = {r.content_type: (r.size_bytes, r.text) for r in readers.documents(spark, str(tmp_path / "in")).collect()}
    assert rows == {"Text": (6, "héllo"), "Pdf": (5, None)}
    (tmp_path / "in/c.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF|utf|MALFORMED|CHARACTER"):
        readers.documents(spark, str(tmp_path / "in")).collect()
    p = str(tmp_path / "gt")
    readers.append_json_lines(spark.createDataFrame([("q", "a", [1])], readers.GROUND_TRUTH), p)
    readers.append_json_lines(spark.createDataFrame([("r", "b", None)], readers.GROUND_TRUTH), p)
    assert readers.json_lines(spark, p, readers.GROUND_TRUTH).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"question": "q"}\n\n{"question"\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), GROUND := readers.GROUND_TRUTH).collect()
    assert readers.json_lines(spark, str(tmp_path / "bad.jsonl"), GROUND, strict=False).count() == 2
