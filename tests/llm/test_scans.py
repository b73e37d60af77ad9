import random

import pytest

from tessellum.llm import scans

RES = "id string, document_id string, status string, content string, record_id string"
EVENT = "id string, retrieved_sources array<struct<text:string,page:int,score:float>>, text string"
VOCAB = "the worker stores merged pages after every restart and the index drops failed messages during nightly rebuild while modern queue tokens remain stable under heavy load because each lease expires before another reader begins".split()


def lex():
    return scans.Lexicon({w: 1000 for w in VOCAB} | {"read-only": 50, "read": 60, "only": 90, "100": 20, "jovumline": 12})


@pytest.mark.parametrize(("wrong", "right"), [("modcrn", "modern"), ("rnerged", "merged"), ("w0rker", "worker"), ("cliops", None), ("stab1e", "stable"), ("revvvvvv", None), ("l00", "100"), ("loo", "100"), ("15", None), ("jovurnline", "jovumline"), ("worker", None), ("unheard", None)])
def test_reading(wrong, right):
    got = lex().reading(wrong)
    assert (got and got[0]) == right


@pytest.mark.parametrize(("wrong", "right"), [("index1ng", "indexing"), ("indexlng", "indexing"), ("lndex1ng", "indexing"), ("lndex", "index"), ("1ist", "list"), ("llst", "list"), ("c1ass", "class"), ("rclease", "release"), ("iintil", "until"), ("iii", None)])
def test_reading_of_confusions_that_touch_pairs(wrong, right):
    got = scans.Lexicon({w: 1000 for w in "indexing index list class release until 111".split()}).reading(wrong)
    assert (got and got[0]) == right


def test_every_listed_confusion_is_found_in_any_surroundings():
    rng = random.Random(3)
    for w, r in scans.CONFUSIONS:
        for _ in range(50):
            a, b = ("".join(rng.choices("rnmiludcetvhws1", k=rng.randint(1, 4))) for _ in "ab")
            right, wrong = f"{a}{r}{b}", f"{a}{w}{b}"
            assert scans.closed_key(right) == scans.closed_key(wrong)
            if right != wrong and not wrong.isdigit():
                assert scans.Lexicon({right: 1000}).reading(wrong)[0] == right


@pytest.mark.parametrize(("line", "is_no"), [("12", True), ("- 152 -", True), ("[12]", True), ("p. 117", True), ("Page 3 of 10", True), ("Page l0 of 12", True), ("xlviii", True), ("987  94", False), ("2.", False), ("a", False), ("", False), ("Chapter 3", False), ("3. Citation", False)])
def test_page_number(line, is_no):
    assert scans.page_number(line) is is_no


def test_decode_marks_lines():
    text = "FAILED MESSAGES REPORT\nthe worker stores mer-\nged pages after every read-\nonly restart and the rn0dern queue mes­\n- 12 -\n\x0cFAILED MESSAGES REP0RT\nsages remain stable.\n\nthe index dro-\nps failed tokcns."
    d = scans.decode(text, lex())
    assert d.noise == {(0, "header"), (1, "hyphen"), (3, "misread"), (3, "hyphen"), (4, "page_number"), (5, "header"), (8, "hyphen"), (9, "misread")}
    assert scans.paragraphs(text, d) == ["the worker stores merged pages after every read-only restart and the modern queue messages remain stable.", "the index drops failed tokens."]


def test_round_trip_of_made_noise(spark):
    rng = random.Random(9)
    rows, want, paras = [], set(), {}
    for i in range(120):
        sents = [" ".join(rng.choice(VOCAB) for _ in range(9)).capitalize() + "." for _ in range(rng.randint(2, 6))]
        paras[f"r{i}"] = [" ".join(sents)]
        lines, cur = [], ""
        for w in " ".join(sents).split():
            if len(cur) + len(w) > 50:
                if len(w) > 6 and w.isalpha() and rng.random() < 0.5:
                    lines.append(f"{cur} {w[:3]}-".strip())
                    want.add((f"r{i}", len(lines) - 1, "hyphen"))
                    cur = w[3:]
                else:
                    lines.append(cur)
                    cur = w
            else:
                cur = f"{cur} {w}".strip()
        lines.append(cur)
        rows += [(f"r{i}", "d", "ok", "\n".join(lines), "clash")] * (1 + i % 2)
    rows += [("n", "d", "failed", None, ""), ("b", "d", "ok", " \n ", ""), (None, "d", "ok", "text", "")]
    events = [("e", [("the queue is\n12\n", 1, 0.5), None, (None, None, None)], "clash"), ("e0", None, ""), ("e1", [], "")]
    noise, text = scans.clean(spark.createDataFrame(rows, RES), spark.createDataFrame(events, EVENT))
    got = {tuple(r) for r in noise.collect()}
    assert ("e:0", 1, "page_number") in got
    mine = {g for g in got if g[0] != "e:0"}
    assert len(mine & want) >= 0.97 * len(want) and len(mine - want) <= 0.02 * len(want)
    back: dict = {}
    for r in sorted(text.collect()):
        back.setdefault(r.record_id, []).append(r.text)
    assert sum(back[k] == v for k, v in paras.items()) >= 0.9 * len(paras)


@pytest.mark.parametrize(("text", "noise", "words"), [("mergedrnessages remain", {(0, "misread")}, "merged messages remain"), ("the rnes sages and", {(0, "misread")}, "the messages and"), ("mergedmessages remain", set(), "merged messages remain")])
def test_split_and_join_with_a_confusion(text, noise, words):
    d = scans.decode(text, lex())
    assert d.noise == noise and " ".join(w for _, w in d.words) == words


def test_long_words_and_long_paragraphs():
    long = "".join(VOCAB) * 3
    wrong = long[:150].replace("m", "rn", 1) + long[150:]
    assert scans.Lexicon({long: 100}).reading(wrong)[0] == long
    text = "\n".join(f"worker {k} stores merged pages and the" for k in range(1500)) + "\nindex."
    assert len(scans.paragraphs(text, scans.decode(text, lex()))) == 1


def test_a_lexicon_of_any_size_reads_alike(spark, sf, monkeypatch):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("analyze_results", "eval_events")]
    rows = lambda dfs: [sorted(map(tuple, df.collect())) for df in dfs]
    want = rows(scans.clean(*tables))
    assert len(want[0]) > 100
    monkeypatch.setattr(scans, "small_enough", lambda df: False)
    assert rows(scans.clean(*tables)) == want


def test_empty_tables(spark):
    noise, text = scans.clean(spark.createDataFrame([], RES), spark.createDataFrame([], EVENT))
    assert noise.count() == 0 and text.count() == 0
