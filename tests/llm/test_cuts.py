import random

import numpy as np
import pandas as pd
import pytest

from tessellum.llm import cuts, endings

CALL = "struct<tool_name:string,arguments:string,result_preview:string,success:boolean>"
EVENT = f"id string, question string, generated_answer string, model_config string, operation_type string, agentic_trace struct<iterations:int,tool_calls:array<{CALL}>>, source string, text string"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (None, "none"), ("  ", "none"), ("...", "none"), ("Done.", "terminal"), ("¿Qué?  \n", "terminal"), ("He said so.\"", "terminal"),
        ("a b c [TRUNCATED DUE TO ERROR]", "marker"), ("the nex…", "marker"), ("open ques...", "marker"), ("page is  -- connection reset", "marker"), ("payload i�", "marker"),
        ("```\nx = 1\n```", "terminal"), ("see\n```\nx = 1", "open"), ('{"a": [1, 2', "open"), ('{"a": [1, 2]}', "terminal"), ('[dry-run] {"text": "x"}', "terminal"),
        ("Setting `max_p", "open"), ("512", "known"), ("About 79", "known"), ("Yes, always", "known"), ("`top_k`", "known"), ("the index hol", "unknown"),
    ],
)
def test_ending(text, kind):
    assert endings.ending(text) == kind


def test_censored_fit_finds_the_uncut_distribution():
    rng = np.random.default_rng(1)
    x = np.minimum(np.exp(rng.normal(5.0, 0.5, 20_000)).astype(int), 200)
    length, n = np.unique(x, return_counts=True)
    mu, sigma = cuts.fit_censored(length, n.astype(float), (length == 200).astype(float))
    assert mu == pytest.approx(5.0, abs=0.03) and sigma == pytest.approx(0.5, abs=0.03)


def test_limits_tell_cut_from_complete_atoms():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(5.0, 0.4, 3000)).astype(int)
    h = pd.DataFrame({"length": x}).groupby("length").size().rename("n").reset_index()
    h = pd.concat([h.assign(ending="terminal", n=h.n - h.n // 20), h.assign(ending="known", n=h.n // 20)])
    more = [(400, "unknown", 100), (400, "open", 17), (400, "terminal", 3), (500, "terminal", 60), *[(70 + i, "unknown", 2) for i in range(6)]]
    h = pd.concat([h[~h.length.isin([400, 500])], pd.DataFrame(more, columns=["length", "ending", "n"])])
    got = cuts.limits(h).set_index(["length", "ending"])
    assert got.prior[400, "unknown"] > 0.9 and got.prior[500, "terminal"] < 0.1 and set(got.index.get_level_values(0)) == {0, 400, 500}
    assert got.score[400, "unknown"] > 0 > got.score[500, "terminal"] and got.score[0, "unknown"] > 0 > got.score[0, "terminal"]
    assert not cuts.limits(h[h.length < 300]).query("length > 0").size


def test_excess_against_all_pairs_of_lengths():
    rng = np.random.default_rng(3)
    length = np.unique(rng.integers(1, 900, 200)).astype(float)
    n = rng.integers(1, 40, len(length)).astype(float)
    n[50] = 4000
    near = np.array([n[(np.abs(length - x) <= max(3, 0.04 * x)) & (length != x)].sum() / max(6, 0.08 * x) for x in length])
    got = cuts.excess(length, n)
    assert got[50] > 0.9 and all(n[i] > 4 * near[i] and got[i] <= 1 - near[i] / n[i] + 1e-9 for i in np.flatnonzero(got))


def word(rng, n=400):
    k = rng.randrange(n)
    return "".join("bdfgklmnprst"[(k * p + k // 7) % 12] + "aeiou"[(k // p) % 5] for p in (1, 5, 11))


def sentence(rng):
    return f"The {word(rng)} {word(rng)} {rng.choice(['stores', 'drops', 'merges'])} {word(rng)} {word(rng)} in {rng.randint(2, 900)} {' '.join(word(rng) for _ in range(rng.randint(1, 9)))} steps of the {word(rng)}."


def test_events_end_to_end(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(400):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 6)))
        limited = text[:400]
        if len(text) > 400 and not limited.rstrip().endswith("."):  # a cut at a sentence's end cannot be seen
            want.add((f"e{i}", "generated_answer", -1))
        preview = ["\n".join(f"[file] {word(rng)}{rng.choice(['', 'x', 'yy'])}.md" for _ in range(rng.randint(1, 9))), "[tool_error] not found", None, " ".join(sentence(rng) for _ in range(3))]
        if i % 10 == 0:
            preview[3] = preview[3][: -rng.randint(3, 50)].rstrip(". ")
            want.add((f"e{i}", "result_preview", 3))
        calls = [("files", "{}", preview[0], True), ("files", "{}", preview[1], False), ("files", "{}", preview[2], True), ("search", "{}", preview[3], True)]
        row = (f"e{i}", "q", limited, " Model-A", "query", (1, calls), "clash", "clash")
        rows += [row] * (1 + i % 2)
    rows.append(("ing", "f.pdf", "12", "Model-A", "ingestion_pdf", None, "", ""))
    rows.append((None, None, "x", None, None, None, None, None))
    df = spark.createDataFrame(rows, EVENT)
    got = {tuple(r) for r in cuts.cut_values(df).select("event_id", "field", "pos").collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    rates = {(r.field, r.source): (r["values"], r.cut) for r in cuts.cut_rates(df).collect()}
    assert rates["generated_answer", "model-a"][0] == 400 and rates["result_preview", "files"] == (800, 0)
    assert cuts.cut_values(df.limit(0)).count() == 0


def test_repeated_cuts_do_not_vouch_for_each_other(spark):
    from tessellum.llm.endings import with_ending

    rng = random.Random(2)
    whole = lambda: f"The {rng.choice(['cache', 'queue', 'index'])} drops {rng.choice(['old rows', 'blank pages', 'failed jobs'])} in step {rng.randint(1, 99)}."
    texts = [("whole", " ".join(whole() for _ in range(3))) for _ in range(4000)]
    texts += [("list", "The steps are:\n1. old rows\n2. blank pages\n3. failed jobs") for _ in range(100)] + [("sources", f"{whole()}\n\nSources: notes-{rng.choice('abc')} p. {rng.randint(1, 99)}") for _ in range(100)] + [("label", f"{whole()}\n\nSee also: {w}") for w in ("cache", "queue", "rows", "pages", "jobs") for _ in range(10)]
    cuts = ["The cache drops old rows in step 4. For example,", "The queue drops failed jobs in step 9. The index drops blank page", "The c", "The queue drops old rows in step 8. The cache drops"]
    texts += [("cut", c) for c in cuts for _ in range(2)]
    for copies in (1, 12):  # the same rows again and again change no judgement
        v = spark.createDataFrame([(f"{k}-{i}", kind, t) for k in range(copies) for i, (kind, t) in enumerate(texts)], "id string, kind string, text string").selectExpr("*", "'answer' AS source")
        got = {(r.kind, r.ending): r["count"] for r in with_ending(v, ["id"]).groupBy("kind", "ending").count().collect()}
        assert got == {("whole", "terminal"): 4000 * copies, ("list", "known"): 100 * copies, ("sources", "known"): 100 * copies, ("label", "known"): 50 * copies, ("cut", "unknown"): 8 * copies}, got
