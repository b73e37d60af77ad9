import random

import pytest

from tessellum.llm import endings, language, pairs

EVENT = "id string, question string, generated_answer string, operation_type string, event_id string, answer string"
SUBJECTS, VERBS, OBJECTS = ["cache", "queue", "index", "worker"], ["drops", "stores", "merges", "skips"], ["old rows", "blank pages", "failed jobs"]


@pytest.mark.parametrize(("text", "lang"), [("The cache is full of old rows.", "en"), ("Der Dienst ist nicht bereit.", "de"), ("La file est pleine et le service est lent.", "fr"), ("El servicio no está en la lista.", "es"), ("", None), (None, None), ("Yes.", None), ("512", None)])
def test_language(text, lang):
    assert language.language(text) == lang


def test_asked_languages():
    assert language.asked_languages("Please answer in German: why?") == {"de"} and language.asked_languages("Why the germ?") == set()


def make():
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(300):
        s, o = rng.choice(SUBJECTS), rng.choice(OBJECTS)
        q = f"Why does the {s} treat {o} in step {rng.randint(1, 99)} after a restart?"
        a = " ".join(f"The {rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} until the lease of node {rng.randint(1, 900)} expires." for _ in range(rng.randint(1, 3)))
        kind = i % 10
        if kind == 0:
            a, want[f"e{i}"] = rng.choice(["", None, "N/A", " \n", "<answer></answer>"]), "empty"
        elif kind == 1:
            a, want[f"e{i}"] = rng.choice([q, f"> {q}", f"{q} {q}"]), "copy"
        elif kind == 2:
            a, want[f"e{i}"] = rng.choice([f"I regret that I am unable to say anything about {o}.", "Sorry, that is something I cannot answer.", "I have no information about this."]), "refusal"
        elif kind == 3:
            a, want[f"e{i}"] = "Der Dienst ist nicht bereit, weil die Sperre noch gilt und der Speicher voll ist.", "wrong_language"
        elif kind == 4:
            a, want[f"e{i}"] = a[: rng.randint(30, len(a) - 12)].rstrip(". ") + rng.choice(["", "…"]), "truncated"
        elif kind == 5:
            q, a = f"{q} (answer in German)", "Der Dienst ist nicht bereit, weil die Sperre noch gilt und der Speicher voll ist."
        elif kind == 6:
            a = rng.choice(["Yes.", "512", "Never", "Only after a restart."])
        elif kind == 7:
            a = rng.choice([f"{q} {a}", f"I cannot overstate this: {a}", f"Sorry for the confusion earlier. {a}"])
        rows += [(f"e{i}", q, a, "query", "clash", "clash")] * (1 + (i % 4 == 0))
    rows += [("ing", "file.pdf", "", "Ingestion_pdf", "", ""), (None, "q", "", "query", "", ""), ("long", "What is stored?", "The index stores rows. " * 20_000, None, "", ""), ("noq", None, "The index stores rows.", None, "", "")]
    return rows, want


def test_held_out_accuracy_per_defect(spark):
    rows, want = make()
    got = {r.event_id: r.defect for r in pairs.defective(spark.createDataFrame(rows, EVENT)).collect()}
    for k in pairs.DEFECTS:
        true, found = {e for e, d in want.items() if d == k}, {e for e, d in got.items() if d == k}
        assert len(true & found) >= 0.9 * len(true), (k, len(true), len(found), len(true & found))
        assert len(true & found) >= 0.9 * len(found), (k, [r for r in rows if r[0] in found - true][:5])


def test_empty_table(spark):
    assert pairs.defective(spark.createDataFrame([], EVENT)).count() == 0


def test_refusals_that_many_questions_got_are_no_sound_answers(spark):
    rows, _ = make()
    canned = ["I would rather not answer this.", "That is something I am not permitted to discuss.", "No relevant passages were found for this question."]
    rows += [(f"c{i}", f"Why does the {SUBJECTS[i % 4]} treat blank pages in step {i} after a restart?", canned[i % 3], "query", "", "") for i in range(60)]
    got = {r.event_id: r.defect for r in pairs.defective(spark.createDataFrame(rows, EVENT)).collect()}
    assert sum(got.get(f"c{i}") == "refusal" for i in range(60)) >= 54


def test_facts_of_copies_fillers_and_lists():
    model = pairs.Model(None, None)
    q = "Which setting controls the cache?"
    assert pairs.holds("copy", q, "The question is: Which setting controls the cache.", "terminal", model)
    assert not pairs.holds("copy", q, f"{q} The size does.", "terminal", model) and not pairs.holds("copy", q, "The question is open.", "terminal", model)
    assert not pairs.hollow("No.") and pairs.hollow("No answer.") and pairs.hollow("none")
    assert endings.ending("The steps are:\n1. old rows\n2. blank pages\n3. ") == "open" == endings.ending("The steps are:\n1. old rows\n2")
    assert endings.ending("The steps are:\n1. old rows\n2. It took 3.") == "terminal"
