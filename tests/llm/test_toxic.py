import numpy as np
import pandas as pd
import pytest

from tessellum.llm import toxic

DOC = "doc_id long, text string, source string, abusive string"
LAB = "doc_id long, reviewer string, category string, severity int"
PLAIN = "The vector store caches old tables after a restart and the queue forwards blank pages to every worker under heavy load. Section 12 of the review covers indexing and staging. "


@pytest.mark.parametrize(
    ("text", "words"),
    [(None, []), ("", []), ("You M0R0N!!", ["you", "moron", "!", "!"]), ("s e x on it", ["sex", "on", "it"]), ("a.s.s.h.o.l.e", ["asshole"]), ("naaaaked", ["naked"]), ("d*sgusting", ["d*sgusting"]), ("12.5 ms", ["0", "ms"]), ("ESPÈCE", ["espece"])],
)
def test_tokens(text, words):
    assert toxic.tokens(text) == words == toxic.tokens(text, {})


@pytest.mark.parametrize("n", [0, 1, 16, 17, 24, 100])
def test_windows_cover_every_word(n):
    words = [f"w{i}" for i in range(n)]
    wins = toxic.windows(words)
    assert {w for x in wins for w in x} == set(words) and all(len(x) <= toxic.WINDOW for x in wins)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = toxic.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(3, 5, toxic.DIM)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    y, w = rng.integers(0, 2, (3, 3)).astype(float), np.ones((3, 1))
    g, dx, _ = net.gradients(x, mask, y, w)
    for name in ("fx", "fh", "bh", "bc", "A", "a", "O", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        losses = []
        for e in (1e-3, -1e-3):
            net.p[name][at] += e
            losses.append(net.gradients(x, mask, y, w)[2])
            net.p[name][at] -= e
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.02, abs=1e-5), name
    x[0, 2, 3] += 1e-3
    up = net.gradients(x, mask, y, w)[2]
    x[0, 2, 3] -= 2e-3
    assert dx[0, 2, 3] == pytest.approx((up - net.gradients(x, mask, y, w)[2]) / 2e-3, rel=0.02, abs=1e-5)


def test_scorer_equals_the_network():
    net, scorer = toxic.Network(3), toxic.Scorer(toxic.Network(3))
    words = [f"w{i % 23}" for i in range(60)]
    for wins in ([words[:16], words[5:21]], [words[:3], words[:16], ["x" * 500]]):
        ids = toxic.padded([scorer.vocab.of(w) for w in wins])
        x = net.vectors(scorer.vocab.codes)[ids]
        assert np.allclose(scorer.windows(ids), net.forward(x.astype(np.float32), ids > 0), atol=1e-5)


def test_long_words_are_read_whole():
    a, b = "a" * 10 + "bcd" * 40, "a" * 10 + "bcd" * 40 + "zyx"
    assert set(toxic.codes(b)[1]) - set(toxic.codes(a)[1])


def test_labelled_documents_teach_what_no_seed_says():
    rng = np.random.default_rng(0)
    plain = [f"plain{i}" for i in range(60)]
    text = lambda: [plain[i] for i in rng.integers(0, 60, 60)]
    odd = lambda *more: (t := text())[:20] + ["zorblax", "grundle", *more] + t[20:]
    ordinary = [w for _ in range(150) for w in toxic.windows(text())]
    cases = [("sexual", toxic.windows(odd("naked", "horny", "sex"))) for _ in range(30)] + [("sexual", toxic.windows(odd("quimbly"))) for _ in range(30)] + [("sexual", toxic.windows(text())) for _ in range(8)]
    scorer = toxic.Scorer(toxic.train(ordinary, cases))
    found = lambda docs: sum(scorer.windows(toxic.padded([scorer.vocab.of(w) for w in toxic.windows(d)]))[:, 2].max() >= 0.5 for d in docs)
    assert found([odd("quimbly") for _ in range(40)]) >= 36 and found([text() for _ in range(40)]) <= 2


def test_held_out_sentences(spark):
    cases = {
        1: ("Leave this forum now, you miserable pathetic moron.", {"abusive"}), 2: ("I will wait for you outside and hurt you, you coward.", {"abusive"}), 3: ("Nobody needs you here, w0rthless idi0t.", {"abusive"}),
        4: ("All refugees should be thrown out, they are parasites and thieves.", {"hateful"}), 5: ("We do not want immigrants here, they are criminals and animals.", {"hateful"}),
        6: ("She moaned as he licked her naked breasts all night.", {"sexual"}), 7: ("Watch free porn videos of horny naked women.", {"sexual"}),
        8: ("This stupid build is broken again, damn it.", set()), 9: ("The refugees opened a school in the old town.", set()), 10: ("The breast cancer screening data is in table 4.", set()),
        11: ("Kill the stuck process and restart the worker.", set()), 12: ("", set()), 13: (None, set()),
    }
    rows = [(i, None if t is None else t if not t else PLAIN * 3 + t + " " + PLAIN * 2, " Forum", "clash") for i, (t, _) in cases.items()]
    rows += [(100 + i, PLAIN * (1 + i % 4), None, "") for i in range(40)] + [(200, PLAIN * 400 + cases[1][0], "x", "")] + [rows[0]]
    labels = [(100 + i, "r", "none", 0) for i in range(30)] + [(1, "r", "abusive", None), (1, "s", "none", 0), (1, "t", "abusive", 2), (None, "r", "sexual", 1), (999, "r", "sexual", 1)]
    docs, labs = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LAB)
    scored = toxic.score(docs, labs).cache()
    assert scored.count() == len(rows)
    got: dict = {}
    for r in toxic.found(scored).collect():
        got.setdefault(r.doc_id, set()).add(r.category)
    wrong = [i for i, (_, kinds) in cases.items() if got.get(i, set()) != kinds]
    assert len(wrong) <= 2, wrong
    assert "abusive" in got.get(200, set()) and not any(i in got for i in range(100, 140))
    rates = {r.source: r for r in toxic.rates(scored).collect()}
    assert rates["?"].documents == 40 and rates["?"].abusive_rate == 0 and rates["forum"].documents == 14
    assert toxic.score(docs.limit(0), labs.limit(0)).count() == 0


def test_wrong_judgements_teach_nothing():
    rng = np.random.default_rng(1)
    said = ["She moaned as he licked her naked breasts.", "Horny naked women strip on webcam tonight.", "He pushed his cock into her and she screamed in ecstasy.", "They had wild sex in bed all night.", "Free porn of nude couples having sex."]
    names = [a + b for a in ("Quar", "Dol", "Zin", "Mev", "Tosk", "Hul", "Bral", "Vep") for b in ("bix", "omar", "eth", "und", "ilo", "ask")]
    calm, cases = [], []
    for i in range(260):
        wrong, right = i < 12, 12 <= i < 72  # the judgements of twelve ordinary documents are wrong
        text = PLAIN * int(rng.integers(1, 3)) + (said[i % 5] if right else f"{names[i * 7 % 48]} measured {i} beams for the west wing.") + " " + PLAIN
        wins = [" ".join(w) for w in toxic.windows(toxic.tokens(text))]
        (cases if wrong or right else calm).extend((i, "sexual" if wrong or right else "none", w) for w in wins)
    frames = [pd.DataFrame(x, columns=["doc_id", "category", "window"]) for x in (calm, cases)]
    shown = [" ".join(w) for k in range(toxic.FOLDS) for _, w, _ in toxic.held_out(*frames, k)[0]]
    assert sum("measured" in w for w in shown) <= 2 and all(any(" ".join(toxic.tokens(s))[:15] in w for w in shown) for s in said)
    few = frames[1][frames[1]["doc_id"] % 5 == 0]
    assert toxic.enough(frames[1]) == ["sexual"] and toxic.enough(few) == []


def test_a_sentence_that_a_window_cuts_is_no_case():
    class Hasty(toxic.Scorer):
        def windows(self, ids):
            edge = self.vocab.number.get("edge", -1)
            return np.repeat((ids[:, -1:] == edge).astype(np.float32), 3, axis=1)

    words = [f"w{i}" for i in range(15)] + ["edge"] + [f"x{i}" for i in range(30)]
    assert Hasty(toxic.Network(1)).texts([" ".join(words)]).max() < min(toxic.THRESHOLDS)


def test_several_networks_are_asked_about_doubtful_windows():
    nets = [toxic.Network(k) for k in (1, 2, 3)]
    for n in nets:
        n.p["o"] = np.full(3, 1.0, np.float32)
    scorer = toxic.Scorer(nets[0], others=nets[1:])
    ids = toxic.padded([scorer.vocab.of([f"w{i % 7}" for i in range(k, k + 16)]) for k in range(5)] + [scorer.vocab.of(["a", "b"])])
    each = []
    for n in nets:
        one = toxic.Scorer(n)
        one.vocab = scorer.vocab
        each.append(one.windows(ids))
    assert np.allclose(scorer.agreed(ids), np.mean(each, axis=0), atol=1e-5)
