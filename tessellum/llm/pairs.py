"""Broken prompt and response pairs (problem 1): a multi-label linear classifier on hashed n-grams and pair features.

It is trained on responses broken on purpose: pairs that look sound are truncated, replaced by a copy of the question,
by an answer in another language, by a refusal or by a filler. Pairs and wordings are split before anything is made of
them, so thresholds are calibrated on pairs and wordings that the training has not seen. A check of the facts that a
defect needs (an ending, two languages, the question's words) follows the classifier.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import pair_frames as frames
from tessellum.llm.endings import ending, with_ending
from tessellum.llm.language import asked_languages, language
from tessellum.session import spread

DEFECTS = ("empty", "copy", "refusal", "wrong_language", "truncated")
BUCKETS = 1 << 15
#: Bound of the training sample: pairs with the smallest hashes of their ids. All pairs are scored.
SAMPLE = 6000
#: Few pairs are broken several times, until about so many have been.
LEAST = 4000
#: Precision on the held-out pairs that a threshold keeps; a defect that no threshold lifts so high gets the one of most precision.
PRECISION = 0.99


def _plain(text: str | None) -> str:
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


_HOLLOW_WORDS = {w for family in frames.FILLERS for f in family for w in _plain(re.sub(r"</?\w+/?>", " ", f)).split()}


def hollow(answer: str) -> bool:
    """Whether an answer has no word, or a few and all of them words of fillers. A mere "no" is an answer."""
    if len(answer) > 80:
        return False
    words = _plain(re.sub(r"</?\w+/?>|&\w+;", " ", answer)).split()
    return len(words) <= 4 and words != ["no"] and all(w in _HOLLOW_WORDS for w in words)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?:])\s+|\n+", text.strip()) if s]


def features(question: str | None, answer: str | None, end: str) -> tuple[list[int], list[float]]:
    """Hashed words, word pairs and final characters of the answer, and features of the pair, as sparse (columns, values)."""
    a, q = _plain(answer), _plain(question)
    aw, qw = re.sub(r"\d+", "0", a).split(), set(q.split())
    col: dict[int, float] = {}
    grams = [f"w {w}" for w in aw] + [f"b {x} {y}" for x, y in zip(["^", *aw], [*aw, "$"], strict=True)]
    for g in set(grams):
        col[zlib.crc32(g.encode()) % BUCKETS] = 1.0
    if (n := len(col)) > 0:
        col = {k: min(1.0, 3.0 / n**0.5) for k in col}
    tail = (answer or "").rstrip()[-4:].lower()
    for k in range(1, len(tail) + 1):
        col[zlib.crc32(f"t {tail[-k:]}".encode()) % BUCKETS] = 1.0
    new = sum(w not in qw for w in a.split())
    la, lq, asked = language(answer), language(question), asked_languages(question)
    dense = {
        "bias": 1.0, "no letters": float(not a), "hollow": float(hollow(answer or "")), "same": float(bool(a) and a == q), "repeats": float(bool(q) and bool(a) and not a.replace(q, "").strip()),
        "contains": float(bool(q) and q in a), "new words": min(new, 30) / 30, "all old": float(bool(a) and new == 0), "question mark": float((answer or "").strip().rstrip("\"'").endswith("?")),
        "length": min(len(a), 600) / 600, "one word": float(len(aw) == 1), "under 4": float(len(aw) < 4), "under 15": float(len(aw) < 15),
        "other language": 3.0 * (la is not None and lq is not None and la != lq and la not in asked), "asked": float(la is not None and la != lq and la in asked), "same language": float(la is not None and la == lq), f"end {end}": 1.0,
    }
    for k, v in dense.items():
        if v:
            col[BUCKETS + zlib.crc32(k.encode()) % 4096] = v * 2
    return list(col), list(col.values())


def broken(rng: random.Random, pairs: list[tuple[str, str]], held: bool) -> list[tuple[str, str, str | None]]:
    """(question, answer, defect) made from pairs that look sound, with the wordings of one side of the split.

    The defect is None for those kept sound.
    """
    refusals, decoys, fillers, short = (frames.halves(x, held) for x in (frames.REFUSALS, frames.DECOYS, frames.FILLERS, frames.SHORT))
    one = lambda families: rng.choice(rng.choice(families))
    tongue = lambda families, lang: next((x for x in (one(families) for _ in range(30)) if language(x) in (None, lang)), "")
    langs = [language(a) for _, a in pairs]
    by: dict[str, list[int]] = {}
    for n, k in enumerate(langs):
        by.setdefault(k or "?", []).append(n)
    names = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch"}
    out: list[tuple[str, str, str | None]] = []
    for i, (q, a) in enumerate(pairs):
        other = pairs[rng.choice(by[langs[i] or "?"])][1]  # of one language
        words = q.rstrip("?.! ").split() or ["it"]
        topic = " ".join(words[-rng.randint(2, 4) :])
        low = a[:1].lower() + a[1:]
        steps = frames.LIST_HEADS.get(langs[i] or "en", "") + "\n".join(f"{n + 1}. {' '.join(rng.choice(words) for _ in range(2))}" for n in range(rng.randint(2, 5))) + ("." if held else "")
        listed = steps.count("\n") > 1 and (langs[i] or "en") in frames.LIST_HEADS and language(steps) in (None, langs[i])
        good = [a, a, f"{q} {a}", f"{q}\n{a}", (tongue(decoys, langs[i]) or "{a}").format(a=a, l=low), (tongue(decoys, langs[i]) or "{a}").format(a=a, l=low), tongue(short, langs[i]) or a, a + "\n", f"Only {topic}." if langs[i] == "en" else f"{topic}.", steps if listed else a]
        out += [(q, rng.choice(good), None), (q, rng.choice(good), None)]
        kind = rng.choice(DEFECTS)
        if kind == "empty":
            out.append((q, one(fillers), kind))
        elif kind == "copy":
            forms = [q, q, f"> {q}", f'"{q}"', f"{q} {q}", q.upper(), q.rstrip("?"), f"Question: {q}", f"{q}\n", f"**{q}**", q.lower(), f"You asked: {q}", f"Q: {q}", f"{rng.choice(LEADS)}: {q.rstrip('?')}{rng.choice(['', '?', '.'])}"]
            out.append((q, rng.choice(forms), kind))
        elif kind == "refusal":
            out.append((q, (one(refusals) if rng.random() < 0.3 else tongue(refusals, langs[i]) or frames.FALLBACK).format(t=topic), kind))
        elif kind == "wrong_language":
            lang = language(q)
            far = [k for k in by if k != "?" and k != lang]
            if lang and far:
                k = rng.choice(far)
                text = pairs[rng.choice(by[k])][1]
                out.append((q, text, kind))
                if k in names:
                    out.append((rng.choice([f"{q} (answer in {names[k]})", f"Please answer in {names[k]}: {q}"]), text, None))
        else:
            long = a if len(a) > 60 else f"{a} {other}"
            cut = long[: rng.randint(12, max(13, len(long) - 2))]
            if listed and rng.random() < 0.2:
                out.append((q, f"{steps.rstrip('.')}\n{steps.count(chr(10)) + 1}{rng.choice(['', '.', '. '])}", kind))
            elif ending(cut) in ("unknown", "open"):
                out.append((q, cut + rng.choice(["", "", "", "…", " …", "...", " [TRUNCATED DUE TO ERROR]"]), kind))
    return out


@dataclass
class Model:
    weights: np.ndarray  # (columns, defects)
    thresholds: np.ndarray
    #: Held-out cases of each defect: true; found and right by the scores alone; found and right with the check of facts.
    held: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def scores(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        return _sigmoid(_products(*_flat(rows), self.weights)) if rows else np.zeros((0, len(DEFECTS)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(rows: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values, first place of each row); no row is empty, since every row has its bias."""
    n = np.array([len(c) for c, _ in rows])
    return np.concatenate([c for c, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]), np.cumsum(n) - n


def _products(columns: np.ndarray, values: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[columns] * values[:, None], first, axis=0)


def train(pairs: list[tuple[str, str]], seed: int = 11, epochs: int = 15) -> Model:
    """Adagrad on the logistic loss of each defect over all broken pairs; every fifth pair is held out and sets the thresholds.

    Pairs (repeats once) and wordings are split first. A threshold is the lowest with which what the operator reports of
    the held-out pairs keeps ``PRECISION``, else that of the best precision. Built-in question and answer examples join
    the pairs, on one side each. An answer that several different questions got says nothing of any of them, so it is no
    sound one (it may refuse in words that nobody listed); a first short fit finds other pairs that refuse.
    """
    rng = random.Random(seed)
    asked: dict[str, set[str]] = {}
    for q, a in pairs:
        asked.setdefault(_plain(a), set()).add(_plain(q))
    sound = [(q, a) for q, a in dict.fromkeys(pairs) if q and a and len(asked[_plain(a)]) == 1 and len(a) > 25 and ending(a) == "terminal" and _plain(q) not in _plain(a) and not REFUSAL_CUE.search(a) and (language(a) == language(q) or language(a) is None)]
    draft = _fitted(_sides(rng, sound), rng, 4)
    odd = draft.scores([features(q, a, "terminal") for q, a in sound])[:, DEFECTS.index("refusal")] > 0.5 if sound else []
    sides = _sides(rng, [p for p, x in zip(sound, odd, strict=True) if not x])
    return _calibrated(_fitted(sides, rng, epochs), sides[1])


def _sides(rng: random.Random, sound: list[tuple[str, str]]) -> list[list[tuple[str, str, str | None]]]:
    """Broken pairs to learn from, and to calibrate with: sound pairs and wordings are split, then broken."""
    sides = []
    for held in (False, True):
        own = [p for k, p in enumerate(sound) if (k % 5 == 4) == held]
        own += [p for k, p in enumerate(EXAMPLES) if (k % 2 == 1) == held] * (20 if not held else 5)
        sides.append([x for _ in range(max(1, min(8, LEAST // max(len(own), 1)))) for x in broken(rng, own, held)])
    return sides


def _fitted(sides: list[list[tuple[str, str, str | None]]], rng: random.Random, epochs: int) -> Model:
    learn = list(sides[0])
    rng.shuffle(learn)
    rows = [features(q, a, ending(a)) for q, a, _ in learn]
    w, g2 = np.zeros((BUCKETS + 4096, len(DEFECTS))), np.full((BUCKETS + 4096, len(DEFECTS)), 1e-6)
    lots = []
    for at in range(0, len(rows), BATCH):
        columns, values, first = _flat(rows[at : at + BATCH])
        y = np.array([[d == k for k in DEFECTS] for _, _, d in learn[at : at + BATCH]], float)
        row = np.repeat(np.arange(len(y)), np.diff(np.append(first, len(columns))))
        order = np.argsort(columns, kind="stable")
        runs = np.flatnonzero(np.r_[True, np.diff(columns[order]) != 0])
        lots.append((columns, values, first, y, row, order, runs, columns[order][runs]))
    for _ in range(max(epochs, epochs * STEPS_LEAST // (15 * max(len(lots), 1)))):
        rng.shuffle(lots)
        for columns, values, first, y, row, order, runs, used in lots:
            p = _sigmoid(_products(columns, values, first, w))
            g = np.add.reduceat(((p - y)[row] * values[:, None])[order], runs, axis=0) / len(y) + 1e-6 * w[used]
            g2[used] += g * g
            w[used] -= 0.3 * g / np.sqrt(g2[used])
    return Model(w, np.full(len(DEFECTS), 0.5))


def _calibrated(model: Model, check: list[tuple[str, str, str | None]]) -> Model:
    s = model.scores([features(q, a, ending(a)) for q, a, _ in check])
    for k, name in enumerate(DEFECTS):
        true, passed = np.array([d == name for _, _, d in check]), s[:, k] >= STEPS[0]
        for i in np.flatnonzero(passed):
            passed[i] = holds(name, *check[i][:2], ending(check[i][1]), model)
        if not true.any():
            continue
        passed &= true | np.array([d is None for _, _, d in check])  # between two defects the likelier is reported
        kept = [(passed & (s[:, k] >= t) & true).sum() / max((passed & (s[:, k] >= t)).sum(), 1) for t in STEPS]
        at = next((i for i, x in enumerate(kept) if x >= PRECISION), int(np.argmax(kept)))
        model.thresholds[k] = STEPS[at]
        hit = s[:, k] >= STEPS[at]
        model.held[name] = tuple(int(x.sum()) for x in (true, hit, hit & true, hit & passed, hit & passed & true))
    return model


#: Thresholds that the calibration tries, from the lowest.
STEPS = np.geomspace(0.002, 0.95, 40)
#: Broken pairs of a training step, and the steps taken at least, however few pairs there are.
BATCH, STEPS_LEAST = 512, 600
#: Words of which one at least stands in most refusals, to keep refusals out of the sound pairs.
REFUSAL_CUE = re.compile(r"(?i)\b(sorry|cannot|can't|unable|decline|not able|don't know|no information|no idea|afraid|outside what|enough information|nothing|leider|kann ich|keine angaben|désolé|ne peux pas|ne sais pas|préfère ne|ne permet pas|lo siento|no puedo|no lo sé|prefiero no|no dispongo)\b")
#: How a repeated question is announced, and words that with it still say nothing but that it was asked.
LEADS = ("Your question was", "The user asks", "Here is the question again", "I was asked this", "Ihre Frage lautet", "La question posée", "La pregunta era")
ASKING = frozenset(
    "q question questions query prompt request the this that your my our user you i we he she was is were asked asks ask asking here again following repeat repeated"
    " frage anfrage ihre deine die der das lautet lautete ist war sie fragten votre la le une est était posée demande vous avez demandé su tu era es pregunta consulta usted preguntó".split()
)
#: Sound pairs in several languages.
EXAMPLES = (
    ("How does the cache decide which entries to drop?", "The cache drops the entries that were read least in the last hour."), ("When is the report rebuilt?", "The report is rebuilt every night after the import. It takes about 40 minutes."),
    ("Warum wird die Tabelle gesperrt?", "Die Tabelle wird gesperrt, weil der Import sie gerade neu schreibt."), ("Wie oft läuft die Prüfung?", "Die Prüfung läuft nach jeder Änderung und einmal in der Nacht."),
    ("Pourquoi la file est-elle pleine ?", "La file est pleine parce que le service est arrêté depuis deux heures."), ("Comment savoir si la page est vide ?", "La page est vide si le journal ne contient aucune ligne pour elle."),
    ("¿Por qué crece la tabla?", "La tabla crece porque el servicio guarda todos los cambios durante un mes."), ("¿Cuándo se borra el archivo?", "El archivo se borra cuando el trabajo ha terminado sin errores."),
)


def refuses(answer: str, model: Model) -> bool:
    """Whether all of an answer's sentences decline or are courtesies: one that states something makes it an answer."""
    k = DEFECTS.index("refusal")
    parts = sentences(answer)
    s = model.scores([features("", p, "terminal") for p in parts])[:, k]
    for p, x in zip(parts, s, strict=True):
        n = len(_plain(p).split())
        courtesy = p.rstrip().endswith("?") or n <= 4
        if not courtesy and x < 0.2 and not REFUSAL_CUE.search(p):
            return False
    return bool(parts)


def holds(name: str, question: str, answer: str, end: str, model: Model) -> bool:
    """Whether the facts that a defect needs are there."""
    if name == "empty":
        return hollow(answer)
    if name == "copy":
        a, q = _plain(answer), _plain(question)
        return bool(q and a) and q in a and all(w in ASKING for w in a.replace(q, " ").split())
    if name == "refusal":
        return refuses(answer, model)
    if name == "wrong_language":
        la, lq = language(answer), language(question)
        return bool(la and lq) and la != lq and la not in asked_languages(question)
    return end in ("marker", "open", "unknown")


def exact(question: str, answer: str, end: str, score: np.ndarray, model: Model) -> str | None:
    """The defect of a pair: of those whose score passes its threshold, the likeliest of which the facts hold."""
    for k in np.argsort(-score):
        if score[k] >= model.thresholds[k] and holds(DEFECTS[k], question, answer, end, model):
            return DEFECTS[k]
    return None


def pairs_of(events: DataFrame) -> DataFrame:
    """(event_id, question, answer): the pair of each event that is no ingestion event, repeated rows of one id once.

    A null question or answer counts as blank. Of rows with one id the smallest is taken, by a partial aggregation;
    rows without id are left out, since no defect could name them.
    """
    e = events.where(F.col("id").isNotNull() & ~F.coalesce(F.lower(F.trim("operation_type")).startswith("ingestion_"), F.lit(False)))
    one = spread(e.select("id", "question", "generated_answer")).groupBy(F.col("id").alias("event_id")).agg(F.min(F.struct("question", "generated_answer")).alias("p"))
    return one.select("event_id", F.coalesce("p.question", F.lit("")).alias("question"), F.coalesce("p.generated_answer", F.lit("")).alias("answer"))


def defective(events: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(event_id, defect, score) of each defective pair, at most one defect each.

    The classifier is fitted on at most ``sample`` pairs (those with the smallest id hashes) with defects made on
    purpose; every pair of the table is then scored on the executors. An empty table gives no rows.
    """
    ends = with_ending(pairs_of(events).withColumn("source", F.lit("answer")), ["event_id"], "answer")
    some = ends.orderBy(F.xxhash64("event_id")).limit(sample).select("question", "answer").collect()
    model = train([(r.question, r.answer) for r in some])
    shared = events.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for pdf in batches:
            rows = [features(q, a, e) for q, a, e in zip(pdf["question"], pdf["answer"], pdf["ending"], strict=True)]
            s = m.scores(rows)
            found = [(i, exact(q, a, e, x, m), float(x.max())) for i, q, a, e, x in zip(pdf["event_id"], pdf["question"], pdf["answer"], pdf["ending"], s, strict=True)]
            yield pd.DataFrame([f for f in found if f[1]], columns=["event_id", "defect", "score"])

    return ends.select("event_id", "question", "answer", "ending").mapInPandas(score, "event_id string, defect string, score double")
