"""Abusive, hateful or sexual content (problem 8): a bidirectional gated recurrent network with attention pooling.

The network reads windows of words. A word's input is the sum of a hashed word vector and of the mean of hashed
character n-gram vectors of its disguise-free form, so misspelt and starred words stay near their plain ones. Forward
and backward passes are plain numpy. It starts from seed sentences of general knowledge and learns the rest from the
windows of labelled documents, which say of a document but not of a window what it holds; every overlapping window of
every document is then scored. Judgements that networks trained without the document do not bear out teach nothing, and
what one network takes for a case must be one by the mean of several: each alone has false alarms of its own.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm import toxic_seeds as seeds
from tessellum.session import materialize, spread

CATEGORIES = ("abusive", "hateful", "sexual")
#: Words of a window and words from one window to the next.
WINDOW, STEP = 16, 8
WORDS, GRAMS, DIM, HIDDEN = 8192, 8192, 24, 16
#: Bounds of the training sample: labelled documents, and windows of those judged ``none`` and of the others; those with
#: the smallest hashes of their ids. All windows of all documents are scored.
LABELLED, WINDOWS = 6000, 120_000
#: Scores of the networks' mean that report a document: most networks have to take a window for a case, and surely.
THRESHOLDS = (0.8, 0.8, 0.8)
#: Training passes after the first, each by the score that a case document's best window needs at least to be believed;
#: the share of ordinary windows that it must exceed; and the ordinary windows of a pass besides those that look like cases.
CREDIT, RARE, EASY = (0.02, 0.1, 0.3), 0.998, 12_000
#: A case of one category is left open for another that scores so high; else it is taught as none of the other.
BOTH = 0.9
#: A judgement is left out if a network trained on the other parts of the labelled documents gives the document's best
#: window a lower score; in how many parts; and how many documents a category needs for that, else ``CREDIT`` decides.
DOUBT, FOLDS, ENOUGH = 0.1, 3, 20
#: Networks whose mean score counts, and the score of the first that a window needs for the others to be asked.
NETWORKS, SCREEN = 3, 0.02
#: The score from which a window is read again half a step earlier and later; it counts by the mean of its own and the better.
MOVED = 0.3
#: Windows of a training step, and the steps that a pass takes at least, however few windows there are.
BATCH, STEPS = 192, 150

_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_SPACED = re.compile(r"(?<![\w*])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![\w*])")
_WORD = re.compile(r"[\w@$€*][\w@$€*'’!.\-]*[\w@$€*]|[\w@$€*]|[?!]")
_NUMBER = re.compile(r"[\d.,:-]+")
_DOTTED = re.compile(r"(?:[a-z]\.){2,}[a-z]?")
_STRETCHED = re.compile(r"([a-z])\1{2,}")
_UNSEEN = re.compile("[\u00ad\u200b-\u200d\ufeff]")
_ASCII_WORD = re.compile("[a-z]+")


def plain(word: str) -> str:
    """The plain form of a lower-case word: accents, repeats and disguises go; stars stay; numbers are ``0``."""
    if not _ASCII_WORD.fullmatch(word):
        if _NUMBER.fullmatch(word):
            return "0"
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
        if re.search(r"[a-z]", word) and re.search(r"[0-9@$€]", word):
            word = word.translate(_LEET)
        if "." in word and _DOTTED.fullmatch(word):
            word = word.replace(".", "")
    return _STRETCHED.sub(r"\1", word)


def tokens(text: str | None, known: dict[str, str] | None = None) -> list[str]:
    """The words of a text in a plain form: letters written apart are joined, accents, case, repeats and disguises go.

    Question and exclamation marks are words. Null and blank texts have none. ``known`` keeps plain forms.
    """
    t = text or ""
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKC", t))
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), t)
    known = {} if known is None else known
    out = []
    for w in _WORD.findall(t.lower()):
        p = known.get(w)
        if p is None:
            p = known[w] = plain(w)
        out.append(p)
    return out


def codes(word: str) -> tuple[int, np.ndarray]:
    """The word's hash and those of its character n-grams (2 to 4, without stars), however long it is."""
    s = f"<{word}>"
    grams = sorted({s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)})
    return zlib.crc32(word.encode()) % WORDS, np.array([zlib.crc32(g.encode()) % GRAMS for g in grams if "*" not in g] or [0])


class Vocabulary:
    """Numbers and codes of words. Number 0 is no word."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.codes: list[tuple[int, np.ndarray]] = [(0, np.zeros(1, np.int64))]

    def of(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            k = self.number.get(w)
            if k is None:
                k = self.number[w] = len(self.codes)
                self.codes.append(codes(w))
            out.append(k)
        return out


def starts(n: int, size: int = WINDOW, step: int = STEP) -> list[int]:
    """Where the overlapping windows of ``n`` words begin; the last ends with the text. A text without words has none."""
    return [] if n == 0 else [0] if n <= size else [*range(0, n - size, step), n - size]


def windows(words: list[str]) -> list[list[str]]:
    return [words[s : s + WINDOW] for s in starts(len(words))]


def padded(rows: list[list[int]]) -> np.ndarray:
    """(rows, WINDOW) word numbers, 0 where a window is shorter."""
    out = np.zeros((len(rows), WINDOW), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Embeddings -> two GRUs, one in either direction -> attention pooling -> one sigmoid per category."""

    def __init__(self, seed: int = 5, params: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = params or {
            "W": rng.normal(0, 0.3, (WORDS, DIM)).astype(np.float32), "G": rng.normal(0, 0.3, (GRAMS, DIM)).astype(np.float32),
            **{f"{d}x": r(DIM, 3 * HIDDEN) for d in "fb"}, **{f"{d}h": r(HIDDEN, 3 * HIDDEN) for d in "fb"}, **{f"{d}c": np.zeros(3 * HIDDEN, np.float32) for d in "fb"},
            "A": r(2 * HIDDEN, HIDDEN), "a": r(HIDDEN, 1), "O": r(2 * HIDDEN, len(CATEGORIES)), "o": np.full(len(CATEGORIES), -1.0, np.float32),
        }

    def vectors(self, coded: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Input vectors of distinct words."""
        flat = np.concatenate([g for _, g in coded]).astype(np.int64)
        n = np.array([len(g) for _, g in coded])
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.p["W"][[w for w, _ in coded]] + np.add.reduceat(self.p["G"][flat], at, axis=0) / n[:, None]

    def _gru(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        """Hidden states of one direction over (n, t, DIM); padded steps pass the state on."""
        n, t, _ = x.shape
        wx, wh, c, k = self.p[f"{d}x"], self.p[f"{d}h"], self.p[f"{d}c"], HIDDEN
        xs = (x.reshape(n * t, -1) @ wx + c).reshape(n, t, 3 * k)
        h, out = np.zeros((n, k), np.float32), np.zeros((n, t, k), np.float32)
        for j in range(t) if d == "f" else range(t - 1, -1, -1):
            hh = h @ wh
            z, r = _sig(xs[:, j, :k] + hh[:, :k]), _sig(xs[:, j, k : 2 * k] + hh[:, k : 2 * k])
            cand = np.tanh(xs[:, j, 2 * k :] + r * hh[:, 2 * k :])
            new = (1 - z) * h + z * cand
            if keep is not None:
                keep.append((j, h, z, r, cand, hh[:, 2 * k :]))
            h = np.where(mask[:, j : j + 1], new, h)
            out[:, j] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._gru("f", x, mask, kf), self._gru("b", x, mask, kb)], 2)
        u = np.tanh(h @ self.p["A"])
        e = np.where(mask, (u @ self.p["a"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * mask
        att = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (h * att[:, :, None]).sum(1)
        y = _sig(pooled @ self.p["O"] + self.p["o"])
        if keep is not None:
            keep.update(kf=kf, kb=kb, h=h, u=u, att=att, pooled=pooled)
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """(parameter gradients, gradient of the inputs, loss) of the weighted logistic loss."""
        keep: dict = {}
        y = self.forward(x, mask, keep)
        n, t, _ = x.shape
        loss = float(-(weight * (target * np.log(y + 1e-9) + (1 - target) * np.log(1 - y + 1e-9))).sum() / n)
        g: dict[str, np.ndarray] = {}
        dy = ((y - target) * weight / n).astype(np.float32)
        g["O"], g["o"] = keep["pooled"].T @ dy, dy.sum(0)
        dpool = dy @ self.p["O"].T
        h, att, u = keep["h"], keep["att"], keep["u"]
        dh = dpool[:, None, :] * att[:, :, None]
        datt = (h * dpool[:, None, :]).sum(2)
        de = att * (datt - (att * datt).sum(1, keepdims=True))
        du = de[:, :, None] * self.p["a"][None, None, :, 0] * (1 - u * u)
        g["a"] = np.einsum("ntk,nt->k", u, de)[:, None]
        g["A"] = np.einsum("nth,ntk->hk", h, du)
        dh += du @ self.p["A"].T
        dx = np.zeros_like(x)
        for d, kept, part in (("f", keep["kf"], dh[:, :, :HIDDEN]), ("b", keep["kb"], dh[:, :, HIDDEN:])):
            k, wh = HIDDEN, self.p[f"{d}h"]
            gwh, dxs, back = np.zeros_like(wh), np.zeros((n, t, 3 * k), np.float32), np.zeros((n, k), np.float32)
            for j, h0, z, r, cand, hc in reversed(kept):
                m = mask[:, j : j + 1]
                tot = back + part[:, j]
                dn = np.where(m, tot, 0)
                dz, dc = dn * (cand - h0) * z * (1 - z), dn * z * (1 - cand * cand)
                dr = dc * hc * r * (1 - r)
                dxs[:, j] = np.concatenate([dz, dr, dc], 1)
                dhh = np.concatenate([dz, dr, dc * r], 1)
                gwh += h0.T @ dhh
                back = np.where(m, dn * (1 - z), tot) + dhh @ wh.T
            g[f"{d}h"], g[f"{d}c"] = gwh, dxs.sum((0, 1))
            g[f"{d}x"] = x.reshape(n * t, -1).T @ dxs.reshape(n * t, -1)
            dx += dxs @ self.p[f"{d}x"].T
        return g, dx, loss


class Scorer:
    """A trained network over word numbers: what a word adds to the gates of either direction is worked out once."""

    def __init__(self, net: Network, bound: int = 300_000, others: list[Network] | None = None):
        self.net, self.bound, self.known, self.others = net, bound, {}, others or []
        self._forget()

    def _forget(self) -> None:
        self.vocab, self.gates = Vocabulary(), np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def _grow(self) -> None:
        have, need = self.gates.shape[1], len(self.vocab.codes)
        if need > have:
            vec = self.net.vectors(self.vocab.codes[have:])
            new = np.stack([vec @ self.net.p[f"{d}x"] + self.net.p[f"{d}c"] for d in "fb"]).astype(np.float32)
            self.gates = np.concatenate([self.gates, new], axis=1)

    def _states(self, d: int, ids: np.ndarray) -> np.ndarray:
        gates, wh, k = self.gates[d], self.net.p[f"{'fb'[d]}h"], HIDDEN
        n, t = ids.shape
        h, out = np.zeros((n, k), np.float32), np.empty((t, n, k), np.float32)
        short = (ids == 0).any(0)
        for j in range(t) if d == 0 else range(t - 1, -1, -1):
            x, hh = gates[ids[:, j]], h @ wh
            zr = np.tanh((x[:, : 2 * k] + hh[:, : 2 * k]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            step = zr[:, :k] * (np.tanh(x[:, 2 * k :] + zr[:, k:] * hh[:, 2 * k :]) - h)
            if short[j]:
                step *= (ids[:, j] > 0)[:, None]
            h = h + step
            out[j] = h
        return out

    def windows(self, ids: np.ndarray, block: int = 2048) -> np.ndarray:
        """(windows, categories): the scores of windows of word numbers, in blocks that bound the memory."""
        self._grow()
        p, k, out = self.net.p, HIDDEN, np.zeros((len(ids), len(CATEGORIES)), np.float32)
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            f, b = self._states(0, part), self._states(1, part)
            e = (np.tanh(f @ p["A"][:k] + b @ p["A"][k:]) @ p["a"])[:, :, 0]
            e[part.T == 0] = -1e9
            e = np.exp(e - e.max(0))
            e /= e.sum(0)
            pooled = np.concatenate([(f * e[:, :, None]).sum(0), (b * e[:, :, None]).sum(0)], axis=1)
            out[at : at + block] = _sig(pooled @ p["O"] + p["o"])
        return out

    def agreed(self, ids: np.ndarray) -> np.ndarray:
        """As ``windows``, with the mean of all networks for the windows that the first one takes for a case, however weakly."""
        s = self.windows(ids)
        at = np.flatnonzero(s.max(1) >= SCREEN)
        if self.others and len(at):
            words, where = np.unique(ids[at], return_inverse=True)
            if words[0] != 0:
                words, where = np.r_[0, words], where + 1
            asked = [s[at]]
            for net in self.others:
                other = Scorer(net)
                other.vocab.codes = [self.vocab.codes[k] for k in words]
                asked.append(other.windows(where.reshape(ids[at].shape)))
            s[at] = np.mean(asked, axis=0)
        return s

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text in each category; texts without words score 0. Equal texts are scored once.

        A window of ``MOVED`` or more also has to be borne out by a window half a step before or behind it.
        """
        if len(self.vocab.codes) > self.bound or len(self.known) > 2 * self.bound:
            self._forget()
            self.known.clear()
        place: dict[str | None, int] = {}
        at = [place.setdefault(t, len(place)) for t in texts]
        read, rows, from_, first = [], [], [], []
        for t in place:
            words = self.vocab.of(tokens(t, self.known))
            read.append(words)
            first.append(len(rows))
            from_ += starts(len(words))
            rows += [words[s : s + WINDOW] for s in starts(len(words))]
        best = np.zeros((len(place), len(CATEGORIES)), np.float32)
        if rows:
            s, n = self.agreed(padded(rows)), np.diff([*first, len(rows)])
            doc = np.repeat(np.arange(len(place)), n)
            cut = np.flatnonzero(s.max(1) >= MOVED)
            if len(cut):  # a sentence that a window cuts may read as a case: where the window is moved, it has to stay one
                moved = [read[doc[i]][max(0, k) : k + WINDOW] for by in (-STEP // 2, STEP // 2) for i in cut for k in [from_[i] + by]]
                s[cut] = (s[cut] + self.agreed(padded(moved)).reshape(2, len(cut), -1).max(0)) / 2
            best[n > 0] = np.maximum.reduceat(s, np.array(first)[n > 0], axis=0)
        return best[at]


def summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, columns): the sum of the rows for each place."""
    order = np.argsort(at, kind="stable")
    runs = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[at[order][runs]] = np.add.reduceat(rows[order], runs, axis=0)
    return out


def fit(net: Network, vocab: Vocabulary, ids: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, seed: int = 3, rate: float = 0.006, size: int = BATCH) -> Network:
    """Adam over mini-batches of windows; words are dropped at random so that no single one is relied on."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    number, step = vocab.of(["0"])[0], 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), size):
            pick = order[at : at + size]
            part = ids[pick]
            part = np.where((part > 0) & (rng.random(part.shape) < 0.06), number, part)
            distinct, where = np.unique(part, return_inverse=True)
            coded = [vocab.codes[k] for k in distinct]
            vec = net.vectors(coded)
            g, dx, _ = net.gradients(vec[where.reshape(part.shape)], part > 0, target[pick], weight[pick])
            dv = summed(where.reshape(-1), dx.reshape(-1, DIM), len(vec))
            n = np.array([len(x) for _, x in coded])
            g["W"] = summed(np.array([w for w, _ in coded]), dv, WORDS)
            g["G"] = summed(np.concatenate([x for _, x in coded]), np.repeat(dv / n[:, None], n, axis=0), GRAMS)
            step += 1
            for k in net.p:
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.002 * (g[k] * g[k] - v2[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.998**step)) + 1e-7)
    return net


def seed_windows(background: list[list[str]], seed: int, rounds: int) -> list[tuple[list[str], str]]:
    """(window, category or ``none``): the seed sentences, plain and disguised, set into windows of ordinary text."""
    rng, data = random.Random(seed), []
    filler = background or [[]]
    for _ in range(rounds):
        for kind, text in seeds.sentences(rng):
            t = seeds.disguise(text, rng) if kind != "none" and rng.random() < 0.35 else text.upper() if rng.random() < 0.1 else text
            words, b = tokens(t), rng.choice(filler)
            k = rng.randint(0, max(0, WINDOW - min(len(words), WINDOW)))
            s = rng.randint(0, max(0, min(len(words) // 3, len(words) - 5)))
            data.append(((b[len(b) - k :] + words + b)[s : s + WINDOW], kind))
    return data


#: A category, a window that shows it, and which categories it may show besides.
Shown = tuple[str, list[str], tuple[bool, ...]]


def train(ordinary: list[list[str]], cases: list[tuple[str, list[list[str]]]], seed: int = 5, passes: int = len(CREDIT), shown: list[Shown] | None = None) -> Network:
    """Fit on windows of labelled documents, starting from the seeds.

    ``ordinary`` are windows of documents judged ``none``; ``cases`` are (category, windows) of the others, of which at
    least one window is a case, it is not said which. The first pass learns the seeds against ordinary windows. In each
    pass after it the best window of a case document, by the network so far, is taught as a case of its category and of
    no other (unless the network insists, after the first such pass, that another holds too), if the network gives it
    some credit, more in each pass: wrong judgements exist. Ordinary windows are taught as none, all those that the network takes for cases and some others. In the last
    pass ordinary windows that still look like cases against all teaching count as wrongly judged and are left out.
    ``shown`` are windows known to be cases, which every pass teaches.
    """
    rng, vocab = np.random.default_rng(seed), Vocabulary()
    calm = padded([vocab.of(w) for w in ordinary])
    sets = [(CATEGORIES.index(c), padded([vocab.of(w) for w in wins])) for c, wins in cases if wins]
    bounds = np.cumsum([0, *[len(w) for _, w in sets]])
    every = np.concatenate([w for _, w in sets]) if sets else padded([])
    net, top = Network(seed), np.zeros(len(calm), np.float32)
    own = np.array([[c == x for x in CATEGORIES] for c, _, _ in shown or []], bool).reshape(-1, len(CATEGORIES))
    known = padded([vocab.of(w) for _, w, _ in shown or []]), own.astype(np.float32), np.where(own, 2.0, np.where(np.array([o for _, _, o in shown or []], bool).reshape(own.shape), 0.0, 1.5)).astype(np.float32)

    def lesson(ids: np.ndarray, y, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.broadcast_to(np.asarray(y, np.float32), (len(ids), len(CATEGORIES)))
        return ids, y, np.full(y.shape, w, np.float32)

    for k in range(passes + 1):
        made = seed_windows(ordinary, seed + k, 4 if k == 0 else 2)
        parts = [(padded([vocab.of(w) for w, _ in made]), np.array([[c == kind for c in CATEGORIES] for _, kind in made], np.float32), np.full((len(made), len(CATEGORIES)), 1.0, np.float32))]
        parts.append(known)
        judged = top < 0.9 if k == passes else np.ones(len(calm), bool)
        hard = np.flatnonzero(judged & (top > 0.05))
        easy = rng.permutation(np.flatnonzero(judged & (top <= 0.05)))[:EASY]
        parts += [lesson(calm[hard], 0.0, 1.5), lesson(calm[easy], 0.0, 0.7)]
        if k and sets:
            s, usual = scorer.windows(every), np.quantile(marks, RARE, axis=0) if len(marks) else np.zeros(len(CATEGORIES))
            best = np.array([bounds[i] + int(s[bounds[i] : bounds[i + 1], c].argmax()) for i, (c, _) in enumerate(sets)])
            y = np.zeros((len(sets), len(CATEGORIES)), np.float32)
            w = np.where((s[best] > BOTH) & (k > 1), 0.0, 1.5).astype(np.float32)
            for i, (c, _) in enumerate(sets):
                believed = s[best[i], c] > max(CREDIT[k - 1], usual[c])
                y[i, c], w[i, c] = 1, 2.0
                w[i] *= believed
            parts.append((every[best], y, w))
        ids, y, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        net = fit(net, vocab, ids, y, w, max(3 if k == 0 else 2, STEPS * BATCH // len(ids)), seed=seed + k, rate=0.006 if k == 0 else 0.004 / k)
        scorer = Scorer(net)
        scorer.vocab = vocab
        marks = scorer.windows(calm)
        top = marks.max(1) if len(calm) else top
    return net


def judgements(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(doc_id, category) of at most ``bound`` labelled documents: the category most reviewers gave, by severity on a tie.

    Null ids and categories are left out.
    """
    votes = labels.where(F.col("doc_id").isNotNull() & F.col("category").isNotNull()).groupBy("doc_id", F.lower(F.trim("category")).alias("category")).agg(F.count("*").alias("n"), F.max(F.coalesce("severity", F.lit(0))).alias("sev"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", "sev", "category")).alias("b")).select("doc_id", "b.category")
    return best.where(F.col("category").isin("none", *CATEGORIES)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def lessons(documents: DataFrame, labels: DataFrame, bound: int = WINDOWS) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(windows of documents judged ``none``, windows of the others): (doc_id, category, window), at most ``bound`` of each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, c, k, " ".join(w)) for d, c, t in zip(pdf["doc_id"], pdf["category"], pdf["text"], strict=True) for k, w in enumerate(windows(tokens(t)))]
            yield pd.DataFrame(rows, columns=["doc_id", "category", "k", "window"])

    judged = F.broadcast(judgements(labels))  # at most LABELLED rows
    docs = documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text").join(judged, "doc_id").select("doc_id", "category", "text")
    all_windows = materialize(docs.mapInPandas(cut, "doc_id long, category string, k int, window string"), "lessons")
    some = lambda which: all_windows.where(which).orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "window").limit(bound).drop("k").toPandas()
    return some("category = 'none'"), some("category <> 'none'")


def by_document(cases: pd.DataFrame) -> list[tuple[str, list[list[str]]]]:
    return [(c, [w.split(" ") for w in g]) for (_, c), g in cases.groupby(["doc_id", "category"])["window"]]


def _part(ids: pd.Series) -> np.ndarray:
    return np.array([zlib.crc32(str(d).encode()) % FOLDS for d in ids], int)


def enough(cases: pd.DataFrame) -> list[str]:
    """The categories with so many case documents that networks trained on some can judge the others."""
    docs = cases.drop_duplicates("doc_id").groupby("category")["doc_id"].count()
    return list(docs.index[docs >= ENOUGH])


def held_out(ordinary: pd.DataFrame, cases: pd.DataFrame, part: int) -> tuple[list[Shown], list[int]]:
    """What a network trained on the other parts of the documents says of one part.

    (the case windows of documents whose judgement it bears out, the places of ordinary windows that it takes for cases).
    Only categories that have enough documents are judged: of others one part may hold what no other shows.
    """
    asked = cases[(_part(cases["doc_id"]) == part) & cases["category"].isin(enough(cases))].reset_index(drop=True)
    here = _part(ordinary["doc_id"]) == part
    scorer = Scorer(train([w.split(" ") for w in ordinary["window"][~here]], by_document(cases[_part(cases["doc_id"]) != part])))
    score = lambda wins: scorer.windows(padded([scorer.vocab.of(w.split(" ")) for w in wins]))
    s, shown = score(asked["window"]), []
    for (_, c), rows in asked.groupby(["doc_id", "category"]).groups.items():
        rows, k = np.asarray(rows), CATEGORIES.index(c)
        best = s[rows, k].max()
        if best >= DOUBT:
            shown += [(c, asked["window"][i].split(" "), tuple(s[i] > 0.5)) for i in rows[s[rows, k] >= min(best, 0.5)]]
    places = np.flatnonzero(here)
    return shown, [int(i) for i in places[score(ordinary["window"][here]).max(1) > BOTH]]


_trained: dict[int, list[dict[str, np.ndarray]]] = {}


def networks(documents: DataFrame, labels: DataFrame) -> list[dict[str, np.ndarray]]:
    """The parameters of the networks of these documents and labels, trained side by side in tasks.

    The last ones are kept, so queries over one data set train once.
    """
    ordinary, cases = lessons(documents, labels)
    key = zlib.crc32("\n".join([*ordinary["window"], "#", *cases["category"], *cases["window"]]).encode())
    if key not in _trained:
        sc = documents.sparkSession.sparkContext
        shared = sc.broadcast((ordinary, cases))
        parts = sc.parallelize(range(FOLDS), FOLDS).map(lambda k: held_out(*shared.value, k)).collect() if enough(cases) else []
        shown, odd = [x for p, _ in parts for x in p], [i for _, p in parts for i in p]
        judged = {c for c, _, _ in shown}

        def fitted(seed: int) -> dict[str, np.ndarray]:
            calm, kept = shared.value
            return train([w.split(" ") for w in calm["window"].drop(calm.index[odd])], by_document(kept[~kept["category"].isin(judged)]), seed, shown=shown).p

        _trained.clear()
        _trained[key] = sc.parallelize(range(5, 5 + NETWORKS), NETWORKS).map(fitted).collect()
        shared.unpersist()
    return _trained[key]


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): the scores of every document, 0 to 1.

    Null and blank texts score 0; repeated documents each have a row; null ids stay. The networks (some 2 MB each,
    whatever the data) are broadcast; whole texts are read, in windows that overlap by half.
    """
    shared = documents.sparkSession.sparkContext.broadcast(networks(documents, labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, *others = [Network(params=p) for p in shared.value]
        scorer = Scorer(first, others=others)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                s = scorer.texts(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy()} | {c: s[:, k].astype(float) for k, c in enumerate(CATEGORIES)})

    docs = spread(documents.select("doc_id", "source", "text"))
    return docs.mapInPandas(run, "doc_id long, source string, abusive double, hateful double, sexual double")


def found(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(doc_id, category) of every score at or above its threshold."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) >= t).alias("hit")) for c, t in zip(CATEGORIES, thresholds, strict=True)]))
    return scored.select("doc_id", rows.alias("x")).where("x.hit").select("doc_id", "x.category").distinct()


def rates(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(source, documents, and the share of each category) per clean source name; null sources are ``?``."""
    scored = materialize(scored, "scores")
    source = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[-\s]+", "_"), F.lit("?"))
    return scored.groupBy(source.alias("source")).agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= t).cast("double")).alias(f"{c}_rate") for c, t in zip(CATEGORIES, thresholds, strict=True)])
