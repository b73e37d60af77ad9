"""Noise in text from scanned pages (problem 4): one joint decoding of the de-lined text, and paragraphs by dynamic programming.

Lexicon and running heads are counted over all texts with ordinary Spark aggregations. Each text is then decoded by
itself: heads and page numbers are set aside, the rest becomes one stream of tokens, and a Viterbi search chooses how to
read it - tokens as they stand, with character confusions undone, joined over a hyphen or a stray space, or split where
a space was lost. All that a text may be read as shares a key with a string of the text, so a lexicon of any size is
joined to the texts by key, and each text is handed its own words; where the lexicon is proven small it is broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.session import materialize, salted_join, small_enough, spread

#: A word counts as one if it stands so often in all texts; a line is no head if it is longer than so many characters.
LEAST_COUNT, HEAD_CHARS = 3, 80
#: What scanners read (left) for what was printed (right).
CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("vv", "w"), ("c", "e"), ("f", "t"), ("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("ı", "i"), ("l", "i"), ("i", "l"), ("1", "i"), ("i", "1"),
    ("|", "l"), ("|", "i"), ("|", "1"), ("!", "l"), ("!", "i"), ("5", "s"), ("s", "5"), ("9", "g"), ("g", "9"), ("q", "9"), ("6", "b"), ("b", "6"), ("8", "b"), ("b", "8"), ("z", "2"), ("2", "z"), ("á", "a"), ("à", "a"), ("é", "e"), ("è", "e"), ("ó", "o"), ("ö", "o"), ("í", "i"), ("ï", "i"), ("ú", "u"), ("ü", "u"), ("ñ", "n"), ("ç", "c"),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("e", "c"), ("h", "b"), ("b", "h"), ("tl", "d"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("u", "v"), ("y", "v"), ("v", "y"), ("$", "s"), ("€", "e"), ("@", "a"), ("(", "c"), ("<", "c"),
)
LIGATURES = frozenset("ﬁﬂﬀﬃﬄﬅﬆ")
_HYPHENS = "-‐‑­¬"
_SURE = "­¬"
_MULTI = (("rn", "m"), ("nn", "m"), ("in", "m"), ("ni", "m"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("tl", "d"), ("vv", "w"))
_SINGLE = str.maketrans({"c": "e", "f": "t", "0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "ı": "l", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "8": "b", "h": "b", "2": "z", "u": "v", "y": "v", "€": "e", "@": "a", "(": "e", "<": "e"})
_STROKES = str.maketrans({ch: "l" for ch in "1i|!ırnmuvywhb68"} | {ch: "c" for ch in "etf(<€"} | {"d": "cl", "0": "o", "5": "s", "$": "s", "9": "g", "q": "g", "2": "z", "@": "a"})
_RUN = re.compile("l+")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_BY_RIGHT: dict[str, list[tuple[str, str]]] = {}
for _w, _r in CONFUSIONS:
    _BY_RIGHT.setdefault(_r[0], []).append((_w, _r))

WORD = r"[\p{L}\p{M}\p{N}|]+(?:[-'_][\p{L}\p{M}\p{N}|]+)*"
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"^([^\w|]*)(.*?)([^\w|]*)$", re.DOTALL)


def canon(word: str) -> str:
    """A key that a word shares with its misreadings: every confusable string becomes one representative."""
    w = unicodedata.normalize("NFKD", word.lower())
    w = "".join(ch for ch in w if not unicodedata.combining(ch))
    for a, b in _MULTI:
        w = w.replace(a, b)
    return w.translate(_SINGLE)


def closed_key(word: str) -> str:
    """A key that no confusion of ``CONFUSIONS`` changes, wherever it stands in the word and however many there are.

    Letters are taken as strokes: all that mix with a run of upright strokes (``m``, ``ni``, ``li``, ``h``, ``u`` ...) are
    one mark a run, and ``d`` is ``c`` and a stroke. Words of one key need not be misreadings of each other.
    """
    w = unicodedata.normalize("NFKD", word.lower())
    return _RUN.sub("l", "".join(ch for ch in w if not unicodedata.combining(ch)).translate(_STROKES))


def confused(right: str, wrong: str, limit: int = 3) -> list[int] | None:
    """Places in ``wrong`` where confusions of ``CONFUSIONS`` turn ``right`` into it, at most ``limit``; None if they can't."""
    ways: dict[tuple[int, int], list[int]] = {(0, 0): []}
    for i in range(len(right)):
        for j in sorted(j for (k, j) in ways if k == i):
            places = ways.pop((i, j))
            steps = [(1, 1, places)] if wrong[j : j + 1] == right[i] else []
            if len(places) < limit:
                steps += [(len(r), len(w), [*places, j]) for w, r in _BY_RIGHT.get(right[i], ()) if wrong.startswith(w, j) and right.startswith(r, i)]
            for di, dj, new in steps:
                have = ways.get((i + di, j + dj))
                if have is None or len(new) < len(have):
                    ways[i + di, j + dj] = new
    return ways.get((len(right), len(wrong))) or None


@dataclass
class Lexicon:
    """Word counts, and words by closed key, the most frequent first; readings are kept per worker."""

    counts: dict[str, int]
    heads: frozenset[str] = frozenset()
    total: int = 0
    keys: dict[str, list[str]] = field(default_factory=dict)
    cache: dict[str, tuple[str, list[int]] | None] = field(default_factory=dict)

    def __post_init__(self):
        self.total = max(1, self.total or sum(self.counts.values()))
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            self.keys.setdefault(closed_key(w), []).append(w)

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return -math.log(n / self.total) if n else math.log(self.total) + 4 + 0.6 * len(word)

    def reading(self, word: str) -> tuple[str, list[int]] | None:
        """(what was printed, places of the confusions) where another word explains this one far better; else None."""
        if word in self.cache:
            return self.cache[word]
        own = self.counts.get(word, 0)
        found = None
        for other in () if word.isdigit() else self.keys.get(closed_key(word), ()):
            n = self.counts[other]
            if n < max(5, 8 * own):
                break
            if other.isdigit() and len(word) > 1 and _ROMAN.fullmatch(word):
                continue
            if other != word and (places := confused(other, word)) is not None:
                found = (other, places)
                break
        if found is None and re.search(r"\d", word) and re.fullmatch(r"[\dlio|sbz]+", word) and not word.isdigit():
            digits = "".join({"l": "1", "i": "1", "|": "1", "o": "0", "s": "5", "b": "8", "z": "2"}.get(ch, ch) for ch in word)
            found = (digits, [k for k, ch in enumerate(word) if not ch.isdigit()])
        if found is None and any(ch in LIGATURES for ch in word):
            found = (unicodedata.normalize("NFKC", word), [k for k, ch in enumerate(word) if ch in LIGATURES])
        if len(self.cache) < 500_000:
            self.cache[word] = found
        return found


_NUM = r"(?:[\dlIO|oSB]*\d[\dlIO|oSB]*|[ivxlcdm]{1,10}|[IVXLCDM]{1,10}|[lIO|]{1,4})"
_PAGE_NO = re.compile(rf"^[\s\x0c]*(?:[-–—~·•*|=\[(<]+\s*)?(?:(?:p|P)(?:age|ag\.|a9e|agc|\.)?|Seite|S\.|pág\.|página|Pagina)?\s*{_NUM}\s*(?:(?:of|/|von|de|sur|di|0f|oI)\s*{_NUM})?\s*(?:[-–—~·•*|=\])>]+)?\s*$")


def page_number(line: str) -> bool:
    """Whether a line is nothing but a page number, in digits or Roman, with or without ``Page``, ``of`` and ornaments."""
    s = line.strip(" \t\r\x0c")
    return bool(s) and len(s) <= 24 and bool(_PAGE_NO.match(s)) and not re.fullmatch(r"[lIO|]+|[A-Za-z]", s)


def head_key(line: str) -> str | None:
    """The canonical key of a line that could be a running head or foot; None for prose, tables and fences.

    The key leaves out numbers, so heads that carry the page number share it.
    """
    s = line.strip(" \t\r\x0c")
    letters = re.sub(r"[\d\W_]+", "", s)
    if len(letters) < 4 or len(s) > HEAD_CHARS or s[-1] in ".,;:!?-¬­" or not re.match(r"[\W\d]*[A-ZÀ-ÞlI5|0]", s) or re.match(r"^\s*(?:[-*•]\s|```|\d+[.)]\s)", s):
        return None
    return canon(re.sub(r"[^\w|]+", " ", re.sub(r"(?<![\w|])[\dlIO|oSB]*\d[\dlIO|oSB]*(?![\w|])", " ", s)).strip()) or None


def layout(lines: list[str], lex: Lexicon) -> list[str]:
    """Of each line: ``page_number``, ``header``, ``blank`` or ``body``."""
    kinds = ["blank" if not x.strip(" \t\r\x0c") else "page_number" if page_number(x) else "body" for x in lines]
    keys = [head_key(x) if k == "body" else None for x, k in zip(lines, kinds, strict=True)]
    seen = Counter(k for k in keys if k)
    body = [i for i, k in enumerate(kinds) if k == "body"]
    for i, key in enumerate(keys):
        if key is None:
            continue
        if seen[key] >= 2:
            kinds[i] = "header"
        elif key in lex.heads:
            edge = not body or i in (body[0], body[-1]) or "\x0c" in lines[i] or any(0 <= j < len(lines) and kinds[j] in ("page_number", "header") or "\x0c" in lines[j] for j in (i - 1, i + 1) if 0 <= j < len(lines))
            gap = next((j for j in range(i - 1, -1, -1) if kinds[j] != "blank"), None)
            if edge or gap is None or kinds[gap] in ("page_number", "header"):
                kinds[i] = "header"
    return kinds


@dataclass
class Decoded:
    noise: set[tuple[int, str]]
    words: list[tuple[int, str]]  # (line, text as read)
    kinds: list[str]


def decode(text: str, lex: Lexicon) -> Decoded:
    """Read one text: the noise of its lines, and its words with the line each begins in.

    The search runs over the tokens of the body lines as one stream. From each token it may keep it, undo confusions,
    join it with the next (over a hyphen at a line's end, which then stays or goes; or over a stray space, if neither is
    a word), or split it in two words. A path's cost is the sum of its words' costs in the lexicon.
    """
    lines = text.split("\n")
    kinds = layout(lines, lex)
    noise = {(i, k) for i, k in enumerate(kinds) if k in ("header", "page_number")}
    toks: list[tuple[int, str, bool]] = []
    for i, line in enumerate(lines):
        if kinds[i] == "body":
            row = _TOKEN.findall(line.replace("\x0c", " "))
            toks += [(i, t, k == len(row) - 1) for k, t in enumerate(row)]
    n = len(toks)
    best = [math.inf] * (n + 1)
    back: list[tuple[int, list[tuple[int, str]], set[tuple[int, str]]] | None] = [None] * (n + 1)
    best[0] = 0.0

    def offer(i: int, j: int, cost: float, read: list[tuple[int, str]], marks: set[tuple[int, str]]) -> None:
        if best[i] + cost < best[j]:
            best[j], back[j] = best[i] + cost, (i, read, marks)

    for i in range(n):
        line, tok, last = toks[i]
        pre, core, post = _CORE.match(tok).groups()
        low = core.lower()
        word = lex.reading(low) if core else None
        if not core:
            offer(i, i + 1, 0.5, [(line, tok)], set())
        elif word is None:
            parts = [p for p in re.split(r"[-_'/.,:]", low) if p] if low not in lex.counts else [low]
            reads = [lex.reading(p) for p in parts]
            if len(parts) > 1 and any(reads):
                fixed = core
                for p, r in zip(parts, reads, strict=True):
                    if r:
                        fixed = re.sub(re.escape(p), lambda m, r=r: _case(m.group(), r[0]), fixed, count=1, flags=re.IGNORECASE)
                offer(i, i + 1, sum(lex.cost(r[0] if r else p) for p, r in zip(parts, reads, strict=True)) + 6, [(line, pre + fixed + post)], {(line, "misread")})
            cost = lex.cost(low) if len(parts) < 2 else sum(map(lex.cost, parts))
            offer(i, i + 1, cost, [(line, tok)], set())
            if low not in lex.counts and low.isalnum() and not low.isdigit() and len(low) >= 6:
                for k in range(3, len(low) - 2):  # a lost space, with a misread half at most
                    halves = [(low[:k], core[:k]), (low[k:], core[k:])]
                    seen = [lex.counts.get(x, 0) >= 50 for x, _ in halves]
                    if not any(seen):
                        continue
                    reads = [None if ok else lex.reading(x) for ok, (x, _) in zip(seen, halves, strict=True)]
                    if all(ok or r and lex.counts.get(r[0], 0) >= 50 for ok, r in zip(seen, reads, strict=True)):
                        shown = [_case(c, r[0]) if r else c for (_, c), r in zip(halves, reads, strict=True)]
                        cost = sum(lex.cost(r[0] if r else x) for (x, _), r in zip(halves, reads, strict=True)) + 8 + 5 * sum(r is not None for r in reads)
                        offer(i, i + 1, cost, [(line, pre + shown[0]), (line, shown[1] + post)], {(line, "misread")} if any(reads) else set())
        else:
            offer(i, i + 1, lex.cost(word[0]) + 5, [(line, pre + _case(core, word[0]) + post)], {(line, "misread")})
            offer(i, i + 1, lex.cost(low) + 12, [(line, tok)], set())
        if i + 1 == n:
            continue
        line2, tok2, _ = toks[i + 1]
        divided = last and len(tok) > 1 and tok[-1] in _HYPHENS and tok[-2] not in _HYPHENS
        if divided:
            head = tok[:-1]
            pre1, core1, _ = _CORE.match(head).groups()
            _, core2, post2 = _CORE.match(tok2).groups()
            if core1 and core2 and tok2[0] not in _HYPHENS:
                joined = (core1 + core2).lower()
                hit = lex.reading(joined)
                cost, marks, shown = lex.cost(joined), {(line, "hyphen")}, core1 + core2
                if hit:
                    cost, shown = lex.cost(hit[0]) + 5, _case(core1 + core2, hit[0])
                    marks |= {(line if p < len(core1) else line2, "misread") for p in hit[1]}
                read = [(line, pre1 + shown + post2)]
                offer(i, i + 2, 0.0 if tok[-1] in _SURE else cost, read, marks)
                if tok[-1] not in _SURE:
                    compound = f"{core1}-{core2}".lower()
                    r1, r2 = lex.reading(core1.lower()), lex.reading(core2.lower())
                    kept = {(ln, "misread") for ln, r in ((line, r1), (line2, r2)) if r}
                    w1, w2 = r1[0] if r1 else core1.lower(), r2[0] if r2 else core2.lower()
                    known = lex.counts.get(compound) or lex.counts.get(f"{w1}-{w2}")
                    both = -math.log(known / lex.total) if known else lex.cost(w1) + lex.cost(w2) + 6
                    offer(i, i + 2, both + 5 * len(kept), [(line, f"{pre1}{_case(core1, w1)}-{_case(core2, w2)}{post2}")], kept)
        elif core and not post and low.isalpha() and low not in lex.counts and line == line2:
            _, core2, post2 = _CORE.match(tok2).groups()
            joined = (core + core2).lower()
            if core2.isalpha() and core2.lower() not in lex.counts:  # a stray space, and perhaps a misread word
                if lex.counts.get(joined, 0) >= 5:
                    offer(i, i + 2, lex.cost(joined) + 4, [(line, pre + core + core2 + post2)], set())
                elif (hit := lex.reading(joined)) and hit[0] in lex.counts:
                    offer(i, i + 2, lex.cost(hit[0]) + 9, [(line, pre + _case(core + core2, hit[0]) + post2)], {(line, "misread")})
    path: list[list[tuple[int, str]]] = []
    j = n
    while j:
        i, read, marks = back[j]
        path.append(read)
        noise |= marks
        j = i
    words = [w for read in reversed(path) for w in read]
    return Decoded(noise, words, kinds)


def _case(shown: str, word: str) -> str:
    """``word`` in the case of what was shown."""
    return word.upper() if shown.isupper() and len(shown) > 1 else word.capitalize() if shown[:1].isupper() else word


def paragraphs(text: str, d: Decoded) -> list[str]:
    """The continuous paragraphs of a decoded text.

    Boundaries between body lines are chosen by dynamic programming: a boundary gains from a blank line, an indent, a
    line ended early and a finished sentence, and loses where a sentence runs on; a paragraph of one unfinished short
    line costs, so the choice at one boundary depends on the last one.
    """
    lines = text.split("\n")
    rows = [i for i, k in enumerate(d.kinds) if k == "body"]
    if not rows:
        return []
    said: dict[int, list[str]] = {}
    for ln, w in d.words:
        said.setdefault(ln, []).append(w)
    width = sorted(len(lines[i].rstrip()) for i in rows)[int(len(rows) * 0.9)]
    indents = [len(lines[i]) - len(lines[i].lstrip(" \t")) for i in rows]
    usual = Counter(indents).most_common(1)[0][0]

    def gain(k: int) -> float:
        a, b = rows[k - 1], rows[k]
        words_a, words_b = said.get(a, []), said.get(b, [])
        done = bool(words_a) and words_a[-1].rstrip("\"')]”»")[-1:] in (".", "!", "?", ":")
        g = (1.6 if any(d.kinds[j] == "blank" for j in range(a + 1, b)) else 0.0) + (1.5 if indents[k] >= usual + 2 else 0.0)
        g += (1.0 if len(lines[a].rstrip()) < 0.75 * width else -0.3) + (0.8 if done else -2.5)
        g += -2.0 if words_b and words_b[0][:1].islower() else -0.8
        return g - (1.0 if any(d.kinds[j] in ("header", "page_number") for j in range(a + 1, b)) else 0.0)

    score, prev = [0.0] * (len(rows) + 1), [0] * (len(rows) + 1)
    gains = [0.0] + [gain(k) for k in range(1, len(rows))]
    far = -1  # the best begin of a paragraph of two lines or more; what it gained does not depend on where it ends
    for e in range(1, len(rows) + 1):
        last = said.get(rows[e - 1], [])
        open_end = not (last and last[-1].rstrip("\"')]”»")[-1:] in (".", "!", "?", ":"))
        s = e - 1
        near = score[s] - (1.0 if open_end else 0.0)
        if far >= 0 and score[far] > near:
            s, near = far, score[far]
        score[e], prev[e] = near + (gains[e] if e < len(rows) else 0.0), s
        if far < 0 or score[e - 1] >= score[far]:
            far = e - 1
    bounds, e = [], len(rows)
    while e:
        bounds.append((prev[e], e))
        e = prev[e]
    out = [" ".join(w for r in rows[s:e] for w in said.get(r, [])) for s, e in reversed(bounds)]
    return [p for p in out if p]


def scanned_texts(results: DataFrame, events: DataFrame) -> DataFrame:
    """(record_id, text) of extraction results and of the sources of evaluation events; repeated rows of one id once.

    Null and blank texts, null ids and null sources give no record. Of rows with one id the smallest is taken, by a
    partial aggregation.
    """
    a = results.where(F.col("id").isNotNull() & F.col("content").isNotNull()).groupBy(F.col("id").alias("record_id")).agg(F.min("content").alias("text"))
    e = spread(events.where(F.col("id").isNotNull()).select("id", F.transform("retrieved_sources", lambda s: s["text"]).alias("texts"))).groupBy("id").agg(F.min("texts").alias("texts"))
    s = e.select("id", F.posexplode("texts").alias("pos", "text")).where(F.col("text").isNotNull()).select(F.concat("id", F.lit(":"), F.col("pos")).alias("record_id"), "text")
    return a.unionByName(s).where(F.length(F.trim("text")) > 0)


def keys_of(text: str) -> set[str]:
    """The keys of all strings that ``decode`` may look up for a text: tokens, their parts, halves and joins."""
    lines = text.split("\n")
    rows = [[_CORE.match(t).group(2).lower() for t in _TOKEN.findall(x.replace("\x0c", " "))] for x in lines]
    strings: set[str] = set()
    for i, row in enumerate(rows):
        after = []
        for j in range(i + 1, len(rows)):  # what a word divided at the line's end may go on with: lines between may be set aside
            after += rows[j][:1]
            if rows[j] and not page_number(lines[j]) and head_key(lines[j]) is None:
                break
        for k, core in enumerate(row):
            strings |= {core, *re.split(r"[-_'/.,:]", core)}
            for x in row[k + 1 : k + 2] if k + 1 < len(row) else after:
                strings |= {core + x, f"{core}-{x}"}
            if core.isalnum():
                strings |= {x for c in range(3, len(core) - 2) for x in (core[:c], core[c:])}
    return {closed_key(x) for x in strings if x}


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n) of every word seen ``LEAST_COUNT`` times or more; words divided at a line's end are left out."""
    whole = F.regexp_replace("text", rf"\S+[{_HYPHENS}][ \t\r]*\n\s*\S+", " ")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(whole), F.lit(WORD), 0)).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def running_heads(texts: DataFrame) -> DataFrame:
    """(head) keys of lines that recur within two texts or more."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: Counter = Counter()
            for t in pdf["text"]:
                seen = Counter(k for k in map(head_key, t.split("\n")) if k)
                out.update(k for k, n in seen.items() if n >= 2)
            yield pd.DataFrame({"head": list(out), "n": list(out.values())}).astype({"head": "object", "n": "int64"})

    return texts.select("text").mapInPandas(heads, "head string, n long").groupBy("head").agg(F.sum("n").alias("n")).where("n >= 2").select("head")


_lexicons: dict[int, Lexicon] = {}


def _shared(broadcast) -> Lexicon:
    """The lexicon of a broadcast, indexed once per worker process."""
    key = id(broadcast.value)
    if key not in _lexicons:
        _lexicons.clear()
        _lexicons[key] = Lexicon(*broadcast.value)
    return _lexicons[key]


def own_words(texts: DataFrame, counts: DataFrame, heads: DataFrame) -> DataFrame:
    """``texts`` plus ``words`` (w, n) and ``heads``: of the lexicon and the heads what a text's own keys ask for.

    A join by key with split hot keys; what a text is handed is bounded by its own length.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, t in zip(pdf["record_id"], pdf["text"], strict=True):
                found = [(r, k, False) for k in keys_of(t)] + [(r, k, True) for k in {head_key(x) for x in t.split("\n")} if k]
                yield pd.DataFrame(found, columns=["record_id", "key", "is_head"])

    @F.pandas_udf("string")
    def keyed(words: pd.Series) -> pd.Series:
        return words.map(closed_key)

    table = counts.select(keyed("w").alias("key"), F.lit(False).alias("is_head"), "w", "n").unionByName(heads.select(F.col("head").alias("key"), F.lit(True).alias("is_head"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("long").alias("n")))
    asked = texts.mapInPandas(ask, "record_id string, key string, is_head boolean")
    mine = salted_join(asked, table, ["key", "is_head"]).groupBy("record_id").agg(
        F.collect_list(F.when(~F.col("is_head"), F.struct("w", "n"))).alias("words"), F.collect_list(F.when(F.col("is_head"), F.col("key"))).alias("heads")
    )
    return texts.join(mine, "record_id", "left")


def clean(results: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(noise, paragraphs): (record_id, line_no, noise) and (record_id, paragraph, text) of every scanned text.

    Every line of every text is decoded, with all words of the lexicon. Empty tables give empty results; columns other
    than those named are ignored.
    """
    texts = materialize(scanned_texts(results, events), "scans")
    many = spread(texts)
    counts, heads = materialize(word_counts(many), "words"), materialize(running_heads(many), "heads")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if small_enough(counts) and small_enough(heads):
        shared = results.sparkSession.sparkContext.broadcast(({r.w: r.n for r in counts.collect()}, frozenset(r.head for r in heads.collect()), total))
        lexicons = lambda pdf: (_shared(shared) for _ in range(len(pdf)))
    else:
        many = own_words(many, counts, heads)
        pairs = lambda x: () if x is None else x
        lexicons = lambda pdf: (Lexicon({w["w"]: w["n"] for w in pairs(ws)}, frozenset(pairs(hs)), total) for ws, hs in zip(pdf["words"], pdf["heads"], strict=True))

    def noise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, i, k) for r, t, lx in zip(pdf["record_id"], pdf["text"], lexicons(pdf), strict=True) for i, k in sorted(decode(t, lx).noise)]
            yield pd.DataFrame(rows, columns=["record_id", "line_no", "noise"])

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, k, p) for r, t, lx in zip(pdf["record_id"], pdf["text"], lexicons(pdf), strict=True) for k, p in enumerate(paragraphs(t, decode(t, lx)))]
            yield pd.DataFrame(rows, columns=["record_id", "paragraph", "text"])

    return many.mapInPandas(noise, "record_id string, line_no int, noise string"), many.mapInPandas(repair, "record_id string, paragraph int, text string")
