"""Evaluation texts leaking into training text (problem 6): pigeonhole edit matching over words.

A passage is a run of ``window`` words of an item's question or answer, and it leaks into a document if some stretch of
the document is within ``budget`` word edits of it. Cut into ``budget + 1`` pieces, at least one piece of such a passage
stands unchanged in the document (pigeonhole), so:

1. every run of ``window // (budget + 1)`` words of the items is a possible piece; it is hashed into a small table;
2. the documents' runs of the same length are hashed inside Spark and joined to it (exact piece hits);
3. each hit carries only the stretch of the document around it, and Myers' bit-parallel distance, with words as the
   alphabet, verifies every window of the item that holds the piece;
4. an exact check follows: a near miss whose edited words are the distinctive ones (names, numbers, settings) is another
   text on the same pattern, and a stretch that fits one item better is no case of another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.session import join_small, materialize, spread

#: Tags, entities and JSON escapes are layout, not text.
_MARKUP = r"<[^<>\n]{1,200}>|&[a-z]{2,8};|&#\d{1,6};|\\[nrt]"


def words(text: Column) -> Column:
    """array<string>: the lower-case words of a text without markup, punctuation and layout. Null gives an empty array.

    A word is a run of letters, digits and underscores inside of a run; a divided word at a line's end is joined only by
    its hyphen's removal where a lower-case letter follows a soft hyphen, so ``re-signs`` is two words in any layout.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _MARKUP, " ")
    bare = F.regexp_replace(bare, r"\x{00AD}\s*|[\x{200B}-\x{200D}\x{FEFF}]", "")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}\p{M}]+(?:_+[\p{L}\p{N}\p{M}]+)*"), 0)


def grams(column: str, n: int) -> Column:
    """array<bigint>: the hash of every run of n words; shorter texts give an empty array."""
    w = F.col(column)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.xxhash64(F.get(w, i + j)) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


@dataclass(frozen=True)
class Leak:
    """Parameters: words of a passage, word edits allowed in it, share of its weight that the edits may hold, edits that
    need no such test, and whether both ends of a passage with several edits must stand in the document."""

    window: int = 12
    budget: int = 3
    lost: float = 0.30
    sure: int = 0
    anchored: bool = True

    @property
    def piece(self) -> int:
        return self.window // (self.budget + 1)

    def allowed(self, m):
        """Edits allowed in a passage of ``m`` words (number, array or Column): the budget, in proportion for shorter ones."""
        return m * self.budget // self.window if not isinstance(m, Column) else F.floor(m * self.budget / self.window)

    def piece_of(self, m: int) -> int:
        """Words of a piece of a text of ``m`` words: as many as leave one piece more than the edits allowed."""
        return self.piece if m >= self.window else m // (self.allowed(m) + 1)


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, field, words, weights): the texts of the items; a word's weight falls with the number of texts that hold it."""
    both = items.select("item_id", F.explode(F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("t")), F.struct(F.lit("answer").alias("field"), F.col("expected_answer").alias("t")))).alias("x"))
    texts = both.select("item_id", "x.field", words(F.col("x.t")).alias("words")).where(F.size("words") > 0).distinct()
    total = texts.count()
    df = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    placed = texts.select("item_id", "field", F.posexplode("words").alias("p", "word")).join(df, "word")
    weight = F.log(F.lit(total + 1.0) / F.col("df"))
    return placed.groupBy("item_id", "field").agg(F.sort_array(F.collect_list(F.struct("p", "word", weight.alias("weight")))).alias("x")).select(
        "item_id", "field", F.col("x.word").alias("words"), F.col("x.weight").alias("weights")
    )


def myers(pattern: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern row within its text row (Myers' bit-parallel recurrence), and where that match ends.

    ``pattern`` (n, m) and ``text`` (n, t) hold word codes, -1 pads the text; rows run side by side in 64-bit words, so
    m is at most 63. ``lengths`` are the pattern lengths.
    """
    n, m = pattern.shape
    one = np.uint64(1)
    bits = one << np.arange(m, dtype=np.uint64)
    last = one << (lengths - 1).astype(np.uint64)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = lengths.astype(np.int64).copy()
    best, end = score.copy(), np.zeros(n, np.int64)
    for j in range(text.shape[1]):
        eq = ((pattern == text[:, j : j + 1]) * bits).sum(1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph & last) != 0).astype(np.int64) - ((mh & last) != 0).astype(np.int64)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        better = (score < best) & (text[:, j] >= 0)
        best, end = np.where(better, score, best), np.where(better, j + 1, end)
    return best, end


def _lost(pattern: list[str], weights: list[float], text: list[str]) -> float:
    """Share of the pattern's weight that its best alignment in the text does not match (heaviest common subsequence)."""
    row = np.zeros(len(text) + 1)
    for w, g in zip(pattern, weights, strict=True):
        new = row.copy()
        for j, x in enumerate(text, 1):
            new[j] = max(new[j - 1], row[j], row[j - 1] + g if w == x else 0.0)
        row = new
    total = float(sum(weights))
    return 1 - row[-1] / total if total else 0.0


def verify(batches: Iterator[pd.DataFrame], rule: Leak) -> Iterator[pd.DataFrame]:
    """Piece hits -> (doc_id, item_id, at, edits, lost): windows of the item that the stretch holds within the budget.

    A window is cut into whole pieces from its first word on, so a hit concerns only the windows in which it is one of
    these pieces. A text shorter than a window is one window, and any hit concerns it.
    """
    for pdf in batches:
        if pdf.empty:
            continue
        codes: dict[str, int] = {}
        known: dict[tuple, list[int]] = {}
        hits = list(zip(pdf["doc_id"].tolist(), pdf["item_id"].tolist(), pdf["field"].tolist(), pdf["words"].tolist(), pdf["weights"].tolist(), pdf["item_pos"].tolist(), pdf["start"].tolist(), pdf["stretch"].tolist(), strict=True))
        rows: list[tuple[int, int, int]] = []
        pats, texts = [], []
        for i, (_, item, fld, iw, _, p, _, st) in enumerate(hits):
            coded = known.get((item, fld))
            if coded is None:
                coded = known[item, fld] = [codes.setdefault(w, len(codes)) for w in iw]
            m = min(rule.window, len(coded))
            if m == rule.window:
                starts = [s for s in range(p, p - m + rule.piece - 1, -rule.piece) if 0 <= s <= len(coded) - m]
            else:
                starts = [0]
            if starts:
                text = [codes.setdefault(w, len(codes)) for w in st]
                for s in starts:
                    rows.append((i, s, m))
                    pats.append(coded[s : s + m])
                    texts.append(text)
        if not rows:
            continue
        lengths = np.array([m for _, _, m in rows])
        pattern = np.full((len(pats), rule.window), -2, np.int64)
        text = np.full((len(texts), max(map(len, texts))), -1, np.int64)
        for k, (x, y) in enumerate(zip(pats, texts, strict=True)):
            pattern[k, : len(x)] = x
            text[k, : len(y)] = y
        edits, ends = myers(pattern, text, lengths)
        allowed = rule.allowed(lengths)
        out = set()
        for k in np.flatnonzero(edits <= allowed):
            i, s, m = rows[k]
            doc, item, _, iw, weights, _, start, st = hits[i]
            end, n = int(ends[k]), int(edits[k])
            lost = 0.0
            if n > rule.sure:
                pat, seen = list(iw[s : s + m]), list(st[max(0, end - m - rule.budget) : end])
                if rule.anchored and n > 1 and (seen[-1] != pat[-1] or pat[0] not in seen[: 2 * rule.budget + 1]):
                    continue  # a shorter passage whose edits are what follows or precedes it
                lost = _lost(pat, list(weights[s : s + m]), seen)
            if lost <= rule.lost:
                out.add((doc, item, start + end - m, n, lost))
        yield pd.DataFrame(list(out), columns=["doc_id", "item_id", "at", "edits", "lost"])


def runs_of(documents: DataFrame, k: int, reach: int, step: int = 64) -> DataFrame:
    """(doc_id, origin, w, i, gram): every run of ``k`` words of every document, with the words around it.

    A text is laid out in overlapping sections of ``step`` words and ``reach`` more on either side, so a row carries some
    hundred words however long its text is; each run is the ``i``-th of just one section, which begins at word ``origin``.
    """
    docs = spread(documents.select("doc_id", "text")).select("doc_id", words(F.col("text")).alias("all")).where(F.size("all") >= k)
    base = F.sequence(F.lit(0), F.size("all") - k, F.lit(step))
    section = F.transform(base, lambda b: F.struct(b.alias("base"), F.greatest(b - reach, F.lit(0)).alias("origin"), F.slice("all", F.greatest(b - reach, F.lit(0)) + 1, F.least(b, F.lit(reach)) + step + k - 1 + reach).alias("w")))
    parts = docs.select("doc_id", F.explode(section).alias("s")).select("doc_id", "s.origin", "s.w", (F.col("s.base") - F.col("s.origin")).alias("first"))
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    parts = parts.withColumn("h", hashes)
    own = F.sequence(F.col("first"), F.least(F.col("first") + step - 1, F.size("w") - k))
    runs = parts.select("doc_id", "origin", "w", F.explode(F.transform(own, lambda i: F.struct(i.alias("i"), F.xxhash64(*[F.get("h", i + j) for j in range(k)]).alias("gram")))).alias("r"))
    return runs.select("doc_id", "origin", "w", F.col("r.i").alias("i"), F.col("r.gram").alias("gram"))


def find(documents: DataFrame, items: DataFrame, rule: Leak = Leak()) -> DataFrame:
    """(doc_id, item_id, at, edits, lost): the best place at which each document holds each item.

    Every document and every word of it is searched. Null and blank texts, items without texts and empty tables give no
    rows; repeated documents each give theirs; items with fewer words than a window are matched whole with a budget in
    proportion, from pieces short enough that one is always left whole. Documents are never shuffled: only piece hits
    are, and these are few. The piece table (item, place and hash) is broadcast if it is proven small and joined by
    shuffle with split keys otherwise; the items' words are joined to the hits alone.
    """
    texts = materialize(item_texts(items), "items")
    reach = rule.window + rule.budget
    length = F.least(F.size("words"), F.lit(rule.window))
    sizes = {rule.piece_of(m) for m in sorted(r.m for r in texts.select(length.alias("m")).distinct().collect())}  # at most ``window`` lengths
    hits = None
    for k in sorted(sizes):
        mine = texts.where(length.isin([m for m in range(1, rule.window + 1) if rule.piece_of(m) == k]))
        pieces = mine.select("item_id", "field", F.posexplode(grams("words", k)).alias("item_pos", "gram"))
        found = join_small(runs_of(documents, k, reach), pieces, "gram").withColumn("k", F.lit(k))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, at long, edits int, lost double")
    hits = join_small(hits, texts, ["item_id", "field"])
    start = F.greatest(F.col("i") - reach, F.lit(0))
    hits = hits.select("doc_id", "item_id", "field", "words", "weights", "item_pos", (F.col("origin") + start).alias("start"), F.slice("w", start + 1, F.col("i") - start + reach + F.col("k")).alias("stretch"))
    schema = "doc_id long, item_id long, at long, edits int, lost double"
    passages = hits.mapInPandas(lambda it: verify(it, rule), schema)
    # partial aggregation: one row for each document, item and place before the shuffle
    places = passages.groupBy("doc_id", "item_id", "at").agg(F.min(F.struct("edits", "lost")).alias("fit"))
    return settle(places, rule)


def settle(places: DataFrame, rule: Leak) -> DataFrame:
    """One row per document and item, without places that another item fits better.

    Places of different items within half a window of each other compete; a place that needed edits yields to one that
    needed fewer. Only the few verified places of one document meet in a window, never documents.
    """
    bucket = places.withColumn("cell", F.explode(F.array(F.floor(F.col("at") / rule.window), F.floor(F.col("at") / rule.window) + 1)))
    w = Window.partitionBy("doc_id", "cell")
    kept = bucket.withColumn("best", F.min("fit").over(w)).where((F.col("fit.edits") <= rule.sure) | (F.col("fit.lost") <= F.col("best.lost") + 0.12) | (F.col("fit.edits") <= F.col("best.edits")))
    out = kept.groupBy("doc_id", "item_id").agg(F.min(F.struct("fit", "at")).alias("x"))
    return out.select("doc_id", "item_id", F.col("x.at").alias("at"), F.col("x.fit.edits").alias("edits"), F.col("x.fit.lost").alias("lost"))
