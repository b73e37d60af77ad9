"""Chunkers: DataFrame (doc_id, text, ...) -> (doc_id, chunk_index, text, offset, offset_unit, start_time).

Fixed windows are plain expressions. Packing restarts where the chunk before it says, so it runs row by row in
``mapInPandas``: one document at a time, documents spread over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id {}, chunk_index int, text string, offset long, offset_unit string, start_time double"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = frozenset("e.g i.e vs etc fig dr mr mrs prof st no vol dept approx inc ltd jr sr".split())
Count = Callable[[str], int]


def estimate(text: str) -> int:
    """Tokens as a quarter of the bytes, 1 at least."""
    return max(1, len(text.encode()) // 4)


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters that overlap; a step of 0 or less becomes ``size``. Null and empty texts have none."""
    step = size - overlap if overlap < size else size
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    x = docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substring(F.col("text"), o + 1, F.lit(size)).alias("text")))).alias("chunk_index", "c"))
    return x.select("doc_id", "chunk_index", F.col("c.text").alias("text"), F.col("c.offset").cast("long").alias("offset"), F.lit("char").alias("offset_unit"), F.lit(None).cast("double").alias("start_time"))


def fixed_segments(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """``fixed_chunks`` of segments (doc_id, texts array<string>, start): their trimmed, non-empty texts joined by spaces.

    Every chunk has the start of its document's first segment.
    """
    kept = F.filter(F.transform("texts", lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    joined = docs.select("doc_id", F.array_join(kept, " ").alias("text"), F.col("start").alias("start_time"))
    return fixed_chunks(joined.select("doc_id", "text"), size, overlap).drop("start_time").join(joined.select("doc_id", "start_time"), "doc_id", "left")


def pack(sizes: list[int], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of units that fit into ``limit``, a separator between two counted as 1.

    A unit over the limit is a run by itself. After a run, the next begins early enough to repeat ``overlap`` or more,
    in whole units, but never at the run's own first unit.
    """
    first = 0
    while first < len(sizes):
        end, total = first + 1, sizes[first]
        if total <= limit:
            while end < len(sizes) and sizes[end] <= limit and total + 1 + sizes[end] <= limit:
                total += 1 + sizes[end]
                end += 1
        yield first, end
        start = end
        if sizes[first] <= limit and end < len(sizes):
            repeated = 0
            while start - 1 > first and repeated < overlap:
                start -= 1
                repeated += sizes[start]
        first = start


def slices(text: str, limit: int, count: Count) -> list[str]:
    """A text over the limit in parts that each fit, cut between words where it can be."""
    out, cur = [], ""
    for piece in re.findall(r"\S+\s*", text):
        while count(piece) > limit:
            cut = max(1, len(piece) * limit // count(piece))
            out, cur, piece = [*out, *([cur.strip()] if cur.strip() else []), piece[:cut]], "", piece[cut:]
        if cur and count(cur + piece) > limit:
            out.append(cur.strip())
            cur = ""
        cur += piece
    return [*out, cur.strip()] if cur.strip() else out


def sentences(text: str) -> list[str]:
    """Sentences of prose; a full stop after a list number or an abbreviation ends none."""
    out, start = [], 0
    for m in re.finditer(r"[.!?](?=\s|$)", text):
        word = re.search(r"(\S*)$", text[start : m.start()]).group(1).lower()
        if m.group() == "." and (word.isdigit() or word in ABBREVIATIONS):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def semantic(text: str, limit: int, overlap: int, count: Count) -> list[tuple[str, int]]:
    """(chunk, byte offset of its first word) of sentence packing over all paragraphs; the search for offsets never goes back."""
    units = [s for p in text.split("\n\n") for s in re.split(r"(?<=[.!?])\s+", p.strip()) if s]
    out: list[tuple[str, int]] = []
    at = 0
    for a, b in pack([count(u) for u in units], limit, overlap):
        for chunk in [" ".join(units[a:b])] if count(units[a]) <= limit else slices(units[a], limit, count):
            found = text.find(chunk.split()[0], at)
            at = found if found >= 0 else at
            out.append((chunk, len(text[:at].encode())))
    return out


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of markdown: header, code (closed or not), table, prose (lines joined by spaces)."""
    out: list[tuple[str, str]] = []
    kind, lines, fence = "", [], ""

    def flush() -> None:
        nonlocal kind, lines
        if any(x.strip() for x in lines):
            out.append((kind, " ".join(x.strip() for x in lines) if kind == "prose" else "\n".join(lines)))
        kind, lines = "", []

    for line in text.splitlines():
        s = line.strip()
        if fence:
            lines.append(line)
            if s.startswith(fence):
                fence = ""
                flush()
        elif s.startswith(("```", "~~~")):
            flush()
            kind, lines, fence = "code", [line], s[:3]
        elif re.match(r"#{1,6} ", s):
            flush()
            out.append(("header", s))
        elif not s:
            flush()
        else:
            new = "table" if s.startswith("|") else "prose"
            if kind != new:
                flush()
                kind = new
            lines.append(line)
    flush()
    return out


def markdown(text: str, limit: int, count: Count) -> list[str]:
    """Chunks of markdown: no chunk crosses a header, and each begins with the trail of headers above it.

    Code and tables stay whole unless they exceed the limit; long prose falls into sentences. Sections of headers alone
    give nothing.
    """
    trail: list[tuple[int, str]] = []
    sections: list[tuple[str, list[str]]] = [("", [])]
    for kind, body in blocks(text):
        if kind == "header":
            level = len(body) - len(body.lstrip("#"))
            trail = [*(t for t in trail if t[0] < level), (level, body)]
            sections.append((" > ".join(h for _, h in trail), []))
        else:
            parts = [body] if count(body) <= limit else sentences(body) if kind == "prose" else slices(body, limit, count)
            sections[-1][1].extend(p for x in parts for p in ([x] if count(x) <= limit else slices(x, limit, count)))
    out = []
    for head, units in sections:
        cur, size, filled = head, count(head) if head else 0, False
        for u in units:
            n = count(u)
            if filled and size + 1 + n > limit:
                out.append(cur)
                cur, size = head, count(head) if head else 0
            cur, size, filled = (f"{cur}\n{u}" if cur else u), size + n + (1 if cur else 0), True
        if filled:
            out.append(cur)
    return out


def segments(parts: list[tuple[str, float]], limit: int, overlap: int, count: Count) -> list[tuple[str, int, float]]:
    """(chunk, index of its first segment, its start) of transcript segments (text, start); a long segment stays whole."""
    parts = [(t.strip(), s) for t, s in parts if t and t.strip()]
    return [(" ".join(t for t, _ in parts[a:b]), a, parts[a][1]) for a, b in pack([count(t) for t, _ in parts], limit, overlap)]


def packed_chunks(docs: DataFrame, limit: int = 512, overlap: int = 50, count: Count = estimate) -> DataFrame:
    """Chunks of every document by its content type: Pdf as markdown, Audio and Video as lines ``[mm:ss] text``, others by sentences.

    ``docs`` (doc_id, text, content_type). Null and blank texts have no chunks; an unknown content type counts as Text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text, kind in zip(pdf["doc_id"], pdf["text"], pdf["content_type"], strict=True):
                if not text or not text.strip():
                    continue
                if kind == "Pdf":
                    rows += [(d, i, c, None, None, None) for i, c in enumerate(markdown(text, limit, count))]
                elif kind in ("Audio", "Video"):
                    marks = re.split(r"(?m)^\[(\d+):(\d\d)\]\s*", text)
                    parts = [(marks[0], 0.0)] + [(marks[k + 2], 60.0 * int(marks[k]) + int(marks[k + 1])) for k in range(1, len(marks) - 2, 3)]
                    rows += [(d, i, c, o, "segment", s) for i, (c, o, s) in enumerate(segments(parts, limit, overlap, count))]
                else:
                    rows += [(d, i, c, o, "byte", None) for i, (c, o) in enumerate(semantic(text, limit, overlap, count))]
            out = pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "offset", "offset_unit", "start_time"])
            yield out.astype({"offset": "Int64", "start_time": "Float64"})

    return docs.select("doc_id", "text", "content_type").mapInPandas(run, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
