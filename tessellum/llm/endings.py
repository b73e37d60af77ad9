"""How texts end: evidence, taken from all texts of a source, of whether an ending is one that complete texts have."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.session import join_small, materialize, small_enough

#: What services and transports leave at the end of a text that they cut.
MARKERS = re.compile(
    r"(?:\[TRUNCATED DUE TO ERROR\]|�|(?:--|—|\[)\s*(?:connection (?:reset|closed|lost|aborted)|stream (?:closed|interrupted)|timed? ?out|truncated|cut off|max(?:imum)? tokens(?: reached)?)\.?\]?|\[\s*(?:…|\.\.\.)\s*\]|\S\s*…|[^\s.]\s*\.\.\.)\s*$",
    re.IGNORECASE,
)
_END = re.compile(r"[.!?。！？؟:;]?[.!?。！？؟][\"'”’»)\]}`*_]*\s*$")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
#: A last line that numbers an item and holds none, behind another item.
_BARE_ITEM = re.compile(r"^\s*\d{1,3}[.)][ \t]+\S.*\n\s*\d{1,3}[.)]?$", re.MULTILINE)
#: Fixed forms of answers that are complete without a sentence: a number, a date, a name in code marks, yes and no, a frequency.
SHORT = re.compile(
    r"(?:(?:about|around|roughly|approximately|at least|at most|up to|only|exactly|etwa|rund|environ|unos|unas)\s+)?[-+~≈]?\d[\d.,:/-]*\s*(?:%|[a-zµ]{1,12})?|`[^`\n]+`"
    r"|(?:yes|no|never|always|sometimes|often|rarely|once|twice|daily|hourly|weekly|both|neither|none|true|false|it depends|ja|nein|nie|niemals|immer|oui|non|jamais|toujours|sí|nunca|siempre)(?:,? (?:always|never|immer|nie|toujours|jamais|siempre|nunca))?",
    re.IGNORECASE,
)
#: What an ending can be. ``marker`` and ``open`` speak for a cut, ``terminal`` and ``known`` against it.
KINDS = ("none", "marker", "open", "terminal", "known", "unknown")


def _unbalanced(text: str) -> bool:
    stack: list[str] = []
    quoted = escaped = False
    for ch in text:
        if escaped:
            escaped = False
        elif ch == "\\":
            escaped = quoted
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "([{":
            stack.append(ch)
        elif not quoted and ch in _CLOSERS and stack and stack[-1] == _CLOSERS[ch]:
            stack.pop()
    return quoted or bool(stack)


def ending(text: str | None) -> str:
    """The kind of ending that a text shows by itself: ``none`` (no letter or digit), ``marker``, ``open`` (code fence, JSON, quote or code mark left open, a list's number without its item), ``terminal`` or ``unknown``."""
    s = (text or "").strip()
    if not re.search(r"\w", s):
        return "none"
    if MARKERS.search(s):
        return "marker"
    if s.count("```") % 2:
        return "open"
    body = re.sub(r"^\[[a-z-]+\]\s*", "", s)
    if body[:1] in "{[" and body[1:2] in '"{[ \n\t]}' and _unbalanced(body):
        return "open"
    if s[-1] in "0123456789.)" and _BARE_ITEM.search(s):
        return "open"
    if _END.search(s) or s.endswith("```"):
        return "terminal"
    if SHORT.fullmatch(s):
        return "known"
    last = s.rsplit("\n", 1)[-1]
    if last.count("`") % 2 or last.count("[") > last.count("]") or last.count("(") > last.count(")"):
        return "open"
    return "terminal" if body[:1] in "{[" and s[-1] in "}]" else "unknown"


def ending_kind(text: Column) -> Column:
    @F.pandas_udf("string")
    def kind(texts: pd.Series) -> pd.Series:
        return texts.map(ending)

    return kind(text)


def plain_line(line: Column) -> Column:
    """A line without case, numbering and numbers, to compare its shape with other lines."""
    s = F.regexp_replace(F.trim(F.lower(line)), r"^(\d+\s*[|.):]|[-*•>#]+)\s*", "")
    return F.regexp_replace(F.regexp_replace(s, r"\d+", "#"), r"\s+", " ")


#: A label and what separates it from the rest of its line, which is not empty.
_LABEL = r"^[\p{L}\p{M}_ ]{2,30}: +(?=\S)"
_TOKEN = r"[\p{L}\p{M}_]+|#|[^\s\p{L}\p{M}_#]"


#: What counts as often must be so many times, and this share of the source's texts (of its unknown endings for ``UNKNOWN``):
#: in a large table any cut comes a few times by chance.
LINE, SHAPE, SHORT_TEXT, UNKNOWN = 0.0001, 0.0005, 0.0005, 0.02


def _feature(kind: str, gram: Column, at_end: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), gram.alias("gram"), (F.lit(0) if at_end is None else at_end).alias("at_end"))


def _ngrams(tokens: Column, n: int, mark: Column) -> Column:
    """The n-grams of a line's tokens, with ``mark`` where they end the line, else 0."""
    runs = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: _feature(f"g{n}", F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(n)]), F.when(i == F.size(tokens) - n, mark).otherwise(F.lit(0))))
    return F.when(F.size(tokens) >= n, runs)


def _shape(line: Column) -> Column:
    return F.regexp_replace(line, r"[\p{L}\p{M}_]+", "a")


def with_ending(values: DataFrame, key: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """``values`` plus ``ending``: as ``ending_kind``, with ``known`` for an unknown ending that complete texts of the source have.

    Known is an ending
    * whose last line stands as a whole line inside other texts of the source (3 times or more), ends 0.3 % of its texts,
      or is the whole of a short text that recurs and that few other texts begin with;
    * whose last line has the shape of lines inside other texts and ends in a word that the source uses (5 times or more);
    * whose last line is one of many that go on in the same shape behind the same label (``See also: ...``);
    * whose last two or three tokens end lines in a fifth or more of their places in the source, not counting the unknown
      endings themselves, or half of them and many of the unknown endings: cuts must not vouch for each other.
    In the last three cases the last word must stand elsewhere too: a stub that only cuts leave is no word. Every count also
    needs a share of the source's texts (``LINE`` and following), so that repeated or many more rows change no judgement.
    What the unknown endings, which are few, ask for is counted over all texts by one aggregation and joined back; where
    it is proven small the rows counted are those asked for, else all are counted, in part before the shuffle, so no key
    is one task's work. Blank and null texts are ``none``. ``key`` names columns that identify a row. The result is
    written once to the shared folder, and each text is judged once.
    """
    ended = materialize(values.withColumn("ending", ending_kind(F.col(text))), "endings")
    v = ended.select(*key, F.col(source).alias("src"), "ending", F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", ""), "\n"), plain_line).alias("lines"))
    unknown = v.where("ending = 'unknown'").withColumn("last", F.element_at("lines", -1)).withColumn("t", F.regexp_extract_all("last", F.lit(_TOKEN), 0)).withColumn("single", F.size("lines") == 1)
    tail = lambda n: F.when(F.size("t") >= n, F.concat_ws(" ", F.slice("t", -n, n)))
    label = F.when(F.col("last").rlike(_LABEL), F.concat(F.regexp_extract("last", _LABEL, 0), _shape(F.regexp_replace("last", _LABEL, ""))))
    asks = [_feature(f"g{n}", tail(n)) for n in (1, 2, 3)] + [_feature("line", F.col("last")), _feature("shape", _shape(F.col("last"))), _feature("start", F.when(F.col("single") & (F.size("t") <= 4), F.concat_ws(" ", "t"))), _feature("final", F.col("last")), _feature("stub", tail(1)), _feature("label", label)]
    asked = unknown.select(*key, "src", "single", F.explode(F.filter(F.array(*asks), lambda x: x["gram"].isNotNull())).alias("x"))
    asked = materialize(asked.select(*key, "src", "single", "x.kind", "x.gram"), "asked")
    per_line = v.select("src", "ending", F.size("lines").alias("n"), F.posexplode("lines").alias("p", "l")).withColumn("t", F.regexp_extract_all("l", F.lit(_TOKEN), 0))
    inner = F.when(F.col("p") < F.col("n") - 1, F.array(_feature("line", F.col("l")), _feature("shape", _shape(F.col("l")))))
    starts = F.when(F.col("n") == 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: _feature("start", F.concat_ws(" ", F.slice("t", 1, k))))))
    none = F.array().cast("array<struct<kind:string,gram:string,at_end:int>>")
    mark = F.when((F.col("p") == F.col("n") - 1) & (F.col("ending") == "unknown"), 2).otherwise(1)  # 2: an ending in question
    features = F.concat(*[F.coalesce(x, none) for x in (*[_ngrams(F.col("t"), n, mark) for n in (1, 2, 3)], inner, starts)])
    rows = per_line.select("src", F.explode(features).alias("x")).select("src", "x.kind", "x.gram", "x.at_end")
    on = ["src", "kind", "gram"]
    wanted = asked.where(~F.col("kind").isin("final", "stub", "label")).select(*on).distinct()
    counted = lambda df: df.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.col("at_end") > 0).alias("ends"), F.count_if(F.col("at_end") == 1).alias("sure"))
    seen = counted(rows.join(F.broadcast(wanted), on, "left_semi")) if small_enough(wanted) else counted(rows).join(wanted, on, "left_semi")
    ends = asked.where(F.col("kind").isin("final", "stub", "label")).groupBy(*on).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("ends"), F.lit(0).cast("long").alias("sure"))
    facts = join_small(asked, materialize(seen.unionByName(ends), "seen"), on).groupBy(*key).agg(
        F.first("src").alias("src"), F.first("single").alias("single"),
        *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("g1", "g2", "g3", "line", "shape", "start", "final", "stub", "label")],
        *[F.coalesce(F.max(F.when(F.col("kind") == f"g{n}", F.col(c))), F.lit(0)).alias(f"{c[0]}{n}") for n in (2, 3) for c in ("ends", "sure")],
    )
    facts = join_small(facts, v.groupBy("src").agg(F.count("*").alias("texts"), F.count_if(F.col("ending") == "unknown").alias("unknowns")), "src")
    c = F.col
    often = lambda share, of="texts": F.greatest(F.lit(3), share * c(of))
    ratio = lambda n: ((c(f"g{n}") >= 5) & (c(f"s{n}") >= 0.2 * c(f"g{n}"))) | ((c(f"e{n}") >= often(UNKNOWN, "unknowns")) & (c(f"e{n}") >= 0.5 * c(f"g{n}")))
    line = ~c("single") & (c("final") >= often(0.003))
    short = (c("start") > 0) & (c("final") >= often(SHORT_TEXT)) & (c("final") >= 0.5 * c("start"))
    shaped = ~c("single") & (c("shape") >= often(SHAPE)) & (c("g1") >= 5)
    labelled = ~c("single") & (c("label") >= often(UNKNOWN, "unknowns"))
    whole = c("g1") - c("stub") >= F.greatest(F.lit(3), 0.5 * c("stub"))
    known = facts.where((c("line") >= often(LINE)) | short | whole & (line | shaped | labelled | ratio(2) | ratio(3))).select(*key, F.lit(True).alias("is_known"))
    return join_small(ended, materialize(known, "known"), key, "left").withColumn("ending", F.when(F.col("is_known"), "known").otherwise(F.col("ending"))).drop("is_known")
