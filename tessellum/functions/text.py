"""Text expressions: Column -> Column. What the JVM cannot do runs as a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that sparse vectors leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought "
    "in on at to for of with by from as into through during before after above below and or but if then that this it its not no nor so yet both either neither"
).split()
#: MIME types of the content types.
MIME = {"application/pdf": "Pdf", "text/plain": "Text"}
ANSWER_TEMPLATE = "Use only the context below.\n\nContext:\n{context}"


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; null stays null."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return f(text)


def sanitize(text: Column, normalise: bool = True) -> Column:
    """Extracted text: compatibility forms composed, words divided at line ends joined, lines trimmed, inner white space
    collapsed, blank lines to one."""
    t = nfkc(text) if normalise else text
    t = F.regexp_replace(t, r"(\w)-[ \t]*\r?\n[ \t]*(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[ \t\x{00A0}]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n\n"), r"^\n+|\n+$", ""))


def terms(text: Column) -> Column:
    """Lower-case words of more than one byte that are no stop words, with repeats."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as bigint."""
    h = F.hex(F.encode(text, "UTF-8"))
    steps = F.sequence(F.lit(0), F.octet_length(text) - 1)
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    folded = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.when(F.octet_length(text) > 0, folded).otherwise(F.lit(2166136261).cast("long"))


def token_estimate(text: Column) -> Column:
    """Tokens of a text, estimated as a quarter of its bytes; null has 0."""
    return F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def content_type(mime: Column) -> Column:
    """Content type of a MIME type, null where there is none."""
    return F.when(mime == "application/pdf", "Pdf").when(mime.startswith("audio/"), "Audio").when(mime.startswith("video/"), "Video").when(mime == "text/plain", "Text")


def mime_of(kind: Column) -> Column:
    """A MIME type of a content type."""
    return F.when(kind == "Pdf", "application/pdf").when(kind == "Audio", "audio/mpeg").when(kind == "Video", "video/mp4").when(kind == "Text", "text/plain")


def strip_extension(filename: Column) -> Column:
    """The name before its last dot, unless that is its first character."""
    return F.regexp_replace(filename, r"^(.+)\.[^.]*$", "$1")


def contextual(text: Column, title: Column, page: Column, start_time: Column) -> Column:
    """What is embedded for a chunk: title, place and text; the text alone without a title."""
    place = F.coalesce(F.when(start_time.isNotNull(), F.format_string("%.1fs", start_time.cast("double"))), page.cast("string"), F.lit("N/A"))
    return F.when(title.isNull(), text).otherwise(F.concat(F.lit("Title: "), title, F.lit("\nPage: "), place, F.lit("\nContent: "), text))


def timestamped_url(url: Column, start_time: Column) -> Column:
    """The URL with the start in whole seconds, if both are there."""
    sec = F.round(start_time.cast("double")).cast("long")
    return F.when(start_time.isNull(), url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("t="), sec.cast("string"), F.lit("s")))


def parse_score(reply: Column) -> Column:
    """The first number from 0 to 1 in a judge's reply, full stops at a word's end aside; null where there is none."""
    words = F.transform(F.split(F.trim(reply), r"\s+"), lambda w: F.regexp_replace(w, r"\.+$", ""))
    numbers = F.transform(F.filter(words, lambda w: w.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), lambda w: w.cast("double"))
    return F.get(F.filter(numbers, lambda x: (x >= 0) & (x <= 1)), 0)


def critic_score(reply: Column) -> Column:
    """The last ``SCORE:`` of a critic's reply, kept within 0 and 1; 1.0 where there is none."""
    found = F.regexp_extract_all(reply, F.lit(r"(?m)^\s*SCORE:\s*([+-]?[\d.]+)"), 1)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_element_at(found, F.lit(-1)).try_cast("double"))), F.lit(1.0))


def critic_issues(reply: Column) -> Column:
    """The comma list of the last ``ISSUES:`` line; ``none`` and no line give an empty list."""
    last = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(?m)^\s*ISSUES:[ \t]*(.*)$"), 1), F.lit(-1))
    items = F.filter(F.transform(F.split(F.coalesce(last, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(F.coalesce(last, F.lit("none")))) == "none", F.array().cast("array<string>")).otherwise(items)


def truncate_utf8(text: Column, limit: int, mark: str = "") -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters; ``mark`` follows where something was cut."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x if len(b := x.encode()) <= limit else b[:limit].decode("utf-8", "ignore") + mark)

    return f(text)


def redact(prompt: Column, keep: int = 100) -> Column:
    """A prompt for the log: ``[EMPTY]``, cut to ``keep`` bytes, and the first value after each kind of secret hidden."""
    t = F.trim(F.coalesce(prompt, F.lit("")))
    cut = F.when(F.octet_length(t) > keep, F.concat(truncate_utf8(t, keep), F.lit("... ("), F.length(t).cast("string"), F.lit(" chars total)"))).otherwise(t)
    for word in ("Bearer ", "api_key=", "password=", "secret=", "token="):
        cut = F.regexp_replace(cut, rf"^((?s:.*?){word})[^\s&\"']+", "$1[REDACTED]")
    return F.when(t == "", "[EMPTY]").otherwise(cut)


def correct_terms(text: Column, corrections: dict[str, str]) -> Column:
    """Replace misheard terms in one pass, in any case, between characters that are no ASCII letters.

    Where terms overlap the one that starts first is replaced, of those the longest; what was replaced is not read again.
    """
    if not corrections:
        return text
    right = {k.lower(): v for k, v in corrections.items()}
    any_term = rf"(?i)(?<![A-Za-z])(?:{'|'.join(map(_quote, sorted(right, key=lambda k: (-len(k), k))))})(?![A-Za-z])"
    table = F.create_map(*[F.lit(x) for kv in right.items() for x in kv])
    between, found = F.split(text, any_term, -1), F.regexp_extract_all(text, F.lit(any_term), 0)
    return F.array_join(F.zip_with(between, found, lambda t, w: F.concat(t, F.coalesce(F.element_at(table, F.lower(w)), F.lit("")))), "")


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in s)


def fill_template(context: Column, template: str = ANSWER_TEMPLATE) -> Column:
    """The system prompt with its context."""
    return F.replace(F.lit(template), F.lit("{context}"), context)


def stream_words(answer: Column) -> Column:
    """An answer in pieces that end after each space; joined they are the answer."""
    return F.split(answer, "(?<= )")


def sse_text(body: Column) -> Column:
    """The text of a stream of server-sent events, up to ``[DONE]``."""
    data = F.regexp_extract_all(F.split_part(body, F.lit("data: [DONE]"), F.lit(1)), F.lit(r"(?m)^data: (.*)$"), 1)
    return F.array_join(F.transform(data, lambda d: F.get_json_object(d, "$.choices[0].delta.content")), "")


def tool_failed(content: Column) -> Column:
    """Whether a tool's answer is an error or a timeout."""
    return F.coalesce(content.startswith("[tool_error]") | content.startswith("[tool_timeout]"), F.lit(False))


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID."""
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lit(False))


def sentences(text: Column) -> Column:
    """Trimmed sentences: boundaries after ``. ! ?`` before white space; blank ones go."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])(?=\s)"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Trimmed paragraphs between blank lines; blank ones go."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def tf_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term counts of two texts, 0.0 where either has no terms."""
    x, y = terms(a), terms(b)
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w)).cast("double")
    squares = lambda words: F.aggregate(F.array_distinct(words), F.lit(0.0), lambda acc, w: acc + count(words, w) * count(words, w))
    dot = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda acc, w: acc + count(x, w) * count(y, w))
    norm = F.sqrt(squares(x) * squares(y))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def share_of_terms(part: Column, whole: Column) -> Column:
    """Share of the distinct terms of one text that another has; 0.0 where there are none."""
    mine = F.array_distinct(terms(part))
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, terms(whole))) / F.size(mine)).otherwise(0.0)


def numbered_sources(sources: Column, title: Column) -> Column:
    """A retrieval reply: a numbered line for each source (text, page, score) with its title, place, score and at most 800 bytes."""
    place = lambda s: F.concat(F.lit("Page "), F.coalesce(s["page"].cast("string"), F.lit("?")))
    label = lambda s: F.when(title.isNull(), place(s)).otherwise(F.concat(title, F.lit(" - "), place(s)))
    short = lambda t: F.when(F.octet_length(t) <= 800, t).otherwise(F.decode(F.substring(F.encode(t, "UTF-8"), F.lit(1), _boundary(t, 800)), "UTF-8"))
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". ["), label(s), F.lit(", score: "), F.format_string("%.2f", s["score"].cast("double")), F.lit("]: "), short(F.coalesce(s["text"], F.lit(""))))
    n = F.coalesce(F.size(sources), F.lit(0))
    return F.when(n <= 0, "No relevant documents found in the knowledge base.").otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(" relevant sources:\n"), F.array_join(F.transform(sources, line), "\n")))


def _boundary(text: Column, limit: int) -> Column:
    """Bytes of the longest prefix within the limit that ends between characters: a byte of the form 10xxxxxx goes on with one."""
    byte = lambda k: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(k + 1), F.lit(1))), 16, 10).cast("int")
    inside = lambda k: (byte(k) >= 128) & (byte(k) < 192)
    return F.when(~inside(limit), limit).when(~inside(limit - 1), limit - 1).when(~inside(limit - 2), limit - 2).otherwise(limit - 3)
