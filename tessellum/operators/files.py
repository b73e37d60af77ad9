"""Searching and reading text by lines: (path, text) tables stand for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that open a definition, per language, and words that may stand before them. A definition is an opening word and
#: a name; ``impl`` blocks are named by their type.
OPENERS = {
    "rust": (("pub", "async"), ("fn", "struct", "enum", "trait", "type")),
    "python": (("async",), ("def",)),
    "script": (("export", "async"), ("function",)),
    "go": ((), ("func",)),
}
#: Languages in which a name and its parameters make a definition by themselves: words that may stand before them, and
#: what the definition's line must and must not be.
SHAPES = {
    "javascript": (("async",), "body"),
    "typescript": (("public", "private", "protected", "static", "async"), "call"),
    "java": (("public", "private", "protected", "static", "final", "abstract", "synchronized"), "typed"),
    "c": ((), "typed, not closed"),
}
#: Languages of a file extension, one with opening words and one with shapes at most. Other extensions have no definitions.
EXTENSIONS = {
    "rs": ("rust",), "py": ("python",), "go": ("go",), "js": ("script", "javascript"), "mjs": ("script", "javascript"), "cjs": ("script", "javascript"),
    "ts": ("script", "typescript"), "tsx": ("script", "typescript"), "java": ("java",), "kt": ("java",), "c": ("c",), "cpp": ("c",), "cc": ("c",), "h": ("c",), "hpp": ("c",),
}
_PARAMETERS = r"\s*\("


def _without(line: Column, words: tuple[str, ...]) -> Column:
    """A line without the words that may stand before a definition; a word may carry a scope in brackets."""
    return F.regexp_replace(line, rf"^(?:(?:{'|'.join(words)})\b(?:\([^)]*\))?\s*)+", "") if words else line


def _opened(line: Column, language: str) -> Column:
    """Whether a line opens a definition with a word of the language."""
    before, openers = OPENERS[language]
    head = _without(line, before)
    words = F.split(F.regexp_replace(head, r"\W+", " "), " ")
    hit = F.get(words, F.lit(0)).isin(*openers) & head.rlike(r"^\w+\s+\w")
    if language == "rust":
        hit = hit | F.startswith(line, F.lit("impl")) & F.regexp_replace(line, r"^impl\s*<[^>]*>", "impl").rlike(r"^impl\s+\w")
    if language == "go":  # a function's name, or a receiver and a method's name
        hit = hit & head.rlike(rf"\w{_PARAMETERS}") | head.rlike(rf"^func\s*\([^)]*\)\s*\w+{_PARAMETERS}")
    if language == "script":  # a function bound to a name
        hit = hit | _without(line, ("export",)).rlike(r"^(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(")
    return hit


def _shaped(line: Column, language: str, indented: Column) -> Column:
    """Whether a line names something with parameters, in the way that the language writes definitions."""
    before, kind = SHAPES[language]
    head = _without(line, before)
    called = F.regexp_extract(head, r"^([^(]*)\(", 1)  # all before the parameters
    name, typed_name = called.rlike(r"^\w+\s*$"), called.rlike(r"^\w+\s+\w+\s*$")
    if kind == "body":  # the parameters are followed by the body
        return name & head.rlike(r"^[^(]*\([^)]*\)\s*\{")
    if kind == "call":  # inside of a class, or with a word that says so
        return name & ((head != line) | indented)
    if kind == "typed":  # a type and a name; a constructor has its type's name only
        return typed_name | name & (head != line)
    open_end = ~F.contains(F.regexp_extract(head, r"^[^(]*\((.*)$", 1), F.lit(";"))  # a closed line is a call or a prototype
    return called.rlike(r"^\w[\w\s*&:<>]*\s[\s*&]*\w+\s*$") & open_end


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line), lines numbered from 1; null texts have none."""
    return files.where(F.col("text").isNotNull()).select("path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def read_range(files: DataFrame, first: int, last: int) -> DataFrame:
    """(path, line_no, line) of lines ``first`` to ``last``, both included."""
    return lines(files).where(F.col("line_no").between(first, last))


def grep(files: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """(path, line_no, line, hit): matching lines and ``context`` lines around each; overlapping ranges come once.

    Lines stay in their file's row until they match: only files with a match are laid out, and nothing is shuffled.
    """
    arr = F.split("text", "\n")
    hits = F.filter(F.transform(arr, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())
    f = files.where(F.col("text").rlike(pattern)).select("path", arr.alias("a"), hits.alias("h")).where(F.size("h") > 0)
    want = F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda i: F.sequence(F.greatest(i - context, F.lit(0)), F.least(i + context, F.size("a") - 1))))))
    x = f.select("path", F.explode(F.transform(want, lambda i: F.struct((i + 1).alias("line_no"), F.get("a", i).alias("line"), F.array_contains("h", i).alias("hit")))).alias("x"))
    return x.select("path", "x.*")


def signatures(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of definitions, by the path's extension; comments, blank lines and unknown extensions have none."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    code = lines(files.where(ext.isin(*EXTENSIONS))).withColumn("ext", ext).withColumn("bare", F.regexp_replace("line", r"^\s+|\s+$", ""))
    code = code.where(~F.col("bare").rlike(r"^(//|#|\*|/\*)|^$"))
    hit = F.lit(False)
    for language in [*OPENERS, *SHAPES]:
        mine = F.col("ext").isin(*[e for e, ls in EXTENSIONS.items() if language in ls])
        hit = hit | mine & (_opened(F.col("bare"), language) if language in OPENERS else _shaped(F.col("bare"), language, F.col("line").rlike(r"^\s")))
    return code.where(hit).select("path", "line_no", F.regexp_replace("line", r"\s+$", "").alias("line"))


def listing(files: DataFrame, n: int) -> DataFrame:
    """The first n paths by name (a limit is what a listing is)."""
    return files.select("path").distinct().orderBy("path").limit(n)


