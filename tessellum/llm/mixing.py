"""Mixing sources to target weights (problem 7): capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.tokens import VOCABULARY, count_tokens
from tessellum.session import materialize, spread

#: Hash cells per source in which the last partial repetition is cut: the cell that the cut falls into is ordered, no other.
CELLS = 1 << 16
#: Most rows of the target table, which the plan of the mix is made from on the driver.
MAX_TARGETS = 100_000


def clean_source(source: Column) -> Column:
    """Source names without case and outer space; hyphens and spaces inside count as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[-\s]+", "_")


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document with a source; blank texts have the few tokens of their white space."""
    docs = spread(documents.select("doc_id", "source", "text"))
    return docs.select("doc_id", clean_source(F.col("source")).alias("source"), count_tokens(F.col("text"), vocabulary).alias("tokens"))


def water_fill(shares: dict[str, float], caps: dict[str, float], total: float) -> tuple[dict[str, float], set[str]]:
    """Tokens for each source, and the sources clamped at their cap.

    Sources whose part of the total exceeds their cap get the cap; what is left goes to the others in proportion to
    their shares, which may clamp more of them, until none exceeds. If all are clamped, the mix is smaller than ``total``.
    """
    clamped: set[str] = set()
    while True:
        free = {s: w for s, w in shares.items() if s not in clamped and w > 0}
        left, weight = total - sum(caps[s] for s in clamped), sum(free.values())
        if not free:
            return {s: caps[s] if s in clamped else 0.0 for s in shares}, clamped
        given = {s: left * w / weight for s, w in free.items()}
        over = {s for s, g in given.items() if g > caps[s]}
        if not over:
            return {s: caps[s] if s in clamped else given.get(s, 0.0) for s in shares}, clamped
        clamped |= over


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, aim, epochs, clamped): one row for each target source.

    ``total`` is the size of the mix in tokens, by default that of all documents. Target rows of one source add their
    shares and take the lowest cap; null shares and caps count as 0 and 1. Only the target table and one sum for each of
    its sources reach the driver, at most ``MAX_TARGETS`` rows.
    """
    t = targets.where(F.col("source").isNotNull()).select(clean_source(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m"))
    t = t.groupBy("source").agg(F.sum("w").alias("target_share"), F.min("m").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    rows = t.join(have, "source", "left").fillna(0, ["documents", "tokens"]).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    if total is None:
        total = sized.agg(F.sum("tokens")).first()[0] or 0
    caps = {r.source: float(r.tokens * max(r.max_repeats, 0)) for r in rows}
    aim, clamped = water_fill({r.source: r.target_share for r in rows}, caps, float(total))
    made = [(r.source, r.target_share, r.max_repeats, r.documents, r.tokens, aim[r.source], aim[r.source] / r.tokens if r.tokens else 0.0, r.source in clamped) for r in rows]
    return sized.sparkSession.createDataFrame(made, "source string, target_share double, max_repeats int, documents long, tokens long, aim double, epochs double, clamped boolean")


def sample(sized: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each document is used; those not used are left out.

    Each document is used the whole part of its source's epochs. The fractional part takes documents in the order of a
    seeded hash until its tokens are reached, and never where the cap is reached already. Sums per hash cell say which
    cell of a source that falls into; this cut, one row a source, is broadcast (at most ``MAX_TARGETS`` rows), so no
    document is shuffled but those of the cut cells, one in 65,536, and the shares are met to within one document.
    """
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tokens"), F.lit(seed))
    docs = sized.withColumn("h", h).withColumn("cell", F.pmod(F.shiftright("h", 40), F.lit(CELLS)))
    whole = F.least(F.floor(F.col("epochs") + 1e-9), F.col("max_repeats"))
    quota = planned.select("source", F.greatest(whole, F.lit(0)).alias("whole"), F.greatest((F.col("epochs") - whole) * F.col("tokens"), F.lit(0.0)).alias("want"), (whole < F.col("max_repeats")).alias("room"))
    cells = docs.groupBy("source", "cell").agg(F.sum("tokens").alias("t")).join(F.broadcast(quota), "source")
    upto = cells.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("cell")) - F.col("t"))  # at most CELLS rows a source
    cut = upto.where(F.col("before") + F.col("t") > F.col("want")).groupBy("source").agg(F.min(F.struct("cell", "before")).alias("cut"))
    bound = F.broadcast(quota.join(cut, "source", "left"))  # a source without cut is taken whole
    placed = docs.join(bound, "source").withColumn("side", F.when(~F.col("room") | (F.col("want") <= 0), "out").when(F.col("cut").isNull() | (F.col("cell") < F.col("cut.cell")), "in").when(F.col("cell") == F.col("cut.cell"), "cut").otherwise("out"))
    base = ["doc_id", "source", "tokens"]
    sure = placed.where("side <> 'cut'").select(*base, (F.col("whole") + (F.col("side") == "in").cast("int")).cast("int").alias("repeats"))
    w = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("side = 'cut'").withColumn("mid", F.col("cut.before") + F.sum("tokens").over(w) - F.col("tokens") / 2)
    edge = edge.select(*base, (F.col("whole") + (F.col("mid") <= F.col("want")).cast("int")).cast("int").alias("repeats"))
    return sure.unionByName(edge).where("repeats > 0")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mix, the report). Empty documents or targets give an empty mix; documents of other or null sources are not used.

    The report has a row for each target source with the share it reached: (source, target_share, max_repeats,
    documents, available_tokens, epochs, clamped, used_documents, used_tokens, actual_share).
    """
    sized = materialize(sizes(documents, vocabulary).where(F.col("source").isNotNull()), "sizes")
    planned = plan(sized, targets, total)
    mixed = sample(sized, planned, seed)
    used = mixed.groupBy("source").agg(F.sum("repeats").alias("used_documents"), F.sum(F.col("repeats") * F.col("tokens")).alias("used_tokens"))
    report = planned.join(used, "source", "left").fillna(0, ["used_documents", "used_tokens"])
    everything = F.sum("used_tokens").over(Window.partitionBy())  # one row per target source
    share = F.when(everything > 0, F.col("used_tokens") / everything).otherwise(0.0)
    return mixed, report.select("source", "target_share", "max_repeats", "documents", F.col("tokens").alias("available_tokens"), "epochs", "clamped", "used_documents", "used_tokens", share.alias("actual_share"))
