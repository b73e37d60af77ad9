"""Text cut off by field limits or broken transfers (problem 5).

For each source (a tool for previews, a model for answers) a right-censored log-normal length distribution is fitted by
maximum likelihood. Lengths at which far more values lie than the distribution has room for are candidate limits, and
each value's censoring posterior at its length is combined with the evidence of how it ends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.endings import KINDS, with_ending
from tessellum.session import join_small, materialize, spread

#: What the fit of endings starts from, in pseudo-counts: how cut values end. The values found to be cut outweigh it.
CUT_PRIOR = {"marker": 2.0, "open": 3.0, "unknown": 10.0}
#: Assumed, since no text says it: the shares of cut values that end like complete ones by chance (a cut after one of the
#: few marks that end a sentence), and of complete values that end like cut ones.
CHANCE = {"known": 0.02, "terminal": 0.01, "none": 0.0005}
STRAY = {"marker": 1e-4, "open": 1e-4, "unknown": 3e-4}
#: Values of one length at least for a candidate limit.
MIN_ATOM = 5


def _phi(x):
    return np.array([0.5 * (1 + math.erf(t / math.sqrt(2))) for t in np.atleast_1d(x)])


def fit_censored(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(mu, sigma) of log length by maximum likelihood (EM), where the share ``censored`` of each length's count was cut there."""
    x = np.log(np.maximum(lengths, 1).astype(float))
    whole, cut = counts * (1 - censored), counts * censored
    n = counts.sum()
    mu = float((x * counts).sum() / n)
    sigma = max(float(np.sqrt((counts * (x - mu) ** 2).sum() / n)), 0.05)
    for _ in range(rounds):
        a = np.clip((x - mu) / sigma, -8, 8)
        hazard = np.exp(-a * a / 2) / math.sqrt(2 * math.pi) / np.maximum(1 - _phi(a), 1e-12)
        m1 = mu + sigma * hazard  # mean and second moment of what a cut value would have been
        m2 = mu * mu + sigma * sigma + sigma * hazard * (x + mu)
        mu_ = float((whole * x + cut * m1).sum() / n)
        var = float((whole * x * x + cut * m2).sum() / n) - mu_ * mu_
        done = abs(mu_ - mu) < 1e-6
        mu, sigma = mu_, max(math.sqrt(max(var, 0)), 0.05)
        if done:
            break
    return mu, sigma


def excess(length: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of the values of each length (ascending) that neither the fitted distribution nor the lengths around explain; 0 where that is no candidate limit."""
    reach = np.maximum(3, 0.04 * length)
    upto = np.concatenate([[0.0], np.cumsum(n)])
    around = upto[np.searchsorted(length, length + reach, "right")] - upto[np.searchsorted(length, length - reach, "left")] - n
    near = around / np.maximum(6, 0.08 * length)
    censored = np.zeros(len(length))
    for _ in range(5):
        mu, sigma = fit_censored(length, n, censored)
        room = n.sum() * (_phi((np.log(length + 0.5) - mu) / sigma) - _phi((np.log(np.maximum(length - 0.5, 0.5)) - mu) / sigma))
        room = np.maximum(room, near)
        atom = (n >= MIN_ATOM) & (n > 4 * room + 3 * np.sqrt(room + 1))
        new = np.where(atom, np.clip(1 - room / n, 0, 1), 0.0)
        if np.allclose(new, censored):
            break
        censored = new
    return censored


def _spread(fixed: np.ndarray, free: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A distribution with its fixed shares, and the rest in proportion to counts."""
    return np.where(free, (1 - fixed[~free].sum()) * counts / counts[free].sum(), fixed)


def limits(hist: pd.DataFrame, rounds: int = 100) -> pd.DataFrame:
    """(length, ending, prior, score) of one source and unit; length 0 stands for all lengths that are no candidate limit.

    ``hist`` is (length, ending, n). The length fit says where more values lie than complete ones account for. From
    there EM goes on over the endings: the share that was cut at each candidate limit, the share broken off elsewhere,
    and how values cut at a limit, values broken off and complete values end, are estimated from each other until they
    agree. So values that merely share a length, and end as complete ones do, give their limit away as none. ``score``
    is the log odds of having been cut.
    """
    table = hist.pivot_table(index="length", columns="ending", values="n", aggfunc="sum", fill_value=0).reindex(columns=list(KINDS), fill_value=0).sort_index()
    length, n = table.index.to_numpy(float), table.to_numpy(float)
    share = excess(length, n.sum(1))
    atom = share > 0
    groups = np.vstack([n[atom], n[~atom].sum(0)])  # the last row: everywhere else
    prior, w = np.array([CUT_PRIOR.get(k, 0.0) for k in KINDS]), np.append(share[atom], 0.02)[:, None]
    like_cut = np.array([k in STRAY for k in KINDS])
    chance, stray = np.array([CHANCE.get(k, 0.0) for k in KINDS]), np.array([STRAY.get(k, 0.0) for k in KINDS])
    at_limit = broken = _spread(chance, like_cut, prior)
    complete = _spread(stray, ~like_cut, n.sum(0) + 1)
    for _ in range(rounds):
        cut = np.vstack([np.tile(at_limit, (len(groups) - 1, 1)), broken])
        posterior = w * cut / (w * cut + (1 - w) * complete)
        was, size = groups * posterior, groups.sum(1)
        new = np.append(np.clip(was[:-1].sum(1) / np.maximum(size[:-1], 1), 0.001, 0.995), (was[-1].sum() + 0.5) / (size[-1] + 100))[:, None]
        at_limit, broken = _spread(chance, like_cut, was[:-1].sum(0) + prior), _spread(chance, like_cut, was[-1] + prior)
        complete = _spread(stray, ~like_cut, (groups - was).sum(0) + 0.5)
        done = np.abs(new - w).max() < 1e-5
        w = new
        if done:
            break
    cut = np.vstack([np.tile(at_limit, (len(groups) - 1, 1)), broken])
    score = np.log(w / (1 - w)) + np.log(cut / complete)
    return pd.DataFrame([(int(x), e, float(p), float(z)) for x, p, row in zip([*length[atom], 0], w[:, 0], score, strict=True) for e, z in zip(KINDS, row, strict=True)], columns=["length", "ending", "prior", "score"])


def values_of(events: DataFrame) -> DataFrame:
    """(event_id, field, pos, source, text) of every answer and tool preview; repeated rows of one id are one record.

    Answers of ingestion events are counts and are left out; null texts give no row. Of rows with one id the smallest
    is taken, by a partial aggregation.
    """
    e = spread(events.where(F.col("id").isNotNull()).select("id", "model_config", "operation_type", "generated_answer", F.col("agentic_trace.tool_calls").alias("calls")))
    e = e.groupBy(F.col("id").alias("event_id")).agg(F.min(F.struct("operation_type", "model_config", "generated_answer", "calls")).alias("e")).select("event_id", "e.*")
    name = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("?"))
    answers = e.where(~F.coalesce(F.lower(F.trim("operation_type")).startswith("ingestion_"), F.lit(False))).select("event_id", F.lit("generated_answer").alias("field"), F.lit(-1).alias("pos"), name("model_config").alias("source"), F.col("generated_answer").alias("text"))
    previews = e.select("event_id", F.posexplode("calls").alias("pos", "c")).where(F.col("c").isNotNull()).select("event_id", F.lit("result_preview").alias("field"), "pos", name(F.col("c.tool_name")).alias("source"), F.col("c.result_preview").alias("text"))
    return answers.unionByName(previews).where(F.col("text").isNotNull())


def judge(values: DataFrame) -> DataFrame:
    """``values`` plus ``ending``, ``posterior`` (of having been cut, by length alone) and ``score`` (log odds; above 0 is cut).

    Tool error messages (``[tool_error]``, ``[tool_timeout]``) are complete. Histograms are aggregated, and each source's
    is fitted in its own task (a row per distinct length and ending).
    """
    v = values.withColumn("family", F.when(F.col("field") == "generated_answer", F.lit("answer")).otherwise(F.col("source")))
    v = with_ending(v, ["event_id", "field", "pos"], "text", "family").withColumn("failed", F.ltrim("text").rlike(r"^\[tool_(error|timeout)\]"))
    v = v.withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text"))
    usable = v.where(~F.col("failed") & (F.col("chars") > 0))
    both = usable.select("field", "source", "ending", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    hist = both.groupBy("field", "source", "x.unit", "x.length", "ending").agg(F.count("*").alias("n"))

    def fit(key: tuple, h: pd.DataFrame) -> pd.DataFrame:
        return limits(h).assign(field=key[0], source=key[1], unit=key[2])[["field", "source", "unit", "length", "ending", "prior", "score"]]

    found = hist.groupBy("field", "source", "unit").applyInPandas(fit, "field string, source string, unit string, length int, ending string, prior double, score double")
    found = materialize(found, "limits")
    j = v
    for unit, length in (("chars", F.col("chars")), ("bytes", F.col("bytes")), ("else", F.lit(0))):
        mine = found.where((F.col("unit") == (unit if unit != "else" else "chars")) & ((F.col("length") == 0) if unit == "else" else (F.col("length") > 0)))
        side = mine.select("field", "source", "ending", F.col("length").alias("_length"), F.struct("score", "prior").alias(unit + "_fit"))
        j = join_small(j.withColumn("_length", length), side, ["field", "source", "ending", "_length"], "left")
    best = F.coalesce(F.greatest("chars_fit", "bytes_fit"), "else_fit")
    score = F.when(F.col("failed") | best.isNull(), F.lit(-99.0)).otherwise(best["score"])
    return j.select("event_id", "field", "pos", "source", "text", "ending", F.coalesce(best["prior"], F.lit(0.0)).alias("posterior"), score.alias("score"))


def cut_values(events: DataFrame) -> DataFrame:
    """(event_id, field, pos, source, posterior, ending) of every value that was cut."""
    return judge(values_of(events)).where("score > 0").select("event_id", "field", "pos", "source", "posterior", "ending")


def cut_rates(events: DataFrame) -> DataFrame:
    """(field, source, values, cut, share) for each tool and each model."""
    j = judge(values_of(events))
    return j.groupBy("field", "source").agg(F.count("*").alias("values"), F.count_if(F.col("score") > 0).alias("cut")).withColumn("share", F.col("cut") / F.col("values"))
