"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the target
shares of each margin until all margins fit; the weight a token of a cell has then, scaled to the wanted number of
tokens and cut at 1, is the probability with which each of its documents is drawn.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, fresh_names, stored, words_col

#: Default targets: shares in proportion to a margin's tokens to this power, so that small sources gain on large ones.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Rounds over all margins at most, rounds in one job, and the largest difference of a share from its target at which
#: raking ends.
ROUNDS, SWEEPS, TOLERANCE = 48, 8, 1e-6
#: The share of all tokens that is drawn.
RATE = 0.8
#: Up to so many cells (some dozen bytes each) are broadcast, and raked in one task.
BROADCAST_CELLS = 20_000
SEED = "mix"


def topic_of(text: Column) -> Column:
    """A document's topic, by its form: markup, figures, capitals, or prose by length."""

    def kind(x: Column) -> Column:
        share = lambda rule: F.regexp_count(x["text"], F.lit(rule)) / F.greatest(F.length(x["text"]), F.lit(1))
        return (
            F.when(x["n"] < 50, "note").when(share(r"[#*$%&|<>]") > 0.03, "markup").when(share(r"\p{Nd}") > 0.05, "figures")
            .when(share(r"\p{Lu}") > 0.3, "capitals").when(x["n"] < 300, "short prose").otherwise("long prose")
        )

    return F.get(F.transform(F.array(F.struct(text.alias("text"), F.size(words_col(text)).alias("n"))), kind), F.lit(0))


def margins(docs: DataFrame) -> dict[str, Column]:
    """What the three margins of a document are; null is a value of its own, ''. A topic column is taken where there is one."""
    text = F.coalesce("text", F.lit(""))
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    return {"source": F.coalesce(F.col("source"), F.lit("")), "lang": F.coalesce(F.col("lang"), F.lit("")), "topic": topic}


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the three margins' values and n_tokens (words and an end) of each row."""
    n_tokens = (F.size(words_col(F.coalesce("text", F.lit("")))) + 1).cast("long")
    return docs.select("doc_id", *(c.alias(m) for m, c in margins(docs).items()), n_tokens.alias("n_tokens"))


def targets(cells: DataFrame, margin: str, power: float, shares: dict[str, float] | None = None) -> DataFrame:
    """The target share of each value of a margin: as given, in proportion to ``shares`` over the values that there
    are, or else in proportion to the value's tokens to a power. Values that given shares lack have none."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t"))
    if shares is None:
        parts = sums.select(margin, F.pow("t", F.lit(power)).alias("part"))
    else:
        given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in shares.items()], f"{margin} string, part double")
        parts = sums.join(F.broadcast(given), margin, "left").select(margin, F.coalesce("part", F.lit(0.0)).alias("part"))
    whole = parts.agg(F.sum("part")).first()[0] or 1.0
    return parts.select(margin, (F.col("part") / F.lit(float(whole))).alias("target"))


def raked(cells: DataFrame, powers: dict[str, float], rounds: int = ROUNDS, tolerance: float = TOLERANCE, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The cells with ``weight``: shares of all tokens whose margins fit the targets.

    Raking ends when every margin is within ``tolerance`` of its targets, or after ``rounds``. It may not come to that
    where cells are missing (a source with a share, all of whose languages have none): it then ends when SWEEPS rounds
    no longer bring it nearer, the last margin fits, and a warning says how far off the others are.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    wanted = {m: stored(targets(cells, m, p, (shares or {}).get(m)), f"target-{m}") for m, p in powers.items()}
    few = cells.count() <= BROADCAST_CELLS
    fitted = stored(cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), "raked")
    off, before, factor = {}, float("inf"), F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(F.lit(0.0))
    for _ in range(0, rounds, SWEEPS):
        step = fitted.repartition(1) if few else fitted  # few cells need no shuffle for any margin's sums
        for margin, goal in SWEEPS * list(wanted.items()):
            if few:
                step = step.join(F.broadcast(goal), margin).withColumn("now", F.sum("weight").over(Window.partitionBy(margin)))
                step = step.withColumn("weight", F.col("weight") * factor).drop("now", "target")
            else:
                now = step.groupBy(margin).agg(F.sum("weight").alias("now")).join(goal, margin).select(margin, factor.alias("factor"))
                step = stored(step.join(now, margin).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "swept")
        step = stored(step.select(*cells.columns, "weight"), "raked")
        drop_stored(fitted)
        fitted = step
        each = [fitted.groupBy(m).agg(F.sum("weight").alias("now")).join(goal, m).select(F.lit(m).alias("m"), F.abs(F.col("now") - F.col("target")).alias("off")) for m, goal in wanted.items()]
        off = dict(reduce(DataFrame.unionByName, each).groupBy("m").agg(F.max("off")).collect())  # one number for each margin
        most = max(off.values(), default=0.0)
        if most <= tolerance:
            return fitted
        if most > 0.99 * before:
            break
        before = most
    logging.getLogger(__name__).warning("raking ended before its targets were met; largest differences of shares: %s", {m: round(x, 6) for m, x in off.items()})
    return fitted


def cell_probabilities(described_docs: DataFrame, powers: dict[str, float] = POWERS, rate: float = RATE, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """source, lang, topic, weight (token weight against an unmixed token) and probability of each cell."""
    names = list(powers)
    cells = stored(described_docs.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = raked(cells, powers, shares=shares)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    ratio = F.col("weight") * F.lit(float(total)) / F.col("tokens")
    scale = rate
    for _ in range(25):  # the scale at which the cut probabilities draw the wanted number of tokens
        drawn = fitted.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * F.lit(scale)))).first()[0]
        if not drawn or abs(drawn / total - rate) <= 1e-4:
            break
        scale *= rate * total / drawn
    return stored(fitted.select(*names, ratio.alias("weight"), F.least(F.lit(1.0), ratio * F.lit(scale)).alias("probability")), "probabilities")


def drawn(doc_id: Column, probability: Column, seed: str = SEED) -> Column:
    """Whether a document is drawn: its own number in [0, 1), from a hash of seed and id, lies below the probability."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(16**13)) < probability


def _joined(rows: DataFrame, cells: DataFrame, margins: list[str]) -> DataFrame:
    return rows.join(F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells, margins)


def mixing_table(docs: DataFrame, powers: dict[str, float] = POWERS, rate: float = RATE, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and kept of every row of ``docs``.

    Needs doc_id, text, lang and source, and takes topic where it is; other columns are ignored. ``shares`` holds target
    weights by margin and value, {"lang": {"en": 3, "de": 1}}; a margin without them has powers of its own sums. Null source or lang is the value ''. Rows of one
    id are drawn together. An empty table gives no rows.
    """
    each = stored(described(docs), "described")
    cells = cell_probabilities(each, powers, rate, shares)
    return _joined(each, cells, list(powers)).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), drawn(F.col("doc_id"), F.col("probability")).alias("kept"))


def mixed_documents(docs: DataFrame, powers: dict[str, float] = POWERS, rate: float = RATE, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns as they are."""
    names = dict(zip([*powers, "probability"], fresh_names(docs, *(f"_{m}" for m in powers), "_probability"), strict=True))
    cells = cell_probabilities(described(docs), powers, rate, shares).select(*(F.col(c).alias(n) for c, n in names.items()))
    values = margins(docs)
    keyed = docs.withColumns({names[m]: values[m] for m in powers})
    return _joined(keyed, cells, [names[m] for m in powers]).filter(drawn(F.col("doc_id"), F.col(names["probability"]))).select(*docs.columns)
