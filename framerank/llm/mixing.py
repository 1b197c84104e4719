"""Mixing sources to target weights by subset sums over exact lengths.

Per source the documents are counted by exact length in words. The target is met with whole passes over the source as
long as one fits; for what remains, an even share of each length is taken, which leaves a budget that doesn't depend
on how often lengths occur, and a bounded-knapsack dynamic programme over the counts left (bit sets of reachable
sums, lengths split into powers of two) chooses how many more documents of each length fill it, exactly where the
lengths allow. Which documents of a length are taken is decided by a seeded hash, up to the count of that length.

The dynamic programme sees one row per source and length, never documents. Targets are found by filling: with
sources in order of ``cap / weight``, those before the cut stop at their cap and the rest share by weight what is
left, which is where sharing again and again ends.

Nulls: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; documents of
size 0 carry no words. Repeated rows are documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framerank.llm.common import cut, n_words, ranked, unit

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often, so no target is larger than this many times its source.
MOST_PASSES = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """From rows of ``source, size``, one row per source: ``source, source_size, target``."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = (
        rows.withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        # The first source, in order, whose cap isn't reached sets the level for itself and for all after it.
        .withColumn("free", F.col("cap") / F.col("w") > F.col("level"))
        .withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(Window.partitionBy().orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a sum as near ``budget`` as lengths and counts allow.

    An even share ``floor(count * budget / total)`` of each length comes first. What is left to fill is brought below a
    small multiple of the largest length by taking one more here and there, longest first; the dynamic programme then
    fills that, with one document given back of each of the shortest lengths: of 64 lengths at first and of twice as many
    as long as the budget isn't met, up to all of them. The nearest sum from below is taken.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total or not len(lengths):
        return counts.copy()
    budget -= budget % int(np.gcd.reduce(lengths))  # no sum lies between
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order], counts[order]
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * taken).sum())
    for i in range(len(lengths)):  # the remainders of the shares: one more of each length, while it fits
        if taken[i] < counts[i] and lengths[i] <= left:
            taken[i] += 1
            left -= int(lengths[i])
    there, room, best = np.flatnonzero(taken)[::-1], 64, (left, taken)
    while best[0] and room < 2 * max(64, len(there)):
        trial = taken.copy()
        trial[there[:room]] -= 1
        trial += knapsack(lengths, counts - trial, left + int(lengths[there[:room]].sum()))
        best = min(best, (budget - int((lengths * trial).sum()), trial), key=lambda x: x[0])
        room *= 2
    taken = best[1]
    back = np.empty_like(taken)
    back[order] = taken
    return back


def knapsack(lengths: np.ndarray, available: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack over exact lengths: counts with the largest sum of at most ``budget``.

    Reachable sums are bits of one integer; each item is some power of two of one length. Filling ends as soon as
    the budget itself is reached.
    """
    mask, reached, steps = (1 << (budget + 1)) - 1, 1, []
    for i in np.argsort(lengths, kind="stable"):
        size, n, power = int(lengths[i]), int(min(available[i], budget // max(1, int(lengths[i])))), 1
        while n > 0 and not reached >> budget & 1:
            m = min(power, n)
            new = (reached << (size * m)) & mask & ~reached
            if new:
                steps.append((int(i), m, new))
                reached |= new
            n -= m
            power *= 2
    taken, at = np.zeros(len(lengths), dtype=np.int64), reached.bit_length() - 1
    for i, m, new in reversed(steps):  # a sum was first reached with the item that added its bit
        if new >> at & 1:
            taken[i] += m
            at -= int(lengths[i]) * m
    return taken


def plan(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source and length: ``passes`` (whole passes) and ``extra`` (documents taken once more), from ``source, size, n``."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        target, whole = int(round(rows["target"].iloc[0])), int(rows["source_size"].iloc[0])
        passes = target // whole if whole else 0
        lengths = rows["size"].to_numpy()
        extra = np.zeros(len(rows), dtype=np.int64)
        real = lengths > 0
        if whole:
            extra[real] = fill(lengths[real], rows["n"].to_numpy()[real], target - passes * whole)
        return rows.assign(passes=passes, extra=extra)

    joined = histogram.join(goals.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    return joined.groupBy("source").applyInPandas(one, "source string, size long, n long, source_size long, target double, passes long, extra long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """Per document of ``doc_id, text, source``: ``size, source_size, target`` and ``taken``, the words that the mix takes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("draw")), "sizes")
    return mix_sizes(sizes, weights).select("doc_id", "size", "source_size", "target", "taken")


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Like ``mix``, from rows of ``doc_id, source, size, draw``; other columns stay."""
    histogram = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    chosen = cut(plan(histogram, targets(sizes, weights)), "plan")
    chosen = chosen.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "source_size", "target", "passes", "extra")
    rows = sizes.join(chosen, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))).drop("__s", "__z")
    # Only lengths of which some but not all documents are taken once more need an order.
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    whole = rows.where(~some).withColumn("more", (F.col("extra") > 0).cast("long"))
    dealt = rows.where(some).withColumn("__bucket", F.floor(unit(F.col("draw")) * F.ceil(F.sqrt("n"))).cast("long"))
    placed = ranked(dealt, ["source", "size"], "__bucket", [F.col("draw"), F.col("doc_id")], "__place")
    part = placed.withColumn("more", (F.col("__place") < F.col("extra")).cast("long")).drop("__bucket", "__place")
    return whole.unionByName(part).withColumn("taken", F.col("size") * (F.col("passes") + F.col("more")))


def taken_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Documents without words are in no mix. Rows that agree in ``doc_id`` and text are told apart by nothing, so what
    their group takes is dealt out among them.
    """
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__draw", F.xxhash64(F.lit(seed), F.col("doc_id"), text)).withColumn("__row", F.monotonically_increasing_id())
    keyed = cut(keyed, "keyed")
    sizes = cut(keyed.select(F.col("__row").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.col("__draw").alias("draw")), "sizes")
    times = mix_sizes(sizes, weights).where("taken > 0").select(F.col("doc_id").alias("__r"), (F.col("taken") / F.col("size")).cast("int").alias("__times"))
    return keyed.join(times, F.col("__row") == F.col("__r")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
