"""The ranking funnel: technical filter, groups, best of each, blend, top N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.functions.scores import is_disqualified, normalize_sharpness, overall_score
from framerank.operators.cuts import cut
from framerank.operators.dedupe import best_of_group, labelled
from framerank.schema import REJECT_THRESHOLD, HASH_DISTANCE, TOP_N, WEIGHTS, checked


def factors() -> dict[str, Column]:
    """The factors of a catalog row with a raw ``score``."""
    return {"sharpness": normalize_sharpness(F.col("score")), **{k: F.col(k) for k in WEIGHTS if k != "sharpness"}}


def with_overall(catalog: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    return catalog.withColumn("overall", overall_score(factors(), weights))


def survivors(catalog: DataFrame, threshold: float = REJECT_THRESHOLD) -> DataFrame:
    return catalog.where(~is_disqualified(F.col("score"), F.col("manual_dq"), threshold))


def keepers(catalog: DataFrame, threshold: float = REJECT_THRESHOLD, distance: int = HASH_DISTANCE, weights: dict[str, float] | None = None) -> DataFrame:
    """The best survivor of each group and the survivors without one. Groups are over survivors alone."""
    rows = cut(with_overall(survivors(catalog, threshold), weights), "survivors")  # hashes, groups and the result read them
    return best_of_group(labelled(rows, distance))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place from 1 of each row in an order of all rows.

    Ranges of the order are tasks; a row's place is its place in its range after the counts of the ranges before, so no
    task sees all rows.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = cut(ranges.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__range", before.alias("__before"))
    return ranges.join(F.broadcast(counts), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def top_n(rows: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first ``n`` by ``overall``, ties by path, with their ``place``."""
    checked(top_n=n)
    first = rows.orderBy(F.col("overall").desc(), "path").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col("overall").desc(), "path")))


def rank(catalog: DataFrame, threshold: float = REJECT_THRESHOLD, distance: int = HASH_DISTANCE, n: int = TOP_N, weights: dict[str, float] | None = None) -> DataFrame:
    checked(threshold=threshold, distance=distance, top_n=n, weights=weights)
    return top_n(keepers(catalog, threshold, distance, weights), n)


def funnel_counts(catalog: DataFrame, threshold: float = REJECT_THRESHOLD, distance: int = HASH_DISTANCE, n: int = TOP_N) -> DataFrame:
    """One row: ``total, after_technical, after_dedupe, shortlist``."""
    dq = is_disqualified(F.col("score"), F.col("manual_dq"), threshold)
    first = catalog.agg(F.count(F.lit(1)).alias("total"), F.count_if(~dq).alias("after_technical"))
    # After the filter each group keeps one row, so the groups are counted, not ranked.
    rows = cut(survivors(catalog, threshold).select("path", "phash"), "survivors")  # hashes and groups read them
    left = labelled(rows, distance).agg(F.countDistinct("group_id").alias("after_dedupe"))
    return first.join(left).withColumn("shortlist", F.least("after_dedupe", F.lit(n).cast("long")))
