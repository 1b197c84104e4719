"""Manual marks, mode overrides, rescored rows and selections: relations beside the catalog, keyed by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.schema import REJECT_THRESHOLD


def mark(catalog: DataFrame, selection: DataFrame, disqualified: bool, threshold: float = REJECT_THRESHOLD) -> DataFrame:
    """Marks the selected rows; a mark that says what the threshold says is none."""
    chosen = selection.select(F.col("path").alias("__p")).distinct()
    auto = F.col("score") <= F.lit(float(threshold))
    new = F.when(auto != F.lit(disqualified), F.lit(disqualified))
    return catalog.join(chosen, F.col("path") == F.col("__p"), "left").withColumn("manual_dq", F.when(F.col("__p").isNotNull(), new).otherwise(F.col("manual_dq"))).drop("__p")


def clear_marks(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("manual_dq", F.lit(None).cast("boolean"))


def override_modes(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """``path, mode`` overrides; a row is ``dirty`` while its score was made for another mode."""
    over = overrides.select(F.col("path").alias("__p"), F.col("mode").alias("__m"))
    rows = catalog.join(over, F.col("path") == F.col("__p"), "left").withColumn("mode_scored", F.col("mode"))
    return rows.withColumn("mode", F.coalesce("__m", "mode")).withColumn("dirty", F.col("mode") != F.col("mode_scored")).drop("__p", "__m")


def dirty_rows(catalog: DataFrame) -> DataFrame:
    return catalog.where("dirty")


def can_move(catalog: DataFrame, flagged: Column, busy: bool = False) -> DataFrame:
    """One row: whether rejects may be moved, which needs one at least and no row that waits for its score."""
    return catalog.agg(((F.count_if(flagged) > 0) & (F.count_if("dirty") == 0) & F.lit(not busy)).alias("can_move"))


def merge_scores(catalog: DataFrame, rescored: DataFrame) -> DataFrame:
    """Takes ``path, mode, score`` of rescored rows; a row is clean again if the mode that was scored is the one it has now."""
    new = rescored.select(F.col("path").alias("__p"), F.col("mode").alias("__m"), F.col("score").alias("__s"))
    rows = catalog.join(new, F.col("path") == F.col("__p"), "left")
    return rows.withColumn("score", F.coalesce("__s", "score")).withColumn("dirty", F.col("dirty") & ~F.coalesce(F.col("__m") == F.col("mode"), F.lit(False))).drop("__p", "__m", "__s")


def select_one(catalog: DataFrame, path: str) -> DataFrame:
    return catalog.where(F.col("path") == path).select("path").distinct()


def toggle(selection: DataFrame, clicked: DataFrame) -> DataFrame:
    """The symmetric difference."""
    a, b = selection.select("path").distinct(), clicked.select("path").distinct()
    return a.join(b, "path", "left_anti").unionByName(b.join(a, "path", "left_anti"))


def select_range(visible: DataFrame, order: list[Column], anchor: str | None, target: str, selection: DataFrame | None = None) -> DataFrame:
    """The rows from anchor to target in the visible order; with a ``selection`` they are added to it.

    Where either end isn't visible, the click counts as one without the range: it selects the target alone, or toggles it in the
    selection. Only the two ends' sort keys are looked up, so nothing is numbered.
    """
    keyed = visible.select("path", F.struct(*order).alias("__k"))
    ends = keyed.where(F.col("path").isin([p for p in (anchor, target) if p is not None])).agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"), F.countDistinct("path").alias("n")).first()
    if anchor is None or ends["n"] < len({anchor, target}):
        clicked = visible.sparkSession.createDataFrame([(target,)], "path string")
        return clicked if selection is None else toggle(selection, clicked)
    low, high = (F.struct(*[F.lit(v) for v in ends[k]]) for k in ("lo", "hi"))
    between = keyed.where((F.col("__k") >= low) & (F.col("__k") <= high)).select("path")
    return between if selection is None else between.unionByName(selection.select("path")).distinct()


def latest_per_key(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last event of each key."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


