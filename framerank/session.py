"""One catalog from scan to move: the library's operators over a folder tree, with the state that belongs to a scan.

A scan writes its rows to the shared folder and starts anew: marks, mode overrides, errors and selections of an earlier scan
are gone. What follows are relations over those rows; nothing is collected but single counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.functions.scores import is_disqualified
from framerank.operators import dedupe, moves, overlay, rank
from framerank.operators.cuts import cut
from framerank.schema import HASH_DISTANCE, REJECT_THRESHOLD, TOP_N, checked
from framerank.sources import files


class Session:
    def __init__(self, spark: SparkSession, roots: list[str], mode: str | None = None, method: str = "FixedRegion", models: dict[str, str] | None = None, threshold: float = REJECT_THRESHOLD, distance: int = HASH_DISTANCE, top_n: int = TOP_N, weights: dict[str, float] | None = None):
        checked(threshold=threshold, distance=distance, top_n=top_n, weights=weights, mode=mode, method=method)
        self.spark, self.roots, self.mode, self.method, self.models = spark, roots, mode, method, models
        self.threshold, self.distance, self.n, self.weights = threshold, distance, top_n, weights
        self.scan_id: str | None = None

    def scan(self) -> DataFrame:
        """Scans the roots and forgets what belonged to the scan before."""
        self.scan_id = uuid.uuid4().hex
        rows = cut(files.scan(files.listing(self.spark, self.roots), self.mode, self.method, models=self.models), "scan")
        self.errors = rows.where("error is not null").select("path", "error")
        good = rows.where("error is null").drop("error", "thumb")
        factors = [F.col(f"metrics.{c}").alias(c) for c in ("exposure", "contrast", "color", "composition", "subject")]
        self.catalog = good.select("path", "mode", F.col("mode").alias("mode_scored"), F.lit(False).alias("dirty"), "score", "phash", F.lit(None).cast("boolean").alias("manual_dq"), *factors)
        return self.catalog

    def flagged(self) -> DataFrame:
        return self.catalog.where(is_disqualified(F.col("score"), F.col("manual_dq"), self.threshold))

    def mark(self, selection: DataFrame, disqualified: bool) -> None:
        self.catalog = overlay.mark(self.catalog, selection, disqualified, self.threshold)

    def clear_marks(self) -> None:
        self.catalog = overlay.clear_marks(self.catalog)

    def override_modes(self, overrides: DataFrame) -> None:
        """``path, mode``; the rows wait for ``recompute``."""
        over = overrides.select(F.col("path").alias("__p"), F.col("mode").alias("__m"))
        rows = self.catalog.join(over, F.col("path") == F.col("__p"), "left").withColumn("mode", F.coalesce("__m", "mode")).drop("__p", "__m")
        self.catalog = rows.withColumn("dirty", F.col("mode") != F.col("mode_scored"))

    def recompute(self) -> None:
        """Scores the rows that wait for it and merges what comes back; failures join the errors."""
        found = cut(files.recompute(files.listing(self.spark, self.roots), overlay.dirty_rows(self.catalog), self.method, self.models), "rescored")
        self.errors = self.errors.unionByName(found.where("error is not null").select("path", "error"))
        new = found.where("error is null")
        rows = overlay.merge_scores(self.catalog, new)
        self.catalog = cut(rows.withColumn("mode_scored", F.when(F.col("dirty"), F.col("mode_scored")).otherwise(F.col("mode"))), "catalog")

    def groups(self) -> DataFrame:
        return dedupe.groups(self.catalog.select("path", "phash"), self.distance)

    def rank(self) -> DataFrame:
        return rank.rank(self.catalog, self.threshold, self.distance, self.n, self.weights)

    def move_plan(self) -> DataFrame:
        return moves.plan(self.catalog, is_disqualified(F.col("score"), F.col("manual_dq"), self.threshold), self.roots)

    def move(self, really: bool = False) -> DataFrame:
        """Moves the rejects and returns the summary; what was moved leaves the catalog, failures join the errors. Refused while rows wait for scores."""
        flagged = is_disqualified(F.col("score"), F.col("manual_dq"), self.threshold)
        if not overlay.can_move(self.catalog, flagged).first()["can_move"]:
            raise ValueError("nothing to move, or rows wait for their scores")
        moved = cut(moves.execute(self.move_plan(), really), "moved")
        if really:
            self.catalog = cut(moves.apply(self.catalog, moved), "catalog")
            self.errors = self.errors.unionByName(moves.failures(moved))
        return moves.summary(moved)
