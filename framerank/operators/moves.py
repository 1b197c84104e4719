"""Moving rejects: a plan of sources and destinations first, file operations only when asked for."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framerank.schema import REJECTS_FOLDER


def reject_path(path: Column, roots: list[str]) -> Column:
    """Where a reject goes: into the rejects folder of the deepest root that holds it; null outside all roots.

    Roots match by components: ``/a`` doesn't hold ``/ab/x``. The roots are a parameter, so this is one expression.
    """
    cleaned = sorted({r.rstrip("/") for r in roots}, key=lambda r: (-len([c for c in r.split("/") if c]), r))
    out = F.lit(None).cast("string")
    for root in reversed(cleaned):
        inside = F.substring(path, 1, len(root) + 1) == F.lit(root + "/")
        out = F.when(inside, F.concat(F.lit(f"{root}/{REJECTS_FOLDER}/"), path.substr(F.lit(len(root) + 2), F.length(path)))).otherwise(out)
    return out


def plan(catalog: DataFrame, flagged: Column, roots: list[str]) -> DataFrame:
    """``src, dst`` of the flagged rows that a root holds."""
    return catalog.where(flagged).select(F.col("path").alias("src"), reject_path(F.col("path"), roots).alias("dst")).where("dst is not null")


def _move(src: str, dst: str) -> None:
    """Moves a file unless the destination is taken. A link can't replace a file that appears meanwhile, as a rename would."""
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    try:
        os.link(src, dst)
    except FileNotFoundError:
        if not os.path.exists(dst):  # else it was moved by an earlier run
            raise
        return
    except FileExistsError:
        if not os.path.samefile(src, dst):  # else an earlier run was cut off in between
            raise
    except OSError:  # no links here
        if os.path.exists(dst):
            raise FileExistsError(f"{dst} exists") from None
        os.rename(src, dst)
        return
    os.unlink(src)


def execute(moves: DataFrame, really: bool = False) -> DataFrame:
    """``src, dst, error`` for each move of a plan. Without ``really`` nothing is touched. An existing destination is an error.

    Meant for folders that all executors see. A task that runs again finds its source gone and its destination there,
    and takes that as moved.
    """
    if not really:
        return moves.withColumn("error", F.lit("dry run"))

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            errors = []
            for src, dst in zip(frame["src"], frame["dst"], strict=True):
                try:
                    _move(src, dst)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield frame.assign(error=errors)

    return moves.mapInPandas(run, "src string, dst string, error string")


def failures(moved: DataFrame) -> DataFrame:
    """``path, error`` of moves that failed, to be added to the errors of the scan."""
    return moved.where("error is not null").select(F.col("src").alias("path"), "error")


def apply(catalog: DataFrame, moved: DataFrame) -> DataFrame:
    """The catalog without what was moved."""
    gone = moved.where("error is null").select(F.col("src").alias("path"))
    return catalog.join(gone, "path", "left_anti")


def summary(moved: DataFrame) -> DataFrame:
    """One row: ``moved, failed`` and the message."""
    counts = moved.agg(F.count_if(F.col("error").isNull()).alias("moved"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    done = F.concat(F.lit("Moved "), F.col("moved").cast("string"), F.lit(f" to {REJECTS_FOLDER}/"))
    return counts.withColumn("message", F.when(F.col("failed") > 0, F.concat(done, F.lit(", "), F.col("failed").cast("string"), F.lit(" failed"))).otherwise(done))
