"""Listing photo files as a DataFrame, and scanning them into catalog rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.functions.scores import is_supported
from framerank.operators.cuts import cut
from framerank.schema import REJECTS_FOLDER, SCAN_SCHEMA, SCORE_BOX, THUMB_BOX, checked


def not_pruned(path: Column, roots: list[str]) -> Column:
    """False below a rejects folder, the root itself included, but not for one above the root."""
    out = F.lit(True)
    for root in sorted({r.rstrip("/") for r in roots}, key=len):
        above = root.rsplit("/", 1)[0]
        inside = path.startswith(root + "/")
        out = F.when(inside, ~path.substr(F.lit(len(above) + 1), F.length(path)).rlike(f"/{REJECTS_FOLDER}/")).otherwise(out)
    return out


def listing(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime, content`` of the supported photos; nothing is read until ``content`` is used.

    Files and folders whose names begin with a dot or an underscore are left out, as Spark's readers do. A file that
    two roots share is there once.
    """
    frames = []
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        plain = F.regexp_replace("path", "^file:/+", "/")
        frames.append(files.withColumn("path", plain).where(not_pruned(F.col("path"), [re.sub("^file:/+", "/", root)]) & is_supported(F.col("path"))))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["path"]) if len(frames) > 1 else out


#: Photos in an output batch at most: thumbnails and previews are large.
BATCH = 4
#: Photos that are read by a list of paths at most.
MOST_PATHS = 100_000


def _parts(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), BATCH):
        yield frame.iloc[at : at + BATCH]


def found_count(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("found"))


def scan(files: DataFrame, mode: str | None = None, method: str = "FixedRegion", with_thumbs: bool = False, models: dict[str, str] | None = None) -> DataFrame:
    """Catalog rows of ``path, content``; a file that can't be decoded gives a row with ``error`` alone.

    ``mode`` fixes the mode; ``models`` has the paths of user-supplied ``face`` and ``animal`` networks, without
    which nothing is detected.
    """
    checked(mode=mode, method=method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from framerank.sources.kernel import scan_one

        for frame in (part for batch in batches for part in _parts(batch)):
            yield pd.DataFrame([scan_one(p, c, mode, method, SCORE_BOX, THUMB_BOX if with_thumbs else 0, models or {}) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=_names())

    return files.select("path", "content").mapInPandas(run, SCAN_SCHEMA)


def _names() -> list[str]:
    return ["path", "mode", "subject", "width", "height", "score", "metrics", "phash", "thumb", "error"]


def previews(files: DataFrame, box: int) -> DataFrame:
    """``path, w, h, rgb, error`` of photos fitted into a larger box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from framerank.sources.kernel import preview_one

        for frame in (part for batch in batches for part in _parts(batch)):
            yield pd.DataFrame([preview_one(p, c, box) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "w", "h", "rgb", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, w int, h int, rgb binary, error string")


def recompute(files: DataFrame, dirty: DataFrame, method: str = "FixedRegion", models: dict[str, str] | None = None) -> DataFrame:
    """Scores again the photos of ``dirty`` (``path, mode``), each with its own mode; only they are decoded.

    The listing without contents is joined first. Up to ``MOST_PATHS`` photos are then read by their paths alone; beyond that, all contents
    are read and joined.
    """
    checked(method=method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from framerank.sources.kernel import scan_one

        for frame in (part for batch in batches for part in _parts(batch)):
            yield pd.DataFrame([scan_one(p, c, m, method, SCORE_BOX, 0, models or {}) for p, c, m in zip(frame["path"], frame["content"], frame["mode"], strict=True)], columns=_names())

    wanted = cut(files.select("path").join(dirty.select("path", "mode"), "path"), "wanted")
    if (n := wanted.count()) <= MOST_PATHS:
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in wanted.select("path").distinct().collect()]
        found = files.sparkSession.read.format("binaryFile").load(names) if n else files.where("false")
        files = found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return files.join(wanted, "path").select("path", "content", "mode").mapInPandas(run, SCAN_SCHEMA)


def report(files: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """``path, line``: how each photo fares by both sharpness methods, and how long that took."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from framerank.sources.kernel import report_one

        for frame in batches:
            yield pd.DataFrame({"path": frame["path"], "line": [report_one(p, c, SCORE_BOX, models or {}) for p, c in zip(frame["path"], frame["content"], strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, line string")
