"""Scan results as streams: what is found is processed once and the stream ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.functions.scores import is_supported
from framerank.operators.cuts import shared_path
from framerank.sources.files import not_pruned, scan


def events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of scan events; ``path`` is a file or a folder of files."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    rows = spark.readStream.schema(schema).parquet(f"{parent}/{name[:-1]}[{name[-1]}]")
    at = F.concat(F.lit("/lib/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    failed = F.col("event_type") == "error"
    return rows.select(at.alias("path"), F.when(failed, "Failed").otherwise("Photo").alias("kind"), F.when(failed, F.col("props")).alias("error"))


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream appends until all that is there has been read."""
    at = shared_path(stream.sparkSession, "stream")
    sink = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """All events, through the stream."""
    return _drained(events(spark, path)).select("path", "kind", "error")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Running counts by kind, as they stand at the end of the stream."""
    at = shared_path(spark, "stream")
    counts = events(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/counts/{number:09d}")
        keep.last = f"{at}/counts/{number:09d}"

    keep.last = None
    counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(keep.last) if keep.last else spark.createDataFrame([], "kind string, n long")


def scan_folder(spark: SparkSession, root: str, **options) -> DataFrame:
    """Photos of a folder as a stream of catalog rows; files that were scanned before aren't scanned again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    plain = root.removeprefix("file://")
    return scan(files.where(not_pruned(F.col("path"), [plain]) & is_supported(F.col("path"))), **options)
