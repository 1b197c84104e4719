"""Token ids as ORC: stripes with run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of ``doc_id`` and sorted, so files in the order of their names hold ascending
ids, each stripe's statistics cover a short range of ids, and a look-up skips files, stripes and row groups by
statistics and Bloom filters. Readers split files by stripes.

Nulls: a null text is empty and has the end id only; null ids come first. Rows that repeat an id stay, ordered by a
hash of their text. An empty table gives an empty file set. Extra columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framerank.llm.common import cut, shared_path

END_ID = 2
#: Code points of text that are encoded to one Arrow batch at most, besides a single longer text.
BATCH_CHARS = 4_000_000
#: Documents in a file at most; a task that has more goes on with another file.
FILE_ROWS = 250_000
SCHEMA = "doc_id long, ids array<int>"


def encode(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """``doc_id, ids`` of ``doc_id, text``, row by row in the order of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from framerank.llm.tokens import encoder

        one, end = encoder(vocabulary).encode, int(end_id).to_bytes(4, "little")

        def flush(ids: list, packed: list[bytes]) -> pa.RecordBatch:
            at = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], ["doc_id", "ids"])

        for batch in batches:
            ids, packed, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id), packed.append(one(text) + end)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield flush(ids, packed)
                    ids, packed, size = [], [], 0
            yield flush(ids, packed)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encodes documents and writes their ids to ``path`` in ascending order of ``doc_id``.

    Texts rather than ids go through the shuffle: they are the smaller of the two.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]  # the hash splits an id that many rows have
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.stripe.size": str(32 << 20), "compression": "zstd", "maxRecordsPerFile": str(FILE_ROWS)}
    encode(rows, vocabulary, end_id).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the ORC reader, which prunes stripes and row groups."""
    return read(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From written files, per document: ``doc_id, start, n_tokens, ids_crc32``; ``start`` counts the ids of all documents before it."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("place"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    files = read(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    rows = cut(files.mapInArrow(sums, "doc_id long, file string, place struct<file_block_start: long, id: long>, n_tokens long, ids_crc32 long"), "digest")
    # Files by name are in the order of their documents; within one, blocks and then rows are.
    by_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = by_file.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(before, F.col("file") == F.col("__file")).select("doc_id", (F.col("__before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes all documents and describes what the files hold."""
    path = shared_path(docs.sparkSession, "orc")
    write(docs, path, vocabulary, end_id)
    return digest(docs.sparkSession, path)
