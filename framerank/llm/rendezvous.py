"""Sharding by weighted rendezvous hashing.

Each shard draws a number for a record's key from a hash of the key and the shard's own index; with weight ``w`` the
draw ``u`` becomes ``-ln(u) / w``, and the smallest wins. A shard wins in proportion to its weight, and as a draw
depends on nothing but the key and that shard, one more shard takes from each of the others the records that it wins
and moves no record between them. Everything is one expression over the key, so there is no shuffle; only the
numbering within shards has one, over three numbers a record.

Nulls: a null key is a key like any other; a null text has no bytes. Repeated rows have the same key and so the
same shard, each with a slot of its own. An empty table gives an empty table. Extra columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framerank.llm.common import ranked, unit


def shard_of(keys: list[Column], weights: list[float], seed: int = 0) -> Column:
    """The index of the shard that wins ``keys``; ties go to the smaller index."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    draws = F.array(*[-F.log(unit(F.lit(seed), F.lit(i), *keys)) / F.lit(float(w)) for i, w in enumerate(weights)])
    return (F.array_position(draws, F.array_min(draws)) - 1).cast("int")


def assign(df: DataFrame, keys: list[str], weights: list[float], added: list[float] = (), seed: int = 0) -> DataFrame:
    """Adds ``shard`` over ``weights`` and ``grown_shard`` over ``weights`` followed by ``added``."""
    cols = [F.col(k) for k in keys]
    return df.withColumn("shard", shard_of(cols, list(weights), seed)).withColumn("grown_shard", shard_of(cols, [*weights, *added], seed))


def with_slots(df: DataFrame, keys: list[str], order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Adds ``slot``, a gapless number from 0 within each ``shard``.

    The rows of a shard are dealt to about as many buckets as a bucket has rows, from one count of the table.
    """
    buckets = max(1, math.isqrt(df.count() // shards))
    dealt = df.withColumn("__bucket", F.floor(unit(F.lit(seed), F.lit("slot"), *[F.col(k) for k in keys]) * buckets).cast("int"))
    return ranked(dealt, ["shard"], "__bucket", [F.col(c) for c in order], "slot").drop("__bucket")


def write_shards(df: DataFrame, path: str) -> None:
    """Writes the records of each shard to a folder of its own; a shard is written by as many tasks as hold some of it."""
    df.write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """Every document's shard, its shard once there is one more, and its slot. Law ``key``: ``doc_id`` and the shard count decide."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign(rows, ["doc_id"], [1.0] * shards, [1.0], seed)
    return with_slots(rows, ["doc_id"], ["doc_id", "text_crc32", "size"], shards, seed)
