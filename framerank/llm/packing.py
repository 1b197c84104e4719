"""Best-fit packing of token sequences by exact-complement hashing.

Documents longer than a sequence are cut into whole pieces and a rest; everything after that works on how many
pieces there are of each length. The lengths from the longest down open sequences. A sequence's gap is looked up
among the single lengths and in an index of the sums of two and, as a length and a pair, of three lengths. What is found fills the
gap exactly and is consumed for as many sequences at once as its counts allow; as counts only fall, entries whose lengths are used
up are passed over once. What no combination completes is filled by best fit: the longest available length that fits, again and again.

The table of counts has at most ``capacity`` rows and each step uses up a length's count, so the plan's size depends
on ``capacity`` alone, not on the number of documents: it is made on the driver and sent to all tasks. Pieces find
their place in it by their rank within their length.

Nulls: a null text is empty and has the end id only. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framerank.llm.common import cut, ranked, trimming, unit

CAPACITY = 4096
END_ID = 1


def pieces(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: ``doc_id, piece, start, length, ids_crc32``. Each text is encoded once."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from framerank.llm.tokens import encoder

        encode, end = encoder(vocabulary).encode, int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    ids.append(doc_id), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(trimming(cut_up), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Index from a sum to the combinations of available lengths that make it, longest member first.

    A sum's entries are made when it is first asked for. They stay in order, and each sum has a mark before which all are used up.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.pairs: dict[int, list] = {}  # sum: [mark, longer members]
        self.triples: dict[int, list] = {}

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] > 0 else None

    def pair(self, gap: int, but: int = 0) -> tuple[int, ...] | None:
        """A pair that sums to ``gap``, with one ``but`` set aside."""
        if (entry := self.pairs.get(gap)) is None:
            there = self.counts[: gap + 1] > 0
            longer = np.flatnonzero(there & there[::-1])[::-1]
            entry = self.pairs[gap] = [0, longer[2 * longer >= gap].tolist()]
        mark, longer = entry
        for k in range(mark, len(longer)):
            a, b = longer[k], gap - longer[k]
            if self.counts[a] <= (a == b) or not self.counts[b]:  # not even without what is set aside
                if k == entry[0]:
                    entry[0] += 1
            elif self.counts[a] - (a == but) > (a == b) and self.counts[b] - (b == but) > 0:
                return a, b
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """A triple that sums to ``gap``: a length, and a pair for the rest."""
        if (entry := self.triples.get(gap)) is None:
            entry = self.triples[gap] = [0, np.flatnonzero(self.counts[: max(gap - 1, 0)] > 0)[::-1].tolist()]
        for k in range(entry[0], len(entry[1])):
            a = entry[1][k]
            if self.counts[a] and (rest := self.pair(gap - a, a)):
                return (a, *rest)
            entry[0] = k + 1  # counts only fall, so what has no pair now won't get one
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """From pieces by length, rows of (number of sequences, [(length, how many in each), ...])."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = Sums(left), []
    if left[capacity]:
        out.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    for longest in range(capacity - 1, 0, -1):
        while left[longest] > 0:
            gap = capacity - longest
            left[longest] -= 1  # it opens the sequence; what complements may use of its length is the rest
            found = sums.single(gap) or sums.pair(gap) or (sums.triple(gap) if gap > 2 else None)
            left[longest] += 1
            items = [longest, *found] if found else _best_fit(left, longest, capacity)
            kinds = sorted({x: items.count(x) for x in items}.items(), reverse=True)
            times = int(min(left[x] // m for x, m in kinds))
            for x, m in kinds:
                left[x] -= times * m
            out.append((times, kinds))
    return out


def _best_fit(left: np.ndarray, longest: int, capacity: int) -> list[int]:
    """One sequence that starts with ``longest``: the longest length that fits, or a combination that then fills it."""
    trial, items, gap = left.copy(), [longest], capacity - longest
    trial[longest] -= 1
    sums = Sums(trial)
    while gap > 0:
        if len(items) > 1 and (exact := sums.single(gap) or sums.pair(gap)):
            return items + list(exact)
        fits = np.flatnonzero(trial[: gap + 1] > 0)
        if not len(fits):
            break
        size = int(fits[-1])
        n = int(min(trial[size], gap // size)) if gap // size > 8 else 1
        items += [size] * n
        trial[size] -= n
        gap -= n * size
    return items


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, pieces in each sequence, offset of the first), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, kinds in made:
        offset = 0
        for length, m in kinds:
            out.setdefault(length, []).append((used.get(length, 0), sequence, m, offset))
            used[length] = used.get(length, 0) + times * m
            offset += m * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    ``parts`` is read three times; pass a written table.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return parts.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for one in np.unique(length):
                of, rows = length == one, where.value[int(one)]
                first, start, each, at = rows[np.searchsorted(rows[:, 0], rank[of], side="right") - 1].T
                sequence[of] = start + (rank[of] - first) // each
                offset[of] = at + (rank[of] - first) % each * one
            keep = [n for n in batch.schema.names if n not in ("__rank", "__bucket")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    # A length's buckets are about as many as the rows of one; the table of counts has at most `capacity` rows.
    sizes = spark.createDataFrame([(k, int(np.sqrt(n)) + 1) for k, n in counts.items()], "__length long, __n long")
    dealt = parts.join(F.broadcast(sizes), F.col("length") == F.col("__length")).withColumn("__bucket", F.floor(unit(F.col("doc_id"), F.col("piece")) * F.col("__n"))).drop("__length", "__n")
    numbered = ranked(dealt, ["length"], "__bucket", [F.col("doc_id"), F.col("piece")], "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of every document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack_pieces(cut(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
