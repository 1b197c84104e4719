"""Duplicate groups: Hamming-threshold self-join and connected components.

A hash is split into ``b`` blocks of bits. Two hashes within distance ``d`` differ in at most ``d`` blocks, so they agree on some
``b - d`` of them, and an equi-join on every choice of ``b - d`` blocks finds all pairs. More blocks make more keys, each with more
bits: the rows grow with the choices and the candidates fall with the bits, so ``b`` follows the number of hashes and the
candidates stay near-linear in it. Equal hashes are one node, so a group of copies makes no pairs among themselves.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.functions.scores import hamming
from framerank.operators.cuts import cut
from framerank.schema import HASH_DISTANCE, checked

#: Blocks beyond the distance at most, and the most choices of blocks that a hash is a row for.
MORE_BLOCKS, MOST_KEYS = 5, 1000
#: Larger distances than block choices can serve compare all distinct hashes, if there are no more than these.
MOST_COMPARED = 50_000


def blocks(distance: int, n: int) -> int | None:
    """How many blocks make the fewest rows and candidates for ``n`` hashes; ``None`` if no number is fit."""

    def cost(b: int) -> float:
        keys, bits = math.comb(b, distance), 64 * (b - distance) / b
        return keys * n + keys * n * n / 2 ** (bits + 1)

    fit = [b for b in range(distance + 1, min(64, distance + MORE_BLOCKS) + 1) if math.comb(b, distance) <= MOST_KEYS and 64 // b >= 2]
    best = min(fit, key=cost, default=None)
    return best if best is not None and cost(best) < n * n / 2 + 64 * n else None


def _masks(b: int) -> list[int]:
    """The bits of each block, as signed 64-bit numbers."""
    bounds = [64 * i // b for i in range(b + 1)]
    return [_signed((1 << high) - (1 << low)) for low, high in itertools.pairwise(bounds)]


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def distinct_pairs(hashes: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """``a, b, distance`` with ``a < b`` over distinct values of ``phash``."""
    checked(distance=distance)
    one = cut(hashes.select("phash").where("phash is not null").distinct(), "hashes")  # both sides of the join read it
    n = one.count()
    b = blocks(distance, n)
    if b is None:
        if n > MOST_COMPARED:
            raise ValueError(f"{n} hashes can't all be compared at distance {distance}; up to {MOST_COMPARED} can")
        both = one.withColumnRenamed("phash", "a").join(one.withColumnRenamed("phash", "b"), F.col("a") < F.col("b"))
        return both.withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= distance)
    masks, k = _masks(b), b - distance
    choices = list(itertools.combinations(range(b), k))
    width = (len(choices) - 1).bit_length()
    keys = F.array(*[F.shiftleft(_packed(c, b), width).bitwiseOR(F.lit(i).cast("long")) for i, c in enumerate(choices)])
    keyed = one.select("phash", F.explode(keys).alias("key"))
    # Spark takes the keys for no larger than the hashes they are made of, and would broadcast hundreds of rows for each of them.
    left, right = keyed.withColumnRenamed("phash", "a"), keyed.withColumnRenamed("phash", "b").hint("merge")
    both = left.join(right, "key").where("a < b").withColumn("distance", hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= distance)
    # A pair that agrees on more blocks is kept for its first choice: no other agreeing block stands before the last.
    last = F.get(F.array(*[F.lit(c[-1]) for c in choices]), F.col("key").bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int"))
    unlike = F.col("a").bitwiseXOR(F.col("b"))
    agreed = sum(((unlike.bitwiseAND(F.lit(m).cast("long")) == 0) & (F.col("last") >= i)).cast("int") for i, m in enumerate(masks))
    return both.withColumn("last", last).where(agreed == k).select("a", "b", "distance")


def _packed(choice: tuple[int, ...], b: int) -> Column:
    """The chosen blocks of a hash side by side, lowest first; with the choice's number below them they fit 64 bits."""
    out, at = None, 0
    for i in choice:
        low, high = 64 * i // b, 64 * (i + 1) // b
        part = F.shiftrightunsigned("phash", low).bitwiseAND(F.lit(_signed((1 << high - low) - 1)).cast("long"))
        out, at = part if out is None else out.bitwiseOR(F.shiftleft(part, at)), at + high - low
    return out


def hamming_pairs(photos: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """All unordered pairs of photos within a distance: ``path_a < path_b, distance``. Large groups make many pairs; groups don't need them."""
    photos = cut(photos.select("path", "phash"), "photos")  # the pairs and both ends read it
    near = cut(distinct_pairs(photos, distance), "pairs")  # read in both directions
    same = photos.where("phash is not null").select("phash").distinct().select(F.col("phash").alias("a"), F.col("phash").alias("b"), F.lit(0).alias("distance"))
    links = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(same)
    a = photos.select(F.col("phash").alias("a"), F.col("path").alias("path_a"))
    b = photos.select(F.col("phash").alias("b"), F.col("path").alias("path_b"))
    # Half a million photos are a file small enough to be broadcast, and many times that in the driver.
    return links.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where("path_a < path_b").select("path_a", "path_b", "distance")


def components(edges: DataFrame, rounds: int = 100, merge: bool = False) -> DataFrame:
    """``node, root`` over ``a, b``: the smallest value that each node reaches.

    Each round takes the smallest label among neighbours and then the label's own label, so long chains shorten by half.
    ``merge``: labels are never broadcast, however small Spark takes them for.
    """

    def held(labels: DataFrame) -> DataFrame:
        return labels.hint("merge") if merge else labels

    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(held(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(held(near), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut(hooked.join(held(up), "root").select("node", "old", F.least("root", "up").alias("root")), "labels")
        if jumped.where("old <> root").isEmpty():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled(photos: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """All photos with ``group_id``, the smallest path of their group; a photo without neighbours is a group of its own.

    The photos are read several times, so they should be written ones. Nothing of a size that grows with them is broadcast.
    """
    roots = components(distinct_pairs(photos, distance), merge=True).withColumnsRenamed({"node": "__h"})
    keyed = photos.join(roots.hint("merge"), F.col("phash") == F.col("__h"), "left").withColumn("__root", F.coalesce("root", "phash")).drop("root", "__h")
    first = keyed.groupBy("__root").agg(F.min("path").alias("__first"))
    joined = keyed.join(first.withColumnRenamed("__root", "__r").hint("merge"), F.col("__root") == F.col("__r"), "left")
    return joined.withColumn("group_id", F.coalesce("__first", "path")).drop("__root", "__r", "__first")


def groups(photos: DataFrame, distance: int = HASH_DISTANCE) -> DataFrame:
    """``group_id, path, size`` of the groups of two and more."""
    rows = labelled(cut(photos.select("path", "phash"), "photos"), distance).select("group_id", "path")  # hashes and groups read it
    rows = cut(rows, "groups")  # so do the sizes
    sizes = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes.hint("merge"), "group_id").select("group_id", "path", "size")


def best_of_group(rows: DataFrame) -> DataFrame:
    """The row with the largest ``overall`` of each ``group_id``; of equals the smallest path."""
    order = Window.partitionBy("group_id").orderBy(F.col("overall").desc(), "path")
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


