"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds the hash of each of its prefixes: ``P[i] = sum(c[j] * B**j for j < i)``, modulo two primes
below 2**31, which keep every product and every running sum within 64 bits, so that whole arrays are computed at
once. The hash of any span follows from two entries; equal spans are found by comparing ``P[j] - P[i]`` shifted to a
common power, and the longest common extension of two positions by binary search.

A fingerprint keeps a text's length, the hash of all of it, the hashes of its prefixes and suffixes whose lengths
are on a fixed ladder, and the lengths and hashes of spans that the text's own contents bound: a span begins where the hash of
``GRAM`` code points is the least within ``REACH`` places on both sides, so equal passages are cut alike wherever they
stand. Two fingerprints are compared as the arrays are, by binary search over the rungs that both have: the longest common
prefix and suffix, and between them the equal spans, as a share of the longer text. An edit costs the span that it is in,
and sometimes one beside it.

Nulls: a null text is empty. Documents are in descending order of ``doc_id``, nulls last, rows that repeat an id by a
hash of their text and then the text; the one after the last is the first, also where there is only one. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two primes and a base for each.
PRIMES = ((2_147_483_647, 1_000_003_919), (2_147_483_629, 789_190_703))

#: Code points of a bucket of documents, about, and the most buckets; beyond, buckets are larger.
BUCKET_CHARS, MOST_BUCKETS = 4_000_000, 20_000

#: Code points whose hash decides on a span's begin, and places on either side that it is compared with.
GRAM, REACH = 8, 16


def rungs(n: int) -> list[int]:
    """The ladder's lengths up to ``n``: about a fifth apart."""
    out, at = [], 1
    while at <= n:
        out.append(at)
        at = max(at + 1, math.ceil(at * 1.19))
    return out


class Powers:
    """Powers of the bases, as far as a text has needed them."""

    def __init__(self, bases: tuple[tuple[int, int], ...] = PRIMES):
        self.bases = bases
        self.of = [np.ones(1, dtype=np.int64) for _ in bases]

    def upto(self, n: int) -> list[np.ndarray]:
        for k, (prime, base) in enumerate(self.bases):
            while len(self.of[k]) <= n:
                have = self.of[k]
                self.of[k] = np.concatenate([have, have * pow(base, len(have), prime) % prime])
        return self.of


POWERS = Powers()
#: Of the first base's inverse.
INVERSES = Powers(((PRIMES[0][0], pow(PRIMES[0][1], -1, PRIMES[0][0])),))


class PrefixHash:
    """Prefix arrays of one text, in code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        self.n = len(points)
        powers = POWERS.upto(self.n)
        self.prefix = []
        for (prime, _), power in zip(PRIMES, powers, strict=True):
            sums = np.zeros(self.n + 1, dtype=np.int64)
            np.cumsum(points * power[: self.n] % prime, out=sums[1:])
            self.prefix.append(sums % prime)

    def _lifted(self, i: int, j: int, by: int) -> tuple[int, ...]:
        return tuple(int(p[j] - p[i]) % prime * int(w[by]) % prime for p, (prime, _), w in zip(self.prefix, PRIMES, POWERS.of, strict=True))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """The hash of the code points from ``i`` to ``j``, wherever they stand."""
        back = [pow(base, -i, prime) for prime, base in PRIMES]
        return tuple(int(p[j] - p[i]) % prime * b % prime for p, (prime, _), b in zip(self.prefix, PRIMES, back, strict=True))

    def same(self, i: int, other: PrefixHash, k: int, length: int) -> bool:
        """Whether the spans of a length at ``i`` here and at ``k`` in ``other`` are equal."""
        if i + length > self.n or k + length > other.n:
            return False
        POWERS.upto(max(i, k))
        return self._lifted(i, i + length, k) == other._lifted(k, k + length, i)

    def extension(self, i: int, other: PrefixHash, k: int) -> int:
        """The longest common extension of position ``i`` here and ``k`` in ``other``."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, k, middle) else (low, middle - 1)
        return low

    def anchored(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and hashes, by the first prime, of the spans that the contents bound; together they are the text."""
        prime, p, back = PRIMES[0][0], self.prefix[0], INVERSES.upto(self.n)[0]
        cuts = np.zeros(0, dtype=np.int64)
        if self.n >= GRAM:
            grams = (p[GRAM:] - p[:-GRAM]) % prime * back[: self.n - GRAM + 1] % prime
            least = np.pad(grams, REACH, constant_values=prime)
            width = 1
            while width < REACH:
                least, width = np.minimum(least[:-width], least[width:]), 2 * width
            # The least of the REACH places before each, and of those after it; of equal ones in reach, the first counts.
            cuts = np.flatnonzero((grams < least[: len(grams)]) & (grams <= least[REACH + 1 :]))
        at = np.unique(np.concatenate([[0], cuts, [self.n]]).astype(np.int64))
        return np.diff(at), (p[at[1:]] - p[at[:-1]]) % prime * back[at[:-1]] % prime

    def fingerprint(self) -> str:
        """``length:hash of the text:hashes of the ladder's prefixes:of its suffixes:of the anchored spans:their lengths``, in hexadecimal.

        A suffix hash is brought to a common power by the inverse of its start's power.
        """
        whole = "".join(f"{int(p[-1]):08x}" for p in self.prefix)
        at = np.array(rungs(self.n), dtype=np.int64)
        prime, base = PRIMES[0]
        p, power = self.prefix[0], POWERS.of[0]
        heads = p[at]
        # P[n] - P[n - l] is B**(n - l) times the suffix's hash; times B**l it is B**n times it, and B**-n is one number.
        tails = (p[-1] - p[self.n - at]) % prime * power[at] % prime * pow(base, -self.n, prime) % prime
        lengths, spans = self.anchored()
        return f"{self.n:x}:{whole}:{heads.astype('>u4').tobytes().hex()}:{tails.astype('>u4').tobytes().hex()}:{spans.astype('>u4').tobytes().hex()}:{','.join(f'{x:x}' for x in lengths.tolist())}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1: common prefix and suffix, as far as the ladder tells, and equal spans between them, over the longer length. Equal fingerprints give 1."""
    if a == b:
        return 1.0
    (n_a, _, heads_a, tails_a, *spans_a), (n_b, _, heads_b, tails_b, *spans_b) = a.split(":"), b.split(":")
    n, most = min(int(n_a, 16), int(n_b, 16)), max(int(n_a, 16), int(n_b, 16))
    at = rungs(n)

    def common(x: str, y: str) -> int:
        low, high = 0, len(at)
        while low < high:  # equal prefixes have equal prefixes, so the rungs that agree come first
            middle = (low + high + 1) // 2
            low, high = (middle, high) if x[8 * (middle - 1) : 8 * middle] == y[8 * (middle - 1) : 8 * middle] else (low, middle - 1)
        return at[low - 1] if low else 0

    head, tail = common(heads_a, heads_b), common(tails_a, tails_b)
    same = head + tail
    if same < n:
        equal = _between(*spans_a, head, int(n_a, 16) - tail) & _between(*spans_b, head, int(n_b, 16) - tail)
        same += sum(length * k for (length, _), k in equal.items())
    return min(same, n) / most if most else 1.0


def _between(hashes: str, lengths: str, start: int, end: int) -> Counter[tuple[int, str]]:
    """Lengths and hashes of the spans that lie from ``start`` to ``end``."""
    out, at = [], 0
    for k, length in enumerate(int(x, 16) for x in lengths.split(",")):
        if at >= start and at + length <= end:
            out.append((length, hashes[8 * k : 8 * k + 8]))
        at += length
    return Counter(out)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the next document's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """``bucket, doc_id, text, guest``, and the number of buckets: buckets are ranges of ``doc_id``; each also has, as guests, the documents that the next one starts with.

    The bounds are quantiles of the ids, as many as the texts' length asks for. Each text goes through the
    shuffle once, and once more if it starts a bucket. Rows without an id, or with the same one, are one bucket.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    count = int(min(MOST_BUCKETS, max(2, math.ceil(chars / BUCKET_CHARS))))
    found = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], 10 * MOST_BUCKETS)).first()[0]
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        return pd.Series(np.where(known, 1 + np.searchsorted(bounds, ids.fillna(0).astype("int64"), side="right"), 0), dtype="int32")

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), bucket_of("doc_id").alias("bucket"))
    heads = {r["bucket"]: r["head"] for r in docs.select(bucket_of("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # one row a bucket
    there = sorted(heads, reverse=True)
    if not heads:
        return rows.withColumn("guest", F.lit(False)).limit(0), 1
    # Of each bucket its first document and the bucket before; the first one's documents follow the last document.
    table = docs.sparkSession.createDataFrame([(b, heads[b], there[i - 1]) for i, b in enumerate(there)], "__b int, head long, before int")
    placed = rows.join(F.broadcast(table), F.col("bucket") == F.col("__b"))  # at most MOST_BUCKETS rows are broadcast
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    # One copy of a text, two places: the text isn't multiplied before the rows are dealt out.
    spread = placed.withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, visit)).otherwise(F.array(own))))
    return spread.select("to.bucket", "doc_id", "text", "to.guest"), len(bounds) + 2


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document of ``doc_id, text``: its length, its edited text's hash, both fingerprints, and the likeness to the edited text and the next document."""
    dealt, buckets = in_order(docs)
    dealt = dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def follow() -> Iterator[tuple]:
            last = None
            for batch in batches:
                for bucket, doc_id, text, guest in zip(*(batch.column(i) for i in range(4)), strict=True):
                    bucket, guest, text = bucket.as_py(), guest.as_py(), text.as_py()
                    print_ = None
                    if last is not None and last[0] == bucket and not last[3]:
                        print_ = PrefixHash(text).fingerprint()
                        yield *last[1:3], last[4] or PrefixHash(last[2]).fingerprint(), text, print_
                    last = (bucket, doc_id.as_py(), text, guest, print_)

        out: list[tuple] = []
        held = 0
        for doc_id, text, own, following, next_print in follow():
            new = edited(text, following)
            changed = PrefixHash(new).fingerprint() if new != text else own
            out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)))
            held += len(own) + len(changed)
            if len(out) >= 2000 or held >= 8_000_000:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
