"""Quality rules judged by an isolation forest over rule statistics.

A document's rule statistics (word and line shapes, repetition, signs, letter cases) are one row of numbers. Random
splits isolate an unusual row early, so its path through random trees is short; a row outside the range that a node has
seen is isolated there and then. The trees are fitted on a bounded sample of the labelled good documents
(``FIT_ROWS``, the smallest hashes of ``doc_id``); the threshold on the mean path's score is the one that separates
all labelled rows best, found from counts of scores by label. A document must pass the base rules and the forest.

Nulls: a null text has no words and fails the base rules. Repeated rows are judged each. Without labelled good rows
there is no forest, and without labelled bad rows no threshold: the base rules alone decide. Labels without a
document, null labels and null ids are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framerank.llm.common import cut, trimming

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled good rows that the trees are fitted on at most.
FIT_ROWS = 20_000
TREES, SAMPLE, DEPTH = 200, 256, 8
#: Scores are counted in so many steps to find the threshold.
STEPS = 2000

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
TAIL = bytes(range(0x80, 0xC0))  # bytes after the first of a code point
UPPER = bytes(range(65, 91))
STOPS, OTHERS = b".,;:!?", b"#*$%&|<>=+_/\\^~@[]{}()\"'-"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "stops", "others", "loose_words", "same_words", "line_words")
SCHEMA = ", ".join([f"{c} long" for c in BASE] + ["stats array<double>"])

_MIX = np.random.default_rng(20).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found at least twice, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=len(words))
    if len(seen) == len(words):
        return 0
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums += (ids[k : k + n] + np.uint64(1)) * _MIX[k]
    order = np.argsort(sums, kind="stable")
    equal = sums[order[1:]] == sums[order[:-1]]
    if not equal.any():
        return 0
    # Neighbours of equal sums must be equal windows; otherwise their words are compared as they are.
    a, b = order[1:][equal], order[:-1][equal]
    spans = np.arange(window)
    if (ids[a[:, None] + spans] != ids[b[:, None] + spans]).any():
        count: dict[bytes, list[int]] = {}
        for i in range(n):
            count.setdefault(ids[i : i + window].tobytes(), []).append(i)
        twice = np.array([i for at in count.values() if len(at) > 1 for i in at], dtype=np.int64)
    else:
        twice = np.unique(np.concatenate([a, b]))
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(data: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The base counts and the rule statistics of a text's UTF-8 bytes."""
    words = data.split()
    bare = data.translate(None, SPACE)
    n, n_bytes = len(words), max(1, len(bare))
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    letters = bare.translate(None, TAIL)
    n_symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    dup, rep = len(lines) - len(set(lines)), repeated(words)

    def share(kind: bytes) -> float:
        return (len(bare) - len(bare.translate(None, kind))) / n_bytes

    loose = sum(1 for w in words if len(w) < 4 and not w.isalnum() and w.isascii() and not w.translate(None, STOPS + OTHERS))
    same = sum(1 for a, b in zip(words[1:], words, strict=False) if a == b)
    stats = [len(letters) / max(1, n), n_symbols / max(1, n), dup / max(1, len(lines)), rep / max(1, n), share(UPPER), share(STOPS), share(OTHERS), loose / max(1, n), same / max(1, n), float(np.log1p(n / max(1, len(lines))))]
    return (n, len(letters), n_symbols, dup, rep), stats


def _stat_columns(texts: pa.Array) -> list[pa.Array]:
    rows = [statistics((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts]
    base = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(BASE))]
    return [*base, pa.array([r[1] for r in rows], pa.list_(pa.float64()))]


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts and ``stats`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *_stat_columns(part.column(1))], ["doc_id", *BASE, "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimming(run), f"doc_id long, {SCHEMA}")


@dataclass
class Forest:
    """Trees as arrays over nodes: feature (-1 at a leaf), split, range that was seen, children and path length at the leaf."""

    feature: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    length: np.ndarray
    norm: float
    threshold: float = float("inf")

    @staticmethod
    def fit(rows: np.ndarray, seed: int = 0, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH) -> Forest:
        rng = np.random.default_rng(seed)
        per_tree = 2 ** (depth + 1) - 1
        shape = (trees, per_tree)
        out = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape, dtype=int), np.zeros(shape), _mean_path(min(sample, len(rows))) or 1.0)  # a single row has no mean path
        for t in range(trees):
            part = rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)]
            stack, free = [(0, part, 0)], 1
            while stack:
                node, part, d = stack.pop()
                low, high = part.min(0), part.max(0)
                wide = np.flatnonzero(high > low)
                # A statistic that never varies can still be left by a new row, so it may be drawn too.
                f = int(rng.integers(rows.shape[1])) if d < 3 or not len(wide) else int(rng.choice(wide))
                if d >= depth or len(part) <= 1:
                    out.length[t, node] = d + _mean_path(len(part))
                    continue
                cut_at = rng.uniform(low[f], high[f])
                out.feature[t, node], out.split[t, node], out.low[t, node], out.high[t, node], out.left[t, node] = f, cut_at, low[f], high[f], free
                out.length[t, node] = d + 1
                go = part[:, f] < cut_at if high[f] > low[f] else np.ones(len(part), dtype=bool)
                stack += [(free, part[go], d + 1), (free + 1, part[~go] if (~go).any() else part[:1], d + 1)]
                free += 2
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the shorter the mean path, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(len(self.feature)):
            node, active = np.zeros(len(rows), dtype=int), every
            while len(active):
                at = node[active]
                f = self.feature[t, at]
                inner = f >= 0
                active, at, f = active[inner], at[inner], f[inner]
                x = rows[active, f]
                inside = (x >= self.low[t, at]) & (x <= self.high[t, at])
                active, at, x = active[inside], at[inside], x[inside]
                node[active] = self.left[t, at] + (x >= self.split[t, at]) * (self.low[t, at] < self.high[t, at])
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _mean_path(n: int) -> float:
    """The mean path of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit(described: DataFrame, labels: DataFrame, seed: int = 0, fit_rows: int = FIT_ROWS) -> Forest | None:
    """A forest with its threshold, from the statistics of the labelled documents."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = described.join(marks, "doc_id").select("doc_id", "quality", "stats")
    good = marked.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("stats").toPandas()
    if not len(good):
        return None
    forest = Forest.fit(np.array(good["stats"].tolist()), seed)
    shared = described.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.minimum((_scores(shared.value, batch.column("stats")) * STEPS).astype(np.int32), STEPS)
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(step)], ["quality", "step"])

    counts = marked.select("quality", "stats").mapInArrow(run, "quality int, step int").groupBy("quality", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most two rows a step
    totals = np.zeros((2, STEPS + 1))
    for r in counts.itertuples():
        totals[int(r.quality == 1), r.step] += r.n
    if totals[0].sum() and totals[1].sum():
        # The step that rejects the largest share of the bad rows for the smallest of the good ones; good rows weigh more.
        bad, ok = totals[0][::-1].cumsum()[::-1] / totals[0].sum(), totals[1][::-1].cumsum()[::-1] / totals[1].sum()
        gain = bad - GOOD_WEIGHT * ok
        if (best := gain.max()) > 0:
            near = np.flatnonzero(gain >= best - 1e-12)
            forest.threshold = float(near[len(near) // 2]) / STEPS
    return forest


#: A good document that is rejected counts as so many bad ones that are kept.
GOOD_WEIGHT = 10.0


def _scores(forest: Forest, stats: pa.Array) -> np.ndarray:
    rows = stats.values.to_numpy(zero_copy_only=False)[stats.offsets[0].as_py() : stats.offsets[-1].as_py()]
    return forest.score(rows.reshape(-1, len(STATS)))


def verdicts(described: DataFrame, forest: Forest | None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and ``score``."""
    shared = described.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(shared.value, batch.column("stats")) if shared.value and batch.num_rows else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *BASE)], pa.array(score)], ["doc_id", *BASE, "score"])

    out = described.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", score double")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    limit = forest.threshold if forest else float("inf")
    return out.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("score") < F.lit(limit))).alias("kept"), "score")


def judge(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """Every document's counts and verdict. The texts are read once."""
    described = cut(describe(docs), "stats")
    return verdicts(described, fit(described, labels, seed))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The documents that are kept, with their columns.

    The statistics are computed once for the fit and once more beside the text, which is cheaper than a join of
    all texts with their verdicts.
    """
    forest = fit(cut(describe(docs), "stats"), labels, seed)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, _, _, _, rep, stats = _stat_columns(part.column("text"))
                n, rep = n.to_numpy(), rep.to_numpy()
                kept = (n >= MIN_WORDS) & (rep * 100 <= n * MAX_REPEAT_PERCENT)
                if shared.value:
                    kept &= _scores(shared.value, stats) < shared.value.threshold
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(trimming(run), docs.schema)
