import itertools
import math
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framerank.llm import mixing, rendezvous


def test_shards_follow_the_key_and_grow_in_place(docs, empty, sample):
    for table in (docs, sample):
        rows = rendezvous.shard_documents(table).toPandas()
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
        moved = rows[rows["shard"] != rows["grown_shard"]]
        assert set(moved["grown_shard"]) <= {16} and rows.groupby("doc_id")["shard"].nunique().max() == 1
        text = {r.doc_id: r.text or "" for r in table.collect()}
        for r in rows.dropna(subset="doc_id").itertuples():
            assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    assert rendezvous.shard_documents(empty).count() == 0


def test_weights_set_the_shares(spark):
    rows = spark.range(20_000).select(rendezvous.shard_of([F.col("id")], [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in rows}[1] == pytest.approx(15_000, rel=0.03)
    with pytest.raises(ValueError):
        rendezvous.shard_of([F.col("id")], [1.0, 0.0])


def test_shards_match_a_plain_rendezvous(spark):
    """Every shard's draw in plain Python; the least wins."""
    weights, added, rows = [1.0, 2.0, 0.5, 4.0], [1.5], spark.range(-50, 2000, 3).withColumnRenamed("id", "doc_id")

    def draw(key, shard, weight):
        h = 42
        for kind, x in (("<i", 7), ("<i", shard), ("<q", key)):
            h = xxhash.xxh64_intdigest(struct.pack(kind, x), seed=h)
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    for r in rendezvous.assign(rows, ["doc_id"], weights, added, seed=7).collect():
        draws = [draw(r.doc_id, i, w) for i, w in enumerate(weights + added)]
        assert (r.shard, r.grown_shard) == (draws.index(min(draws[:4])), draws.index(min(draws)))
    wide = rendezvous.shard_documents(rows.withColumn("text", F.lit("x")), shards=3).toPandas()
    assert set(wide["shard"]) == {0, 1, 2} and all(sorted(g["slot"]) == list(range(len(g))) for _, g in wide.groupby("shard"))


def test_every_length_is_given_back_where_the_budget_needs_it():
    lengths = np.array([2, *range(101, 301)])  # 201 lengths: the shortest 64 alone can't make up for a remainder of 1
    counts = np.ones(201, dtype=np.int64)
    for budget in (20_001, 20_003, 33_333, 3):
        got = int((mixing.fill(lengths, counts, budget) * lengths).sum())
        assert got == (budget if budget > 3 else 2)
    assert (mixing.fill(np.array([4, 6, 10]), np.array([50, 50, 50]), 333) * np.array([4, 6, 10])).sum() == 332


@pytest.mark.parametrize("seed", range(30))
def test_filling_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
    counts = rng.integers(1, 4, 4)
    sums = {int((np.array(c) * lengths).sum()) for c in itertools.product(*(range(n + 1) for n in counts))}
    for budget in range(int((lengths * counts).sum()) + 2):
        taken = mixing.knapsack(lengths, counts, budget)
        assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)
        taken = mixing.fill(lengths, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (taken * lengths).sum() <= budget
        assert (taken * lengths).sum() >= max(s for s in sums if s <= budget) - lengths.max()  # shares first, so not always the best


def plain_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mix_meets_its_targets(docs, empty, sample):
    for table in (docs, sample):
        source = {(r.doc_id, len((r.text or "").split())): r.source for r in table.collect()}
        rows = mixing.mix(table).collect()
        sizes, taken, target = {}, {}, {}
        for r in rows:
            s = source[r.doc_id, r.size]
            sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        want = plain_targets(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            assert taken[s] <= target[s] + 1
        again = sorted((str(r.doc_id), r.taken) for r in mixing.mix(table).collect())
        assert again == sorted((str(r.doc_id), r.taken) for r in rows)
    assert max(abs(taken[s] - target[s]) for s in sizes) < max(r.size for r in rows)  # ten documents a source can't fill every sum
    assert mixing.mix(empty).count() == 0


def test_taken_rows_repeat_documents(docs):
    n = {}
    for r in mixing.taken_rows(docs).collect():
        n[r.doc_id, r.text] = n.get((r.doc_id, r.text), 0) + 1
    assert sum(len(t.split()) * k for (_, t), k in n.items()) == sum(r.taken for r in mixing.mix(docs).collect())
    assert mixing.taken_rows(docs).columns == docs.columns
