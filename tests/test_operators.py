"""Groups, boxes, overlays, moves and the funnel, against plain Python where there is something to compare."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framerank.operators import boxes as bx
from framerank.operators import dedupe, moves, overlay, rank
from framerank.sources import kernel as k


def brute_groups(rows, d):
    root = {p: p for p, _ in rows}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, (p, a) in enumerate(rows):
        for q, b in rows[:i]:
            if (a ^ b).bit_count() <= d:
                x, y = sorted((top(p), top(q)))
                root[y] = x
    out = {}
    for p, _ in rows:
        out.setdefault(top(p), []).append(p)
    return sorted(sorted(v) for v in out.values() if len(v) > 1)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("hashes", "sizes"), [({"a": 0, "b": 1, "c": 255}, [2]), ({"a": 0, "b": 3, "c": 15}, [3])])
def test_groups_of_the_first_examples(spark, hashes, sizes):
    df = spark.createDataFrame(list(hashes.items()), "path string, phash long")
    assert [r["size"] for r in dedupe.groups(df, 2).select("group_id", "size").distinct().collect()] == sizes


def test_key_tables_are_not_broadcast(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(signed(rng.getrandbits(64)),) for _ in range(500)], "phash long")
    plan = dedupe.distinct_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


@pytest.mark.parametrize("distance", range(16))
def test_keys_of_all_choices_fit_a_long(distance):
    for n in (10, 10_000, 1_000_000, 100_000_000):
        if b := dedupe.blocks(distance, n):
            choices = list(itertools.combinations(range(b), b - distance))
            bits = max(sum(64 * (i + 1) // b - 64 * i // b for i in c) for c in choices)
            assert bits + (len(choices) - 1).bit_length() <= 64


@pytest.mark.parametrize("distance", [0, 3, 6, 20])
def test_groups_match_all_pairs(spark, distance):
    rng = random.Random(distance)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(120):
        h = rng.choice(seeds)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        rows.append((f"p{i:03}", h))
    df = spark.createDataFrame([(p, signed(h)) for p, h in rows], "path string, phash long")
    got = {}
    for r in dedupe.groups(df, distance).collect():
        got.setdefault(r["group_id"], []).append(r["path"])
    assert sorted(sorted(v) for v in got.values()) == brute_groups(rows, distance)
    pairs = {(r[0], r[1]) for r in dedupe.hamming_pairs(df, distance).collect()}
    assert pairs == {(p, q) for i, (p, a) in enumerate(rows) for q, b in rows[i + 1 :] if (a ^ b).bit_count() <= distance}


def test_no_photos_and_no_hashes(spark):
    none = spark.createDataFrame([], "path string, phash long")
    assert dedupe.groups(none).count() == 0
    nulls = spark.createDataFrame([("a", None), ("b", None)], "path string, phash long")
    assert sorted((r["path"], r["group_id"]) for r in dedupe.labelled(nulls).collect()) == [("a", "a"), ("b", "b")]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in dedupe.components(edges).collect()} == {0}


def test_reject_paths(spark):
    def dst(roots, path):
        return spark.range(1).select(moves.reject_path(F.lit(path), roots)).first()[0]

    assert dst(["/a", "/b/trip"], "/a/sub/x.jpg") == "/a/disqualified/sub/x.jpg"
    assert dst(["/a", "/b/trip"], "/b/trip/y.jpg") == "/b/trip/disqualified/y.jpg"
    assert dst(["/a", "/b/trip"], "/c/z.jpg") is None
    assert dst(["/a", "/a/inner"], "/a/inner/x.jpg") == "/a/inner/disqualified/x.jpg"
    assert dst(["/a"], "/ab/x.jpg") is None and dst(["/a_b"], "/aXb/x.jpg") is None


def test_moves_refuse_to_overwrite(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.png").write_text(n)
    (tmp_path / "disqualified").mkdir()
    (tmp_path / "disqualified/b.png").write_text("old")
    rows = spark.createDataFrame([(str(tmp_path / f"{n}.png"), str(tmp_path / f"disqualified/{n}.png")) for n in "ab"], "src string, dst string")
    assert {r["error"] for r in moves.execute(rows).collect()} == {"dry run"}
    done = spark.createDataFrame(moves.execute(rows, really=True).collect(), "src string, dst string, error string")
    assert (tmp_path / "disqualified/a.png").read_text() == "a" and (tmp_path / "disqualified/b.png").read_text() == "old"
    assert moves.summary(done).first()["message"] == "Moved 1 to disqualified/, 1 failed"


def test_priors_and_grid(spark):
    p = bx.face_priors(spark).orderBy("prior").toPandas()
    assert p["prior"].tolist() == list(range(4420)) and np.allclose(p[["cx", "cy", "w", "h"]].to_numpy(), k.priors())
    g = bx.animal_grid(spark).orderBy("cell").toPandas()
    assert g["cell"].tolist() == list(range(3549)) and np.array_equal(g[["gx", "gy", "stride"]].to_numpy(np.float32), k.cells())


def test_nms_matches_the_kernel(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for photo in range(12):
        at = rng.integers(0, 60, (25, 2)).astype(float)
        b = np.concatenate([at, at + rng.integers(5, 40, (25, 2))], 1)
        s = rng.integers(0, 20, 25) / 20
        rows += [(photo, i, float(s[i]), *map(float, b[i])) for i in range(25)]
        want |= {(photo, i) for i in k.suppressed(s, b)}
    df = spark.createDataFrame(rows, "photo_id long, box_id long, score float, x1 float, y1 float, x2 float, y2 float")
    assert {(r["photo_id"], r["box_id"]) for r in bx.nms(df).collect()} == want


def test_funnel_does_not_depend_on_order(spark):
    rng = random.Random(5)
    rows = [(f"/p/{i:03}", float(rng.randint(0, 90)), *[float(rng.randint(0, 3)) for _ in range(4)], rng.choice([None, 1.0]), rng.choice([None, True, False]), signed(rng.choice([3, 0xFFFF0, 0xFFFF << 40, 1 << 63 | 0xFFF << 24]))) for i in range(80)]
    schema = "path string, score double, exposure double, contrast double, color double, composition double, subject double, manual_dq boolean, phash long"
    results = []
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, schema)
        results.append([(r["path"], r["place"]) for r in rank.rank(df, n=10).orderBy("place").collect()])
        assert rank.funnel_counts(df, n=2).first()["shortlist"] == 2
    assert results[0] == results[1] and results[0]


def test_overlays(spark):
    c = spark.createDataFrame([("a", "Object", 10.0, None), ("b", "Object", 50.0, None), ("c", "Portrait", 10.0, True)], "path string, mode string, score double, manual_dq boolean")
    marked = {r["path"]: r["manual_dq"] for r in overlay.mark(c, c.where("path <> 'c'"), True).collect()}
    assert marked == {"a": None, "b": True, "c": True}
    over = overlay.override_modes(c, spark.createDataFrame([("a", "Animal"), ("b", "Object")], "path string, mode string"))
    assert {r["path"] for r in overlay.dirty_rows(over).collect()} == {"a"}
    late = spark.createDataFrame([("a", "Landscape", 1.0)], "path string, mode string, score double")
    assert overlay.dirty_rows(overlay.merge_scores(over, late)).count() == 1  # scored for a mode that it no longer has
    s = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r["path"] for r in overlay.toggle(s, s.where("path = 'a'")).collect()] == ["b"]
    assert sorted(r["path"] for r in overlay.select_range(c, [F.col("score"), F.col("path")], "b", "c").collect()) == ["b", "c"]
    paths = lambda df: sorted(r["path"] for r in df.collect())
    # An end that isn't visible: the click counts alone, or toggles.
    assert paths(overlay.select_range(c, [F.col("path")], "zz", "b")) == ["b"] == paths(overlay.select_range(c, [F.col("path")], None, "b"))
    assert paths(overlay.select_range(c, [F.col("path")], "zz", "b", s)) == ["a"]
    assert paths(overlay.select_range(c, [F.col("path")], "b", "c", s)) == ["a", "b", "c"]


@pytest.mark.parametrize("b", [7, 8, 10])
def test_choices_of_blocks_find_each_pair_once(spark, monkeypatch, b):
    rng = random.Random(b)
    hashes = {rng.getrandbits(64) - (1 << 63) for _ in range(40)}
    for h in list(hashes):
        for _ in range(4):
            near = h + (1 << 63)
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                near ^= 1 << bit
            hashes.add(near - (1 << 63))
    monkeypatch.setattr(dedupe, "blocks", lambda distance, n: b)
    found = [(r["a"], r["b"], r["distance"]) for r in dedupe.distinct_pairs(spark.createDataFrame([(h,) for h in hashes], "phash long"), 6).collect()]
    want = {(x, y, d) for x in hashes for y in hashes if x < y and (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= 6}
    assert len(found) == len(set(found)) and set(found) == want


def test_more_hashes_take_more_blocks():
    chosen = [dedupe.blocks(6, n) for n in (10, 10_000, 1_000_000, 100_000_000)]
    assert chosen == sorted(chosen) and chosen[0] == 7 and chosen[-1] > 8
    assert dedupe.blocks(40, 1000) is None and dedupe.blocks(0, 1000) == 1


def test_places_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id % 37 AS k", "id").repartition(7)
    got = [(r["k"], r["id"]) for r in sorted(rank.numbered(rows, [F.col("k").desc(), F.col("id")], "place").collect(), key=lambda r: r["place"])]
    assert got == sorted(((i % 37, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert rank.numbered(rows.where("false"), [F.col("k")], "place").count() == 0


def test_hamming_pairs_broadcast_no_photos(spark):
    photos = spark.createDataFrame([(f"p{i}", i // 2) for i in range(20)], "path string, phash long")
    pairs = dedupe.hamming_pairs(photos, 0)
    assert sorted((r.path_a, r.path_b) for r in pairs.collect()) == sorted(tuple(sorted((f"p{i}", f"p{i + 1}"))) for i in range(0, 20, 2))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
