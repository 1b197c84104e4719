"""Scores, predicates and pixel formulas: fixed examples, and the two formulations against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framerank.functions import pixels as px
from framerank.functions import scores as sc
from framerank.schema import WEIGHTS, checked
from framerank.sources import kernel as k


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_hamming_counts_differing_bits(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 15, 4), (-1, 0, 64)], "a long, b long, d int")
    assert rows.where(sc.hamming(F.col("a"), F.col("b")) != F.col("d")).count() == 0


@pytest.mark.parametrize(("path", "raw", "standard"), [("/a/x.CR2", True, False), ("/a/x.jpeg", False, True), ("/a/.jpg", False, False), ("/a/x", False, False), ("/a.png/x", False, False), ("/a/x.heic", False, False), ("x.tar.Png", False, True)])
def test_extensions(spark, path, raw, standard):
    assert tuple(one(spark, sc.is_raw(F.lit(path)), sc.is_standard(F.lit(path)))) == (raw, standard)


def test_overall_leaves_out_what_is_missing(spark):
    values = {n: F.lit(50.0) for n in WEIGHTS} | {"subject": F.lit(None).cast("double"), "exposure": F.lit(100.0)}
    assert one(spark, sc.overall_score(values))[0] == pytest.approx((0.7 * 50 + 0.15 * 100) / 0.85)
    assert one(spark, sc.overall_score(values, dict.fromkeys(WEIGHTS, 0.0)))[0] == 0


def test_manual_mark_wins(spark):
    rows = spark.createDataFrame([(10.0, None, True), (10.0, False, False), (32.0, None, True), (33.0, None, False), (90.0, True, True)], "score double, m boolean, want boolean")
    assert rows.where(sc.is_disqualified(F.col("score"), F.col("m")) != F.col("want")).count() == 0


@pytest.mark.parametrize("bad", [{"threshold": -1}, {"distance": 65}, {"top_n": 0}, {"weights": {"sharpness": 1}}, {"mode": "x"}, {"method": "x"}])
def test_domains(bad):
    with pytest.raises(ValueError):
        checked(**bad)


def frame(spark, images):
    rows = [(i, x, y, *map(int, im[y, x])) for i, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "photo_id long, x int, y int, r int, g int, b int")


def test_relational_and_numpy_forms_agree(spark):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, s + (3,)) for s in ((1, 1), (3, 5), (20, 33), (9, 40))] + [np.full((12, 12, 3), 120)]
    gray = px.with_gray(frame(spark, images)).cache()
    want = {i: (k.luma(im), im) for i, im in enumerate(images)}

    def got(df, col):
        return {r["photo_id"]: r[col] for r in df.collect()}

    for i, v in got(px.variance_of_laplacian(gray), "vol").items():
        assert v == pytest.approx(k.variance_of_laplacian(want[i][0]), abs=1e-6)
    for i, v in got(px.variance_of_laplacian(px.center_crop(gray, 0.45)), "vol").items():
        assert v == pytest.approx(k.variance_of_laplacian(k.center_crop(want[i][0], 0.45)), abs=1e-6)
    for i, v in got(px.sharpest_region(gray), "score").items():
        assert v == pytest.approx(k.sharpest_region(want[i][0]), abs=1e-6)
    parts = {i: k.factors(im, g, 10.0, None) for i, (g, im) in want.items()}
    for df, names in ((px.tone_scores(gray), ("exposure", "contrast")), (px.color_score(gray), ("color",)), (px.composition_score(gray), ("composition",))):
        for n in names:
            for i, v in got(df, n).items():
                assert v == pytest.approx(parts[i][n], abs=1e-6), (n, i)


def test_orientation_matches_the_kernel(spark):
    im = np.arange(3 * 5 * 3).reshape(3, 5, 3)
    for tag in range(10):
        rows = px.oriented(frame(spark, [im]), F.lit(tag)).collect()
        want = k.orient(im, tag)
        assert {(r["x"], r["y"]): r["r"] for r in rows} == {(x, y): want[y, x, 0] for y in range(want.shape[0]) for x in range(want.shape[1])}


def test_sharpest_region_finds_what_the_centre_misses():
    y, x = np.mgrid[0:480, 0:640]
    im = np.where(((x < 80) & (y < 80) & ((x // 4 + y // 4) % 2 == 0))[..., None], 230, 100) * np.ones(3, int)
    g = k.luma(im)
    assert k.score(g, "Object", None, "FixedRegion") < 1 < 100 < k.score(g, "Object", None, "SharpestRegion")
    assert k.sharpest_region(np.full((480, 640), 120)) < 1
