"""Files written here, listed, decoded and scanned, in batch and as a stream."""

import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from framerank.session import Session
from framerank.sources import files as fs
from framerank.sources import kernel as k
from framerank.streaming import scan as st


def png(rgb, kind=2, how=(0,)):
    """A PNG whose rows use the filters ``how`` in turn."""
    h, w = rgb.shape[:2]
    rows = rgb.astype(np.int64).reshape(h, w, -1)
    left, above = np.pad(rows, ((0, 0), (1, 0), (0, 0)))[:, :-1], np.pad(rows, ((1, 0), (0, 0), (0, 0)))[:-1]
    corner = np.pad(rows, ((1, 0), (1, 0), (0, 0)))[:-1, :-1]
    guess = left + above - corner
    far = [np.abs(guess - x) for x in (left, above, corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    by = [rows * 0, left, above, (left + above) // 2, paeth]
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    raw = b"".join(bytes([how[y % len(how)]]) + ((rows[y] - by[how[y % len(how)]][y]) & 255).astype(np.uint8).tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    im = rng.integers(0, 256, (20, 30, 3))
    (tmp_path / "disqualified").mkdir()
    (tmp_path / "sub").mkdir()
    for name, data in {"a b.png": png(im), "c.PNG": png(im), "rgba.png": png(np.dstack([im, im[..., :1]]), 6), "gray.png": png(im[..., 0], 0), "bad.jpg": b"no", "note.txt": b"x", "disqualified/z.png": png(im), "sub/d.png": png(im)}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, im


def test_listing_prunes_filters_and_dedupes(spark, folder):
    root, _ = folder
    paths = sorted(r["path"].removeprefix(f"{root}/") for r in fs.listing(spark, [str(root), str(root / "sub")]).select("path").collect())
    assert paths == ["a b.png", "bad.jpg", "c.PNG", "gray.png", "rgba.png", "sub/d.png"]
    assert fs.listing(spark, [str(root / "disqualified")]).count() == 0
    assert fs.found_count(fs.listing(spark, [str(root)], recursive=False)).first()["found"] == 5


def test_scan_keeps_failures_apart(spark, folder):
    root, im = folder
    rows = {r["path"].removeprefix(f"{root}/"): r for r in fs.scan(fs.listing(spark, [str(root)]), with_thumbs=True).collect()}
    assert rows["bad.jpg"]["error"] and rows["bad.jpg"]["score"] is None
    a, c = rows["a b.png"], rows["c.PNG"]
    assert a["phash"] == c["phash"] and a["error"] is None and a["thumb"]["w"] == 220 and len(a["thumb"]["rgb"]) == 220 * a["thumb"]["h"] * 3
    assert a["metrics"]["subject"] is None and a["mode"] in ("Landscape", "Object")
    again = fs.recompute(fs.listing(spark, [str(root)]), spark.createDataFrame([(a["path"], "Portrait")], "path string, mode string")).collect()
    assert [(r["path"], r["mode"]) for r in again] == [(a["path"], "Portrait")]
    assert fs.previews(fs.listing(spark, [str(root / "sub")]), 60).first()["w"] == 60


def test_report_has_both_methods(spark, folder):
    root, _ = folder
    lines = {r["path"].rsplit("/", 1)[-1]: r["line"] for r in fs.report(fs.listing(spark, [str(root)])).collect()}
    assert lines["bad.jpg"].startswith("bad.jpg: ERR ") and lines["a b.png"].startswith("a b.png: OK 1600x1067 mode=") and "sharpest_region=" in lines["a b.png"] and lines["a b.png"].endswith("ms)")


def test_session_from_scan_to_move(spark, folder):
    root, _ = folder
    s = Session(spark, [str(root)], threshold=0.0)
    assert s.scan().count() == 5 and s.errors.count() == 1 and s.rank().count() >= 1
    one = s.catalog.where("path like '%c.PNG'").select("path")
    s.mark(one, True)
    s.override_modes(one.withColumn("mode", F.lit("Portrait")))
    assert s.flagged().count() == 1
    with pytest.raises(ValueError):
        s.move()
    s.recompute()
    assert s.catalog.where("dirty").count() == 0 and s.catalog.where("mode = 'Portrait' and mode_scored = 'Portrait'").count() == 1
    assert s.move().first()["failed"] == 1 and (root / "c.PNG").exists()  # a dry run
    done = s.move(really=True).first()
    assert done["moved"] == 1 and (root / "disqualified" / "c.PNG").exists() and not (root / "c.PNG").exists() and s.catalog.count() == 4
    first = s.scan_id
    assert s.scan().where("manual_dq is not null or dirty").count() == 0 and s.catalog.count() == 4 and s.scan_id != first


def test_decoders_agree(folder):
    _, im = folder
    assert np.array_equal(k.decode_png(png(im)), im)
    row = (30 * 3 + 3) // 4 * 4
    body = b"".join(im[y, :, ::-1].astype(np.uint8).tobytes().ljust(row, b"\0") for y in range(19, -1, -1))
    assert np.array_equal(k.decode_bmp(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 30, 20, 1, 24, 0, 0, 0, 0, 0, 0) + body), im)


@pytest.mark.parametrize("how", [(0,), (1,), (2,), (3,), (4,), (4, 0, 3, 2, 1, 4)])
def test_png_filters(folder, how):
    _, im = folder
    smooth = np.add.outer(np.arange(20) * 3, np.arange(30) * 5)[..., None] + np.array([0, 9, 40])
    for px in (im, smooth % 256):
        assert np.array_equal(k.decode_png(png(px, how=how)), px)
        assert np.array_equal(k.decode_png(png(np.dstack([px, px[..., :1]]), 6, how)), px)
    assert np.array_equal(k.decode_png(png(im[..., 0], 0, how)), np.repeat(im[..., :1], 3, axis=2))


def test_previews_in_containers():
    segment = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    stream = lambda body, coded: b"\xff\xd8" + body + segment(0xDA, b"\1\2\3") + coded + b"\xff\xd9"
    thumb = stream(segment(0xE0, b"JFIF"), b"ab\xff\0c")
    outer = stream(segment(0xE1, b"Exif" + thumb), b"x" * 400 + b"\xff\xd3" + b"y" * 90)
    found = k.embedded_jpegs(b"II*\0" + thumb[:-1] + outer + b"tail")
    assert found[0] == outer and thumb in found and k.embedded_jpegs(outer[:-3]) == [thumb]


def test_resize_matches_full_weights():
    rng = np.random.default_rng(4)
    for h, w, nh, nw in ((20, 30, 8, 9), (7, 5, 15, 11), (40, 3, 1, 3), (16, 16, 16, 4), (1, 1, 3, 2)):
        px = rng.integers(0, 256, (h, w, 3)).astype(np.uint8)
        full = px.astype(float)
        for axis, (old, new) in enumerate(((h, nh), (w, nw))):
            middle, reach = (np.arange(new) + 0.5) * old / new, max(old / new, 1.0)
            weights = np.maximum(1 - np.abs(np.arange(old)[None, :] + 0.5 - middle[:, None]) / reach, 0)
            full = np.moveaxis(np.tensordot(weights / weights.sum(1, keepdims=True), full, (1, axis)), 0, axis)
        assert np.abs(k.resize(px, nw, nh).astype(int) - np.clip(np.floor(full + 0.5), 0, 255)).max() <= 1


def test_resize_keeps_flat_colours_and_fits():
    flat = np.full((10, 40, 3), 77, np.uint8)
    assert np.all(k.resize(flat, 9, 8) == 77) and k.fit(flat, 20).shape == (5, 20, 3) and k.fit(flat, 80).shape == (20, 80, 3)
    ramp = np.repeat(np.arange(90, 0, -10)[None, :, None], 8, 0) * np.ones(3, int)
    assert k.dhash(ramp.astype(np.uint8)) == -1


def test_stream_scans_once(spark, folder):
    root, _ = folder
    q = st.scan_folder(spark, str(root)).writeStream.format("memory").queryName("scanned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scanned").count() == 6 and spark.table("scanned").where("error is not null").count() == 1
