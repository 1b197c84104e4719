"""Registered queries and, where SQL can express them, their oracles.

A query is a function of the session and the tables' folder; ``register`` puts its oracle beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framerank.functions import pixels as px
from framerank.functions import scores as sc
from framerank.operators import boxes as bx
from framerank.operators import dedupe, moves, overlay, rank
from framerank.operators.cuts import cut
from framerank.plans import bridges as br
from framerank.plans.bridges import BOXES, CATALOG, FRAMES, OVERALL, PIXELS, SCAN_EVENTS, lap
from framerank.schema import IMAGE_EXTENSIONS, METHOD_LABELS, MODES, RAW_EXTENSIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c):
    return F.round(c, 6)


_EXT = "CASE WHEN regexp_matches(path, '/[^/]+\\.[^./]+$') THEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) END"
_RAW = f"coalesce(({_EXT}) IN ({', '.join(repr(e) for e in RAW_EXTENSIONS)}), false)"
_STD = f"coalesce(({_EXT}) IN ({', '.join(repr(e) for e in IMAGE_EXTENSIONS)}), false)"
_PRUNED = "NOT regexp_matches(path, '/disqualified/')"
_DQ = "coalesce(manual_dq, score <= 32)"


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    from framerank.sources.files import not_pruned

    c = br.catalog(spark, sf)
    return c.where(not_pruned(F.col("path"), ["/lib"]) & sc.is_supported(F.col("path")))


# Sources


@register(f"WITH {CATALOG} SELECT path FROM catalog WHERE {_PRUNED} AND ({_RAW} OR {_STD})")
def scan_files(spark, sf):
    return _scanned(spark, sf).select("path")


@register(f"WITH {CATALOG} SELECT path FROM catalog WHERE {_PRUNED}")
def scan_prune_disqualified(spark, sf):
    from framerank.sources.files import not_pruned

    return br.catalog(spark, sf).where(not_pruned(F.col("path"), ["/lib"])).select("path")


@register(f"WITH {CATALOG} SELECT path, {_RAW} AS is_raw FROM catalog")
def ext_is_raw(spark, sf):
    return br.catalog(spark, sf).select("path", sc.is_raw(F.col("path")).alias("is_raw"))


@register(f"WITH {CATALOG} SELECT path, {_STD} AS is_standard FROM catalog")
def ext_is_standard(spark, sf):
    return br.catalog(spark, sf).select("path", sc.is_standard(F.col("path")).alias("is_standard"))


@register(f"WITH {CATALOG} SELECT path, ({_RAW} OR {_STD}) AS supported FROM catalog")
def ext_supported(spark, sf):
    return br.catalog(spark, sf).select("path", sc.is_supported(F.col("path")).alias("supported"))


@register(f"WITH {CATALOG} SELECT DISTINCT path FROM (SELECT path FROM catalog UNION ALL SELECT path FROM catalog WHERE path LIKE '/lib/en/%')")
def scan_dedupe_overlap(spark, sf):
    c = br.catalog(spark, sf).select("path")
    return c.unionByName(c.where(F.col("path").startswith("/lib/en/"))).dropDuplicates(["path"])


@register(f"WITH {CATALOG} SELECT count(*) AS found FROM catalog WHERE {_PRUNED} AND ({_RAW} OR {_STD})")
def scan_found_count(spark, sf):
    return _scanned(spark, sf).agg(F.count(F.lit(1)).alias("found"))


@register(f"WITH {CATALOG} SELECT path, row_number() OVER (ORDER BY path) AS place FROM catalog WHERE regexp_matches(path, '^/lib/en/src0/[^/]+$') AND ({_RAW} OR {_STD})")
def list_folder_sorted(spark, sf):
    inside = br.catalog(spark, sf).where(F.col("path").rlike("^/lib/en/src0/[^/]+$") & sc.is_supported(F.col("path")))
    return rank.numbered(inside.select("path"), [F.col("path")], "place")


_TURNED = "CASE CAST(photo_id % 9 AS INT) {} END"
_NX = _TURNED.format("WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x")
_NY = _TURNED.format("WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y")


@register(f"WITH {PIXELS} SELECT photo_id, CAST({_NX} AS INT) AS x, CAST({_NY} AS INT) AS y, r FROM pixels")
def exif_orient(spark, sf):
    return px.oriented(br.pixels(spark, sf).select("photo_id", "x", "y", "r"), F.col("photo_id") % 9).select("photo_id", "x", "y", "r")


@register(f"WITH {CATALOG} SELECT path, list_extract(string_split(path, '/'), -1) AS name FROM catalog")
def file_name(spark, sf):
    return br.catalog(spark, sf).select("path", sc.file_name(F.col("path")).alias("name"))


@register("SELECT doc_id, round(CAST(doc_id % 101 AS DOUBLE) / 100, 6) AS value FROM documents")
def parse_percent(spark, sf):
    text = F.concat((F.col("doc_id") % 101).cast("string"), F.lit(" %"))
    return br.table(spark, sf, "documents").select("doc_id", r6(sc.parse_percent(text)).alias("value"))


# Pixels


@register(f"WITH {PIXELS} SELECT photo_id, x, y, gray FROM gray")
def px_luma(spark, sf):
    return px.with_gray(br.pixels(spark, sf)).select("photo_id", "x", "y", "gray")


@register(f"WITH {PIXELS}, {lap('gray')} SELECT photo_id, x, y, lap FROM lap")
def px_laplacian(spark, sf):
    return px.with_laplacian(px.with_gray(br.pixels(spark, sf))).select("photo_id", "x", "y", "lap")


@register(f"WITH {PIXELS} SELECT photo_id, round(var_pop(gray), 6) AS v FROM gray GROUP BY photo_id")
def px_variance(spark, sf):
    return px.with_gray(br.pixels(spark, sf)).groupBy("photo_id").agg(r6(px._variance_of("gray")).alias("v"))


@register(f"WITH {PIXELS}, {lap('gray')} SELECT photo_id, round(var_pop(lap), 6) AS vol FROM lap GROUP BY photo_id")
def variance_of_laplacian(spark, sf):
    return px.variance_of_laplacian(px.with_gray(br.pixels(spark, sf))).select("photo_id", r6("vol").alias("vol"))


def _crop(source: str, fraction: str, w: int, h: int) -> str:
    cut = lambda n: f"CAST(greatest(round(CAST({n} AS FLOAT) * CAST({fraction} AS FLOAT)), 1) AS INT)"
    inside = " AND ".join(f"{a} >= ({n} - {cut(n)}) // 2 AND {a} < ({n} - {cut(n)}) // 2 + {cut(n)}" for a, n in (("x", w), ("y", h)))
    return f"cropped AS (SELECT * FROM {source} WHERE {inside})"


@register(f"WITH {FRAMES}, {_crop('frames', '0.45', br.WIDTH, br.HEIGHT)}, {lap('cropped')} SELECT photo_id, count(*) AS n, round(var_pop(lap), 6) AS vol FROM lap GROUP BY photo_id")
def center_crop(spark, sf):
    cropped = px.with_laplacian(px.center_crop(br.frames(spark, sf), 0.45))
    return cropped.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"), r6(px._variance_of("lap")).alias("vol"))


@register(f"WITH {CATALOG} SELECT path, mode, CASE mode WHEN 'Landscape' THEN CAST(1 AS FLOAT) WHEN 'Portrait' THEN CAST(0.45 AS FLOAT) ELSE CAST(0.6 AS FLOAT) END AS fraction FROM catalog")
def region_fraction(spark, sf):
    return br.catalog(spark, sf).select("path", "mode", sc.region_fraction(F.col("mode")).alias("fraction"))


def _crop_axis(a: str, b: str, name: str, size: str) -> str:
    start = f"least(greatest((({a} + {b}) / CAST(2 AS FLOAT)) - greatest(({b} - {a}) * CAST(1.7 AS FLOAT), CAST(1 AS FLOAT)) / CAST(2 AS FLOAT), CAST(0 AS FLOAT)), CAST(119 AS FLOAT))"
    long = f"greatest(({b} - {a}) * CAST(1.7 AS FLOAT), CAST(1 AS FLOAT))"
    return f"CAST(floor({start}) AS INT) AS {name}, CAST(floor(greatest(least({long}, CAST(120 AS FLOAT) - {start}), CAST(1 AS FLOAT))) AS INT) AS {size}"


@register(f"WITH {BOXES} SELECT box_id, {_crop_axis('x1', 'x2', 'x', 'w')}, {_crop_axis('y1', 'y2', 'y', 'h')} FROM boxes")
def subject_crop_rect(spark, sf):
    rect = sc.subject_crop({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.lit(120), F.lit(120))
    return br.boxes(spark, sf).select("box_id", *[c.alias(k) for k, c in rect.items()])


_TILES = f"""{lap('frames')}, tiles AS (SELECT photo_id, x // 8 AS tx, y // 8 AS ty, var_pop(lap) AS v FROM lap GROUP BY ALL HAVING max(x) - min(x) + 1 >= 4 AND max(y) - min(y) + 1 >= 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY v DESC, ty, tx) AS rank, count(*) OVER (PARTITION BY photo_id) AS n FROM tiles)"""


@register(f"WITH {FRAMES}, {_TILES} SELECT photo_id, round(avg(v), 6) AS score FROM ranked WHERE rank <= greatest(ceil(n * CAST(0.05 AS DOUBLE)), 1) GROUP BY photo_id")
def sharpest_region(spark, sf):
    return px.sharpest_region(br.frames(spark, sf)).select("photo_id", r6("score").alias("score"))


@register(
    f"""WITH {FRAMES}, even AS (SELECT * FROM frames WHERE photo_id % 2 = 0), {_crop('even', '0.6', br.WIDTH, br.HEIGHT)}, {lap('cropped')}, fixed AS (SELECT photo_id, var_pop(lap) AS score FROM lap GROUP BY photo_id),
odd AS (SELECT * FROM frames WHERE photo_id % 2 = 1), {_TILES.replace('lap AS', 'lap2 AS').replace('FROM frames', 'FROM odd').replace('FROM lap ', 'FROM lap2 ')}
SELECT photo_id, round(score, 6) AS score FROM fixed UNION ALL SELECT photo_id, round(avg(v), 6) FROM ranked WHERE rank <= greatest(ceil(n * CAST(0.05 AS DOUBLE)), 1) GROUP BY photo_id"""
)
def sharpness_score(spark, sf):
    """Even frames by the fixed region of an object, odd ones by the sharpest region."""
    f = br.frames(spark, sf)
    fixed = px.variance_of_laplacian(px.center_crop(f.where("photo_id % 2 = 0"), 0.6)).select("photo_id", r6("vol").alias("score"))
    return fixed.unionByName(px.sharpest_region(f.where("photo_id % 2 = 1")).select("photo_id", r6("score").alias("score")))


@register(f"WITH {CATALOG} SELECT doc_id, phash FROM catalog")
def dhash(spark, sf):
    return br.catalog(spark, sf).select("doc_id", "phash")


# Detection


@register(
    """WITH layers(fw, fh, start, sizes) AS (VALUES (40, 30, 0, [10.0, 16.0, 24.0]), (20, 15, 3600, [32.0, 48.0]), (10, 8, 4200, [64.0, 96.0]), (5, 4, 4360, [128.0, 192.0, 256.0])),
c AS (SELECT fw, fh, start, sizes, i, j, k FROM layers, range(0, 40) a(i), range(0, 30) b(j), range(0, 3) d(k) WHERE i < fw AND j < fh AND k < len(sizes))
SELECT CAST(start + (j * fw + i) * len(sizes) + k AS INT) AS prior, round(CAST((i + 0.5) / fw AS DOUBLE), 5) AS cx, round(CAST((j + 0.5) / fh AS DOUBLE), 5) AS cy,
  round(least(CAST(sizes[k + 1] AS DOUBLE) / 320, 1), 5) AS w, round(least(CAST(sizes[k + 1] AS DOUBLE) / 240, 1), 5) AS h FROM c"""
)
def face_priors(spark, sf):
    return bx.face_priors(spark).select(F.col("prior").cast("int").alias("prior"), *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("cx", "cy", "w", "h")])


@register(
    """WITH layers(stride, n, start) AS (VALUES (8, 52, 0), (16, 26, 2704), (32, 13, 3380)) SELECT CAST(start + y * n + x AS INT) AS cell, CAST(x AS DOUBLE) AS gx, CAST(y AS DOUBLE) AS gy, CAST(stride AS DOUBLE) AS stride
FROM layers, range(0, 52) a(x), range(0, 52) b(y) WHERE x < n AND y < n"""
)
def animal_grid(spark, sf):
    return bx.animal_grid(spark).select(F.col("cell").cast("int").alias("cell"), *[F.col(c).cast("double").alias(c) for c in ("gx", "gy", "stride")])


def _raw(spark, sf):
    """Detector rows made from events: a prior, a confidence and four deltas each."""
    e = F.col("event_id")
    return br.table(spark, sf, "events").select(
        F.col("user_id").alias("photo_id"), (e % 4420).cast("int").alias("prior"), ((e % 100) / 100.0).cast("float").alias("score"),
        *[((e * k) % 21 - 10).cast("double").alias(n) for k, n in ((3, "lx"), (5, "ly"), (7, "lw"), (11, "lh"))],
    )


_PRIORS = ORACLES["face_priors"].replace("WITH layers", "layers").split("SELECT CAST(start")[0]
_PRIORS += "SELECT CAST(start + (j * fw + i) * len(sizes) + k AS INT) AS prior, CAST(CAST(i + 0.5 AS FLOAT) / CAST(fw AS FLOAT) AS FLOAT) AS cx, CAST(CAST(j + 0.5 AS FLOAT) / CAST(fh AS FLOAT) AS FLOAT) AS cy, CAST(least(CAST(sizes[k + 1] AS FLOAT) / CAST(320 AS FLOAT), 1) AS FLOAT) AS w, CAST(least(CAST(sizes[k + 1] AS FLOAT) / CAST(240 AS FLOAT), 1) AS FLOAT) AS h FROM c"
_PRIORS = _PRIORS.replace("SELECT CAST(start +", "priors AS (SELECT CAST(start +", 1).replace("c AS (SELECT fw", "c AS (SELECT fw") + ")"
_PRIORS = _PRIORS.replace("len(sizes))\npriors", "len(sizes)),\npriors")


@register(
    f"""WITH {_PRIORS}, raw AS (SELECT user_id AS photo_id, CAST(event_id % 4420 AS INT) AS prior, CAST((event_id % 100) / 100.0 AS FLOAT) AS score,
  CAST((event_id * 3) % 21 - 10 AS DOUBLE) AS lx, CAST((event_id * 5) % 21 - 10 AS DOUBLE) AS ly, CAST((event_id * 7) % 21 - 10 AS DOUBLE) AS lw, CAST((event_id * 11) % 21 - 10 AS DOUBLE) AS lh FROM events),
d AS (SELECT photo_id, raw.prior AS box_id, score, lx * 0.1::DOUBLE * w + cx AS ox, ly * 0.1::DOUBLE * h + cy AS oy, exp(lw * 0.2::DOUBLE) * w AS ow, exp(lh * 0.2::DOUBLE) * h AS oh FROM raw JOIN priors USING (prior) WHERE score > CAST(0.7 AS FLOAT))
SELECT photo_id, box_id, round(CAST(score AS DOUBLE), 5) AS score, round(ox - ow / 2, 5) AS x1, round(oy - oh / 2, 5) AS y1, round(ox + ow / 2, 5) AS x2, round(oy + oh / 2, 5) AS y2 FROM d"""
)
def ssd_decode(spark, sf):
    out = bx.ssd_decode(_raw(spark, sf), bx.face_priors(spark))
    return out.select("photo_id", F.col("box_id").cast("int").alias("box_id"), *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


@register(
    f"""WITH grid AS ({ORACLES['animal_grid']}), raw AS (SELECT user_id AS photo_id, CAST(event_id % 3549 AS INT) AS cell, list_transform(range(0, 85), lambda i: CASE WHEN i < 2 THEN CAST((event_id * (i + 3)) % 11 - 5 AS DOUBLE) WHEN i < 4 THEN CAST((event_id * (i + 3)) % 5 - 2 AS DOUBLE) ELSE CAST((event_id * (i + 1)) % 101 AS DOUBLE) / 100 END) AS v FROM events),
s AS (SELECT *, v[5] * greatest(list_max(v[20:29]), 0) AS score FROM raw JOIN grid USING (cell))
SELECT photo_id, cell AS box_id, round(score, 5) AS score, round((v[1] + gx) * stride - exp(v[3]) * stride / 2, 5) AS x1, round((v[2] + gy) * stride - exp(v[4]) * stride / 2, 5) AS y1,
  round((v[1] + gx) * stride + exp(v[3]) * stride / 2, 5) AS x2, round((v[2] + gy) * stride + exp(v[4]) * stride / 2, 5) AS y2 FROM s WHERE score >= 0.35"""
)
def yolox_decode(spark, sf):
    e = F.col("event_id")
    v = F.transform(F.sequence(F.lit(0), F.lit(84)), lambda i: F.when(i < 2, ((e * (i + 3)) % 11 - 5).cast("double")).when(i < 4, ((e * (i + 3)) % 5 - 2).cast("double")).otherwise(((e * (i + 1)) % 101).cast("double") / 100))
    raw = br.table(spark, sf, "events").select(F.col("user_id").alias("photo_id"), (e % 3549).cast("int").alias("cell"), v.alias("v"))
    out = bx.yolox_decode(raw, bx.animal_grid(spark))
    return out.select("photo_id", F.col("box_id").cast("int").alias("box_id"), *[F.round(c, 5).alias(c) for c in ("score", "x1", "y1", "x2", "y2")])


def _iou_sql(a: str, b: str) -> str:
    inter = f"(CAST(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) AS DOUBLE) * CAST(greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0) AS DOUBLE))"
    size = lambda o: f"(CAST({o}.x2 - {o}.x1 AS DOUBLE) * CAST({o}.y2 - {o}.y1 AS DOUBLE))"
    return f"({inter} / ({size(a)} + {size(b)} - {inter} + CAST(1e-5 AS DOUBLE)))"


@register(f"WITH {BOXES}, p AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY box_id) AS n FROM boxes) SELECT a.box_id AS a, b.box_id AS b, round({_iou_sql('a', 'b')}, 6) AS iou FROM p a JOIN p b ON a.photo_id = b.photo_id AND b.n = a.n + 1")
def box_iou(spark, sf):
    """Each box against the next one of its photo."""
    w = Window.partitionBy("photo_id").orderBy("box_id")
    rows = br.boxes(spark, sf).select("photo_id", "box_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = rows.select("*", F.lead("box_id").over(w).alias("b"), *[F.lead(c).over(w).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")]).where("b is not null")
    pair = sc.iou({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, {c: F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2")})
    return rows.select(F.col("box_id").alias("a"), "b", r6(pair).alias("iou"))


_KEPT = "STRUCT(box_id BIGINT, x1 FLOAT, y1 FLOAT, x2 FLOAT, y2 FLOAT)[]"
_NMS = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, box_id) AS n FROM boxes),
fold AS (SELECT photo_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_KEPT}) AS kept FROM (SELECT DISTINCT photo_id FROM boxes)
  UNION ALL SELECT f.photo_id, o.n, CASE WHEN len(list_filter(f.kept, lambda k: {_iou_sql('k', 'o')} > 0.3)) = 0 THEN list_append(f.kept, CAST(struct_pack(box_id := o.box_id, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2) AS STRUCT(box_id BIGINT, x1 FLOAT, y1 FLOAT, x2 FLOAT, y2 FLOAT))) ELSE f.kept END
  FROM fold f JOIN ordered o ON o.photo_id = f.photo_id AND o.n = f.n + 1),
kept AS (SELECT photo_id, unnest(kept).box_id AS box_id FROM (SELECT photo_id, kept FROM fold QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY n DESC) = 1))"""


@register(f"WITH RECURSIVE {BOXES}, {_NMS} SELECT photo_id, box_id FROM kept")
def nms(spark, sf):
    return bx.nms(br.boxes(spark, sf)).select("photo_id", "box_id")


_CLIP = "SELECT box_id, " + ", ".join(f"least(greatest(CAST({c} AS DOUBLE) / {{0}}, 0), {{1}}) * {{2}} AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM boxes"


@register(f"WITH {BOXES}, c AS ({_CLIP.format(100, 1, 120)}) SELECT box_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / 14400 >= 0.01")
def box_postfilter(spark, sf):
    rows = br.boxes(spark, sf).select("box_id", *[(F.col(c).cast("double") / 100).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return bx.face_filter(rows, 120, 120, 0.01).select("box_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@register(f"WITH {BOXES}, c AS ({_CLIP.format(0.8, 120, 1)}) SELECT box_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE greatest(x2 - x1, 0) * greatest(y2 - y1, 0) / 14400 >= 0.03")
def box_postfilter_animal(spark, sf):
    return bx.animal_filter(br.boxes(spark, sf), 0.8, 120, 120, 0.03).select("box_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


_MAIN = "main AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY CAST(x2 - x1 AS DOUBLE) * CAST(y2 - y1 AS DOUBLE) DESC, score DESC, box_id) = 1)"


@register(f"WITH {BOXES}, {_MAIN} SELECT photo_id, box_id FROM main")
def main_subject(spark, sf):
    return bx.main_subject(br.boxes(spark, sf)).select("photo_id", "box_id")


@register(f"WITH {BOXES} SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY score DESC, box_id) AS place, round(CAST(score AS DOUBLE), 5) AS score, x1, y1, x2, y2 FROM boxes")
def detections_report(spark, sf):
    place = F.row_number().over(Window.partitionBy("photo_id").orderBy(F.col("score").desc(), "box_id"))
    return br.boxes(spark, sf).select("photo_id", place.alias("place"), F.round(F.col("score").cast("double"), 5).alias("score"), "x1", "y1", "x2", "y2")


# Classification and scores


@register(f"WITH {CATALOG} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'Portrait' WHEN doc_id % 7 = 0 THEN 'Animal' WHEN doc_id % 2 = 0 THEN 'Object' ELSE 'Landscape' END AS mode FROM catalog")
def classify_mode(spark, sf):
    guess = F.when(F.col("doc_id") % 2 == 0, "Object").otherwise("Landscape")
    return br.catalog(spark, sf).select("path", sc.classify_mode(F.col("doc_id") % 5 == 0, F.col("doc_id") % 7 == 0, guess).alias("mode"))


@register(f"WITH {CATALOG} SELECT path, 'Object' AS mode FROM catalog")
def classify_fixed(spark, sf):
    return br.catalog(spark, sf).select("path", F.lit("Object").alias("mode"))


@register(
    f"""WITH {FRAMES}, {lap('frames')}, f AS (SELECT photo_id, var_pop(lap) AS v FROM lap GROUP BY photo_id), {_crop('frames', '0.5', br.WIDTH, br.HEIGHT)}, {lap('cropped').replace('lap AS (', 'lap2 AS (', 1)},
c AS (SELECT photo_id, var_pop(lap) AS v FROM lap2 GROUP BY photo_id) SELECT photo_id, CASE WHEN f.v <= 1 THEN 'Landscape' WHEN round(c.v / f.v, 9) > 1.6 THEN 'Object' ELSE 'Landscape' END AS mode FROM f JOIN c USING (photo_id)"""
)
def guess_mode(spark, sf):
    f = br.frames(spark, sf)
    both = px.variance_of_laplacian(f).join(px.variance_of_laplacian(px.center_crop(f, 0.5)).withColumnRenamed("vol", "center"), "photo_id")
    return both.select("photo_id", sc.guess_mode(F.col("vol"), F.col("center")).alias("mode"))


@register(f"WITH {CATALOG} SELECT path, round(CASE WHEN score <= 0 THEN 0 ELSE 100 * score / (score + 100) END, 6) AS sharpness FROM catalog")
def normalize_sharpness(spark, sf):
    return br.catalog(spark, sf).select("path", r6(sc.normalize_sharpness(F.col("score"))).alias("sharpness"))


_TONE = "SELECT photo_id, round(least(greatest(100 * (1 - abs(avg(gray) - 128) / 128) - 100 * avg(CASE WHEN gray <= 3 OR gray >= 252 THEN 1.0::DOUBLE ELSE 0 END), 0), 100), 6) AS exposure, round(least(100 * stddev_pop(gray) / 64, 100), 6) AS contrast FROM gray GROUP BY photo_id"


@register(f"WITH {PIXELS} SELECT photo_id, exposure FROM ({_TONE})")
def exposure_score(spark, sf):
    return px.tone_scores(px.with_gray(br.pixels(spark, sf))).select("photo_id", r6("exposure").alias("exposure"))


@register(f"WITH {PIXELS} SELECT photo_id, contrast FROM ({_TONE})")
def contrast_score(spark, sf):
    return px.tone_scores(px.with_gray(br.pixels(spark, sf))).select("photo_id", r6("contrast").alias("contrast"))


_COLOR = "SELECT photo_id, round(least((sqrt(var_pop(r - g) + var_pop(0.5::DOUBLE * (r + g) - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg(0.5::DOUBLE * (r + g) - b), 2))) * 100 / 110, 100), 6) AS color FROM pixels GROUP BY photo_id"


@register(f"WITH {PIXELS} {_COLOR}")
def color_score(spark, sf):
    return px.color_score(br.pixels(spark, sf)).select("photo_id", r6("color").alias("color"))


def _near(axis: str, n: int) -> str:
    return f"(abs({axis} - {n} / 3.0::DOUBLE) <= greatest({n} * 0.1::DOUBLE, 1) OR abs({axis} - 2 * {n} / 3.0::DOUBLE) <= greatest({n} * 0.1::DOUBLE, 1))"


def _composition(source: str, w: int, h: int) -> str:
    base = f"(1 - (1 - least(2 * greatest({w} * 0.1::DOUBLE, 1) / {w}, 1)) * (1 - least(2 * greatest({h} * 0.1::DOUBLE, 1) / {h}, 1)))"
    return f"""{lap(source)}, e AS (SELECT photo_id, CAST(sum(abs(lap)) AS DOUBLE) AS total, CAST(sum(CASE WHEN {_near('x', w)} OR {_near('y', h)} THEN abs(lap) ELSE 0 END) AS DOUBLE) AS inside FROM lap GROUP BY photo_id),
comp AS (SELECT photo_id, round(CASE WHEN total <= 0 THEN 50 ELSE least(greatest(50 + 50 * (inside / total - {base}) / greatest(1 - {base}, 1e-6), 0), 100) END, 6) AS composition FROM e)"""


@register(f"WITH {FRAMES}, {_composition('frames', br.WIDTH, br.HEIGHT)} SELECT photo_id, composition FROM comp")
def composition_score(spark, sf):
    return px.composition_score(br.frames(spark, sf)).select("photo_id", r6("composition").alias("composition"))


_SUBJECT = """round(0.6 * least(greatest(100 * (CAST(greatest(x2 - x1, 0) AS DOUBLE) * CAST(greatest(y2 - y1, 0) AS DOUBLE) / 14400) / 0.15, 0), 100)
  + 0.4 * least(greatest(100 * (1 - sqrt(pow(CAST(x1 + x2 AS DOUBLE) / 2 - 60, 2) + pow(CAST(y1 + y2 AS DOUBLE) / 2 - 60, 2)) / (sqrt(CAST(28800 AS DOUBLE)) / 2)), 0), 100), 6)"""


@register(f"WITH {BOXES} SELECT box_id, {_SUBJECT} AS subject FROM boxes")
def subject_score(spark, sf):
    score = sc.subject_score({c: F.col(c) for c in ("x1", "y1", "x2", "y2")}, F.lit(120), F.lit(120))
    return br.boxes(spark, sf).select("box_id", r6(score).alias("subject"))


@register(f"WITH {PIXELS}, {_composition('gray', 8, 8)}, v AS (SELECT photo_id, var_pop(lap) AS v FROM lap GROUP BY photo_id), t AS ({_TONE}), k AS ({_COLOR}) SELECT photo_id, round(100 * v / (v + 100), 6) AS sharpness, exposure, contrast, color, composition FROM v JOIN t USING (photo_id) JOIN k USING (photo_id) JOIN comp USING (photo_id)")
def factors(spark, sf):
    out = px.factor_scores(px.with_gray(br.pixels(spark, sf)))
    return out.select("photo_id", r6(sc.normalize_sharpness(F.col("vol"))).alias("sharpness"), *[r6(c).alias(c) for c in ("exposure", "contrast", "color", "composition")])


@register(f"WITH {CATALOG} SELECT path, round({OVERALL}, 6) AS overall FROM catalog")
def overall_score(spark, sf):
    return rank.with_overall(br.catalog(spark, sf)).select("path", r6("overall").alias("overall"))


@register(f"WITH {CATALOG} SELECT path, CASE WHEN score <= 40 THEN 'blurry' WHEN score <= 100 THEN 'soft' ELSE 'sharp' END AS bucket FROM catalog")
def sharpness_bucket(spark, sf):
    return br.catalog(spark, sf).select("path", sc.sharpness_bucket(F.col("score")).alias("bucket"))


@register("SELECT * FROM (VALUES " + ", ".join(f"('mode', '{m}', '{m}')" for m in MODES) + ", " + ", ".join(f"('method', '{k}', '{v}')" for k, v in METHOD_LABELS.items()) + ") t(kind, name, label)")
def mode_label(spark, sf):
    return spark.createDataFrame([("mode", m, m) for m in MODES] + [("method", k, v) for k, v in METHOD_LABELS.items()], "kind string, name string, label string")


# Filters, marks and moves


@register(f"WITH {CATALOG} SELECT path, {_DQ} AS disqualified FROM catalog")
def disqualified(spark, sf):
    return br.catalog(spark, sf).select("path", sc.is_disqualified(F.col("score"), F.col("manual_dq")).alias("disqualified"))


@register(f"WITH {CATALOG} SELECT path, CASE WHEN doc_id % 10 = 3 THEN CASE WHEN (score <= 32) <> true THEN 'true' END ELSE CASE WHEN manual_dq THEN 'true' WHEN NOT manual_dq THEN 'false' END END AS manual_dq FROM catalog")
def bulk_mark(spark, sf):
    c = br.catalog(spark, sf)
    return overlay.mark(c, c.where("doc_id % 10 = 3"), True).select("path", F.col("manual_dq").cast("string").alias("manual_dq"))


@register(f"WITH {CATALOG} SELECT path, manual_dq IS NULL AND false AS marked, score <= 32 AS disqualified FROM catalog")
def clear_marks(spark, sf):
    c = overlay.clear_marks(br.catalog(spark, sf))
    return c.select("path", F.col("manual_dq").isNotNull().alias("marked"), sc.is_disqualified(F.col("score"), F.col("manual_dq")).alias("disqualified"))


def _overridden(spark, sf):
    c = br.catalog(spark, sf)
    return overlay.override_modes(c, c.where("doc_id % 6 = 1").select("path", F.lit("Object").alias("mode")))


_OVER = "over AS (SELECT *, mode AS mode_scored, CASE WHEN doc_id % 6 = 1 THEN 'Object' ELSE mode END AS new_mode FROM catalog)"


@register(f"WITH {CATALOG}, {_OVER} SELECT path, new_mode AS mode, new_mode <> mode_scored AS dirty, score FROM over")
def apply_mode_override(spark, sf):
    return _overridden(spark, sf).select("path", "mode", "dirty", "score")


@register(f"WITH {CATALOG}, {_OVER} SELECT path, new_mode AS mode FROM over WHERE new_mode <> mode_scored")
def dirty_rows(spark, sf):
    return overlay.dirty_rows(_overridden(spark, sf)).select("path", "mode")


@register(f"WITH {CATALOG}, {_OVER} SELECT (count(*) FILTER (WHERE {_DQ}) > 0) AND (count(*) FILTER (WHERE new_mode <> mode_scored) = 0) AS can_move FROM over")
def can_move(spark, sf):
    c = _overridden(spark, sf)
    return overlay.can_move(c, sc.is_disqualified(F.col("score"), F.col("manual_dq")))


def _rescored(rows):
    return rows.select("path", "mode", (F.col("score") * 1.5).alias("score"))


@register(f"WITH {CATALOG}, {_OVER} SELECT path, new_mode AS mode, round(score * 1.5, 6) AS score FROM over WHERE new_mode <> mode_scored")
def recompute(spark, sf):
    """Only rows that wait for it are scored again."""
    return _rescored(overlay.dirty_rows(_overridden(spark, sf))).withColumn("score", r6("score"))


@register(f"WITH {CATALOG}, {_OVER} SELECT path, new_mode AS mode, round(CASE WHEN new_mode <> mode_scored AND doc_id % 4 <> 0 THEN score * 1.5 ELSE score END, 6) AS score, new_mode <> mode_scored AND doc_id % 4 = 0 AS dirty FROM over")
def merge_scores(spark, sf):
    c = _overridden(spark, sf)
    return overlay.merge_scores(c, _rescored(overlay.dirty_rows(c).where("doc_id % 4 <> 0"))).select("path", "mode", r6("score").alias("score"), "dirty")


_ROOTS = ["/lib/en", "/lib/en/src0", "/lib/de"]
_DST = "CASE WHEN starts_with(path, '/lib/en/src0/') THEN concat('/lib/en/src0/disqualified/', substr(path, 14)) WHEN starts_with(path, '/lib/en/') THEN concat('/lib/en/disqualified/', substr(path, 9)) WHEN starts_with(path, '/lib/de/') THEN concat('/lib/de/disqualified/', substr(path, 9)) END"


@register(f"WITH {CATALOG} SELECT path, {_DST} AS dst FROM catalog")
def disqualified_path(spark, sf):
    return br.catalog(spark, sf).select("path", moves.reject_path(F.col("path"), _ROOTS).alias("dst"))


def _plan(spark, sf):
    return moves.plan(br.catalog(spark, sf), sc.is_disqualified(F.col("score"), F.col("manual_dq")), _ROOTS)


_PLAN = f"plan AS (SELECT path AS src, {_DST} AS dst FROM catalog WHERE {_DQ} AND ({_DST}) IS NOT NULL)"


@register(f"WITH {CATALOG}, {_PLAN} SELECT src, dst FROM plan")
def move_plan(spark, sf):
    return _plan(spark, sf)


def _moved(spark, sf):
    return _plan(spark, sf).withColumn("error", F.when(F.length("src") % 5 == 0, "exists"))


@register(f"WITH {CATALOG}, {_PLAN} SELECT path FROM catalog WHERE path NOT IN (SELECT src FROM plan WHERE length(src) % 5 <> 0)")
def move_apply(spark, sf):
    return moves.apply(br.catalog(spark, sf), _moved(spark, sf)).select("path")


@register(f"WITH {CATALOG}, {_PLAN}, n AS (SELECT count(*) FILTER (WHERE length(src) % 5 <> 0) AS moved, count(*) FILTER (WHERE length(src) % 5 = 0) AS failed FROM plan) SELECT moved, failed, concat('Moved ', moved, ' to disqualified/', CASE WHEN failed > 0 THEN concat(', ', failed, ' failed') ELSE '' END) AS message FROM n")
def move_summary(spark, sf):
    return moves.summary(_moved(spark, sf))


@register(f"WITH {CATALOG} SELECT path, concat(mode, ' ', CAST(CAST(round_even(score, 0) AS BIGINT) AS VARCHAR), ' ', coalesce(CAST(CAST(composition AS BIGINT) AS VARCHAR), '-1'), ' ', coalesce(CAST(CAST(subject AS BIGINT) AS VARCHAR), '-')) AS line FROM catalog")
def scan_report(spark, sf):
    whole = lambda c: F.bround(c).cast("long").cast("string")
    line = F.concat_ws(" ", "mode", whole("score"), F.coalesce(whole("composition"), F.lit("-1")), F.coalesce(whole("subject"), F.lit("-")))
    return br.catalog(spark, sf).select("path", line.alias("line"))


# Duplicates and ranking

_PAIRS = "pairs AS (SELECT a.path AS path_a, b.path AS path_b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM {0} a JOIN {0} b ON a.path < b.path WHERE bit_count(xor(a.phash, b.phash)) <= 6)"
_LINKED = "both_ways AS (SELECT path_a AS a, path_b AS b FROM pairs UNION ALL SELECT path_b, path_a FROM pairs), reach AS (SELECT path AS node, path AS other FROM {0} UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a), labelled AS (SELECT node AS path, min(other) AS group_id FROM reach GROUP BY node)"


def _groups_sql(source: str) -> str:
    return f"{_PAIRS.format(source)}, {_LINKED.format(source)}, sized AS (SELECT path, group_id, count(*) OVER (PARTITION BY group_id) AS size FROM labelled)"


@register(f"WITH {CATALOG} SELECT doc_id, CAST(bit_count(xor(phash, CAST(255 AS BIGINT))) AS INT) AS distance FROM catalog")
def hamming(spark, sf):
    return br.catalog(spark, sf).select("doc_id", sc.hamming(F.col("phash"), F.lit(255).cast("long")).alias("distance"))


@register(f"WITH {CATALOG}, {_PAIRS.format('catalog')} SELECT path_a, path_b, distance FROM pairs")
def hamming_pairs(spark, sf):
    return dedupe.hamming_pairs(br.catalog(spark, sf).select("path", "phash"))


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')} SELECT group_id, path FROM sized WHERE size > 1")
def dup_groups(spark, sf):
    return dedupe.groups(br.catalog(spark, sf).select("path", "phash")).select("group_id", "path")


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')} SELECT group_id, size, row_number() OVER (ORDER BY size DESC, group_id) AS place FROM (SELECT DISTINCT group_id, size FROM sized WHERE size > 1)")
def dup_groups_sized(spark, sf):
    one = dedupe.groups(br.catalog(spark, sf).select("path", "phash")).select("group_id", "size").distinct()
    return rank.numbered(one, [F.col("size").desc(), F.col("group_id")], "place")


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')} SELECT group_id, count(*) AS members FROM sized JOIN catalog USING (path) WHERE size > 1 AND doc_id % 3 <> 0 GROUP BY group_id HAVING count(*) >= 2")
def groups_surviving(spark, sf):
    """Groups as found, looked up in a catalog that has lost a third of its rows since."""
    c = br.catalog(spark, sf)
    found = dedupe.groups(c.select("path", "phash")).join(c.where("doc_id % 3 <> 0").select("path").hint("merge"), "path")
    return found.groupBy("group_id").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')} SELECT group_id, path, round(overall, 6) AS overall FROM (SELECT group_id, path, {OVERALL} AS overall FROM sized JOIN catalog USING (path) WHERE size > 1) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY overall DESC, path) = 1")
def best_of_group(spark, sf):
    c = rank.with_overall(br.catalog(spark, sf))
    rows = dedupe.groups(c.select("path", "phash")).join(c.select("path", "overall").hint("merge"), "path")
    return dedupe.best_of_group(rows).select("group_id", "path", r6("overall").alias("overall"))


_SURV = f"surv AS (SELECT *, {OVERALL} AS overall FROM catalog WHERE NOT {_DQ})"
_KEEP = f"{_SURV}, {_groups_sql('surv')}, keep AS (SELECT * FROM (SELECT s.group_id, c.path, c.overall FROM sized s JOIN surv c USING (path)) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY overall DESC, path) = 1)"


@register(f"WITH RECURSIVE {CATALOG}, {_KEEP} SELECT path FROM sized WHERE size = 1")
def ungrouped(spark, sf):
    rows = rank.survivors(br.catalog(spark, sf)).select("path", "phash")
    return rows.select("path").join(dedupe.groups(rows).select("path").hint("merge"), "path", "left_anti")


@register(f"WITH RECURSIVE {CATALOG}, {_KEEP} SELECT path, round(overall, 6) AS overall FROM keep")
def keepers(spark, sf):
    return rank.keepers(br.catalog(spark, sf)).select("path", r6("overall").alias("overall"))


@register(f"WITH RECURSIVE {CATALOG}, {_KEEP} SELECT path, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, path) AS place FROM keep ORDER BY overall DESC, path LIMIT 150")
def rank_pipeline(spark, sf):
    return rank.rank(br.catalog(spark, sf)).select("path", r6("overall").alias("overall"), "place")


@register(f"WITH RECURSIVE {CATALOG}, {_KEEP} SELECT (SELECT count(*) FROM catalog) AS total, (SELECT count(*) FROM surv) AS after_technical, (SELECT count(*) FROM keep) AS after_dedupe, (SELECT least(count(*), 150) FROM keep) AS shortlist")
def funnel_counts(spark, sf):
    return rank.funnel_counts(br.catalog(spark, sf))


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')}, n AS (SELECT group_id, size, dense_rank() OVER (ORDER BY size DESC, group_id) AS number FROM (SELECT DISTINCT group_id, size FROM sized WHERE size > 1)) SELECT n.number, sized.path, concat('Group ', number, ' (', n.size, ' photos)') AS title, {OVERALL} = max({OVERALL}) OVER (PARTITION BY n.number) AS best FROM n JOIN sized USING (group_id) JOIN catalog USING (path)")
def group_view(spark, sf):
    c = rank.with_overall(br.catalog(spark, sf))
    rows = dedupe.groups(c.select("path", "phash")).join(c.select("path", "overall").hint("merge"), "path")
    rows = cut(rows, "grouped")
    one = rank.numbered(rows.groupBy("group_id", "size").agg(F.max("overall").alias("most")), [F.col("size").desc(), F.col("group_id")], "number")
    rows = rows.join(one.select("group_id", "number", "most").hint("merge"), "group_id")
    title = F.format_string("Group %d (%d photos)", F.col("number"), F.col("size"))
    return rows.select("number", "path", title.alias("title"), (F.col("overall") == F.col("most")).alias("best"))


@register(f"WITH {CATALOG} SELECT min(score) AS low, max(score) AS high FROM catalog")
def score_range(spark, sf):
    return br.catalog(spark, sf).agg(F.min("score").alias("low"), F.max("score").alias("high"))


@register(f"WITH {CATALOG}, {_OVER} SELECT count(*) FILTER (WHERE {_DQ}) AS flagged, count(manual_dq) AS manual, count(*) FILTER (WHERE new_mode <> mode_scored) AS dirty FROM over")
def status_counts(spark, sf):
    return _overridden(spark, sf).agg(F.count_if(sc.is_disqualified(F.col("score"), F.col("manual_dq"))).alias("flagged"), F.count("manual_dq").alias("manual"), F.count_if("dirty").alias("dirty"))


@register(f"WITH RECURSIVE {CATALOG}, {_groups_sql('catalog')} SELECT count(DISTINCT group_id) AS groups, count(*) AS members FROM sized WHERE size > 1")
def group_totals(spark, sf):
    return dedupe.groups(br.catalog(spark, sf).select("path", "phash")).agg(F.countDistinct("group_id").alias("groups"), F.count(F.lit(1)).alias("members"))


@register(f"WITH {CATALOG} SELECT path, score, row_number() OVER (ORDER BY score, path) AS place FROM catalog")
def sort_sharpness(spark, sf):
    return rank.numbered(br.catalog(spark, sf).select("path", "score"), [F.col("score"), F.col("path")], "place")


@register(f"WITH {CATALOG} SELECT path, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, path) AS place FROM (SELECT path, {OVERALL} AS overall FROM catalog)")
def sort_overall(spark, sf):
    rows = rank.numbered(rank.with_overall(br.catalog(spark, sf)).select("path", "overall"), [F.col("overall").desc(), F.col("path")], "place")
    return rows.select("path", r6("overall").alias("overall"), "place")


@register(f"WITH {CATALOG} SELECT path, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, path) AS place FROM (SELECT path, {OVERALL} AS overall FROM catalog) ORDER BY place LIMIT 150")
def top_n(spark, sf):
    return rank.top_n(rank.with_overall(br.catalog(spark, sf))).select("path", r6("overall").alias("overall"), "place")


# Selections


def _paths(spark, sf):
    return br.catalog(spark, sf).select("path", "doc_id", "score")


@register(f"WITH {CATALOG} SELECT path FROM catalog WHERE path = (SELECT path FROM catalog WHERE doc_id = 5)")
def select_one(spark, sf):
    p = _paths(spark, sf)
    return overlay.select_one(p, p.where("doc_id = 5").first()["path"])


@register(f"WITH {CATALOG}, a AS (SELECT path FROM catalog WHERE doc_id % 3 = 0), b AS (SELECT path FROM catalog WHERE doc_id % 2 = 0) (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL (SELECT path FROM b EXCEPT SELECT path FROM a)")
def select_toggle(spark, sf):
    p = _paths(spark, sf)
    return overlay.toggle(p.where("doc_id % 3 = 0"), p.where("doc_id % 2 = 0"))


@register(f"WITH {CATALOG}, v AS (SELECT path, doc_id, row_number() OVER (ORDER BY score, path) AS n FROM catalog), e AS (SELECT min(n) AS lo, max(n) AS hi FROM v WHERE doc_id IN (10, 20)) SELECT path FROM v, e WHERE n BETWEEN lo AND hi")
def select_range(spark, sf):
    p = _paths(spark, sf)
    ends = {r["doc_id"]: r["path"] for r in p.where("doc_id in (10, 20)").collect()}
    return overlay.select_range(p, [F.col("score"), F.col("path")], ends[10], ends[20])


@register(f"WITH {CATALOG} SELECT path FROM catalog")
def select_all(spark, sf):
    return _paths(spark, sf).select("path")


# Scan events


@register(f"WITH {SCAN_EVENTS} SELECT kind, count(*) AS n FROM scan_events GROUP BY kind")
def scan_progress(spark, sf):
    return br.scan_events(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {SCAN_EVENTS} SELECT path, error FROM scan_events WHERE kind = 'Failed'")
def scan_failures(spark, sf):
    return br.scan_events(spark, sf).where("kind = 'Failed'").select("path", "error")


@register(f"WITH {SCAN_EVENTS}, f AS (SELECT *, regexp_extract(path, '^/lib/[^/]+', 0) AS folder FROM scan_events) SELECT folder, event_id, kind FROM f QUALIFY row_number() OVER (PARTITION BY folder ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf):
    rows = br.scan_events(spark, sf).withColumn("folder", F.regexp_extract("path", "^/lib/[^/]+", 0))
    return overlay.latest_per_key(rows, "folder", [F.col("ts").desc(), F.col("event_id").desc()]).select("folder", "event_id", "kind")


@register(f"WITH {SCAN_EVENTS} SELECT kind, count(*) AS n FROM scan_events GROUP BY kind")
def stream_progress(spark, sf):
    from framerank.streaming.scan import progress

    return progress(spark, f"{sf}/events.parquet")


@register(f"WITH {SCAN_EVENTS} SELECT path, kind, error FROM scan_events")
def stream_scan(spark, sf):
    from framerank.streaming.scan import scan_table

    return scan_table(spark, f"{sf}/events.parquet")
