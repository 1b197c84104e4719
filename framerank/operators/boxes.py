"""Detector outputs: priors, grids, box decoding, suppression and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The face detector's input, layers (width, height, box sizes), thresholds and variances.
FACE_INPUT = (320, 240)
FACE_LAYERS = ((40, 30, (10.0, 16.0, 24.0)), (20, 15, (32.0, 48.0)), (10, 8, (64.0, 96.0)), (5, 4, (128.0, 192.0, 256.0)))
FACE_CONFIDENCE, CENTER_VARIANCE, SIZE_VARIANCE, MIN_FACE_AREA = 0.7, 0.1, 0.2, 0.001
# The animal detector's input, strides, classes and thresholds.
ANIMAL_INPUT, STRIDES, ANIMAL_CLASSES, ANIMAL_CONFIDENCE, MIN_ANIMAL_AREA = 416, (8, 16, 32), (14, 23), 0.35, 0.003
MAX_IOU = 0.3


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def face_priors(spark: SparkSession) -> DataFrame:
    """``prior, cx, cy, w, h`` in the order of the detector's rows, as shares of its input."""
    layers, start = [], 0
    for w, h, sizes in FACE_LAYERS:
        layers.append((w, h, start, [float(s) for s in sizes]))
        start += w * h * len(sizes)
    rows = spark.createDataFrame(layers, "fw int, fh int, start int, sizes array<float>")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("fh") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fw") - 1)))
    rows = rows.select("*", F.posexplode("sizes").alias("k", "size"))
    place = F.col("start") + (F.col("j") * F.col("fw") + F.col("i")) * F.size("sizes") + F.col("k")
    one = _f(1.0)
    return rows.select(
        place.alias("prior"),
        ((F.col("i").cast("float") + _f(0.5)) / F.col("fw").cast("float")).cast("float").alias("cx"),
        ((F.col("j").cast("float") + _f(0.5)) / F.col("fh").cast("float")).cast("float").alias("cy"),
        F.least((F.col("size") / _f(FACE_INPUT[0])).cast("float"), one).alias("w"),
        F.least((F.col("size") / _f(FACE_INPUT[1])).cast("float"), one).alias("h"),
    )


def animal_grid(spark: SparkSession) -> DataFrame:
    """``cell, gx, gy, stride`` in the order of the detector's rows."""
    layers, start = [], 0
    for s in STRIDES:
        layers.append((s, ANIMAL_INPUT // s, start))
        start += (ANIMAL_INPUT // s) ** 2
    rows = spark.createDataFrame(layers, "stride int, n int, start int")
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select((F.col("start") + F.col("y") * F.col("n") + F.col("x")).alias("cell"), F.col("x").cast("float").alias("gx"), F.col("y").cast("float").alias("gy"), F.col("stride").cast("float").alias("stride"))


def ssd_decode(raw: DataFrame, priors: DataFrame) -> DataFrame:
    """Boxes as shares of the frame from ``photo_id, prior, score, lx, ly, lw, lh`` above the confidence."""
    rows = raw.where(F.col("score") > _f(FACE_CONFIDENCE)).join(F.broadcast(priors), "prior")  # the priors are a fixed table of 4420 rows
    cx = F.col("lx") * CENTER_VARIANCE * F.col("w") + F.col("cx")
    cy = F.col("ly") * CENTER_VARIANCE * F.col("h") + F.col("cy")
    w, h = F.exp(F.col("lw") * SIZE_VARIANCE) * F.col("w"), F.exp(F.col("lh") * SIZE_VARIANCE) * F.col("h")
    return rows.select("photo_id", F.col("prior").alias("box_id"), "score", (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def yolox_decode(raw: DataFrame, grid: DataFrame) -> DataFrame:
    """Boxes in input pixels from ``photo_id, cell, v`` (5 numbers and the class scores) at the confidence or above."""
    low, high = ANIMAL_CLASSES
    best = F.greatest(F.array_max(F.slice("v", 6 + low, high - low + 1)), F.lit(0.0))
    score = F.col("v")[4] * best
    rows = raw.withColumn("score", score).where(F.col("score") >= F.lit(ANIMAL_CONFIDENCE)).join(F.broadcast(grid), "cell")  # a fixed table of 3549 rows
    cx, cy = (F.col("v")[0] + F.col("gx")) * F.col("stride"), (F.col("v")[1] + F.col("gy")) * F.col("stride")
    w, h = F.exp(F.col("v")[2]) * F.col("stride"), F.exp(F.col("v")[3]) * F.col("stride")
    return rows.select("photo_id", F.col("cell").alias("box_id"), "score", (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def nms(boxes: DataFrame, max_iou: float = MAX_IOU) -> DataFrame:
    """Greedy suppression by ``score``, ties by ``box_id``: a box stays if it overlaps none that stayed. NaN scores are dropped.

    One fold over a photo's sorted boxes; a detector gives a photo a bounded number of them.
    """
    box = "struct(-score AS s, box_id, score, x1, y1, x2, y2)"
    fold = f"""aggregate(sort_array(collect_list({box})), cast(array() AS array<struct<s: float, box_id: bigint, score: float, x1: float, y1: float, x2: float, y2: float>>), (kept, b) ->
      if(forall(kept, k -> double(greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), float(0)) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), float(0)))
        / (greatest(k.x2 - k.x1, float(0)) * greatest(k.y2 - k.y1, float(0)) + greatest(b.x2 - b.x1, float(0)) * greatest(b.y2 - b.y1, float(0))
           - greatest(least(k.x2, b.x2) - greatest(k.x1, b.x1), float(0)) * greatest(least(k.y2, b.y2) - greatest(k.y1, b.y1), float(0)) + double(1e-5)) <= double({max_iou})),
        concat(kept, array(b)), kept))"""
    grouped = boxes.where("score is not null and not isnan(score)").groupBy("photo_id").agg(F.expr(fold).alias("kept"))
    return grouped.select("photo_id", F.explode("kept").alias("b")).select("photo_id", "b.box_id", "b.score", "b.x1", "b.y1", "b.x2", "b.y2")


def area() -> Column:
    zero = F.lit(0.0)
    return F.greatest((F.col("x2") - F.col("x1")).cast("double"), zero) * F.greatest((F.col("y2") - F.col("y1")).cast("double"), zero)


def face_filter(boxes: DataFrame, width: float, height: float, share: float = MIN_FACE_AREA) -> DataFrame:
    """Boxes clipped to the frame, in pixels, without those too small."""
    out = boxes
    for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height)):
        out = out.withColumn(c, F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)) * F.lit(float(size)))
    return out.where(area() / F.lit(float(width * height)) >= share)


def animal_filter(boxes: DataFrame, scale: float, width: float, height: float, share: float = MIN_ANIMAL_AREA) -> DataFrame:
    """Boxes brought back from the letterbox, clipped to the frame, without those too small."""
    out = boxes
    for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height)):
        out = out.withColumn(c, F.least(F.greatest(F.col(c).cast("double") / F.lit(float(scale)), F.lit(0.0)), F.lit(float(size))))
    return out.where(area() / F.lit(float(width * height)) >= share)


def main_subject(boxes: DataFrame) -> DataFrame:
    """The largest box of each photo; of equals the more certain, then the smaller id."""
    order = Window.partitionBy("photo_id").orderBy(area().desc(), F.col("score").desc(), "box_id")
    return boxes.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
