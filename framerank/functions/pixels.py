"""Pixel kernels over a relation ``photo_id, x, y`` and values.

All windows are partitioned by ``photo_id`` and one axis; dealing the rows out by ``photo_id`` once serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framerank.functions.scores import clamp


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma, truncated."""
    return F.floor((r * 2126 + g * 7152 + b * 722) / 10000).cast("int")


def with_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", luma(F.col("r"), F.col("g"), F.col("b")))


def with_laplacian(frames: DataFrame, value: str = "gray", id: str = "photo_id") -> DataFrame:
    """Adds ``lap``, the 4-neighbour Laplacian with replicated borders."""
    across, down = Window.partitionBy(id, "y").orderBy("x"), Window.partitionBy(id, "x").orderBy("y")
    v = F.col(value)
    near = sum((F.coalesce(step(v).over(w), v) for w in (across, down) for step in (F.lag, F.lead)), start=F.lit(0))
    return frames.repartition(id).withColumn("lap", (near - v * 4).cast("int"))


def population_variance(total: Column, squares: Column, n: Column) -> Column:
    """From exact integer sums; 0 for no values."""
    mean = total / n
    return F.coalesce(F.when(n > 0, F.greatest(squares / n - mean * mean, F.lit(0.0))), F.lit(0.0))


def _variance_of(col: str) -> Column:
    c = F.col(col).cast("long")
    return population_variance(F.sum(c).cast("double"), F.sum(c * c).cast("double"), F.count(c).cast("double"))


def variance_of_laplacian(frames: DataFrame, value: str = "gray", id: str = "photo_id") -> DataFrame:
    return with_laplacian(frames, value, id).groupBy(id).agg(_variance_of("lap").alias("vol"))


def with_size(frames: DataFrame, id: str = "photo_id") -> DataFrame:
    w = Window.partitionBy(id)
    return frames.withColumn("width", F.max("x").over(w) + 1).withColumn("height", F.max("y").over(w) + 1)


def center_crop(frames: DataFrame, fraction: Column | float, id: str = "photo_id") -> DataFrame:
    """The centre of each frame. What is cut off is gone before any stencil, so crop borders are replicated."""
    part = (F.lit(fraction) if not isinstance(fraction, Column) else fraction).cast("float")
    sized = with_size(frames, id)
    keep = F.lit(True)
    for at, size in (("x", "width"), ("y", "height")):
        crop = F.when(part >= 1, F.col(size)).otherwise(F.greatest(F.round((F.col(size).cast("float") * part).cast("float")), F.lit(1.0).cast("float")).cast("int"))
        start = F.floor((F.col(size) - crop) / 2)
        keep = keep & (F.col(at) >= start) & (F.col(at) < start + crop)
    return sized.where(keep).drop("width", "height")


def sharpest_region(frames: DataFrame, value: str = "gray", id: str = "photo_id", grid: int = 16, share: float = 0.05) -> DataFrame:
    """Mean Laplacian variance of the sharpest share of tiles; strips thinner than half a tile don't count."""
    sized = with_size(with_laplacian(frames, value, id), id)
    sized = sized.withColumn("tile", F.greatest(F.floor(F.greatest("width", "height") / grid), F.lit(8)).cast("int"))
    small = (F.col("width") < F.col("tile")) | (F.col("height") < F.col("tile"))
    tx = F.when(small, 0).otherwise(F.floor(F.col("x") / F.col("tile"))).cast("int")
    ty = F.when(small, 0).otherwise(F.floor(F.col("y") / F.col("tile"))).cast("int")
    tiles = sized.groupBy(id, tx.alias("tx"), ty.alias("ty")).agg(_variance_of("lap").alias("v"), F.first("tile").alias("tile"), (F.max("x") - F.min("x") + 1).alias("tw"), (F.max("y") - F.min("y") + 1).alias("th"), F.first(small).alias("small"))
    tiles = tiles.where("small or (tw >= floor(tile / 2) and th >= floor(tile / 2))")
    order = Window.partitionBy(id).orderBy(F.col("v").desc(), "ty", "tx")
    ranked = tiles.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(id)))
    return ranked.where(F.col("rank") <= F.greatest(F.ceil(F.col("n") * F.lit(share)), F.lit(1))).groupBy(id).agg(F.avg("v").alias("score"))


def tone_columns() -> tuple[Column, Column]:
    """``exposure`` and ``contrast`` as aggregates over ``gray``."""
    n, g = F.count(F.lit(1)).cast("double"), F.col("gray").cast("long")
    mean = F.sum(g).cast("double") / n
    clipped = F.sum(F.when((g <= 3) | (g >= 252), 1).otherwise(0)).cast("double") / n
    exposure = clamp(F.lit(100.0) * (F.lit(1.0) - F.abs(mean - 128.0) / 128.0) - clipped * 100.0)
    contrast = clamp(F.sqrt(_variance_of("gray")) * 100.0 / 64.0)
    return exposure.alias("exposure"), contrast.alias("contrast")


def tone_scores(gray: DataFrame, id: str = "photo_id") -> DataFrame:
    """``exposure`` and ``contrast`` of ``photo_id, gray``."""
    return gray.groupBy(id).agg(*tone_columns())


def color_column() -> Column:
    """Colourfulness of opponent channels, from exact integer sums of ``r - g`` and ``r + g - 2 b``, as an aggregate."""
    n = F.count(F.lit(1)).cast("double")
    rg = (F.col("r") - F.col("g")).cast("long")
    yb2 = (F.col("r") + F.col("g") - F.col("b") * 2).cast("long")
    m1, m2 = F.sum(rg).cast("double") / n, F.sum(yb2).cast("double") / 2.0 / n
    v1 = F.greatest(F.sum(rg * rg).cast("double") / n - m1 * m1, F.lit(0.0))
    v2 = F.greatest(F.sum(yb2 * yb2).cast("double") / 4.0 / n - m2 * m2, F.lit(0.0))
    return clamp((F.sqrt(v1 + v2) + F.sqrt(m1 * m1 + m2 * m2) * 0.3) * 100.0 / 110.0).alias("color")


def color_score(pixels: DataFrame, id: str = "photo_id") -> DataFrame:
    return pixels.groupBy(id).agg(color_column())


def factor_scores(pixels: DataFrame, id: str = "photo_id") -> DataFrame:
    """``vol, exposure, contrast, color, composition`` of ``photo_id, x, y, r, g, b, gray``: one shuffle, one aggregate."""
    return composition_score(pixels, "gray", id, [_variance_of("lap").alias("vol"), *tone_columns(), color_column()])


def composition_score(frames: DataFrame, value: str = "gray", id: str = "photo_id", more: list[Column] = ()) -> DataFrame:
    """How much of the detail lies near the lines of thirds, against the share of the frame that the bands are held to cover.

    ``more`` are aggregates to compute beside it, over the same rows with their Laplacian.
    """
    sized = with_size(with_laplacian(frames, value, id), id)
    near, base = F.lit(False), F.lit(1.0)
    for at, size in (("x", "width"), ("y", "height")):
        s = F.col(size).cast("double")
        band = F.greatest(s * 0.10, F.lit(1.0))
        for t in (s / 3.0, s * 2.0 / 3.0):
            near = near | (F.abs(F.col(at).cast("double") - t) <= band)
        base = base * (F.lit(1.0) - F.least(band * 2.0 / s, F.lit(1.0)))
    e = F.abs("lap").cast("long")
    sums = sized.withColumn("near", near).withColumn("base", F.lit(1.0) - base)
    sums = sums.groupBy(id).agg(F.sum(e).cast("double").alias("total"), F.sum(F.when(F.col("near"), e).otherwise(0)).cast("double").alias("inside"), F.first("base").alias("base"), F.first("width").alias("width"), F.first("height").alias("height"), *more)
    added = [c for c in sums.columns if c not in (id, "total", "inside", "base", "width", "height")]
    lift = (F.col("inside") / F.col("total") - F.col("base")) / F.greatest(F.lit(1.0) - F.col("base"), F.lit(1e-6))
    flat = (F.col("width") < 4) | (F.col("height") < 4) | (F.col("total") <= 0)
    return sums.select(id, *added, F.when(flat, F.lit(50.0)).otherwise(clamp(lift * 50.0 + 50.0)).alias("composition"))


def oriented(pixels: DataFrame, orientation: Column, id: str = "photo_id") -> DataFrame:
    """Pixels where an orientation tag from 1 to 8 puts them; anything else leaves them."""
    x, y, w, h = F.col("x"), F.col("y"), F.col("width"), F.col("height")
    right, low = w - 1 - x, h - 1 - y
    # Tag to (new x, new y); 5 and 7 mirror left to right and then turn.
    moves = {2: (right, y), 3: (right, low), 4: (x, low), 5: (y, x), 6: (low, x), 7: (low, right), 8: (y, right)}
    nx, ny = x, y
    for tag, (a, b) in moves.items():
        nx, ny = F.when(orientation == tag, a).otherwise(nx), F.when(orientation == tag, b).otherwise(ny)
    return with_size(pixels, id).select("*", nx.cast("int").alias("nx"), ny.cast("int").alias("ny")).drop("x", "y", "width", "height").withColumnsRenamed({"nx": "x", "ny": "y"})
