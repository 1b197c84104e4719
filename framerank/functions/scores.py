"""Scalar scores, predicates and path helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framerank.schema import REJECT_THRESHOLD, IMAGE_EXTENSIONS, RAW_EXTENSIONS, REGION_FRACTIONS, WEIGHTS


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, in lower case; null without one and for names like ``.jpg``."""
    found = F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1)
    return F.when(F.length(found) > 0, F.lower(found))


def is_raw(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*RAW_EXTENSIONS), F.lit(False))


def is_standard(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*IMAGE_EXTENSIONS), F.lit(False))


def is_supported(path: Column) -> Column:
    return is_raw(path) | is_standard(path)


def parse_percent(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, "%\\s*$", "")).cast("double") / 100.0


def normalize_sharpness(raw: Column) -> Column:
    """From 0 to 100 without a ceiling: 100 is half-way."""
    return F.when(raw <= 0, F.lit(0.0)).otherwise(raw * 100.0 / (raw + 100.0))


def sharpness_bucket(score: Column) -> Column:
    return F.when(score <= 40, "blurry").when(score <= 100, "soft").otherwise("sharp")


def overall_score(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the factors that are there; 0 if their weights have no sum. Weights are single precision."""
    weights = weights or WEIGHTS
    total, summed = F.lit(0.0), F.lit(0.0)
    for name, value in factors.items():
        w = F.lit(weights[name]).cast("float").cast("double")
        total = total + F.when(value.isNull(), F.lit(0.0)).otherwise(w)
        summed = summed + F.coalesce(w * value, F.lit(0.0))
    return F.when(total <= 0, F.lit(0.0)).otherwise(summed / total)


def is_disqualified(score: Column, manual: Column, threshold: float = REJECT_THRESHOLD) -> Column:
    """The manual mark if there is one, else whether the score is at the threshold or below."""
    return F.coalesce(manual, score <= F.lit(float(threshold)))


def region_fraction(mode: Column) -> Column:
    table = F.create_map(*[x for k, v in REGION_FRACTIONS.items() for x in (F.lit(k), F.lit(v).cast("float"))])
    return F.element_at(table, mode)


def classify_mode(has_face: Column, has_animal: Column, guess: Column) -> Column:
    return F.when(has_face, "Portrait").when(has_animal, "Animal").otherwise(guess)


def guess_mode(full: Column, center: Column) -> Column:
    """Object if the centre is much sharper than the whole frame."""
    return F.when(full <= 1.0, "Landscape").when(F.round(center / full, 9) > 1.6, "Object").otherwise("Landscape")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def dhash(values: list[Column]) -> Column:
    """64 bits of 8 rows of 9 values: a bit is set where a value is larger than its right neighbour, lowest bit first."""
    out = F.lit(0).cast("long")
    for i in range(64):
        left, right = values[i // 8 * 9 + i % 8], values[i // 8 * 9 + i % 8 + 1]
        bit = (1 << i) - (1 << 64 if i == 63 else 0)
        out = out.bitwiseOR(F.when(left > right, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def subject_crop(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The box 1.7 times as large about its centre, clipped: ``x, y, w, h`` as integers, in single precision."""

    def f(x: Column) -> Column:
        return x.cast("float")

    one, scale = F.lit(1.0).cast("float"), F.lit(1.7).cast("float")
    out = {}
    for at, low, high, size, length in (("x", "x1", "x2", width, "w"), ("y", "y1", "y2", height, "h")):
        middle = f((box[low] + box[high]) / F.lit(2.0).cast("float"))
        long = F.greatest(f((box[high] - box[low]) * scale), one)
        start = F.least(F.greatest(f(middle - f(long / F.lit(2.0).cast("float"))), F.lit(0.0).cast("float")), f(size) - one)
        out[at] = F.floor(start).cast("int")
        out[length] = F.floor(F.greatest(F.least(long, f(size) - start), one)).cast("int")
    return out


def subject_score(box: dict[str, Column], width: Column, height: Column) -> Column:
    """Prominence: six tenths size, full at 15 % of the frame, and four tenths closeness to the centre."""
    w, h = width.cast("double"), height.cast("double")
    area = F.greatest(box["x2"] - box["x1"], F.lit(0.0).cast("float")).cast("double") * F.greatest(box["y2"] - box["y1"], F.lit(0.0).cast("float")).cast("double")
    size = clamp(F.lit(100.0) * (area / (w * h)) / 0.15)
    dx = (box["x1"] + box["x2"]).cast("double") / 2.0 - w / 2.0
    dy = (box["y1"] + box["y2"]).cast("double") / 2.0 - h / 2.0
    farthest = F.sqrt(w * w + h * h) / 2.0
    near = clamp(F.lit(100.0) * (F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / F.greatest(farthest, F.lit(1.0))))
    return F.when((w <= 0) | (h <= 0), F.lit(50.0)).otherwise(size * 0.6 + near * 0.4)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    zero = F.lit(0.0).cast("float")
    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)

    def area(o: dict[str, Column]) -> Column:
        return F.greatest(o["x2"] - o["x1"], zero) * F.greatest(o["y2"] - o["y1"], zero)

    return inter / (area(a) + area(b) - inter + F.lit(1e-5))
