"""Names, defaults and parameter domains that the operators share."""

from __future__ import annotations

MODES = ("Landscape", "Portrait", "Object", "Animal")
METHODS = ("FixedRegion", "SharpestRegion")
METHOD_LABELS = {"FixedRegion": "Fixed region", "SharpestRegion": "Sharpest region"}
REJECTS_FOLDER = "disqualified"

# File extensions of RAW photos and of other images.
RAW_EXTENSIONS = ("cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "orf", "rw2", "raf", "dng", "pef", "ptx", "srw", "x3f", "3fr", "erf", "kdc", "mrw", "raw", "mos", "iiq", "rwl", "dcr")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")

# The factors and their default weights, single precision.
WEIGHTS = {"sharpness": 0.25, "exposure": 0.15, "contrast": 0.10, "color": 0.10, "composition": 0.25, "subject": 0.15}

# The share of width and height that is scored, by mode.
REGION_FRACTIONS = {"Landscape": 1.0, "Portrait": 0.45, "Object": 0.6, "Animal": 0.6}

REJECT_THRESHOLD, HASH_DISTANCE, TOP_N = 32.0, 6, 150
SCORE_BOX, THUMB_BOX, HOVER_BOX, VIEW_BOX = 1600, 220, 1200, 2400

SCAN_SCHEMA = (
    "path string, mode string, subject struct<x1: float, y1: float, x2: float, y2: float, score: float>, width int, height int, score double, "
    "metrics struct<sharpness: double, exposure: double, contrast: double, color: double, composition: double, subject: double>, "
    "phash long, thumb struct<w: int, h: int, rgb: binary>, error string"
)


def checked(*, threshold: float | None = None, distance: int | None = None, top_n: int | None = None, weights: dict[str, float] | None = None, mode: str | None = None, method: str | None = None) -> None:
    """Raises ``ValueError`` for parameters outside their domains."""
    if threshold is not None and not threshold >= 0:
        raise ValueError(f"threshold {threshold} is below 0")
    if distance is not None and not 0 <= distance <= 64:
        raise ValueError(f"hash distance {distance} is outside 0 to 64")
    if top_n is not None and not 1 <= top_n <= 100_000:
        raise ValueError(f"top N {top_n} is outside 1 to 100000")
    if weights is not None and (set(weights) != set(WEIGHTS) or not all(0 <= w <= 1 for w in weights.values())):
        raise ValueError("weights are six numbers from 0 to 1, one for each factor")
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown sharpness method {method}")
