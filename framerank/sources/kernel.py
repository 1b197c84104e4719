"""Decoding and scoring of one photo in numpy: the same formulas as the relational ones in ``functions``."""

from __future__ import annotations

import io
import math
import struct
import zlib
from functools import lru_cache

import numpy as np

from framerank.schema import RAW_EXTENSIONS, REGION_FRACTIONS


class Unsupported(ValueError):
    pass


def decode_png(data: bytes) -> np.ndarray:
    """8-bit RGB of a non-interlaced PNG; alpha is dropped."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[6]:
        raise Unsupported("unsupported PNG")
    w, h, depth, kind = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    bpp = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * bpp)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(h, w, bpp))
    px = out.reshape(h, w, channels, depth // 8)[..., 0]
    if kind == 3:
        return palette[px[..., 0]]
    return px[..., :3] if channels >= 3 else np.repeat(px[..., :1], 3, axis=2)


def _unfiltered(how: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """PNG rows without their filters: row by row where none looks at two sides, else along diagonals, whose samples don't need each other."""
    h, w, bpp = rows.shape
    out = np.zeros((h + 1, w + 1, bpp), np.int16)  # with a row above and a column before
    if not np.isin(how, (3, 4)).any():
        for y in range(h):
            row = rows[y].astype(np.int64)
            row = np.cumsum(row, axis=0) if how[y] == 1 else row + out[y, 1:] if how[y] == 2 else row
            out[y + 1, 1:] = row & 255
        return out[1:, 1:].astype(np.uint8)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x, kind = d - y, how[y, None]
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.choose(np.broadcast_to(kind, left.shape), [np.zeros_like(left), left, above, (left + above) // 2, nearest])
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    start, = struct.unpack("<I", data[10:14])
    w, h, _, bits, how = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or how not in (0, 3):
        raise Unsupported("unsupported BMP")
    row = (w * bits // 8 + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return (px[::-1] if h > 0 else px)[..., 2::-1].copy()


def decode_other(data: bytes) -> tuple[np.ndarray, int]:
    """Anything else, and its orientation, where Pillow is there."""
    try:
        from PIL import Image
    except ImportError:
        raise Unsupported("unsupported in this environment") from None
    with Image.open(io.BytesIO(data)) as im:
        return np.asarray(im.convert("RGB")), int(im.getexif().get(274, 1))


def _jpeg_end(data: bytes, at: int) -> int:
    """Where the JPEG stream that starts at ``at`` ends; -1 if it doesn't. Markers inside segments, as of a thumbnail in EXIF data, are passed over."""
    at += 2
    while at + 4 <= len(data) + 2 and data[at : at + 1] == b"\xff":
        kind = data[at + 1]
        if kind == 0xD9:
            return at + 2
        if kind == 0xFF:
            at += 1
        elif kind == 0xD8:  # the beginning of another stream
            return -1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xDA:  # coded data: up to a marker that is neither a stuffed byte nor a restart
                while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                    at += 2
                if at < 0:
                    return -1
    return -1


def embedded_jpegs(data: bytes) -> list[bytes]:
    """JPEG streams inside a RAW container, largest first: the full image, then the preview, then the thumbnail."""
    out, at = [], 0
    while (at := data.find(b"\xff\xd8\xff", at)) >= 0:
        end = _jpeg_end(data, at)
        if end > 0:
            out.append(data[at:end])
        at += 3
    return sorted(out, key=len, reverse=True)


def decode(path: str, data: bytes, box: int) -> np.ndarray:
    """RGB of any supported photo, upright and fitted into ``box``."""
    if path.rsplit(".", 1)[-1].lower() in RAW_EXTENSIONS:
        for part in embedded_jpegs(data):
            try:
                rgb, turn = decode_other(part)
                break
            except Unsupported:
                raise
            except Exception:
                continue
        else:
            raise Unsupported(f"no usable preview found in {path}")
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        rgb, turn = decode_png(data), 1
    elif data[:2] == b"BM":
        rgb, turn = decode_bmp(data), 1
    else:
        rgb, turn = decode_other(data)
    return fit(orient(rgb, turn), box)


def orient(rgb: np.ndarray, tag: int) -> np.ndarray:
    """The orientation tag from 1 to 8; 5 and 7 mirror left to right before they turn."""
    turns = {2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 1), 6: (False, 3), 7: (True, 3), 8: (False, 1)}
    mirror, quarter = turns.get(tag, (False, 0))
    return np.ascontiguousarray(np.rot90(rgb[:, ::-1] if mirror else rgb, quarter))


def _taps(old: int, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Per sample of ``new``, the few of ``old`` that a triangle reaches, and their weights."""
    ratio = old / new
    reach = max(ratio, 1.0)
    middle = (np.arange(new) + 0.5) * ratio
    at = np.floor(middle - reach).astype(int)[:, None] + np.arange(int(2 * reach) + 3)[None, :]
    w = np.maximum(1 - np.abs(at + 0.5 - middle[:, None]) / reach, 0) * ((at >= 0) & (at < old))
    return np.clip(at, 0, old - 1), w / w.sum(1, keepdims=True)


def _resized(px: np.ndarray, new: int) -> np.ndarray:
    """``px`` with ``new`` rows."""
    at, w = _taps(px.shape[0], new)
    out = np.zeros((new, *px.shape[1:]))
    for k in range(at.shape[1]):
        out += px[at[:, k]] * w[:, k, None, None]
    return out


def resize(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    if rgb.shape[:2] == (h, w):
        return rgb
    tall = _resized(rgb, h)
    return np.clip(np.floor(_resized(tall.transpose(1, 0, 2), w).transpose(1, 0, 2) + 0.5), 0, 255).astype(np.uint8)


def fit(rgb: np.ndarray, box: int) -> np.ndarray:
    """Fills the box by the longer edge, up or down."""
    h, w = rgb.shape[:2]
    ratio = min(box / w, box / h)
    return resize(rgb, max(round(w * ratio), 1), max(round(h * ratio), 1))


def luma(rgb: np.ndarray) -> np.ndarray:
    p = rgb.astype(np.int64)
    return (p[..., 0] * 2126 + p[..., 1] * 7152 + p[..., 2] * 722) // 10000


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray.astype(np.int64), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def variance_of_laplacian(gray: np.ndarray) -> float:
    return float(laplacian(gray).var()) if gray.size else 0.0


def center_crop(gray: np.ndarray, fraction: float) -> np.ndarray:
    if fraction >= 1:
        return gray
    (h, w), f = gray.shape, np.float32(fraction)
    cw, ch = (int(max(math.floor(np.float32(n) * f + np.float32(0.5)), 1)) for n in (w, h))
    x, y = (w - cw) // 2, (h - ch) // 2
    return gray[y : y + ch, x : x + cw]


def subject_crop(gray: np.ndarray, box: dict) -> np.ndarray:
    out = []
    for low, high, size in ((box["y1"], box["y2"], gray.shape[0]), (box["x1"], box["x2"], gray.shape[1])):
        low, high, one = np.float32(low), np.float32(high), np.float32(1)
        long = max((high - low) * np.float32(1.7), one)
        start = min(max((low + high) / np.float32(2) - long / np.float32(2), np.float32(0)), np.float32(size) - one)
        out.append(slice(int(start), int(start) + int(max(min(long, np.float32(size) - start), one))))
    return gray[out[0], out[1]]


def sharpest_region(gray: np.ndarray, grid: int = 16, share: float = 0.05) -> float:
    h, w = gray.shape
    tile = max(max(w, h) // grid, 8)
    if w < tile or h < tile:
        return variance_of_laplacian(gray)
    lap = laplacian(gray)
    parts = (lap[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile))
    scores = sorted((float(p.var()) for p in parts if min(p.shape) >= tile // 2), reverse=True)
    k = max(math.ceil(len(scores) * share), 1)
    return sum(scores[:k]) / k if scores else variance_of_laplacian(gray)


def guess_mode(gray: np.ndarray) -> str:
    full = variance_of_laplacian(gray)
    return "Object" if full > 1 and variance_of_laplacian(center_crop(gray, 0.5)) / full > 1.6 else "Landscape"


def factors(rgb: np.ndarray, gray: np.ndarray, raw: float, subject: dict | None) -> dict:
    h, w = gray.shape
    clamp = lambda v: float(min(max(v, 0.0), 100.0))
    exposure = clamp(100 * (1 - abs(gray.mean() - 128) / 128) - 100 * float(((gray <= 3) | (gray >= 252)).mean()))
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    rg, yb = r - g, 0.5 * (r + g) - b
    color = clamp(100 * (math.sqrt(rg.var() + yb.var()) + 0.3 * math.hypot(rg.mean(), yb.mean())) / 110)
    composition, energy = 50.0, np.abs(laplacian(gray))
    if w >= 4 and h >= 4 and energy.sum() > 0:
        near, base = np.zeros((h, w), bool), 1.0
        for n, axis in ((w, 1), (h, 0)):
            band = max(n * 0.10, 1.0)
            hit = np.any([np.abs(np.arange(n) - t) <= band for t in (n / 3, 2 * n / 3)], axis=0)
            near |= hit[None, :] if axis else hit[:, None]
            base *= 1 - min(2 * band / n, 1.0)
        base = 1 - base
        composition = clamp(50 + 50 * (energy[near].sum() / energy.sum() - base) / max(1 - base, 1e-6))
    prominence = None
    if subject:
        area = max(subject["x2"] - subject["x1"], 0) * max(subject["y2"] - subject["y1"], 0) / (w * h)
        off = math.hypot((subject["x1"] + subject["x2"]) / 2 - w / 2, (subject["y1"] + subject["y2"]) / 2 - h / 2)
        prominence = 0.6 * clamp(100 * area / 0.15) + 0.4 * clamp(100 * (1 - off / max(math.hypot(w, h) / 2, 1.0)))
    sharpness = 100 * raw / (raw + 100) if raw > 0 else 0.0
    return {"sharpness": sharpness, "exposure": exposure, "contrast": clamp(100 * gray.std() / 64), "color": color, "composition": composition, "subject": prominence}


def dhash(rgb: np.ndarray) -> int:
    g = luma(resize(rgb, 9, 8))
    bits = (g[:, :-1] > g[:, 1:]).reshape(-1)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    inter = np.prod(np.maximum(np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]), 0))
    return float(inter / (np.prod(np.maximum(a[2:] - a[:2], 0)) + np.prod(np.maximum(b[2:] - b[:2], 0)) - inter + 1e-5))


def suppressed(scores: np.ndarray, boxes: np.ndarray, most: float = 0.3) -> list[int]:
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        if not np.isnan(scores[i]) and all(iou(boxes[k], boxes[i]) <= most for k in kept):
            kept.append(int(i))
    return kept


@lru_cache(maxsize=4)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


def _largest(scores: np.ndarray, boxes: np.ndarray, scale: list[float], limit: tuple[float, float], share: float) -> dict | None:
    """The largest box that is left. Boxes are suppressed in the network's own units, then scaled to pixels."""
    keep = suppressed(scores, boxes)
    clipped = [(float(scores[i]), np.clip(boxes[i] * scale, 0, [*limit, *limit])) for i in keep]
    best = [(float((b[2] - b[0]) * (b[3] - b[1])), s, b) for s, b in clipped if (b[2] - b[0]) * (b[3] - b[1]) / (limit[0] * limit[1]) >= share]
    if not best:
        return None
    _, s, b = max(best, key=lambda x: (x[0], x[1]))
    return {"x1": float(b[0]), "y1": float(b[1]), "x2": float(b[2]), "y2": float(b[3]), "score": s}


def face_input(rgb: np.ndarray) -> np.ndarray:
    return ((resize(rgb, 320, 240).astype(np.float32) - 127) / 128).transpose(2, 0, 1)[None]


def animal_input(rgb: np.ndarray) -> tuple[np.ndarray, float]:
    """Letterboxed at the top left, channels reversed; and the scale."""
    h, w = rgb.shape[:2]
    scale = min(416 / w, 416 / h)
    nw, nh = (min(max(math.floor(n * scale + 0.5), 1), 416) for n in (w, h))
    out = np.full((416, 416, 3), 114, np.float32)
    out[:nh, :nw] = resize(rgb, nw, nh)[..., ::-1]
    return out.transpose(2, 0, 1)[None], scale


def priors() -> np.ndarray:
    rows = []
    for fw, fh, sizes in ((40, 30, (10, 16, 24)), (20, 15, (32, 48)), (10, 8, (64, 96)), (5, 4, (128, 192, 256))):
        y, x, s = np.meshgrid(np.arange(fh), np.arange(fw), np.array(sizes, float), indexing="ij")
        rows.append(np.stack([(x + 0.5) / fw, (y + 0.5) / fh, np.minimum(s / 320, 1), np.minimum(s / 240, 1)], -1).reshape(-1, 4))
    return np.concatenate(rows).astype(np.float32)


def cells() -> np.ndarray:
    rows = []
    for stride in (8, 16, 32):
        y, x = np.meshgrid(np.arange(416 // stride), np.arange(416 // stride), indexing="ij")
        rows.append(np.stack([x, y, np.full_like(x, stride)], -1).reshape(-1, 3))
    return np.concatenate(rows).astype(np.float32)


def main_face(rgb: np.ndarray, model: str) -> dict | None:
    """The largest face; nothing if the network fails."""
    try:
        session = _session(model)
        scores, deltas = session.run(None, {session.get_inputs()[0].name: face_input(rgb)})[:2]
    except Exception:
        return None
    p, scores, deltas = priors(), scores.reshape(-1, 2)[:, 1], deltas.reshape(-1, 4)
    keep = scores > 0.7
    p, scores, d = p[keep], scores[keep], deltas[keep]
    middle, size = d[:, :2] * 0.1 * p[:, 2:] + p[:, :2], np.exp(d[:, 2:] * 0.2) * p[:, 2:]
    h, w = rgb.shape[:2]
    return _largest(scores, np.concatenate([middle - size / 2, middle + size / 2], 1), [w, h, w, h], (w, h), 0.001)


def main_animal(rgb: np.ndarray, model: str) -> dict | None:
    """The largest animal; nothing if the network fails."""
    try:
        session = _session(model)
        tensor, scale = animal_input(rgb)
        out = session.run(None, {session.get_inputs()[0].name: tensor})[0].reshape(-1, 85)
    except Exception:
        return None
    c = cells()
    scores = out[:, 4] * np.maximum(out[:, 19:29].max(1), 0)
    keep = scores >= 0.35
    o, c, scores = out[keep], c[keep], scores[keep]
    middle, size = (o[:, :2] + c[:, :2]) * c[:, 2:], np.exp(o[:, 2:4]) * c[:, 2:]
    h, w = rgb.shape[:2]
    return _largest(scores, np.concatenate([middle - size / 2, middle + size / 2], 1), [1 / scale] * 4, (w, h), 0.003)


def classify(rgb: np.ndarray, gray: np.ndarray, mode: str | None, models: dict[str, str]) -> tuple[str, dict | None]:
    """The mode and the subject; the second network runs only if the first finds nothing."""
    face = lambda: main_face(rgb, models["face"]) if models.get("face") else None
    animal = lambda: main_animal(rgb, models["animal"]) if models.get("animal") else None
    if mode:
        return mode, face() if mode == "Portrait" else animal() if mode == "Animal" else None
    if found := face():
        return "Portrait", found
    if found := animal():
        return "Animal", found
    return guess_mode(gray), None


def score(gray: np.ndarray, mode: str, subject: dict | None, method: str) -> float:
    if subject:
        return variance_of_laplacian(subject_crop(gray, subject))
    return sharpest_region(gray) if method == "SharpestRegion" else variance_of_laplacian(center_crop(gray, REGION_FRACTIONS[mode]))


def scan_one(path: str, data: bytes, mode: str | None, method: str, box: int, thumb: int, models: dict[str, str]) -> tuple:
    try:
        rgb = decode(path, data, box)
    except Exception as e:
        return path, None, None, None, None, None, None, None, None, str(e) or type(e).__name__
    gray = luma(rgb)
    mode, subject = classify(rgb, gray, mode, models)
    raw = score(gray, mode, subject, method)
    small = fit(rgb, thumb) if thumb else None
    return path, mode, subject, rgb.shape[1], rgb.shape[0], raw, factors(rgb, gray, raw, subject), dhash(rgb), None if small is None else {"w": small.shape[1], "h": small.shape[0], "rgb": small.tobytes()}, None


def preview_one(path: str, data: bytes, box: int) -> tuple:
    try:
        rgb = decode(path, data, box)
    except Exception as e:
        return path, None, None, None, str(e) or type(e).__name__
    return path, rgb.shape[1], rgb.shape[0], rgb.tobytes(), None


def report_one(path: str, data: bytes, box: int, models: dict[str, str]) -> str:
    """One line: size, mode, both sharpness methods, factors, overall and the time it took; or the error."""
    import time

    from framerank.schema import WEIGHTS

    start, name = time.perf_counter(), path.rsplit("/", 1)[-1]
    try:
        rgb = decode(path, data, box)
    except Exception as e:
        return f"{name}: ERR {e or type(e).__name__}"
    gray = luma(rgb)
    mode, subject = classify(rgb, gray, None, models)
    raw, tiles = score(gray, mode, subject, "FixedRegion"), score(gray, mode, subject, "SharpestRegion")
    f = factors(rgb, gray, raw, subject)
    parts = {k: w for k, w in WEIGHTS.items() if f[k] is not None}
    overall = sum(f[k] * w for k, w in parts.items()) / sum(parts.values())
    shown = " ".join(f"{k}={'-' if f[k] is None else format(f[k], '.0f')}" for k in WEIGHTS)
    return f"{name}: OK {rgb.shape[1]}x{rgb.shape[0]} mode={mode} subject={str(subject is not None).lower()} score={raw:.0f} sharpest_region={tiles:.0f} {shown} overall={overall:.0f} ({(time.perf_counter() - start) * 1000:.0f}ms)"
