"""Frame kernels in numpy: frames in, numbers out.

Frames are height x width x 3 (blue, green, red) or height x width (gray) uint8 arrays. The UDF
factories at the end wrap kernels for columns of raw bytes, one Arrow batch at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# HSV ranges (hue 0-180, saturation and value 0-255), both ends inclusive.
SKIN_OFFLINE = (((0, 20, 70), (20, 255, 255)),)
SKIN_ONLINE = (((0, 20, 70), (20, 150, 255)), ((0, 20, 0), (20, 150, 120)))
SKIN_MASK = (((0, 20, 0), (20, 150, 255)),)
BOARD = (((0, 0, 0), (180, 255, 80)), ((35, 40, 40), (85, 255, 255)), ((0, 0, 180), (180, 30, 255)))
BLACK = 50


def gray(frame: np.ndarray) -> np.ndarray:
    if frame.ndim == 2:
        return frame
    weighted = frame.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    return np.floor(weighted + 0.5).astype(np.uint8)


def hsv(frame: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0-179), saturation and value 0-255."""
    b, g, r = (frame[..., k].astype(np.float64) for k in range(3))
    value = np.maximum(np.maximum(b, g), r)
    span = value - np.minimum(np.minimum(b, g), r)
    safe = np.where(span == 0, 1, span)
    hue = np.select([span == 0, value == r, value == g], [0.0, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    hue = np.where(hue < 0, hue + 360, hue) / 2
    saturation = np.where(value == 0, 0, 255 * span / np.where(value == 0, 1, value))
    return np.stack([np.floor(hue + 0.5) % 180, np.floor(saturation + 0.5), value], axis=-1).astype(np.uint8)


def in_ranges(image: np.ndarray, ranges) -> np.ndarray:
    out = np.zeros(image.shape[:2], bool)
    for low, high in ranges:
        out |= ((image >= np.array(low)) & (image <= np.array(high))).all(axis=-1)
    return out


def black_ratio(frame: np.ndarray) -> float:
    """Share of pixels whose channels (or gray value) are all below BLACK."""
    dark = frame < BLACK
    return float((dark.all(axis=-1) if frame.ndim == 3 else dark).mean())


def skin_ratio(frame: np.ndarray, ranges=SKIN_OFFLINE) -> float:
    return float(in_ranges(hsv(frame), ranges).mean())


def teacher_presence(frame: np.ndarray, form: str = "offline") -> float:
    """offline: black + skin shares; online: skin alone; clipped: the sum within [0, 1]; percent: masked skin in %."""
    if form == "online":
        return skin_ratio(frame, SKIN_ONLINE)
    if form == "percent":
        return 100 * skin_ratio(frame, SKIN_MASK)
    total = black_ratio(frame) + skin_ratio(frame)
    return min(max(total, 0.0), 1.0) if form == "clipped" else total


def _box(x: np.ndarray, size: int) -> np.ndarray:
    """Means over all size x size windows that fit."""
    sums = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2


def ssim(a: np.ndarray, b: np.ndarray, size: int = 7, span: float = 255.0) -> float:
    """Mean structural similarity: uniform windows, sample covariance, K1 = .01, K2 = .03.

    Windows that reach over the border are left out; images smaller than the window give 0.
    """
    if a.shape != b.shape or min(a.shape[:2]) < size:
        return 0.0
    x, y = a.astype(np.float64), b.astype(np.float64)
    unbiased = size**2 / (size**2 - 1)
    mx, my = _box(x, size), _box(y, size)
    vx, vy, vxy = (unbiased * (_box(p, size) - q) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def resize_nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.arange(height) * image.shape[0] // height
    columns = np.arange(width) * image.shape[1] // width
    return image[rows][:, columns]


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size: pixel centres mapped back, four neighbours weighted, borders repeated, rounded to nearest."""
    if image.shape[:2] == (height, width):
        return image

    def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        low = np.floor(at).astype(np.int64)
        return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), np.where(low < 0, 0.0, at - low)

    y0, y1, fy = taps(image.shape[0], height)
    x0, x1, fx = taps(image.shape[1], width)
    x = image.astype(np.float64)
    fy, fx = (fy[:, None, None], fx[None, :, None]) if x.ndim == 3 else (fy[:, None], fx[None, :])
    rows = x[y0] * (1 - fy) + x[y1] * fy
    return np.floor(rows[:, x0] * (1 - fx) + rows[:, x1] * fx + 0.5).astype(image.dtype)


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size: means over the area that each new pixel covers, as floating point."""

    def cover(n: int, m: int) -> np.ndarray:
        low, high = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        at = np.arange(n)
        return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) * m / n

    rows, columns = cover(image.shape[0], height), cover(image.shape[1], width)
    x = np.tensordot(rows, image.astype(np.float64), 1)
    return np.moveaxis(np.tensordot(columns, x, (1, 1)), 0, 1)


def board_ssim(current: np.ndarray, other: np.ndarray) -> float:
    """SSIM of the grays with the current frame's skin pixels blanked in both; other takes current's size."""
    if other.shape != current.shape:
        other = resize_bilinear(other, *current.shape[:2])
    board = ~in_ranges(hsv(current), SKIN_MASK)
    return ssim(gray(current) * board, gray(other) * board)


def smaller_ssim(a: np.ndarray, b: np.ndarray) -> float:
    """SSIM at the smaller height and width of both."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    return ssim(resize_bilinear(gray(a), h, w), resize_bilinear(gray(b), h, w))


def mse(a: np.ndarray, b: np.ndarray) -> float:
    return float(((gray(a).astype(np.float64) - gray(b).astype(np.float64)) ** 2).mean())


def _correlation(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p - p.mean(), q - q.mean()
    norm = float(np.sqrt((p * p).sum() * (q * q).sum()))
    return float((p * q).sum()) / norm if norm else 1.0


def histogram_correlation(a: np.ndarray, b: np.ndarray, colour: bool = True) -> float:
    """Correlation of 8 x 8 x 8 colour histograms, at least 0, or of 256-bin gray ones, as it is."""
    if not colour:
        return _correlation(*(np.bincount(gray(x).ravel(), minlength=256).astype(np.float64) for x in (a, b)))
    bins = [np.bincount((x // 32).astype(np.int64).reshape(-1, 3) @ np.array([64, 8, 1]), minlength=512).astype(np.float64) for x in (a, b)]
    return max(0.0, _correlation(*bins))


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 Sobel derivatives with mirrored borders that repeat no edge row."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return across[:, 2:] - across[:, :-2], down[2:] - down[:-2]


def canny(image: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge mask: L1 gradient, thinning along four directions, hysteresis over eight neighbours."""
    gx, gy = gradients(image)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    at = lambda dy, dx: p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx]
    flat = np.abs(gy) < 0.41421356 * np.abs(gx)
    steep = np.abs(gy) > 2.41421356 * np.abs(gx)
    same = gx * gy > 0
    one = np.select([flat, steep, same], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    two = np.select([flat, steep, same], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    thin = (size > one) & (size >= two)
    weak, edges = thin & (size > low), thin & (size > high)
    while True:
        grown = np.pad(edges, 1)
        grown = np.logical_or.reduce([grown[1 + y : grown.shape[0] - 1 + y, 1 + x : grown.shape[1] - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1)])
        after = weak & grown
        if (after == edges).all():
            return edges
        edges = after


def zones(image: np.ndarray, other: np.ndarray, bottom_only: bool = True) -> list[tuple[float, float]]:
    """(SSIM, edge density) of the left, centre and right third, of the lowest fifth of rows or of all."""
    a, b = gray(image), gray(other)
    top = int(a.shape[0] * 0.8) if bottom_only else 0
    third = a.shape[1] // 3
    ea, eb = canny(a), canny(b)
    out = []
    for k in range(3):
        cut = (slice(top, None), slice(k * third, (k + 1) * third if k < 2 else None))
        now, before = float(ea[cut].mean()), float(eb[cut].mean())
        out.append((ssim(a[cut], b[cut]), (now + before) / 2 if bottom_only else now))
    return out


def board_visibility(frame: np.ndarray) -> float:
    return float(in_ranges(hsv(frame), BOARD).mean())


def laplacian_variance(image: np.ndarray) -> float:
    p = np.pad(gray(image).astype(np.float64), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def sharpness(image: np.ndarray) -> float:
    return min(laplacian_variance(image) / 200, 1.0)


def brightness(image: np.ndarray) -> float:
    return float(gray(image).mean())


def contrast(image: np.ndarray) -> float:
    return float(gray(image).std())


def edge_score(image: np.ndarray) -> tuple[float, float]:
    """(edge share, evenness over a 3 x 3 grid): max(1 - cv / 2, .3), .5 without edges; remainder rows and columns are left out of the grid."""
    edges = canny(gray(image))
    h, w = edges.shape[0] // 3, edges.shape[1] // 3
    cells = np.array([edges[y * h : (y + 1) * h, x * w : (x + 1) * w].mean() for y in range(3) for x in range(3)]) if h and w else np.zeros(9)
    mean = cells.mean()
    return float(edges.mean()), 0.5 if mean == 0 else float(max(1 - cells.std() / (mean + 1e-6) / 2, 0.3))


def _blurred(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian mean over size x size with the deviation that belongs to the size, borders repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    bell = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    bell /= bell.sum()
    p = np.pad(image.astype(np.float64), size // 2, mode="edge")
    rows = sum(w * p[k : k + image.shape[0]] for k, w in enumerate(bell))
    return sum(w * rows[:, k : k + image.shape[1]] for k, w in enumerate(bell))


def adaptive_binary(image: np.ndarray, size: int = 11, offset: float = 2) -> np.ndarray:
    """Gaussian-adaptive threshold as used ahead of text recognition: 255 above the neighbourhood's rounded mean less offset."""
    g = gray(image)
    return np.where(g > np.floor(_blurred(g, size) + 0.5) - offset, 255, 0).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means of a gray image: each pixel is the mean of its search window, weighted by how alike the patches around are.

    A weight is exp(-d / strength^2) of the mean squared difference d of two patches. One pass per
    displacement over the whole image; memory is a few images.
    """
    g = gray(image).astype(np.float64)
    h, w = g.shape
    p, r = patch // 2, search // 2
    wide = np.pad(g, p + r, mode="reflect" if min(h, w) > p + r else "symmetric" if min(h, w) >= p + r else "edge")
    own = wide[r : r + h + 2 * p, r : r + w + 2 * p]
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
            weight = np.exp(-_box((own - other) ** 2, patch) / strength**2)
            total += weight * other[p : p + h, p : p + w]
            weights += weight
    return np.clip(np.floor(total / weights + 0.5), 0, 255).astype(np.uint8)


def clahe(image: np.ndarray, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Contrast-limited histogram equalisation: a clipped histogram per tile, its curves blended between tile centres."""
    g = gray(image)
    h, w = g.shape
    ny, nx = tiles
    th, tw = -(-h // ny), -(-w // nx)
    p = np.pad(g, ((0, th * ny - h), (0, tw * nx - w)), mode="reflect" if h > th * ny - h and w > tw * nx - w else "edge")
    cells = p.reshape(ny, th, nx, tw).transpose(0, 2, 1, 3).reshape(ny * nx, th * tw)
    counts = np.stack([np.bincount(c, minlength=256) for c in cells])
    limit = max(int(clip * th * tw / 256), 1)
    over = np.maximum(counts - limit, 0).sum(axis=1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None]
    # what is left over goes to every so many bins
    for cell, rest in enumerate((over % 256).tolist()):
        if rest:
            counts[cell, :: max(256 // rest, 1)][:rest] += 1
    curves = np.floor(counts.cumsum(axis=1) * (255 / (th * tw)) + 0.5).clip(0, 255).reshape(ny, nx, 256)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: curves[np.clip(y0 + a, 0, ny - 1)[:, None], np.clip(x0 + b, 0, nx - 1)[None, :], g]
    blended = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.floor(blended + 0.5).clip(0, 255).astype(np.uint8)


def for_recognition(image: np.ndarray) -> np.ndarray:
    """A frame made ready for text recognition: gray, denoised, contrast raised, thresholded."""
    return adaptive_binary(clahe(denoise(gray(image))))


def png(image: np.ndarray) -> bytes:
    """A gray or colour (blue, green, red) frame as a PNG file."""
    h, w = image.shape[:2]
    samples = image if image.ndim == 2 else image[..., ::-1]
    lines = np.concatenate((np.zeros((h, 1), np.uint8), samples.reshape(h, -1)), axis=1)  # filter 0 before each line
    # Signature and chunk names of the format.
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(data, height: int, width: int) -> np.ndarray:
    """A frame from bytes or from an array column's numbers, channels last."""
    flat = np.frombuffer(data, np.uint8) if isinstance(data, bytes | bytearray) else np.asarray(data, np.uint8)
    channels = len(flat) // (height * width)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)


def frame_udf(kernel: Callable[[np.ndarray], float]):
    """A pandas UDF (data, height, width) -> double for a kernel of one frame."""

    @F.pandas_udf("double")
    def run(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([float(kernel(decode(d, h, w))) if d is not None else None for d, h, w in zip(data, height, width, strict=True)], dtype="float64")

    return run


def pair_udf(kernel: Callable[[np.ndarray, np.ndarray], float], missing: float):
    """A pandas UDF (data, other, height, width) -> double; `missing` where there is no other frame."""

    @F.pandas_udf("double")
    def run(data: pd.Series, other: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([missing if o is None or d is None else float(kernel(decode(d, h, w), decode(o, h, w))) for d, o, h, w in zip(data, other, height, width, strict=True)], dtype="float64")

    return run


def png_udf():
    """A pandas UDF (data, height, width) -> PNG bytes."""

    @F.pandas_udf("binary")
    def run(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([png(decode(d, h, w)) if d is not None else None for d, h, w in zip(data, height, width, strict=True)], dtype="object")

    return run
