"""Baseline JPEG files from arrays: transform, quantisation and Huffman codes over whole images in numpy.

Codes are built for each image from its own symbols, so no code table is held here. Colour is stored at half its size both
ways, as usual encoders do; grey images have one component.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

# The quantisation tables of the standard for brightness and colour, at quality 50
LUMINANCE = [
    [16, 11, 10, 16, 24, 40, 51, 61],
    [12, 12, 14, 19, 26, 58, 60, 55],
    [14, 13, 16, 24, 40, 57, 69, 56],
    [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77],
    [24, 35, 55, 64, 81, 104, 113, 92],
    [49, 64, 78, 87, 103, 121, 120, 101],
    [72, 92, 95, 98, 112, 100, 103, 99],
]
CHROMINANCE = [
    [17, 18, 24, 47, 99, 99, 99, 99],
    [18, 21, 26, 66, 99, 99, 99, 99],
    [24, 26, 56, 99, 99, 99, 99, 99],
    [47, 66, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
    [99, 99, 99, 99, 99, 99, 99, 99],
]

_N = np.arange(8)
_COSINES = np.cos((2 * _N[None] + 1) * _N[:, None] * np.pi / 16) * np.where(_N == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: Places of a block by diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def quantisers(table: list[list[int]], quality: int) -> np.ndarray:
    """The table at a quality from 1 to 100."""
    if not 1 <= quality <= 100:
        raise ValueError(quality)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """(block rows, block columns, 64) whole coefficients in zigzag order."""
    h, w = plane.shape
    cells = (plane - 128.0).reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)
    found = np.rint(_COSINES @ cells @ _COSINES.T / quantiser).astype(np.int64)
    return found.reshape(h // 8, w // 8, 64)[..., ZIGZAG]


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _symbols(blocks: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, place, symbol, extra bits, their number) of a component's blocks (n, 64) with the differences of their first value.

    Places of a block: 0 the first value, 2k and 2k + 1 the long runs before value k and itself, 128 the end.
    """
    n, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    v = blocks[n, k]
    before = np.where(np.r_[-1, n[:-1]] == n, np.r_[0, k[:-1]], 0) if len(n) else k
    run = k - before - 1
    long = np.repeat(np.arange(len(n)), run // 16)
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, n, k)
    ends = np.flatnonzero(last < 63)
    values = np.r_[steps, v, np.zeros(len(long) + len(ends), np.int64)]
    size = _sizes(values)
    block = np.r_[np.arange(len(blocks)), n, n[long], ends]
    place = np.r_[np.zeros(len(blocks), np.int64), 2 * k + 1, 2 * k[long], np.full(len(ends), 128)]
    symbol = np.r_[size[: len(blocks)], run % 16 << 4 | _sizes(v), np.full(len(long), 0xF0), np.zeros(len(ends), np.int64)]
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return block, place, symbol, extra, size


def code_lengths(counts: dict[int, int], limit: int = 16) -> dict[int, int]:
    """Bits of the best prefix code with no code longer than limit (packages of pairs, merged limit times)."""
    leaves = sorted((c, (s,)) for s, c in counts.items())
    held: list = []
    for _ in range(limit):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(held[::2], held[1::2], strict=False)]
        held = sorted(leaves + pairs, key=lambda x: x[0])
    return dict(Counter(s for _, some in held[: 2 * len(leaves) - 2] for s in some))


def _table(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(stored table, code by symbol, bits by symbol); one code of all ones is left unused, as the format wants."""
    counts = dict(zip(*(x.tolist() for x in np.unique(symbols, return_counts=True)), strict=True))
    bits = code_lengths(counts | {-1: 0})
    order = sorted(counts, key=lambda s: (bits[s], s))
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= bits[s] - at
        at = bits[s]
        codes[s], lengths[s] = code, at
        code += 1
    return bytes(sum(bits[s] == n for s in order) for n in range(1, 17)) + bytes(order), codes, lengths


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _planes(image: np.ndarray) -> list[np.ndarray]:
    """Planes padded to whole units by their edges, colour (blue, green, red) averaged over squares of four."""
    image = image.astype(np.float64)
    unit = 8 if image.ndim == 2 else 16
    pad = [(0, -image.shape[0] % unit), (0, -image.shape[1] % unit)] + [(0, 0)] * (image.ndim - 2)
    image = np.pad(image, pad, mode="edge")
    if image.ndim == 2:
        return [image]
    b, g, r = (image[..., i] for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    halves = [(128 + (b - y) / 1.772), (128 + (r - y) / 1.402)]
    return [y] + [c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean(axis=(1, 3)) for c in halves]


def jpeg(image: np.ndarray, quality: int = 85) -> bytes:
    """A file of an image (height, width) or (height, width, 3: blue, green, red) of bytes."""
    height, width = image.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise ValueError(f"{height} x {width}")
    tables = [quantisers(LUMINANCE, quality), quantisers(CHROMINANCE, quality)]
    planes = _planes(image)
    parts = []
    for c, plane in enumerate(planes):
        blocks = _blocks(plane, tables[c > 0])
        rows, columns = blocks.shape[:2]
        if c == 0 and len(planes) == 3:  # four blocks of brightness in a unit
            blocks = blocks.reshape(rows // 2, 2, columns // 2, 2, 64).swapaxes(1, 2)
            per, first = 4, 0
        else:
            per, first = 1, c + 3 if c else 0
        blocks = blocks.reshape(-1, 64)
        block, *rest = _symbols(blocks, np.diff(blocks[:, 0], prepend=0))
        order = (block // per) * 6 + first + block % per  # six blocks in a unit at most
        parts.append((np.full(len(block), int(c > 0)), order, *rest))
    kind, block, place, symbol, extra, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, block))
    kind, place, symbol, extra, size = (x[order] for x in (kind, place, symbol, extra, size))
    code, bits, stored = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), b""
    for k in range(1 + (len(planes) == 3)):
        for ac in (0, 1):
            mine = (kind == k) & ((place > 0) == ac)
            table, codes, lengths = _table(symbol[mine])
            code[mine], bits[mine] = codes[symbol[mine]], lengths[symbol[mine]]
            stored += _segment(0xC4, bytes([ac << 4 | k]) + table)
    value, bits = code << size | extra, bits + size
    ends = np.cumsum(bits)
    shift = np.repeat(ends, bits) - 1 - np.arange(ends[-1])
    stream = (np.repeat(value, bits) >> shift & 1).astype(np.uint8)
    packed = np.packbits(np.r_[stream, np.ones(-len(stream) % 8, np.uint8)])
    packed = np.insert(packed, np.flatnonzero(packed == 0xFF) + 1, 0)

    ids = range(len(planes))
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, t in enumerate(tables[: 1 + (len(planes) == 3)]):
        out += _segment(0xDB, bytes([k]) + bytes(t.reshape(64)[ZIGZAG].tolist()))
    sampled = [0x22 if c == 0 and len(planes) == 3 else 0x11 for c in ids]
    out += _segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, sampled[c], int(c > 0)]) for c in ids))
    out += stored
    out += _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in ids) + b"\0\x3f\0")
    return out + packed.tobytes() + b"\xff\xd9"
