"""Kernels against plain loops."""

import numpy as np

from tidemark.functions import kernels as k

RNG = np.random.default_rng(4)
GRAY = RNG.integers(0, 256, (24, 31), dtype=np.uint8)
OTHER = np.clip(GRAY.astype(int) + RNG.integers(-20, 20, GRAY.shape), 0, 255).astype(np.uint8)
COLOUR = RNG.integers(0, 256, (13, 17, 3), dtype=np.uint8)


def test_ssim_by_loops():
    a, b, out = GRAY.astype(float), OTHER.astype(float), []
    for y in range(a.shape[0] - 6):
        for x in range(a.shape[1] - 6):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + 6.5025) * (2 * c[0, 1] + 58.5225) / ((p.mean() ** 2 + q.mean() ** 2 + 6.5025) * (c[0, 0] + c[1, 1] + 58.5225)))
    assert abs(k.ssim(GRAY, OTHER) - np.mean(out)) < 1e-9
    assert k.ssim(GRAY, GRAY) == 1.0
    assert k.ssim(GRAY, OTHER[:5]) == 0.0


def test_hsv_known_colours():
    bgr = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255], [0, 0, 0], [0, 128, 128]]], np.uint8)
    assert k.hsv(bgr)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0], [30, 255, 128]]


def test_ratios():
    frame = np.zeros((2, 2, 3), np.uint8)
    frame[0, 0] = (90, 120, 200)
    assert k.black_ratio(frame) == 0.75
    assert k.skin_ratio(frame) == 0.25
    assert k.teacher_presence(frame) == 1.0
    assert k.teacher_presence(frame, "percent") == 25.0
    assert k.board_visibility(frame) == 0.75


def test_laplacian_by_loops():
    p = np.pad(GRAY.astype(float), 1, mode="reflect")
    z = [p[y, x + 1] + p[y + 2, x + 1] + p[y + 1, x] + p[y + 1, x + 2] - 4 * p[y + 1, x + 1] for y in range(24) for x in range(31)]
    assert abs(k.laplacian_variance(GRAY) - np.var(z)) < 1e-6


def test_canny_finds_a_step():
    step = np.zeros((20, 20), np.uint8)
    step[:, 10:] = 200
    edges = k.canny(step)
    assert edges[:, 9:11].any(axis=1).all()
    assert not edges[:, :8].any() and not edges[:, 12:].any()
    assert not k.canny(np.full((9, 9), 7, np.uint8)).any()


def test_histograms_and_mse():
    assert abs(k.histogram_correlation(COLOUR, COLOUR) - 1) < 1e-12
    assert k.histogram_correlation(COLOUR, 255 - COLOUR) >= 0
    assert k.mse(GRAY, OTHER) == ((GRAY.astype(float) - OTHER) ** 2).mean()


def test_masked_and_resized_ssim():
    assert k.board_ssim(COLOUR, COLOUR) == 1.0
    assert 0 < k.smaller_ssim(GRAY, np.repeat(np.repeat(GRAY, 2, 0), 2, 1)) <= 1.0
    assert k.edge_score(np.zeros((2, 2), np.uint8)) == (0.0, 0.5)
    assert len(k.zones(COLOUR, COLOUR)) == 3


def test_bilinear_by_loops():
    a, (h, w) = GRAY.astype(float), (17, 40)
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            sy, sx = max((y + 0.5) * a.shape[0] / h - 0.5, 0), max((x + 0.5) * a.shape[1] / w - 0.5, 0)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, a.shape[0] - 1), min(x0 + 1, a.shape[1] - 1)
            top, low = a[y0, x0] * (1 - sx + x0) + a[y0, x1] * (sx - x0), a[y1, x0] * (1 - sx + x0) + a[y1, x1] * (sx - x0)
            out[y, x] = np.floor(top * (1 - sy + y0) + low * (sy - y0) + 0.5)
    assert np.array_equal(k.resize_bilinear(GRAY, h, w), out)
    assert k.resize_bilinear(COLOUR, 5, 6).shape == (5, 6, 3)
    assert np.array_equal(k.resize_bilinear(COLOUR, *COLOUR.shape[:2]), COLOUR)


def test_denoise_by_loops():
    g, p, r = GRAY[:12, :14].astype(float), 1, 2
    wide = np.pad(g, p + r, mode="reflect")
    out = np.zeros(g.shape)
    for y in range(g.shape[0]):
        for x in range(g.shape[1]):
            cut = lambda dy, dx: wide[y + r + dy : y + r + dy + 3, x + r + dx : x + r + dx + 3]
            steps = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
            w = [np.exp(-((cut(0, 0) - cut(*s)) ** 2).mean() / 900) for s in steps]
            out[y, x] = np.floor(sum(v * cut(*s)[1, 1] for v, s in zip(w, steps)) / sum(w) + 0.5)
    assert np.abs(k.denoise(GRAY[:12, :14], 30, 3, 5).astype(float) - out).max() <= 1
    flat = np.full((20, 20), 9, np.uint8)
    assert np.array_equal(k.denoise(flat), flat)


def test_clahe_raises_contrast_locally():
    soft = (100 + GRAY // 16).astype(np.uint8)
    assert k.clahe(soft, tiles=(2, 2)).std() > soft.std()
    # one tile without a limit in force is plain equalisation
    whole = k.clahe(GRAY, clip=1e9, tiles=(1, 1))
    counts = np.bincount(GRAY.ravel(), minlength=256).cumsum()
    assert np.array_equal(whole, np.floor(counts[GRAY] * 255 / GRAY.size + 0.5))
    assert set(np.unique(k.for_recognition(GRAY))) <= {0, 255}


def test_png_decodes():
    import struct
    import zlib

    for image in (GRAY, COLOUR):
        data = k.png(image)
        assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        at, chunks = 8, {}
        while at < len(data):
            (n,) = struct.unpack(">I", data[at : at + 4])
            name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
            assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + body)
            chunks[name], at = body, at + 12 + n
        w, h, depth, kind = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
        lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(h, -1)
        assert (h, w, depth) == (*image.shape[:2], 8) and not lines[:, 0].any()
        samples = lines[:, 1:].reshape(image.shape)
        assert np.array_equal(samples if kind == 0 else samples[..., ::-1], image)
