"""JPEG files against the JVM's decoder, code lengths against a search, thumbnails as files."""

import itertools

import numpy as np
import pytest

from tidemark.functions import jpeg as j
from tidemark.functions import kernels as k
from tidemark.sources import writers


def decoded(spark, folder, images):
    for name, data in images.items():
        (folder / f"{name}.jpg").write_bytes(data)
    out = {}
    for r in spark.read.format("image").load(str(folder)).select("image.*").collect():
        pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
        out[r.origin.rsplit("/", 1)[1][:-4]] = pixels[..., 0] if r.nChannels == 1 else pixels
    return out


def signal_to_noise(a, b):
    return 10 * np.log10(255**2 / max(np.mean((a.astype(float) - b) ** 2), 1e-9))


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([127 + 100 * np.sin(x / 17), 127 + 90 * np.cos(y / 23), 127 + 80 * np.sin((x + y) / 29)], -1).astype(np.uint8)


def test_decoder_gives_the_image_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (45, 70), dtype=np.uint8)
    images = {"colour": smooth(61, 83), "grey": smooth(40, 33)[..., 0], "tiny": np.full((1, 1, 3), 200, np.uint8), "flat": np.zeros((16, 16), np.uint8), "noise": noise, "sparse": np.where(rng.random((64, 64)) < 0.01, 255, 0).astype(np.uint8)}
    got = decoded(spark, tmp_path, {n: j.jpeg(x, 100 if n in ("noise", "sparse") else 85) for n, x in images.items()})
    assert {n: x.shape for n, x in got.items()} == {n: x.shape for n, x in images.items()}
    for n, least in {"colour": 35, "grey": 38, "tiny": 40, "flat": 60, "noise": 45, "sparse": 45}.items():
        assert signal_to_noise(images[n], got[n]) > least, n
    assert len(j.jpeg(smooth(61, 83), 40)) < len(j.jpeg(smooth(61, 83), 85)) < len(j.jpeg(smooth(61, 83), 98))


def test_quantisers_at_85():
    # the known first row of encoders at this quality
    assert j.quantisers(j.LUMINANCE, 85)[0].tolist() == [5, 3, 3, 5, 7, 12, 15, 18]
    assert sorted(j.ZIGZAG.tolist()) == list(range(64)) and j.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


@pytest.mark.parametrize("limit", [3, 4, 16])
def test_code_lengths_are_the_best(limit):
    counts = {7: 50, 1: 20, 9: 9, 4: 3, 0: 1}
    bits = j.code_lengths(counts, limit)
    cost = sum(counts[s] * n for s, n in bits.items())
    fits = [c for c in itertools.product(range(1, min(limit, 6) + 1), repeat=5) if sum(2.0**-n for n in c) <= 1]
    assert cost == min(sum(n * c for n, c in zip(f, counts.values(), strict=True)) for f in fits) and max(bits.values()) <= limit


def test_area_resampling():
    image = np.arange(48, dtype=np.uint8).reshape(4, 12)
    assert np.allclose(k.resize_area(image, 2, 6), image.reshape(2, 2, 6, 2).mean(axis=(1, 3)))
    odd = k.resize_area(image, 3, 5)
    assert odd.shape == (3, 5) and np.isclose(odd.mean(), image.mean())


def test_thumbnails_as_files(spark, tmp_path):
    rows = [(1, 60, 80, smooth(60, 80).tobytes()), (2, 30, 20, smooth(30, 20).tobytes()), (3, 8, 8, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, data binary")
    out = {r.id: r for r in writers.thumbnails(df, 40, enlarge=False, quality=85, resize="area").collect()}
    assert [(r.height, r.width) for _, r in sorted(out.items())] == [(30, 40), (30, 20), (8, 8)] and out[3].data is None
    got = decoded(spark, tmp_path, {"one": bytes(out[1].data), "two": bytes(out[2].data)})
    assert signal_to_noise(k.resize_area(smooth(60, 80), 30, 40), got["one"]) > 30 and signal_to_noise(smooth(30, 20), got["two"]) > 30
    plain = writers.thumbnails(df.where("id = 1"), 40).first()
    assert np.array_equal(np.frombuffer(plain.data, np.uint8).reshape(30, 40, 3), np.clip(np.rint(k.resize_bilinear(smooth(60, 80), 30, 40)), 0, 255))
    with pytest.raises(ValueError):
        writers.thumbnails(df, 40, resize="cubic")


def test_previews_of_slides(spark, tmp_path):
    from tidemark.plans import catalogue

    rows = catalogue.QUERIES["slide_previews"](spark, "/root/testdata/sf0.001").collect()
    got = decoded(spark, tmp_path, {str(r.vec_id): bytes(r.data) for r in rows})
    assert len(got) == len(rows) > 0 and {x.shape[:2] for x in got.values()} == {(r.height, r.width) for r in rows} == {(64, 64)}
