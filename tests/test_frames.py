"""The frame source and the frame loop against loops over the same pictures."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators.features import WINDOW, extract_features
from tidemark.sources import frames
from tidemark.sources.readers import FEATURES

KIND = "video_id string, frame_no long, height int, width int, data binary"


def pictures(n, h=12, w=16, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, h, w), dtype=np.uint8)


def stored(spark, path, videos, **options):
    rows = [(v, k, *p.shape, p.tobytes()) for v, ps in videos.items() for k, p in enumerate(ps)]
    frames.write_frames(spark.createDataFrame(rows, KIND).repartition(5), str(path), **options)


def test_round_trip_in_pieces(spark, tmp_path):
    videos = {"a": pictures(23), "b/ü 1.000000003": pictures(5, 8, 8), "one": pictures(1)}
    stored(spark, tmp_path, videos, fps=Fraction(30000, 1001), piece=8)
    assert len(list(tmp_path.glob("*.y4m"))) == 5 and not list(tmp_path.glob("_*"))
    got = {(r.video_id, r.frame_no): r for r in frames.read_frames(spark, str(tmp_path)).collect()}
    assert set(got) == {(v, k) for v, ps in videos.items() for k in range(len(ps))}
    for (v, k), r in got.items():
        assert bytes(r.data) == videos[v][k].tobytes() and (r.height, r.width) == videos[v][k].shape
        assert abs(r.t - k * 1001 / 30000) < 1e-12 and r["sample"] == k
    sampled = frames.read_frames(spark, f"file://{tmp_path}", 5).where("video_id = 'a'").orderBy("sample").collect()
    assert [(r.frame_no, r["sample"]) for r in sampled] == [(0, 0), (5, 1), (10, 2), (15, 3), (20, 4)]


def test_filters_choose_files_and_ranges(spark, tmp_path):
    stored(spark, tmp_path, {"a": pictures(40), "b": pictures(40)})
    (tmp_path / "broken.y4m").write_bytes(b"no recording")
    source = frames.read_frames(spark, str(tmp_path), task_bytes=12 * 16 * 10).where("video_id in ('a', 'b')")
    assert source.rdd.getNumPartitions() == 8  # each recording in ranges of ten frames
    part = source.where("video_id = 'b' and frame_no >= 12 and frame_no < 25")
    assert part.rdd.getNumPartitions() == 2 and sorted(r.frame_no for r in part.collect()) == list(range(12, 25))
    assert [r.frame_no for r in source.where("video_id = 'a' and frame_no = 39").collect()] == [39]
    assert source.where("video_id = 'c'").count() == 0 and source.where("frame_no > 99").count() == 0
    with pytest.raises(Exception, match="not a recording"):
        frames.read_frames(spark, str(tmp_path)).count()


def test_colours_and_frame_parameters(spark, tmp_path):
    y, u, v = pictures(3, 4, 6)
    head = b"YUV4MPEG2 W6 H4 F25:1 C444 XA=B\n"
    (tmp_path / "c.y4m").write_bytes(head + b"FRAME Ip\n" + y.tobytes() + u.tobytes() + v.tobytes() + b"FRAME\n" + bytes([16]) * 24 + bytes([128]) * 48)
    got = frames.read_frames(spark, str(tmp_path)).orderBy("frame_no").collect()
    assert len(got) == 2 and set(bytes(got[1].data)) == {0}
    bgr = kernels.decode(bytes(got[0].data), 4, 6)
    for i in range(4):
        for j in range(6):
            l, c, d = 1.164383 * (int(y[i, j]) - 16), int(u[i, j]) - 128, int(v[i, j]) - 128
            want = [l + 2.017232 * c, l - 0.391762 * c - 0.812968 * d, l + 1.596027 * d]
            assert bgr[i, j].tolist() == [int(min(max(np.floor(x + 0.5), 0), 255)) for x in want]
    half = tmp_path / "half"
    half.mkdir()
    (half / "d.y4m").write_bytes(b"YUV4MPEG2 W3 H3 F25:1 C420jpeg\nFRAME\n" + bytes(range(0, 90, 10)) + bytes([128] * 8))
    only = frames.read_frames(spark, str(half)).first()
    assert kernels.decode(bytes(only.data), 3, 3)[..., 1].ravel().tolist() == list(range(0, 90, 10))


@pytest.mark.parametrize("bad", [b"YUV4MPEG2 W4 H4 F25:1 Cmono\nFRAME\n" + bytes(15), b"YUV4MPEG2 W4 H4 F25:1 Cmono\nFRAME\n" + bytes(16) + b"XRAME\n" + bytes(16), b"YUV4MPEG2 W4 H4 F25:1 C411\n"])
def test_damage_is_told_with_its_file(spark, tmp_path, bad):
    (tmp_path / "x.y4m").write_bytes(bad)
    with pytest.raises(Exception, match="x.y4m"):
        frames.read_frames(spark, str(tmp_path)).collect()


def test_nothing_to_read_or_write(spark, tmp_path):
    (tmp_path / "e.y4m").write_bytes(b"YUV4MPEG2 W4 H4 F25:1 Cmono\n")
    assert frames.read_frames(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        frames.read_frames(spark, f"{tmp_path}/nowhere").count()
    with pytest.raises(Exception, match="gray"):
        frames.write_frames(spark.createDataFrame([("a", 0, 4, 4, None)], KIND), f"{tmp_path}/out")


def slow_loop(ps):
    """The loop over whole recordings with lists."""
    out, likes, counts, before, edges = [], [], [], None, None
    for p in ps:
        colour = np.stack([p] * 3, -1) if p.ndim == 2 else p
        g = kernels.gray(p)
        e = kernels.canny(g)
        if before is None:
            row = dict.fromkeys(FEATURES, 0.0) | {"edge_count": e.sum()}
        else:
            black, skin = (colour < 50).all(-1).mean(), kernels.skin_ratio(colour)
            row = {"black_pixel_ratio": black, "skin_pixel_ratio": skin, "teacher_presence": black + skin, "global_ssim": kernels.ssim(g, before), "global_mse": np.mean((g.astype(float) - before) ** 2), "histogram_correlation": kernels.histogram_correlation(colour, np.stack([before] * 3, -1)), "edge_count": e.sum(), "edge_change_rate": int(e.sum()) - int(edges.sum())}
            top, third = int(g.shape[0] * 0.8), g.shape[1] // 3
            for name, a, b in (("left", 0, third), ("center", third, 2 * third), ("right", 2 * third, g.shape[1])):
                row[f"zone_{name}_ssim"] = kernels.ssim(g[top:, a:b], before[top:, a:b])
                row[f"zone_{name}_edge_density"] = (e[top:, a:b].mean() + edges[top:, a:b].mean()) / 2
            likes.append(row["global_ssim"])
            counts.append(int(e.sum()))
            s, c = likes[-10:], counts[-10:]
            row |= {"ssim_rolling_mean": np.mean(s), "ssim_rolling_std": np.std(s), "ssim_rolling_max": max(s), "edge_rolling_mean": np.mean(c), "edge_rolling_std": np.std(c), "edge_rolling_max": max(c)}
            row["edge_decay_velocity"] = np.polyfit(range(len(c)), c, 1)[0] if len(c) > 1 else 0.0
        out.append([float(row[name]) for name in FEATURES])
        before, edges = g, e
    return out


def test_frame_loop_in_stretches(spark):
    rng = np.random.default_rng(3)
    scene = rng.integers(0, 256, (37, 5, 6, 3), dtype=np.uint8).repeat(8, 1).repeat(8, 2)  # blocks have edges
    scene[10:20] = scene[10]
    videos = {"colour": scene, "gray": pictures(12, 40, 24), "single": pictures(1, 40, 24)}
    rows = [(v, k, k / 5, *p.shape[:2], p.tobytes()) for v, ps in videos.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "video_id string, sample long, t double, height int, width int, data binary")
    want = {(v, k): row for v, ps in videos.items() for k, row in enumerate(slow_loop(ps))}
    for stretch in (WINDOW, 16, 600):
        made = extract_features(df, stretch)
        got = {(r.video_id, r.frame_index): r for r in made.collect()}
        assert set(got) == set(want) and made.columns == ["video_id", "frame_index", "timestamp_seconds", *FEATURES, "label"]
        for key, r in got.items():
            assert np.allclose([r[c] for c in FEATURES], want[key], atol=1e-9) and r.label == 0
    with pytest.raises(ValueError):
        extract_features(df, WINDOW - 1)


def test_one_recording_spans_tasks(spark):
    df = spark.range(200).select(F.lit("a").alias("video_id"), F.col("id").alias("sample"), (F.col("id") / 5).alias("t"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.repeat(F.lpad(F.hex(F.col("id")), 2, "0"), 64)).alias("data"))
    spread = extract_features(df, 20).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 200
    plan = extract_features(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
