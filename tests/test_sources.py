"""Readers and writers on small files."""

import io
import json

import numpy as np

from tidemark.operators import model
from tidemark.sources import readers, writers


def test_features_round_trip(spark, tmp_path):
    row = {c: 0.5 for c in readers.FEATURES} | {"video_id": None, "frame_index": 3, "timestamp_seconds": 0.6, "label": 1}
    df = spark.createDataFrame([row], readers.FEATURE_SCHEMA)
    df.coalesce(1).write.csv(str(tmp_path / "x"), header=True)
    part = next((tmp_path / "x").glob("*.csv"))
    part.rename(tmp_path / "lec_1_features.csv")
    got = readers.read_features(spark, str(tmp_path / "lec_1_features.csv"))
    assert readers.feature_columns(got) == readers.FEATURES
    assert got.first().video_id == "lec_1"
    writers.write_features(got, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    hot = spark.range(200).selectExpr("'a' as video_id", "id")
    writers.write_features(hot, str(tmp_path / "hot"), files=4)
    assert 1 <= len(list((tmp_path / "hot" / "video_id=a").glob("*.parquet"))) <= 4 and spark.read.parquet(str(tmp_path / "hot")).count() == 200


def test_transitions_of_both_versions(spark, tmp_path):
    docs = {
        "a": {"video_id": "a", "blank_count": 1, "transitions": [{"index": 1, "timestamp": 84.4, "ssim_score": None, "audio_window": {"start": 0.0, "end": 84.4, "duration": 84.4}}]},
        "b": {"video_id": "b", "transitions": [{"index": 1, "timestamp": 5.0, "ssim_from_prev": 0.25}]},
        "c": [{"index": 1, "timestamp": 7.0}],
    }
    for name, doc in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "transitions.json").write_text(json.dumps(doc))
    for name, bad in (("d", ""), ("e", "{not json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "transitions.json").write_text(bad)
    rows = readers.read_transitions(spark, f"{tmp_path}/*/transitions.json").orderBy("video_id").collect()
    assert [(r.video_id, r.timestamp, r.similarity) for r in rows] == [("a", 84.4, None), ("b", 5.0, 0.25), ("c", 7.0, None)]


def test_ground_truth_lines(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "transitions.txt").write_text("# Total: 0\n\n85\n 12.5 \nabc\n# c\n193\n")
    assert sorted(tuple(r) for r in readers.read_ground_truth(spark, f"{tmp_path}/v1/transitions.txt").collect()) == [("v1", 12.5), ("v1", 85.0), ("v1", 193.0)]


def test_listing_priority_and_frames(spark, tmp_path):
    frames = np.arange(40 * 4 * 5, dtype=np.uint8).reshape(40, 4, 5)
    buffer = io.BytesIO()
    np.save(buffer, frames)
    for name in ("v.npy", "a.mp3", "a.WAV", "b.wav", "note.txt"):
        (tmp_path / name).write_bytes(buffer.getvalue() if name.endswith("npy") else b"x")
    files = readers.list_files(spark, str(tmp_path), readers.AUDIO)
    assert [r.name for r in readers.pick_by_extension(files, readers.AUDIO).orderBy("name").collect()] == ["a.mp3", "b.wav"]
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/v.npy")
    sampled = readers.scan_frames(raw).orderBy("sample").collect()
    assert [r.frame_no for r in sampled] == list(range(0, 40, 6))
    assert bytes(sampled[1].data) == frames[6].tobytes()
    small = writers.thumbnails(readers.scan_frames(raw), 10).first()
    assert (small.height, small.width, len(small.data)) == (8, 10, 80)
    assert writers.thumbnails(readers.scan_frames(raw), 10, enlarge=False).first().width == 5


def test_versions_never_overwrite(spark, tmp_path):
    df = spark.range(2)
    assert writers.write_version(df, str(tmp_path)) != writers.write_version(df, str(tmp_path))
    assert len(list(tmp_path.glob("v=*"))) == 2
    writers.write_text(df.selectExpr("'a' as video_id", "'x' as line"), str(tmp_path / "txt"), "line")
    writers.write_documents(df.selectExpr("'a' as video_id", "id"), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2


def test_model_saves_and_loads(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 20)) for i in range(40)], "x double, label int")
    fitted = model.fit(df, ["x"], trees=2, depth=2)
    model.save(fitted, str(tmp_path / "m"))
    again = model.predict(model.load(str(tmp_path / "m")), df, 0.5)
    assert again.where("label <> prediction").count() == 0
    assert model.importances(spark, fitted, ["x"]).first().feature == "x"


def test_versions_of_a_model_keep_their_feature_names(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(-i), int(i > 20)) for i in range(40)], "x double, y double, label int")
    fitted = model.fit(df, ["y", "x"], trees=1, depth=2)
    one, two = model.save_version(fitted, ["y", "x"], str(tmp_path)), model.save_version(fitted, ["y", "x"], str(tmp_path))
    assert one != two
    again, names = model.load_version(one)
    assert names == ["y", "x"] and model.predict(again, df, 0.5).count() == 40
