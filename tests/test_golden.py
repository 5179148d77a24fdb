"""Hand-made cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars, text
from tidemark.functions.external import python_round, write_notes
from tidemark.operators import cluster, evaluate, intervals, rules, sequential, windows

IDS = "video_id string, frame_index long, t double, p double"


def timed(spark, rows):
    return spark.createDataFrame([("a", i, float(t), float(p)) for i, (t, p) in enumerate(rows)], IDS)


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(0, 0.6), (5.0, 0.9), (10.1, 0.7)], [5.0, 10.1]),
        ([(0, 0.6), (4, 0.7), (8, 0.8)], [8.0]),
        ([(0, 0.8), (1, 0.8)], [0.0]),
        ([(0, 0.1), (1, 0.2)], []),
    ],
)
def test_suppress(spark, rows, kept):
    out = cluster.suppress(timed(spark, rows), "p", 0.5, 5.0)
    assert out.where("smoothed is null").count() == 0
    assert [r.t for r in out.where("smoothed = 1").orderBy("t").collect()] == kept


def test_min_gap(spark):
    out = cluster.min_gap(timed(spark, [(t, 1) for t in (0, 1, 3, 5, 6, 11, 12, 5)]), 5.0)
    assert [r.t for r in out.orderBy("t").collect()] == [0.0, 5.0, 11.0]


def test_bursts(spark):
    out = cluster.bursts(timed(spark, [(1.0, 1), (1.5, 1), (2.125, 1), (1.5, 1)]), 0.5)
    assert [r.timestamps for r in out.orderBy("start").collect()] == [[1.0, 1.5], [2.125]]


@pytest.mark.parametrize("n, padded", [(1, False), (10, False), (11, True)])
def test_warmup(spark, n, padded):
    out = windows.warmup_padding(timed(spark, [(i, i) for i in range(n)]), "p", 10).orderBy("frame_index").collect()
    assert out[0].p == (10.0 if padded else 0.0)


def test_constant_scales_to_zero(spark):
    assert {r.s for r in windows.minmax_scale(timed(spark, [(0, 3), (1, 3)]), "p", "s").collect()} == {0.0}


def test_snap_takes_lower_frame_of_equals(spark):
    f = timed(spark, [(0, 0.5), (1, 0.2), (2, 0.2), (9, 0.1)])
    marks = spark.createDataFrame([("a", 7, 1.0), ("a", 8, 50.0)], "video_id string, point_id int, t double")
    assert [(r.point_id, r.frame_index) for r in intervals.snap_to_min(marks, f, 1.5, "p").collect()] == [(7, 1)]


def test_align_drops_straddlers(spark):
    slides = spark.createDataFrame([("a", 1, 10.0, 20.0), ("a", 2, 20.0, 25.0), ("b", 1, 0.0, 1.0)], "video_id string, index int, start double, end double")
    segments = spark.createDataFrame([("a", 5.0, 9.0, "x"), ("a", 10.0, 20.0, "y"), ("a", 18.0, 22.0, "z"), ("a", 20.0, 25.0, "w")], "video_id string, seg_start double, seg_end double, seg_text string")
    assert {(r.video_id, r["index"]): r.transcript for r in intervals.align_segments(slides, segments).collect()} == {("a", 1): "y", ("a", 2): "w", ("b", 1): ""}


def test_greedy_matching_follows_given_order(spark):
    kind = "video_id string, t double, ord int"
    truth = spark.createDataFrame([("a", 0.0, 0), ("a", 3.0, 1)], kind)
    found = spark.createDataFrame([("a", 1.5, 0), ("a", -1.0, 1)], kind)
    assert tuple(evaluate.tolerance_match(found, truth, 2.0).first())[1:] == (1, 1, 1)
    only = spark.createDataFrame([("b", 1.0, 0)], kind)
    assert {tuple(r) for r in evaluate.tolerance_match(found, only, 2.0).collect()} == {("a", 0, 2, 0), ("b", 0, 0, 1)}


@pytest.mark.parametrize(
    "row, score, name",
    [((100, 50, 15, 30), 100, "EXCELLENT"), ((99.9, 120, 0, 60), 70, "GOOD"), ((99.9, 49, 0, 60), 50, "ACCEPTABLE"), ((10, 230, 20, 10), 10, "POOR")],
)
def test_quality(spark, row, score, name):
    df = spark.createDataFrame([tuple(map(float, row))], "sharpness double, brightness double, teacher double, contrast double")
    out = rules.quality(df).first()
    assert (out.score, out["class"]) == (score, name)


@pytest.mark.parametrize("share, kind", [(0.31, "INCREMENTAL_WRITING"), (0.30, "MIXED"), (0.15, "DISCRETE_SLIDES")])
def test_video_type(spark, share, kind):
    assert rules.video_type(spark.createDataFrame([("a", share)], "video_id string, high_share double")).first().video_type == kind


def test_sequential_forms_differ(spark):
    likeness = {(0, 1): 0.96, (1, 2): 0.96, (0, 2): 0.90}
    similar = lambda a, b: likeness[tuple(sorted((int(a[0]), int(b[0]))))]
    df = spark.createDataFrame([("a", k, [float(k)], 1.0 - k / 10) for k in range(3)], "video_id string, k long, v array<double>, pen double")
    first = sequential.keep_first(df, 0.95, 0.85, 2.0, "k", "v", similarity=similar)
    assert [r.k for r in first.orderBy("k").collect()] == [0, 2]
    latest = sequential.keep_latest(df, 0.95, "k", "v", similarity=similar)
    assert [(r.k, r.audio_start) for r in latest.collect()] == [(2, 0)]
    cleaner = sequential.keep_cleaner(df, 0.95, "k", "v", "pen", similarity=similar)
    assert [(r.k, r.audio_end) for r in cleaner.collect()] == [(2, 0)]


def test_rolling_skips_first_row(spark):
    out = windows.rolling_stats(timed(spark, [(0, 9), (1, 1), (2, 3)]), "p", 10, True).orderBy("t").collect()
    assert [(r.rolling_mean, r.rolling_std, r.rolling_max) for r in out] == [(0, 0, 0), (1, 0, 1), (2, 1, 3)]


def test_python_rounding(spark):
    out = spark.createDataFrame([(2.675,), (0.125,), (None,)], "x double").select(python_round(2)("x").alias("r"))
    assert [r.r for r in out.collect()] == [2.67, 0.12, None]


def test_brightness_and_time(spark):
    df = spark.createDataFrame([(79.0,), (80.0,), (150.0,), (255.0,), (8.0,)], "m double").select(scalars.brightness_quality(F.col("m")).alias("q"), scalars.mmss(F.col("m") * 60 + 5).alias("t"))
    rows = df.collect()
    assert [round(r.q, 4) for r in rows] == [0.9875, 1.0, 1.0, 0.3, 0.3]
    assert rows[3].t == "255:05"


def test_flashcards_and_resume(spark):
    md = "# T\n## Slide 1: x\n### Q1\nanswer one\n---\n#### Q2\n### Q3\na\nb\n## Slide 2: y\nshort"
    df = spark.createDataFrame([("a", md)], "id string, md string")
    cards = text.flashcards(df, "md", "id").orderBy("card").collect()
    assert [(c.question, c.answer, c.slide) for c in cards] == [("Q1", "answer one", "Slide 1: x"), ("Q3", "a\nb\nshort", "Slide 2: y")]
    assert df.select(text.resume_point(F.col("md")).alias("r")).first().r == 1
    assert spark.createDataFrame([("none",)], "md string").select(text.resume_point(F.col("md")).alias("r")).first().r == 0


def test_failing_model_costs_one_row(spark):
    def factory():
        def call(prompt):
            if prompt == "bad":
                raise ValueError(prompt)
            return prompt.upper()

        return call

    out = spark.createDataFrame([("ok",), ("bad",)], "p string").select(write_notes(factory)("p").alias("n"))
    assert [r.n for r in out.collect()] == ["OK", "stub: bad"]


def test_failures_of_outside_models_are_told(spark):
    from tidemark.functions.external import recognise

    def factory():
        def call(image):
            if image == b"bad":
                raise ValueError("no image")
            return {"text": "seen", "confidence": 0.5, "blocks": []}

        return call

    df = spark.createDataFrame([(b"ok",), (b"bad",)], "i binary").select(recognise(factory)("i").alias("r"))
    assert [(r.r.text, r.r.error) for r in df.collect()] == [("seen", None), ("", "ValueError: no image")]


def test_spacing_by_loops():
    rng = np.random.default_rng(3)
    for gap in (0.1, 0.5, 3.0):
        times = np.unique(np.round(rng.random(300) * 30, 1))
        kept, last = [], None
        for k, t in enumerate(times):
            if last is None or t - last >= gap:
                kept.append(k)
                last = t
        assert cluster.spaced_out(times, gap).tolist() == kept


def test_matching_by_loops():
    rng = np.random.default_rng(4)
    for _ in range(300):
        times, wanted = np.round(rng.random(rng.integers(0, 30)) * 9, 1), np.round(rng.random(rng.integers(0, 30)) * 9, 1)
        free, hits = list(range(len(times))), 0
        for x in wanted:
            hit = next((k for k in free if abs(times[k] - x) <= 0.3), None)
            if hit is not None:
                free.remove(hit)
                hits += 1
        assert evaluate._matches(times, wanted, 0.3) == hits


def test_auc_by_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", float(np.round(rng.normal() * 3, 1)), int(rng.random() < 0.4)) for i in range(400)] + [("c", 1.0, 1)]
    got = {r.k: r.auc for r in evaluate.roc_auc(spark.createDataFrame(rows, "k string, s double, label int"), "s", "label", "k").collect()}
    for key in "ab":
        pos = [s for k, s, y in rows if k == key and y]
        neg = [s for k, s, y in rows if k == key and not y]
        assert abs(got[key] - np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])) < 1e-12
    assert got["c"] is None


WINDOWED = "nms_smooth rolling_stats10 decay_slope minmax_scale burst_groups burst_representative min_gap_filter tolerance_match lag_change".split()


@pytest.mark.parametrize("name", WINDOWED)
def test_window_queries_shuffle_once(spark, name):
    from tidemark.plans import catalogue

    if name not in catalogue.QUERIES:
        pytest.skip("no such query")
    df = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_keys_move_and_mark(spark):
    keys = spark.createDataFrame([("a", i, k) for i, k in enumerate("ynUdaaNqy")] + [("b", 0, "x")], "video_id string, frame_index long, k string")
    got = {}
    for r in sequential.press_keys(keys, 4, "frame_index", "k").orderBy("slide").collect():
        got.setdefault(r.video_id, []).append(r.keep)
    assert got == {"a": [True, False, False, True], "b": [True] * 4}


def test_stream_of_cleaner_slides(spark, tmp_path):
    from tidemark.streaming import sessions

    rows = [(1, "2024-01-01 00:00:01", [1.0, 0.0], 5.0), (1, "2024-01-01 00:00:02", [1.0, 0.01], 3.0), (1, "2024-01-01 00:00:03", [1.0, 0.02], 4.0), (1, "2024-01-01 00:00:04", [0.0, 1.0], 9.0)]
    df = spark.createDataFrame(rows, "video_id long, at string, vector array<double>, penalty double").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = sessions.run_to_end(sessions.accepted(events, 0.9, "cleaner"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.action for r in out.orderBy("t").collect()] == ["keep", "replace", "drop", "keep"]
    with pytest.raises(ValueError):
        sessions.accepted(events, 0.9, "oldest")


def test_gallery_pages_are_bounded(spark):
    from tidemark.functions import pages

    df = spark.range(7).select(F.lit("v<1>").alias("video_id"), (F.col("id") + 1).alias("index"), F.lit('a "b"').alias("caption"), F.lit(b"PNG").alias("picture"), F.lit("image/png").alias("kind"))
    rows = pages.gallery_pages(df, 3).orderBy("page").collect()
    assert [r.html.count("<figure") for r in rows] == [3, 3, 1] and 'src="data:image/png;base64,UE5H" alt="a &quot;b&quot;"' in rows[0].html


def test_key_sessions_by_loops(spark):
    rng = np.random.default_rng(9)
    slides, keys, want = [], [], set()
    for video in range(12):
        n = int(rng.integers(0, 8))
        vectors = [None if rng.random() < 0.2 else [1.0, float(rng.integers(0, 2)) * 9] + [0.0] * int(rng.random() < 0.2) for _ in range(n)]
        pressed = rng.choice(list("yNuUdarRxsq"), 12, p=[0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.08, 0.08, 0.02, 0.02]).tolist()
        keep, at, ended = [True] * n, 0, "open"
        for k in map(str.lower, pressed):
            if not n or k in "sq":
                ended = {"s": "save", "q": "quit"}.get(k, ended)
                break
            if k == "r":
                last = None
                for i in range(n):
                    if keep[i] and vectors[i] is not None:
                        if last is not None and len(last) == len(vectors[i]) and last[1] == vectors[i][1]:
                            keep[i] = False
                        else:
                            last = vectors[i]
            elif k == "u":
                keep[at] = not keep[at]
            elif k in "yn":
                keep[at] = k == "y"
            at = min(at + 1, n - 1) if k in "ynd" else max(at - 1, 0) if k == "a" else at
        want |= {(video, 10 + i, True if ended == "quit" else keep[i], ended) for i in range(n)}
        slides += [(video, 10 + i, v) for i, v in enumerate(vectors)]
        keys += [(video, i, k) for i, k in enumerate(pressed)]
    s = spark.createDataFrame(slides, "video_id int, o int, v array<double>").repartition(3)
    k = spark.createDataFrame([*keys, (99, 0, "y")], "video_id int, o int, key string").repartition(3)
    got = sequential.key_session(s, k, "o", "v", "key").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
