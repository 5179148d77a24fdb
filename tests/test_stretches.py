"""Long entities cut into stretches give what whole ones give, and spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cluster, evaluate, intervals, stretches

KIND = "video_id string, frame_index long, t double, p double, ord long"


def signals(spark, n=400, seed=2, step=0.1):
    rng = np.random.default_rng(seed)
    rows = [(v, k, float(np.round(t, 1)), float(np.round(s, 1)), k) for v in "ab" for k, (t, s) in enumerate(zip(np.sort(rng.random(n) * n * step), rng.random(n), strict=True))]
    rows += [("single", 0, -7.0, 0.9, 0), ("late", 0, 1000.3, 0.4, 0), ("late", 1, 1003.0, 0.7, 1)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def same(a, b):
    columns = sorted(b.columns)
    return sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


@pytest.mark.parametrize("gap, width", [(0.0, 1.0), (0.2, 3.0), (0.7, 5.0)])
def test_clusters_in_stretches(spark, gap, width):
    df = signals(spark)
    assert same(stretches.islands(df, gap, width), cluster.islands(df, gap))
    assert same(stretches.suppress(df, "p", 0.5, gap, width), cluster.suppress(df, "p", 0.5, gap))
    assert same(stretches.bursts(df, gap, width), cluster.bursts(df, gap))


@pytest.mark.parametrize("gap, width", [(0.1, 0.7), (0.5, 3.0), (2.3, 2.4), (7.0, 40.0)])
def test_spacing_in_stretches(spark, gap, width):
    df = signals(spark, 150)
    assert same(stretches.min_gap(df, gap, width), cluster.min_gap(df, gap))


def test_pointers_by_loops():
    rng = np.random.default_rng(8)
    for _ in range(200):
        times, gap = np.unique(np.round(rng.random(rng.integers(1, 60)) * 6, 1)), float(rng.choice([0.1, 0.3, 1.7]))
        step, last = stretches._next_kept(times, gap), stretches._last_kept(times, gap)
        for k, t in enumerate(times):
            later = [j for j in range(k + 1, len(times)) if times[j] - t >= gap]
            assert step[k] == (later[0] if later else len(times))
            assert last[k] == k + cluster.spaced_out(times[k:], gap)[-1]


@pytest.mark.parametrize("tolerance", [0.1, 0.4])
def test_matching_in_parts(spark, tolerance):
    df = signals(spark, 200, step=0.4).withColumn("ord", F.xxhash64("t", "video_id"))
    predicted, truth = df.where("p < 0.5"), df.where("p > 0.4 and video_id <> 'late'")
    assert same(stretches.tolerance_match(predicted, truth, tolerance, 5.0), evaluate.tolerance_match(predicted, truth, tolerance))


def test_rows_without_time_or_entity_and_no_rows(spark):
    odd = spark.createDataFrame([("a", 0, None, 0.9, 0), (None, 0, 1.0, 0.9, 0), ("a", 1, 2.0, 0.9, 1)], KIND)
    assert [r.cluster for r in stretches.islands(odd, 1.0, 5.0).collect()] == [1]
    assert [tuple(r) for r in stretches.min_gap(odd, 1.0, 5.0).collect()] == [("a", 2.0)]
    none = spark.createDataFrame([], KIND)
    assert stretches.min_gap(none, 1.0, 5.0).count() == stretches.islands(none, 1.0, 5.0).count() == stretches.tolerance_match(none, none, 1.0, 5.0).count() == 0
    with pytest.raises(ValueError):
        stretches.min_gap(odd, 5.0, 5.0)


def test_a_long_entity_spans_tasks(spark):
    long = signals(spark).where("video_id = 'a'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (stretches.islands(long, 0.2, 3.0), stretches.min_gap(long, 0.2, 3.0)):
            assert df.select(F.spark_partition_id().alias("k")).distinct().count() > 1
        near = intervals.band_join(long.where("p > 0.5"), long, F.col("t") - 1, F.col("t") + 1, 2.0)
        assert near.select(F.spark_partition_id().alias("k")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_band_joins_by_loops(spark):
    rows = list({(r.video_id, r.t): r for r in signals(spark, 120, step=0.6).collect()}.values())
    df = spark.createDataFrame(rows, KIND).repartition(3)
    points = df.where("p > 0.6").withColumnRenamed("frame_index", "point_id")
    chosen = [r for r in rows if r.p > 0.6]
    low = df.where("p < 0.3")
    snapped, valued, best = {}, {}, {}
    for c in chosen:
        near = [(r.p, r.frame_index) for r in rows if r.video_id == c.video_id and c.t - 0.3 <= r.t <= c.t + 0.3]
        snapped[c.video_id, c.frame_index] = min(near)[1]
        first = [(r.frame_index, r.p) for r in rows if r.p < 0.3 and r.video_id == c.video_id and abs(r.t - c.t) <= 0.2]
        valued[c.video_id, c.frame_index] = min(first)[1] if first else 0.5
        before = max([x.t for x in chosen if x.video_id == c.video_id and (x.t, x.frame_index) < (c.t, c.frame_index)], default=0.0)
        a, b = max(c.t - 2.0, before + 0.5), c.t - 0.5
        if a >= b:
            a = max(0.0, c.t - 1.0)
            b = max(a + 0.5, c.t - 0.25)
        inside = [(-r.p, r.frame_index, r.t) for r in rows if r.video_id == c.video_id and a <= r.t <= b]
        best[c.video_id, c.frame_index] = (min(inside)[2], -min(inside)[0], len(inside)) if inside else (c.t, 0.0, 0)
    assert {(r.video_id, r.point_id): r.frame_index for r in intervals.snap_to_min(points, df, 0.3, "p").collect()} == snapped
    assert {(r.video_id, r.point_id): r.p for r in intervals.nearest_default(points, low, 0.2, "p", 0.5, key="point_id").collect()} == valued
    assert {(r.video_id, r.point_id): (r.capture, r.best_score, r.n_frames) for r in intervals.best_in_window(points, df, 2.0, "p", 0.5, point="point_id").collect()} == best
