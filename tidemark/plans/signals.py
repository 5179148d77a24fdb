"""Queries over ordered signals: windows, clusters, band joins, evaluation.

Seconds are scaled to the driver's tables: events of a user are hours apart, so gaps and
bands are hours wide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster, evaluate, intervals, quantiles, stretches, windows
from ..session import table
from .registry import FRAMES, ORACLES, frames, query, r6

HOUR = 3600.0
ERRORS = "event_type = 'error'"
TRUTHS = "event_type = 'purchase'"


# --- windows -------------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT video_id, frame_index, round(coalesce(signal - lag(signal) OVER w, 0), 6) AS change, round(coalesce(abs(signal - lag(signal) OVER w), 0), 6) AS change_abs FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)")
def lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = windows.lag_change(windows.lag_change(frames(spark, sf_dir), "signal", "change"), "signal", "change_abs", signed=False)
    return both.select("video_id", "frame_index", r6("change").alias("change"), r6("change_abs").alias("change_abs"))


_ROLL = """WITH {frames} SELECT video_id, frame_index, round(coalesce(avg(v) OVER w, 0), 6) AS rolling_mean, round(coalesce(stddev_pop(v) OVER w, 0), 5) AS rolling_std, coalesce(max(v) OVER w, 0) AS rolling_max
FROM (SELECT *, CASE WHEN {cond} THEN signal END AS v FROM frames) WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"""


def _rolled(df: DataFrame, rows: int, skip: bool) -> DataFrame:
    out = windows.rolling_stats(df, "signal", rows, skip)
    return out.select("video_id", "frame_index", r6("rolling_mean").alias("rolling_mean"), F.round("rolling_std", 5).alias("rolling_std"), "rolling_max")


@query(_ROLL.format(frames=FRAMES, cond="frame_index > 0", n=9))
def rolling_stats10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(frames(spark, sf_dir), 10, True)


@query(_ROLL.format(frames=FRAMES, cond="TRUE", n=4))
def rolling_stats5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(frames(spark, sf_dir), 5, False)


@query(f"""WITH {FRAMES} SELECT video_id, frame_index, round(CASE WHEN count(signal) OVER w < 2 THEN 0 ELSE coalesce(regr_slope(signal, (frame_index + 1)::DOUBLE) OVER w, 0) END, 6) AS slope
FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def decay_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.decay_slope(frames(spark, sf_dir), "signal", 10).select("video_id", "frame_index", r6("slope").alias("slope"))


@query(f"WITH {FRAMES} SELECT video_id, frame_index, round(coalesce(signal - lag(signal) OVER (PARTITION BY video_id ORDER BY frame_index), 0), 6) AS velocity FROM frames")
def decay_last_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lag_change(frames(spark, sf_dir), "signal", "velocity").select("video_id", "frame_index", r6("velocity").alias("velocity"))


_PADDED = f"""WITH {FRAMES}, padded AS (SELECT video_id, frame_index, CASE WHEN frame_index < 10 AND count(*) OVER v > 10 THEN max(CASE WHEN frame_index = 10 THEN signal END) OVER v ELSE signal END AS signal
FROM frames WINDOW v AS (PARTITION BY video_id))"""


@query(f"{_PADDED} SELECT * FROM padded")
def warmup_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.warmup_padding(frames(spark, sf_dir), "signal", 10).select("video_id", "frame_index", "signal")


@query(f"{_PADDED} SELECT video_id, frame_index, round(CASE WHEN max(signal) OVER v - min(signal) OVER v <= 1e-10 THEN 0 ELSE (signal - min(signal) OVER v) / (max(signal) OVER v - min(signal) OVER v) END, 6) AS scaled FROM padded WINDOW v AS (PARTITION BY video_id)")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = windows.warmup_padding(frames(spark, sf_dir), "signal", 10)
    return windows.minmax_scale(padded, "signal", "scaled").select("video_id", "frame_index", r6("scaled").alias("scaled"))


@query(f"WITH {FRAMES} SELECT video_id, frame_index, CASE WHEN frame_index = 0 THEN 1.0 ELSE round(signal / 500, 6) END AS online, CASE WHEN frame_index = 0 THEN 0.0 ELSE round(signal / 500, 6) END AS offline FROM frames")
def first_row_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, value = F.col("frame_index") == 0, r6(F.col("signal") / 500)
    return frames(spark, sf_dir).select("video_id", "frame_index", F.when(first, 1.0).otherwise(value).alias("online"), F.when(first, 0.0).otherwise(value).alias("offline"))


_TRUTH = f"WITH {FRAMES}, marks AS (SELECT * FROM frames WHERE event_type = 'purchase')"


@query(f"{_TRUTH} SELECT video_id, event_id, coalesce(lag(t) OVER w, 0) AS audio_start, t AS audio_end, round(t - coalesce(lag(t) OVER w, 0), 3) AS duration FROM marks WINDOW w AS (PARTITION BY video_id ORDER BY t)")
def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = windows.previous_interval(frames(spark, sf_dir).where(TRUTHS), "t", "audio_start")
    return marks.select("video_id", "event_id", "audio_start", F.col("t").alias("audio_end"), F.round("duration", 3).alias("duration"))


@query(f"{_TRUTH}, ends AS (SELECT video_id, max(t) + 60 AS e FROM frames GROUP BY video_id) SELECT video_id, event_id, t AS slide_start, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), e) AS slide_end FROM marks JOIN ends USING (video_id)")
def next_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    ends = f.groupBy("video_id").agg((F.max("t") + 60).alias("e"))
    return windows.next_interval(f.where(TRUTHS).join(ends, "video_id"), "t", F.col("e"), "slide_end").select("video_id", "event_id", F.col("t").alias("slide_start"), "slide_end")


@query(f"{_TRUTH} SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS index FROM marks WHERE signal >= 20")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.renumber(frames(spark, sf_dir).where(TRUTHS).where("signal >= 20"), "t", "event_id").select("video_id", "event_id", "index")


@query(f"{_TRUTH} SELECT video_id, event_id, t, coalesce(lag(t) OVER (PARTITION BY video_id ORDER BY t), 0) AS t_prev FROM marks")
def previous_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.previous_interval(frames(spark, sf_dir).where(TRUTHS), "t", "t_prev").select("video_id", "event_id", "t", "t_prev")


@query(f"{_TRUTH} SELECT video_id, event_id, t FROM (SELECT *, max(t) OVER (PARTITION BY video_id) AS last FROM marks) WHERE t < last")
def drop_last_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.before_last(frames(spark, sf_dir).where(TRUTHS), "t").select("video_id", "event_id", "t")


@query(f"""WITH {FRAMES}, stats AS (SELECT video_id, max(signal) AS m, greatest(quantile_cont(signal, 0.99), avg(signal) + 2 * stddev_pop(signal)) AS o FROM frames GROUP BY video_id)
SELECT video_id, frame_index, round(CASE WHEN m >= 300 THEN 300 ELSE o END, 5) AS threshold FROM frames JOIN stats USING (video_id) WHERE signal >= CASE WHEN m >= 300 THEN 300 ELSE o END""")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.adaptive_threshold(frames(spark, sf_dir), "signal", 300.0).select("video_id", "frame_index", F.round("threshold", 5).alias("threshold"))


@query(f"WITH {FRAMES} SELECT video_id, frame_index // 6 AS sample, round(frame_index / 30.0, 6) AS seconds, round(frame_index / 30.0, 2) AS seconds_online, signal FROM frames WHERE frame_index % 6 = 0")
def frame_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every skip-th frame of a 30 fps source sampled to 5 fps; skip is at least one."""
    fps, target = 30.0, 5
    skip = max(1, int(fps / target))
    f = frames(spark, sf_dir).where(F.col("frame_index") % skip == 0)
    ordinal = (F.row_number().over(windows.ordered()) - 1).cast("long")
    return f.select("video_id", ordinal.alias("sample"), r6(F.col("frame_index") / fps).alias("seconds"), F.round(F.col("frame_index") / fps, 2).alias("seconds_online"), "signal")


@query(f"""WITH {FRAMES}, wanted AS (SELECT video_id, event_id, signal / 10 AS at FROM frames WHERE event_type = 'purchase')
SELECT w.video_id, w.event_id, f.frame_index, f.signal FROM wanted w JOIN frames f ON w.video_id = f.video_id AND f.frame_index = floor(w.at * 5)::BIGINT""")
def frame_at_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups by frame number, floor(time * fps)."""
    f = frames(spark, sf_dir)
    wanted = f.where(TRUTHS).select("video_id", "event_id", F.floor(F.col("signal") / 10 * 5).alias("frame_index"))
    return wanted.join(f.select("video_id", "frame_index", "signal"), ["video_id", "frame_index"]).select("video_id", "event_id", "frame_index", "signal")


@query(f"""WITH {FRAMES}, wanted AS (SELECT video_id, event_id, t + 1800 AS at FROM frames WHERE event_type = 'purchase'),
near AS (SELECT w.video_id, w.event_id, f.frame_index, row_number() OVER (PARTITION BY w.event_id ORDER BY abs(f.t - w.at), f.frame_index) AS k FROM wanted w JOIN frames f ON w.video_id = f.video_id AND abs(f.t - w.at) <= 21600)
SELECT video_id, event_id, frame_index FROM near WHERE k = 1""")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame nearest in time within a band, lowest number of equals."""
    f = frames(spark, sf_dir)
    w = f.where(TRUTHS).select("video_id", "event_id", (F.col("t") + 1800).alias("at"))
    near = intervals.band_join(w, f, F.col("at") - 21601, F.col("at") + 21601, 43200).where(F.abs(F.col("f.t") - F.col("p.at")) <= 21600)
    best = F.min(F.struct(F.abs(F.col("f.t") - F.col("p.at")).alias("d"), F.col("f.frame_index").alias("i"))).alias("b")
    return near.groupBy("p.video_id", "p.event_id").agg(best).select("video_id", "event_id", F.col("b.i").alias("frame_index"))


@query(f"WITH {FRAMES} SELECT video_id, frame_index, round(signal / 500 + (frame_index::DOUBLE / greatest(n - 1, 1)), 6) AS score FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames)")
def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("video_id", "frame_index", r6(F.col("signal") / 500 + windows.position_share()).alias("score"))


# --- clusters ------------------------------------------------------------------------------

_ISLANDS = """WITH {frames}, hits AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM frames WHERE signal >= {least} WINDOW w AS (PARTITION BY video_id ORDER BY t)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t) AS cluster FROM hits)"""


def _suppressed(name: str, gap: float, least: float):
    sql = _ISLANDS.format(frames=FRAMES, gap=gap, least=least) + """,
    ranked AS (SELECT video_id, frame_index, row_number() OVER (PARTITION BY video_id, cluster ORDER BY signal DESC, t, frame_index) AS k FROM islands)
    SELECT f.video_id, f.frame_index, CASE WHEN k = 1 THEN 1 ELSE 0 END AS smoothed FROM frames f LEFT JOIN ranked r USING (video_id, frame_index)"""

    @query(sql, name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cluster.suppress(frames(spark, sf_dir), "signal", least, gap).select("video_id", "frame_index", "smoothed")


_suppressed("nms_smooth", HOUR, 100.0)
_suppressed("nms_online", 12 * HOUR, 60.0)


@query(_ISLANDS.format(frames=FRAMES, gap=HOUR * 4, least=0) + " SELECT video_id, cluster::BIGINT AS cluster, min(t) AS start, max(t) AS \"end\", count(*) AS n, list(t ORDER BY t) AS timestamps FROM islands GROUP BY ALL")
def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.bursts(frames(spark, sf_dir), HOUR * 4).select("video_id", "cluster", "start", "end", "n", "timestamps")


@query(_ISLANDS.format(frames=FRAMES, gap=HOUR * 4, least=0) + """, ranked AS (SELECT *, count(*) OVER c AS n, row_number() OVER (PARTITION BY video_id, cluster ORDER BY CASE WHEN label = 0 THEN 0 ELSE 1 END, signal, frame_index) AS k,
    row_number() OVER (PARTITION BY video_id, cluster ORDER BY t) AS ordinal, count(CASE WHEN label = 0 THEN 1 END) OVER c AS n_ok FROM islands WINDOW c AS (PARTITION BY video_id, cluster))
SELECT video_id, cluster::BIGINT AS cluster, n, max(CASE WHEN n_ok > 0 AND k = 1 THEN t WHEN n_ok = 0 AND ordinal = n // 2 + 1 THEN t END) AS t, max(CASE WHEN n_ok > 0 AND k = 1 THEN signal END) AS signal FROM ranked GROUP BY video_id, cluster, n""")
def burst_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features exist for rows that are no errors only, so that some bursts fall back to their middle."""
    f = frames(spark, sf_dir)
    return cluster.burst_representative(f, HOUR * 4, "signal", F.col("label") == 0).select("video_id", "cluster", "n", "t", "signal")


@query(f"""WITH {FRAMES}, hits AS (SELECT *, CASE WHEN frame_index - lag(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) <= 2 THEN 0 ELSE 1 END AS fresh FROM frames WHERE label = 1),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_index) AS cluster FROM hits)
SELECT video_id, cluster::BIGINT AS cluster, max(frame_index) AS frame_index, count(*) AS n FROM islands GROUP BY video_id, cluster""")
def frame_clusters_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.last_of_cluster(frames(spark, sf_dir).where(ERRORS), 2).select("video_id", "cluster", "frame_index", "n")


_SPACED = """WITH RECURSIVE {frames}, times AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM ({source})),
walk AS (SELECT video_id, k, t, t AS last, TRUE AS kept FROM times WHERE k = 1 UNION ALL
    SELECT x.video_id, x.k, x.t, CASE WHEN x.t - w.last >= {gap} THEN x.t ELSE w.last END, x.t - w.last >= {gap} FROM walk w JOIN times x ON x.video_id = w.video_id AND x.k = w.k + 1)"""


@query(_SPACED.format(frames=FRAMES, source="SELECT DISTINCT video_id, t FROM frames", gap=12 * HOUR) + " SELECT video_id, t FROM walk WHERE kept")
def min_gap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.min_gap(frames(spark, sf_dir), 12 * HOUR).select("video_id", "t")


@query(_SPACED.format(frames=FRAMES, source="SELECT video_id, t FROM frames WHERE event_type = 'purchase' UNION SELECT video_id, max(t) + 3600 FROM frames GROUP BY video_id", gap=24 * HOUR) + " SELECT video_id, t FROM walk WHERE kept")
def end_row_then_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic row at each entity's end joins the marks before spacing."""
    f = frames(spark, sf_dir)
    ends = f.groupBy("video_id").agg((F.max("t") + 3600).alias("duration"))
    return cluster.min_gap(cluster.with_end_row(f.where(TRUTHS), ends), 24 * HOUR).select("video_id", "t")


@query(_ISLANDS.format(frames=FRAMES, gap=HOUR * 6, least=0) + " SELECT video_id, min(t) AS start, max(t) AS last, count(*) AS n, round(sum(signal), 4) AS total FROM islands GROUP BY video_id, cluster")
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters by session_window, the form that also runs on streams (a gap equal to the timeout joins)."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.expr("cast(ts as timestamp)").alias("at"), F.col("value").alias("signal"))
    epoch = F.expr("unix_micros(cast(timestamp_ntz '1970-01-01 00:00:00' as timestamp))")
    micros = lambda c: (F.unix_micros(c) - epoch) / F.lit(1e6)
    found = e.groupBy("video_id", F.session_window("at", "6 hours")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"), F.round(F.sum("signal"), 4).alias("total"))
    return found.select("video_id", micros("a").alias("start"), micros("b").alias("last"), "n", "total")


# --- band joins ----------------------------------------------------------------------------

_SNAPPED = f"""{_TRUTH}, near AS (SELECT m.video_id, m.event_id, f.frame_index, f.signal, row_number() OVER (PARTITION BY m.event_id ORDER BY f.signal, f.frame_index) AS k
FROM marks m JOIN frames f ON m.video_id = f.video_id AND f.t BETWEEN m.t - {6 * HOUR} AND m.t + {6 * HOUR}), snapped AS (SELECT * FROM near WHERE k = 1)"""


def _snapped(f: DataFrame) -> DataFrame:
    return intervals.snap_to_min(f.where(TRUTHS), f, 6 * HOUR, "signal", "event_id")


@query(f"{_SNAPPED} SELECT video_id, event_id, frame_index, signal FROM snapped")
def snap_to_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapped(frames(spark, sf_dir)).select("video_id", "event_id", "frame_index", "signal")


@query(f"{_SNAPPED} SELECT f.video_id, f.frame_index, CASE WHEN EXISTS (SELECT 1 FROM snapped s WHERE s.video_id = f.video_id AND s.frame_index BETWEEN f.frame_index - 2 AND f.frame_index + 2) THEN 1 ELSE 0 END AS near FROM frames f")
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return intervals.context_labels(f, _snapped(f), 2).select("video_id", "frame_index", "near")


@query(f"""{_TRUTH}, near AS (SELECT m.video_id, m.event_id, f.signal, row_number() OVER (PARTITION BY m.event_id ORDER BY f.frame_index) AS k FROM marks m
LEFT JOIN (SELECT * FROM frames WHERE label = 1) f ON m.video_id = f.video_id AND abs(f.t - m.t) <= {4 * HOUR}) SELECT video_id, event_id, coalesce(signal, 0.5) AS signal FROM near WHERE k = 1""")
def nearest_feature_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return intervals.nearest_default(f.where(TRUTHS), f.where(ERRORS), 4 * HOUR, "signal", 0.5).select("video_id", "event_id", "signal")


@query(f"""{_TRUTH}, prev AS (SELECT video_id, event_id, t, coalesce(lag(t) OVER (PARTITION BY video_id ORDER BY t), 0) AS p FROM marks),
raw AS (SELECT *, greatest(t - {24 * HOUR}, p + {HOUR}) AS a, t - {HOUR} AS b FROM prev),
win AS (SELECT video_id, event_id, t, CASE WHEN a >= b THEN greatest(0, t - {2 * HOUR}) ELSE a END AS ws, CASE WHEN a >= b THEN greatest(greatest(0, t - {2 * HOUR}) + {HOUR}, t - {HOUR / 2}) ELSE b END AS we FROM raw),
cand AS (SELECT w.video_id, w.event_id, w.t AS own_t, f.t, f.signal, count(f.frame_index) OVER (PARTITION BY w.event_id) AS n_frames, row_number() OVER (PARTITION BY w.event_id ORDER BY f.signal DESC, f.frame_index) AS k
FROM win w LEFT JOIN frames f ON w.video_id = f.video_id AND f.t BETWEEN ws AND we)
SELECT video_id, event_id, coalesce(t, own_t) AS capture, coalesce(signal, 0) AS best_score, n_frames FROM cand WHERE k = 1""")
def best_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return intervals.best_in_window(f.where(TRUTHS), f, 24 * HOUR, "signal", HOUR).select("video_id", "event_id", "capture", "best_score", "n_frames")


_SELECTION = """{truth}, scored AS (SELECT m.video_id, m.event_id, f.frame_index, f.signal, row_number() OVER e - 1 AS pos, count(*) OVER (PARTITION BY m.event_id) AS n
FROM marks m JOIN frames f ON m.video_id = f.video_id AND f.t BETWEEN m.t - {back} AND m.t WINDOW e AS (PARTITION BY m.event_id ORDER BY f.frame_index)),
ranked AS (SELECT *, (1 - signal / 500) * (1 + pos::DOUBLE / greatest(n - 1, 1)) AS score FROM scored)
SELECT video_id, event_id, frame_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, frame_index) AS k FROM ranked) WHERE k = 1"""


def _selection(name: str, back: float):
    @query(_SELECTION.format(truth=_TRUTH, back=back), name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The look-back frame with the best mix of little penalty and late position."""
        f = frames(spark, sf_dir)
        near = intervals.band_join(f.where(TRUTHS), f, F.col("t") - back, F.col("t"), back)
        rows = near.select("p.video_id", "p.event_id", "f.frame_index", "f.signal")
        score = (1 - F.col("signal") / 500) * (1 + windows.position_share("event_id"))
        top = rows.withColumn("score", score).groupBy("video_id", "event_id").agg(F.max(F.struct("score", (-F.col("frame_index")).alias("n"))).alias("b"))
        return top.select("video_id", "event_id", (-F.col("b.n")).alias("frame_index"), r6("b.score").alias("score"))


_selection("selection_score", 48 * HOUR)
_selection("best_quality_lookback", 24 * HOUR)


# --- filters and sets ----------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT video_id, frame_index, signal FROM frames WHERE signal >= 100")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(F.col("signal") >= 100).select("video_id", "frame_index", "signal")


@query(f"{_TRUTH} SELECT DISTINCT f.video_id, f.frame_index FROM frames f JOIN marks m ON f.video_id = m.video_id AND f.t BETWEEN m.t - 3600 AND m.t + 3600")
def closed_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    near = (F.col("f.video_id") == F.col("m.video_id")) & F.col("f.t").between(F.col("m.t") - 3600, F.col("m.t") + 3600)
    return f.alias("f").join(f.where(TRUTHS).alias("m"), near, "left_semi").select("video_id", "frame_index")


_TEST = "(3, 7, 11, 19)"


@query(f"WITH {FRAMES} SELECT CASE WHEN video_id IN {_TEST} THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT video_id) AS videos FROM frames GROUP BY 1")
def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test by fixed entity ids, so that neighbours never part."""
    split = F.when(F.col("video_id").isin(3, 7, 11, 19), "test").otherwise("train")
    return frames(spark, sf_dir).groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.countDistinct("video_id").alias("videos"))


@query("SELECT x AS video_id FROM (SELECT unnest([3, 7, 11, 19, 100000, 100001])::BIGINT AS x) WHERE x NOT IN (SELECT user_id FROM events)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 7, 11, 19, 100000, 100001)])).alias("video_id"))
    return wanted.join(table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")), "video_id", "left_anti")


@query(f"WITH {FRAMES} SELECT video_id, frame_index FROM frames WHERE (video_id, t) IN (SELECT video_id, t FROM frames WHERE event_type = 'error' AND signal > 50)")
def timestamp_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.join(f.where(ERRORS).where("signal > 50").select("video_id", "t"), ["video_id", "t"], "left_semi").select("video_id", "frame_index")


@query(f"{_TRUTH} SELECT m.video_id, m.event_id, f.frame_index, f.signal FROM marks m JOIN frames f ON m.video_id = f.video_id AND m.frame_index = f.frame_index")
def transition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks with the features of their frame, joined on the frame number instead of a float time."""
    f = frames(spark, sf_dir)
    marks = f.where(TRUTHS).select("video_id", "event_id", "frame_index")
    return marks.join(f.select("video_id", "frame_index", "signal"), ["video_id", "frame_index"]).select("video_id", "event_id", "frame_index", "signal")


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_type IN ('error', 'purchase') UNION ALL SELECT event_type FROM events WHERE event_type = 'view') GROUP BY 1")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(e.event_type.isin("error", "purchase")).unionByName(e.where(e.event_type == "view"), allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id AS video_id, date_trunc('day', ts)::DATE AS day FROM events")
def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.to_date("ts").alias("day")).distinct()


@query(f"""WITH {FRAMES}, old AS (SELECT video_id, list(frame_index ORDER BY frame_index) AS a FROM frames WHERE signal >= 100 GROUP BY 1), new AS (SELECT video_id, list(frame_index ORDER BY frame_index) AS b FROM frames WHERE signal >= 100 AND label = 0 GROUP BY 1)
SELECT video_id, len(a) AS n_old, len(b) AS n_new, len(b) - len(a) AS change, a = b AS same FROM old JOIN new USING (video_id)""")
def resultset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result sets per entity compared as ordered arrays."""
    f = frames(spark, sf_dir).where(F.col("signal") >= 100)
    arrays = f.groupBy("video_id").agg(F.sort_array(F.collect_list("frame_index")).alias("a"), F.sort_array(F.collect_list(F.when(F.col("label") == 0, F.col("frame_index")))).alias("b"))
    n = lambda c: F.size(c).cast("long")
    return arrays.where(F.size("b") > 0).select("video_id", n("a").alias("n_old"), n("b").alias("n_new"), (n("b") - n("a")).alias("change"), F.col("a").eqNullSafe(F.col("b")).alias("same"))


# --- evaluation ----------------------------------------------------------------------------

_PRED = f"WITH {FRAMES}, p AS (SELECT *, CASE WHEN signal >= 60 THEN 1 ELSE 0 END AS prediction FROM frames)"
_COUNTS = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn"
_SCORES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"
_ACCURACY = _SCORES + ", round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("prediction", (F.col("signal") >= 60).cast("int"))


@query(f"{_PRED} SELECT *, {_ACCURACY} FROM (SELECT {_COUNTS} FROM p)")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_scores(evaluate.confusion(_predicted(spark, sf_dir)))


@query(f"{_PRED} SELECT *, {_ACCURACY} FROM (SELECT video_id, {_COUNTS} FROM p GROUP BY video_id)")
def per_video_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_scores(evaluate.confusion(_predicted(spark, sf_dir), "video_id"))


@query(f"{_PRED}, v AS (SELECT video_id, {_COUNTS} FROM p GROUP BY video_id) SELECT *, {_SCORES} FROM (SELECT count(*) AS videos, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM v)")
def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = evaluate.confusion(_predicted(spark, sf_dir), "video_id")
    return evaluate.with_scores(each.agg(F.count("*").alias("videos"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))


@query(f"WITH {FRAMES} SELECT video_id, count(*) AS frames, sum(label)::BIGINT AS positives, round(100.0 * sum(label) / count(*), 6) AS positive_percent FROM frames GROUP BY video_id")
def video_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.count("*"), F.sum("label")
    return frames(spark, sf_dir).groupBy("video_id").agg(n.alias("frames"), p.alias("positives"), r6(100.0 * p / n).alias("positive_percent"))


@query(f"WITH {FRAMES} SELECT n0, n1, round(n0 / n1, 6) AS scale_pos_weight, round(100.0 * n1 / (n0 + n1), 6) AS positive_percent FROM (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM frames)")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = frames(spark, sf_dir).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    return counts.select("n0", "n1", r6(F.when(F.col("n1") > 0, F.col("n0") / F.col("n1"))).alias("scale_pos_weight"), r6(evaluate.ratio(100.0 * F.col("n1"), F.col("n0") + F.col("n1"))).alias("positive_percent"))


@query(f"WITH {FRAMES} SELECT count(DISTINCT video_id) AS videos, count(DISTINCT event_type) AS kinds, count(DISTINCT signal) AS signals FROM frames")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).agg(F.countDistinct("video_id").alias("videos"), F.countDistinct("event_type").alias("kinds"), F.countDistinct("signal").alias("signals"))


@query(f"""WITH {FRAMES}, g AS (SELECT signal, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM frames GROUP BY signal),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY signal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM g)
SELECT round((sum(rank * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM r""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(frames(spark, sf_dir), "signal").select(r6("auc").alias("auc"))


@query(f"""{_PRED}, c AS (SELECT cls, sum(CASE WHEN label = cls AND prediction = cls THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN label <> cls AND prediction = cls THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN label = cls AND prediction <> cls THEN 1 ELSE 0 END)::BIGINT AS fn FROM p, (SELECT unnest([0, 1]) AS cls) GROUP BY cls),
s AS (SELECT cls::VARCHAR AS class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, tp + fn AS support FROM c),
a AS (SELECT * FROM s UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM s UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support)::BIGINT FROM s)
SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM a""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluate.confusion(_predicted(spark, sf_dir))
    rows = F.inline(F.array(F.struct(F.lit("0").alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("over"), F.col("fp").alias("miss")), F.struct(F.lit("1").alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("over"), F.col("fn").alias("miss"))))
    h, o, m = F.col("hit"), F.col("over"), F.col("miss")
    each = counts.select(rows).select("class", evaluate.ratio(h, h + o).alias("p"), evaluate.ratio(h, h + m).alias("r"), evaluate.ratio(2 * h, 2 * h + o + m).alias("f"), (h + m).alias("support"))
    macro = each.agg(F.lit("macro avg").alias("class"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"), F.sum("support").alias("support"))
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = each.agg(F.lit("weighted avg").alias("class"), mean("p"), mean("r"), mean("f"), F.sum("support").alias("support"))
    return each.unionByName(macro).unionByName(weighted).select("class", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"), "support")


_STEPS = [round(5.0 * k, 2) for k in range(1, 20)]
_SWEEP = f"""WITH {FRAMES}, s AS (SELECT threshold, count(*) FILTER (label = 1 AND signal >= threshold) AS tp, count(*) FILTER (label = 0 AND signal >= threshold) AS fp, count(*) FILTER (label = 1 AND signal < threshold) AS fn, count(*) FILTER (label = 0 AND signal < threshold) AS tn
FROM frames, (SELECT unnest({_STEPS})::DOUBLE AS threshold) GROUP BY threshold), m AS (SELECT *, {_ACCURACY} FROM s)"""


@query(f"{_SWEEP} SELECT * FROM m")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.threshold_sweep(frames(spark, sf_dir), "signal", _STEPS)


@query(f"{_SWEEP} SELECT threshold, precision, recall, f1 FROM m ORDER BY recall >= 0.85 DESC, f1 DESC, threshold LIMIT 1")
def optimal_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.optimal_threshold(evaluate.threshold_sweep(frames(spark, sf_dir), "signal", _STEPS), 0.85).select("threshold", "precision", "recall", "f1")


@query(f"""WITH {FRAMES} SELECT video_id, min(signal) AS lowest, max(signal) AS highest, round(avg(signal), 6) AS mean, round(quantile_cont(signal, 0.5), 6) AS median, round(quantile_cont(signal, 0.95), 6) AS p95, round(quantile_cont(signal, 0.99), 6) AS p99,
count(*) FILTER (signal >= 10) AS n10, count(*) FILTER (signal >= 25) AS n25, count(*) FILTER (signal >= 50) AS n50, count(*) FILTER (signal >= 100) AS n100, count(*) FILTER (signal >= 200) AS n200 FROM frames GROUP BY video_id""")
def prob_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = lambda p: r6(F.percentile("signal", p))
    return frames(spark, sf_dir).groupBy("video_id").agg(
        F.min("signal").alias("lowest"), F.max("signal").alias("highest"), r6(F.avg("signal")).alias("mean"), pct(0.5).alias("median"), pct(0.95).alias("p95"), pct(0.99).alias("p99"), *[F.count_if(F.col("signal") >= k).alias(f"n{k}") for k in (10, 25, 50, 100, 200)]
    )


@query(f"{_PRED} SELECT video_id, frame_index, signal FROM p WHERE label = 0 AND prediction = 1 ORDER BY signal DESC, video_id, frame_index LIMIT 10")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten false positives of greatest score: the limit is the report's."""
    wrong = _predicted(spark, sf_dir).where("label = 0 AND prediction = 1")
    return wrong.orderBy(F.desc("signal"), "video_id", "frame_index").limit(10).select("video_id", "frame_index", "signal")


_FIVE = {"level": "signal / 500", "parity": "frame_index % 2", "third": "frame_index % 3", "ordinal": "frame_index", "user": "video_id"}
_MEANS = _PRED + ", u AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, label, prediction, ({v})::DOUBLE AS x FROM p" for k, v in _FIVE.items()) + ")"


@query(_MEANS + " SELECT feature, round(avg(x) FILTER (label = 0 AND prediction = 1), 5) AS fp_mean, round(avg(x) FILTER (label = 1), 5) AS true_mean, round(avg(x) FILTER (label = 0 AND prediction = 1) - avg(x) FILTER (label = 1), 5) AS difference FROM u GROUP BY feature")
def hard_negative_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature means of false positives against labelled rows: aggregated first, unpivoted after."""
    p = _predicted(spark, sf_dir)
    aggs = [f(F.expr(f"cast({v} as double)")).alias(f"{k}_{n}") for k, v in _FIVE.items() for n, f in (("fp", lambda x: F.avg(F.when((F.col("label") == 0) & (F.col("prediction") == 1), x))), ("true", lambda x: F.avg(F.when(F.col("label") == 1, x))))]
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"{k}_fp").alias("a"), F.col(f"{k}_true").alias("b")) for k in _FIVE]))
    return p.agg(*aggs).select(rows).select("feature", F.round("a", 5).alias("fp_mean"), F.round("b", 5).alias("true_mean"), F.round(F.col("a") - F.col("b"), 5).alias("difference"))


@query(_MEANS + """, d AS (SELECT feature, avg(x) FILTER (label = 0 AND prediction = 1) AS a FROM u GROUP BY feature), w AS (SELECT max(a) FILTER (feature = 'level') AS lv, max(a) FILTER (feature = 'parity') AS pa, max(a) FILTER (feature = 'third') AS th FROM d)
SELECT list_filter([CASE WHEN lv > 0.3 THEN 'high level' END, CASE WHEN pa < 0.7 THEN 'even frames' END, CASE WHEN th > 0.1 THEN 'off thirds' END], lambda x: x IS NOT NULL) AS causes FROM w""")
def false_positive_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent rules over the means of false positives, as an array of causes."""
    wrong = _predicted(spark, sf_dir).where("label = 0 AND prediction = 1").agg(F.avg(F.col("signal") / 500).alias("lv"), F.avg(F.col("frame_index") % 2).alias("pa"), F.avg(F.col("frame_index") % 3).alias("th"))
    return wrong.select(F.array_compact(F.array(F.when(F.col("lv") > 0.3, "high level"), F.when(F.col("pa") < 0.7, "even frames"), F.when(F.col("th") > 0.1, "off thirds"))).alias("causes"))


@query(f"""WITH RECURSIVE {FRAMES}, preds AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM frames WHERE event_type = 'error'),
truth AS (SELECT video_id, list(t ORDER BY t) AS ts FROM frames WHERE event_type = 'purchase' GROUP BY video_id), ids AS (SELECT DISTINCT video_id FROM frames WHERE event_type IN ('error', 'purchase')),
walk AS (SELECT i.video_id, 0::BIGINT AS k, coalesce(ts, []::DOUBLE[]) AS free, 0::BIGINT AS tp FROM ids i LEFT JOIN truth USING (video_id) UNION ALL
    SELECT w.video_id, p.k, CASE WHEN len(list_filter(w.free, lambda x: abs(x - p.t) <= {6 * HOUR})) > 0 THEN list_filter(w.free, lambda x: x <> list_filter(w.free, lambda y: abs(y - p.t) <= {6 * HOUR})[1]) ELSE w.free END,
    w.tp + CASE WHEN len(list_filter(w.free, lambda x: abs(x - p.t) <= {6 * HOUR})) > 0 THEN 1 ELSE 0 END FROM walk w JOIN preds p ON p.video_id = w.video_id AND p.k = w.k + 1),
ends AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) AS z FROM walk)
SELECT video_id, tp, k - tp AS fp, len(free)::BIGINT AS fn FROM ends WHERE z = 1""")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("ord", F.col("t"))
    return evaluate.tolerance_match(f.where(ERRORS), f.where(TRUTHS), 6 * HOUR)


@query(f"WITH {FRAMES} SELECT f.video_id, f.frame_index, p.prediction FROM frames f JOIN (SELECT video_id, frame_index, CASE WHEN signal >= 60 THEN 1 ELSE 0 END AS prediction FROM frames WHERE label = 0) p USING (video_id, frame_index) WHERE f.video_id IN {_TEST}")
def prediction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions meet test features by key rather than by row position."""
    p = _predicted(spark, sf_dir)
    return p.where(F.col("video_id").isin(3, 7, 11, 19)).select("video_id", "frame_index").join(p.where("label = 0").select("video_id", "frame_index", "prediction"), ["video_id", "frame_index"])


@query(f"WITH {FRAMES} SELECT CASE WHEN errors > 20 THEN 'failed' WHEN errors > 10 THEN 'partial' ELSE 'ok' END AS status, count(*) AS videos, sum(n)::BIGINT AS frames, sum(errors)::BIGINT AS errors FROM (SELECT video_id, count(*) AS n, sum(label) AS errors FROM frames GROUP BY video_id) GROUP BY 1")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"), F.sum("label").alias("errors"))
    status = F.when(F.col("errors") > 20, "failed").when(F.col("errors") > 10, "partial").otherwise("ok")
    return each.groupBy(status.alias("status")).agg(F.count("*").alias("videos"), F.sum("n").alias("frames"), F.sum("errors").alias("errors"))


@query(f"WITH {FRAMES}, k AS (SELECT video_id, count(*) AS n, count(*) FILTER (signal >= 20) AS final FROM frames GROUP BY 1) SELECT video_id, n, final, round((n - final) / n, 6) AS reduction FROM k")
def reduction_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(F.col("signal") >= 20).alias("final"))
    return each.select("video_id", "n", "final", r6(evaluate.ratio(F.col("n") - F.col("final"), F.col("n"))).alias("reduction"))


# --- long entities -------------------------------------------------------------------------

WEEK = 168 * HOUR


@query(ORACLES["nms_smooth"])
def nms_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same suppression with every entity cut into weeks."""
    return stretches.suppress(frames(spark, sf_dir), "signal", 100.0, HOUR, WEEK).select("video_id", "frame_index", "smoothed")


@query(ORACLES["burst_groups"])
def bursts_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches.bursts(frames(spark, sf_dir), HOUR * 4, WEEK).select("video_id", "cluster", "start", "end", "n", "timestamps")


@query(ORACLES["min_gap_filter"])
def min_gap_in_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches.min_gap(frames(spark, sf_dir), 12 * HOUR, WEEK)


@query(ORACLES["tolerance_match"])
def match_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("ord", F.col("t"))
    return stretches.tolerance_match(f.where(ERRORS), f.where(TRUTHS), 6 * HOUR, WEEK)


@query("""WITH wanted AS (SELECT unnest([0.05, 0.5, 0.95, 0.99]) AS share) SELECT event_type, share::DOUBLE AS share, count(value) AS n,
round(CASE share WHEN 0.05 THEN quantile_cont(value, 0.05) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.95 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END, 6) AS percentile FROM events, wanted GROUP BY event_type, share""")
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of few, large groups: ranges from a sketch, ranks from counts."""
    found = quantiles.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.05, 0.5, 0.95, 0.99], 1000)
    return found.select("event_type", "share", "n", r6("percentile").alias("percentile"))
