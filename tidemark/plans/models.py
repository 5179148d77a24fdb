"""Queries with a fitted model or a stream, which have no SQL form or another one."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.external import python_round
from ..operators import boosting, evaluate, windows
from ..session import scratch
from ..streaming import ledger, ordered, sessions
from .registry import FRAMES, frames, query
from .slides import SLIDE_SEQUENCE

_INPUTS = ["signal", "change", "rolling_mean", "rolling_std", "rolling_max"]


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rolled = windows.rolling_stats(windows.lag_change(frames(spark, sf_dir), "signal", "change"), "signal", 10, True)
    test = F.col("video_id").isin(3, 7, 11, 19)
    return rolled.where(~test), rolled.where(test)


@lru_cache(maxsize=4)
def _fitted(spark: SparkSession, sf_dir: str) -> boosting.Boosted:
    """The model in its published shape; the three queries of a session share it."""
    return boosting.fit(_training(spark, sf_dir)[0], _INPUTS, key=["event_id"])


@query()
def gbt_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted model, in its published shape, fitted on the training entities, applied to the test entities."""
    scored = boosting.predict(_fitted(spark, sf_dir), _training(spark, sf_dir)[1], 0.5)
    return scored.select("video_id", "frame_index", "label", "probability", "prediction")


@query()
def gbt_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = boosting.predict(_fitted(spark, sf_dir), _training(spark, sf_dir)[1], 0.5)
    return evaluate.with_scores(evaluate.confusion(scored, "video_id"))


@query()
def gbt_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.importances(spark, _fitted(spark, sf_dir))


_CUTS = [float(c) for c in range(10, 200, 10)]


@query(f"""WITH {FRAMES}, used AS (SELECT *, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) FROM frames) ELSE 1.0 END AS w FROM frames),
x AS (SELECT *, CAST(round_even((0.5 - label) * w * 1048576, 0) AS BIGINT) AS g, CAST(round_even(0.25 * w * 1048576, 0) AS BIGINT) AS h FROM used),
cuts AS (SELECT CAST(unnest(range(1, 20)) * 10 AS DOUBLE) AS cut), sides AS (SELECT cut, sum(g) FILTER (signal <= cut) / 1048576 AS gl, sum(h) FILTER (signal <= cut) / 1048576 AS hl, sum(g) / 1048576 AS gt, sum(h) / 1048576 AS ht FROM x, cuts GROUP BY cut),
scored AS (SELECT *, power(greatest(abs(gl) - 0.1, 0), 2) / (hl + 1) + power(greatest(abs(gt - gl) - 0.1, 0), 2) / (ht - hl + 1) - power(greatest(abs(gt) - 0.1, 0), 2) / (ht + 1) AS gain FROM sides WHERE hl >= 3 AND ht - hl >= 3),
best AS (SELECT * FROM scored ORDER BY gain DESC, cut LIMIT 1)
SELECT event_id, cut, round(gain, 6) AS gain, round(1 / (1 + exp(0.1 * CASE WHEN signal <= cut THEN sign(gl) * greatest(abs(gl) - 0.1, 0) / (hl + 1) ELSE sign(gt - gl) * greatest(abs(gt - gl) - 0.1, 0) / (ht - hl + 1) END)), 6) AS probability FROM frames, best""")
def boost_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regularised split of all rows at fixed cuts: its place, its gain and the probabilities it gives."""
    f = frames(spark, sf_dir)
    shape = boosting.Settings(trees=1, depth=1, rows=1.0, columns=1.0, gamma=0.0)
    found = boosting.fit(f, ["signal"], settings=shape, edges=[_CUTS])
    root = found.trees[0]
    scored = boosting.predict(found, f)
    return scored.select("event_id", F.lit(_CUTS[root.cut[1]]).alias("cut"), F.lit(round(root.gain[1], 6)).alias("gain"), F.round("probability", 6).alias("probability"))


@query()
def rounded_for_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as documents print them: the binary value to two and three digits, ties to even."""
    f = frames(spark, sf_dir)
    return f.select("video_id", "frame_index", python_round(2)(F.col("signal") / 8).alias("two"), python_round(3)(F.col("signal") / 16).alias("three"))


@query(f"WITH {FRAMES} SELECT video_id, event_id AS latest FROM frames QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t DESC, event_id DESC) = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest item of each entity, as a model folder is chosen by its time."""
    return frames(spark, sf_dir).groupBy("video_id").agg(F.max(F.struct("t", "event_id")).alias("b")).select("video_id", F.col("b.event_id").alias("latest"))


_EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern instead of a plain path: stream sources take a plain path to be a folder
    found = spark.readStream.schema(_EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return found.select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("at"), "value")


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    """An output and a checkpoint path in the shared folder of the session."""
    path = scratch(spark, name)
    return f"{path}/out", f"{path}/state"


@query(f"""WITH RECURSIVE {FRAMES}, times AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM (SELECT DISTINCT video_id, t FROM frames)),
walk AS (SELECT video_id, k, t, t AS last, TRUE AS kept FROM times WHERE k = 1 UNION ALL SELECT x.video_id, x.k, x.t, CASE WHEN x.t - w.last >= 43200 THEN x.t ELSE w.last END, x.t - w.last >= 43200 FROM walk w JOIN times x ON x.video_id = w.video_id AND x.k = w.k + 1)
SELECT video_id, t FROM walk WHERE kept""")
def stream_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy spacing as a stream with one kept time per entity as state."""
    return sessions.run_to_end(sessions.spaced(_stream(spark, sf_dir), 43200.0), *_folders(spark, "spaced"))


@query(f"""WITH {FRAMES} SELECT video_id, t, round(coalesce(signal - lag(signal) OVER w, 0), 6) AS change, round(avg(signal) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_mean,
max(signal) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rolling_max FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY t)""")
def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame loop as a stream: difference, mean and maximum over ten held values."""
    out = sessions.run_to_end(sessions.rolling(_stream(spark, sf_dir), 10), *_folders(spark, "rolling"))
    return out.select("video_id", "t", F.round("change", 6).alias("change"), F.round("rolling_mean", 6).alias("rolling_mean"), "rolling_max")


def _slide_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.LongType())])
    found = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    return found.select(F.col("label").alias("video_id"), F.timestamp_micros(F.col("vec_id") * 1_000_000).alias("at"), "embedding", "vec_id")


@query(f"""WITH RECURSIVE {SLIDE_SEQUENCE}, w AS (SELECT video_id, k, vec_id, e AS le, vec_id AS lid, TRUE AS kept FROM s WHERE k = 1 UNION ALL
SELECT video_id, k, vec_id, CASE WHEN ok THEN ne ELSE le END, CASE WHEN ok THEN vec_id ELSE lid END, ok FROM (SELECT *, c < CASE WHEN vec_id - lid < 12 THEN 0.25 ELSE 0.15 END AS ok
FROM (SELECT w.video_id, s.k, s.vec_id, s.e AS ne, w.le, w.lid, list_cosine_similarity(w.le, s.e) AS c FROM w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1)))
SELECT video_id, vec_id FROM w WHERE kept""")
def stream_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential deduplication as a stream, its accepted slides."""
    events = _slide_stream(spark, sf_dir).withColumnRenamed("embedding", "vector")
    out = sessions.run_to_end(sessions.accepted(events, 0.15, "first", 0.25, 12.0), *_folders(spark, "first"))
    return out.where("action = 'keep'").select(F.col("video_id").cast("int").alias("video_id"), F.col("t").cast("long").alias("vec_id"))


@query(f"""WITH RECURSIVE {SLIDE_SEQUENCE}, w AS (SELECT video_id, k, [vec_id] AS ids, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE e END AS le FROM s WHERE k = 1 UNION ALL
SELECT w.video_id, s.k, CASE WHEN s.vec_id % 11 <> 0 AND w.le IS NOT NULL AND list_cosine_similarity(w.le, s.e) >= 0.1 THEN list_append(list_filter(w.ids, lambda x: x <> w.lid), s.vec_id) ELSE list_append(w.ids, s.vec_id) END,
CASE WHEN s.vec_id % 11 = 0 THEN w.le ELSE s.e END FROM (SELECT *, list_last(list_filter(ids, lambda x: x % 11 <> 0)) AS lid FROM w) w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1),
z AS (SELECT video_id, ids, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) AS r FROM w) SELECT video_id, unnest(ids) AS vec_id FROM z WHERE r = 1""")
def stream_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of each run of like slides, from a stream of decisions; slides without an image stay."""
    events = _slide_stream(spark, sf_dir).select("video_id", "at", F.when(F.col("vec_id") % 11 != 0, F.col("embedding")).alias("vector"))
    out = sessions.run_to_end(sessions.accepted(events, 0.1, "latest"), *_folders(spark, "latest"))
    gone = out.where("action = 'replace'").select("video_id", F.col("instead_of").alias("t"))
    return out.where("action <> 'drop'").join(gone, ["video_id", "t"], "left_anti").select(F.col("video_id").cast("int").alias("video_id"), F.col("t").cast("long").alias("vec_id"))


@query()
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose end the watermark has passed when the input ends."""
    return sessions.run_to_end(sessions.sessions(_stream(spark, sf_dir), "6 hours", "1 hour"), *_folders(spark, "sessions"))


_WATERMARK = "(SELECT max(t) - 3600 FROM frames)"


@query(f"""WITH RECURSIVE {FRAMES}, times AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS k FROM (SELECT DISTINCT video_id, t FROM frames WHERE t <= {_WATERMARK})),
walk AS (SELECT video_id, k, t, t AS last, TRUE AS kept FROM times WHERE k = 1 UNION ALL SELECT x.video_id, x.k, x.t, CASE WHEN x.t - w.last >= 43200 THEN x.t ELSE w.last END, x.t - w.last >= 43200 FROM walk w JOIN times x ON x.video_id = w.video_id AND x.k = w.k + 1)
SELECT CAST(video_id AS BIGINT) AS video_id, t FROM walk WHERE kept""")
def stream_spaced_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy spacing of a stream whose events wait for the watermark and are taken in order of time; what it has not passed waits on."""
    return ordered.run_ordered(ordered.spaced_in_order(_stream(spark, sf_dir), 43200.0, "1 hour"), *_folders(spark, "spaced-order"))


@query(f"""WITH {FRAMES}, seen AS (SELECT *, t - lag(t) OVER w AS gap FROM frames WHERE t <= {_WATERMARK} WINDOW w AS (PARTITION BY video_id ORDER BY t)),
runs AS (SELECT *, sum(CASE WHEN gap < 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY t) AS k FROM seen),
found AS (SELECT video_id, k, min(t) AS start, max(t) AS "end", count(*) AS n, max(signal) AS peak FROM runs GROUP BY video_id, k)
SELECT CAST(video_id AS BIGINT) AS video_id, start, "end", n, peak FROM found QUALIFY k < max(k) OVER (PARTITION BY video_id)""")
def stream_sessions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a state machine in order of time, each given when the one after it begins."""
    return ordered.run_ordered(ordered.sessions_in_order(_stream(spark, sf_dir), 21600.0, "1 hour"), *_folders(spark, "sessions-order"))


@query(f"WITH {FRAMES} SELECT video_id, t, signal AS value FROM frames WHERE signal >= 50")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong signals of a stream through the sink with a ledger, run again over the same input: each row is there once."""
    marks = _stream(spark, sf_dir).where("value >= 50").select("video_id", (F.unix_micros("at") / F.lit(1e6)).alias("t"), "value")
    root, state = _folders(spark, "ledger")
    ledger.run_resumable(marks, root, state)
    return ledger.run_resumable(marks, root, state)
