"""Queries that make whole documents: final notes, reports, galleries, scripts, prompts, and the note-making chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, pages, scalars
from ..operators import cluster, evaluate, intervals, sequential, windows
from ..session import table
from ..sources import writers
from .registry import FRAMES, frames, query, r6
from .slides import SIDE, slides

HOUR = 3600.0


@query("""WITH s AS (SELECT conv_id, turn + 1 AS slide, turn * 60.0 AS a, turn * 60.0 + 45 AS b, concat('## ', role, chr(10), text) AS notes FROM conversations),
body AS (SELECT conv_id, count(*) AS n, string_agg(concat(slide, '. [', replace(replace(string_split(notes, chr(10))[1], '## ', ''), '#', ''), '](#slide-', slide, ') (⏱️ ', printf('%.0f', a), 's)'), chr(10) ORDER BY slide) AS toc,
    string_agg(concat('<a id=''slide-', slide, '''></a>', chr(10), chr(10), '### Slide ', slide, chr(10), printf('**Time:** %.1fs - %.1fs', a, b), chr(10), printf('**Duration:** %.1fs', b - a), chr(10), chr(10), '![Slide ', slide, '](slides/', slide, '.png)', chr(10), chr(10), notes, chr(10), chr(10), '---', chr(10)), chr(10) ORDER BY slide) AS slides FROM s GROUP BY conv_id),
lect AS (SELECT conv_id, arg_min(text, turn) AS summary FROM conversations GROUP BY conv_id)
SELECT conv_id AS video_id, concat_ws(chr(10), concat('# Lecture ', conv_id, chr(10)), '**Generated:** 2024-01-01 00:00', '**Source Language:** EN', '**Notes Language:** English', concat('**Total Slides:** ', n), chr(10) || '---' || chr(10), '## 📋 Executive Summary' || chr(10), summary, chr(10) || '---' || chr(10),
    '## 📑 Table of Contents' || chr(10), toc, chr(10) || '---' || chr(10), slides, chr(10) || '## 📝 Generation Details' || chr(10), concat('- **Project:** ', conv_id)) AS document FROM body JOIN lect USING (conv_id)""")
def final_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final notes document of each lecture: summary, contents, anchored slides."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "video_id")
    start = F.col("turn") * F.lit(60.0)
    own = c.select("video_id", (F.col("turn") + 1).alias("slide"), start.alias("start"), (start + 45).alias("end"), F.concat(F.lit("slides/"), (F.col("turn") + 1).cast("string"), F.lit(".png")).alias("image"), F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("notes"))
    lectures = c.groupBy("video_id").agg(F.min_by("text", "turn").alias("summary")).select("video_id", F.concat(F.lit("Lecture "), F.col("video_id").cast("string")).alias("title"), F.lit("en").alias("language"), "summary", F.lit("2024-01-01 00:00").alias("generated"))
    return pages.final_notes(own, lectures)


@query(f"""WITH {FRAMES}, p AS (SELECT label, CASE WHEN signal >= 100 THEN 1 ELSE 0 END AS pred FROM frames),
c AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM p),
e AS (SELECT count(DISTINCT video_id) AS videos, count(*) FILTER (event_type = 'error' AND signal >= 100) AS tp, count(*) FILTER (event_type = 'purchase') AS fp, count(*) FILTER (event_type = 'error' AND signal < 100) AS fn FROM frames),
x AS (SELECT c.tp, c.fp, c.fn, c.tn, e.videos, e.tp AS etp, e.fp AS efp, e.fn AS efn FROM c, e)
SELECT concat_ws(chr(10), 'COMPARISON ANALYSIS REPORT', repeat('=', 70), '1. FRAMES', format('Total Frames Analyzed: {{:,}}', tp + fp + fn + tn), format('Manual Positives: {{:,}}', tp + fn), format('Predicted Positives: {{:,}}', tp + fp),
    format('  TN: {{:,}}', tn), format('  FP: {{:,}}', fp), format('  FN: {{:,}}', fn), format('  TP: {{:,}}', tp),
    printf('  Accuracy:  %.4f (%.2f%%)', (tp + tn) / (tp + fp + fn + tn), 100 * (tp + tn) / (tp + fp + fn + tn)), printf('  Precision: %.4f (%.2f%%)', tp / (tp + fp), 100 * tp / (tp + fp)), printf('  Recall:    %.4f (%.2f%%)', tp / (tp + fn), 100 * tp / (tp + fn)), printf('  F1 Score:  %.4f', 2 * tp / (2 * tp + fp + fn)), repeat('=', 70),
    '2. EVENTS', 'Matching Tolerance: ±2s', printf('Total Videos: %d', videos), printf('Manual Transitions: %d', etp + efn), printf('Predicted Transitions: %d', etp + efp),
    printf('  TP: %d (correctly detected)', etp), printf('  FP: %d (false alarms)', efp), printf('  FN: %d (missed transitions)', efn),
    printf('  Precision: %.4f (%.2f%%)', etp / (etp + efp), 100 * etp / (etp + efp)), printf('  Recall:    %.4f (%.2f%%)', etp / (etp + efn), 100 * etp / (etp + efn)), printf('  F1 Score:  %.4f', 2 * etp / (2 * etp + efp + efn)), repeat('=', 70)) AS report FROM x""")
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-level and event-level results side by side, as one text."""
    f = frames(spark, sf_dir)
    frame = evaluate.confusion(f.withColumn("prediction", (F.col("signal") >= 100).cast("int")))
    hit, miss = (F.col("event_type") == "error") & (F.col("signal") >= 100), (F.col("event_type") == "error") & (F.col("signal") < 100)
    event = f.groupBy("video_id").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("event_type") == "purchase").alias("fp"), F.count_if(miss).alias("fn"))
    return pages.comparison_report(frame, event, 2.0)


@query()
def slide_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most fifty slides with their pictures as PNG bytes."""
    w = Window.partitionBy("video_id").orderBy("vec_id")
    numbered = slides(spark, sf_dir).select("video_id", F.row_number().over(w).alias("index"), F.concat(F.lit("slide "), F.col("vec_id").cast("string")).alias("caption"), kernels.png_udf()(F.col("px"), F.lit(SIDE), F.lit(SIDE)).alias("picture"), F.lit("image/png").alias("kind"))
    return pages.gallery_pages(numbered, 50)


@query()
def slide_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides scaled to a width of 64 as JPEG files of quality 85."""
    found = slides(spark, sf_dir).select("video_id", "vec_id", F.col("px").alias("data"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    return writers.thumbnails(found, 64, quality=85)


@query("""WITH v AS (SELECT label AS video_id, count(*) AS slides, count(*) FILTER (vec_id % 10 = 0) AS blanks FROM embeddings GROUP BY label), p AS (SELECT *, row_number() OVER (ORDER BY video_id) AS position FROM v)
SELECT ((position - 1) // 100 + 1)::BIGINT AS page, concat('<!DOCTYPE html>', chr(10), '<html><body>', chr(10), string_agg(concat('<div class="video-card"><a href="', video_id, '/gallery.html">', video_id, '</a><span>', slides, ' slides, ', blanks, ' blank</span></div>'), chr(10) ORDER BY position), chr(10), '</body></html>') AS html FROM p GROUP BY 1""")
def video_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all recordings, a hundred to a page; the ranking window runs over a row per recording."""
    v = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("video_id")).agg(F.count("*").alias("slides"), F.count_if(F.col("vec_id") % 10 == 0).alias("blanks"))
    return pages.index_page(v.withColumn("position", F.row_number().over(Window.orderBy("video_id"))), 100)


@query("""SELECT concat('<!DOCTYPE html>', chr(10), '<html><body><h1>Comparison</h1>', chr(10), '<div class="metric-card"><b>videos</b> ', count(DISTINCT user_id), '</div>', chr(10), '<div class="metric-card"><b>frames</b> ', count(*), '</div>', chr(10), '<div class="metric-card"><b>errors</b> ', count(*) FILTER (event_type = 'error'), '</div>', chr(10), '</body></html>') AS html FROM events""")
def metrics_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = frames(spark, sf_dir).agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("frames"), F.count_if(F.col("label") == 1).alias("errors"))
    return pages.dashboard(totals, "Comparison")


@query(f"""WITH {FRAMES}, m AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t) AS index, coalesce(lag(t) OVER (PARTITION BY video_id ORDER BY t), 0) AS a, t AS b FROM frames WHERE event_type = 'purchase'),
c AS (SELECT *, concat('videos/it''s ', video_id, ' at 5%.mp4') AS v, printf('audio/%d_%03d.mp3', video_id, index) AS o, printf(' -ss %.2f -t %.2f -vn -acodec libmp3lame -q:a 2 ', a, b - a) AS mid FROM m)
SELECT video_id, index, concat('ffmpeg -i ''', replace(v, '''', '''\\'''''), '''', mid, '''', o, '''') AS posix, concat('ffmpeg -i "', replace(replace(v, '/', '\\'), '%', '%%'), '"', mid, '"', replace(o, '/', '\\'), '"') AS batch FROM c""")
def audio_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting commands for both kinds of shell; names are quoted, not only put between quotes."""
    m = windows.previous_interval(frames(spark, sf_dir).where("event_type = 'purchase'"), "t")
    m = m.withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("t")).cast("long"))
    video = F.concat(F.lit("videos/it's "), F.col("video_id").cast("string"), F.lit(" at 5%.mp4"))
    audio = F.format_string("audio/%d_%03d.mp3", "video_id", "index")
    command = lambda q: pages.audio_command(video, F.col("start"), F.col("t"), audio, q)
    return m.select("video_id", "index", command(pages.posix_quoted).alias("posix"), command(pages.windows_quoted).alias("batch"))


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS heard, turn * 60.0 AS a, turn * 60.0 + 60 AS b FROM conversations)
SELECT conv_id, turn, concat('Repair this recognised slide text; change nothing that is right and add nothing.', chr(10), chr(10), '[slide text]', chr(10), text, chr(10), chr(10), '[speech]', chr(10), heard, chr(10), chr(10), '[speech language] en', chr(10), chr(10), 'Answer with the repaired text, in English, line by line.', chr(10)) AS cleaning,
concat('Write lecture notes in English from this slide and its speech alone.', chr(10), chr(10), '[slide] ', turn + 1, chr(10), printf('[time] %.1fs - %.1fs', a, b), chr(10), '[speech language] en', chr(10), chr(10), '[slide text]', chr(10), text, chr(10), chr(10), '[speech]', chr(10), heard, chr(10), chr(10), 'Begin with a ## heading; use bullets for ideas and numbers for steps; mark what is called important or examined; write formulas as LaTeX.', chr(10)) AS notes FROM c""")
def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both prompts of a slide, over whole texts."""
    c = table(spark, sf_dir, "conversations")
    heard = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    start, en = F.col("turn") * F.lit(60.0), F.lit("en")
    rows = c.select("conv_id", "turn", "text", heard.alias("heard"))
    return rows.select("conv_id", "turn", pages.cleaning_prompt(F.col("text"), F.col("heard"), en).alias("cleaning"), pages.notes_prompt(F.col("turn") + 1, F.col("text"), F.col("heard"), en, start, start + 60).alias("notes"))


@query("""WITH s AS (SELECT label AS video_id, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), there AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY vec_id) AS before FROM s WHERE vec_id % 11 <> 0)
SELECT video_id, k - 1 AS slide_from, k AS slide_to, round(list_cosine_similarity(before, e), 6) AS similarity FROM there WHERE before IS NOT NULL""")
def similarity_of_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each slide against the slide before it that has an image; every eleventh has none."""
    w = Window.partitionBy("video_id").orderBy("vec_id")
    numbered = slides(spark, sf_dir).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("vec_id") % 11 != 0)
    pairs = numbered.withColumn("before", F.lag("vector").over(w)).where(F.col("before").isNotNull())
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("vector", "before") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("before", "before")))
    return pairs.select("video_id", (F.col("k") - 1).alias("slide_from"), F.col("k").alias("slide_to"), r6(cosine).alias("similarity"))


_KEYS = "CASE event_type WHEN 'view' THEN 'd' WHEN 'click' THEN 'n' WHEN 'purchase' THEN 'u' WHEN 'error' THEN 'a' ELSE 'y' END"


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, frame_index, {_KEYS} AS key FROM frames),
w AS (SELECT DISTINCT video_id, -1::BIGINT AS f, 1::BIGINT AS pos, list_transform(range(12), lambda x: TRUE) AS keep FROM k UNION ALL
SELECT w.video_id, k.frame_index, CASE WHEN key IN ('y', 'n', 'd') THEN least(pos + 1, 12) WHEN key = 'a' THEN greatest(pos - 1, 1) ELSE pos END,
CASE WHEN key = 'y' THEN list_concat(keep[:pos - 1], [TRUE], keep[pos + 1:]) WHEN key = 'n' THEN list_concat(keep[:pos - 1], [FALSE], keep[pos + 1:]) WHEN key = 'u' THEN list_concat(keep[:pos - 1], [NOT keep[pos]], keep[pos + 1:]) ELSE keep END FROM w JOIN k ON k.video_id = w.video_id AND k.frame_index = w.f + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f DESC) AS r FROM w), o AS (SELECT video_id, unnest(range(1, 13)) AS slide, unnest(keep) AS keep FROM z WHERE r = 1)
SELECT video_id, slide, row_number() OVER (PARTITION BY video_id ORDER BY slide) AS index, 12::BIGINT AS original_count FROM o WHERE keep""")
def curation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses on twelve slides a recording, then the kept slides renumbered: y and n mark and go on, u turns the mark, d and a move."""
    kept = sequential.press_keys(frames(spark, sf_dir).withColumn("key", F.expr(_KEYS)), 12, "frame_index", "key").where("keep")
    return kept.select("video_id", "slide", F.row_number().over(Window.partitionBy("video_id").orderBy("slide")).cast("long").alias("index"), F.lit(12).cast("long").alias("original_count"))


_SESSION_KEYS = "CASE WHEN event_id % 53 = 0 THEN 'r' WHEN event_id % 211 = 0 THEN 's' WHEN event_id % 307 = 0 THEN 'q' WHEN event_type = 'view' THEN 'd' WHEN event_type = 'click' THEN 'n' WHEN event_type = 'purchase' THEN 'u' WHEN event_type = 'error' THEN 'A' ELSE 'Y' END"


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, frame_index, lower({_SESSION_KEYS}) AS key FROM frames),
sl AS (SELECT label::BIGINT AS video_id, list(vec_id ORDER BY vec_id) AS ids, list(CASE WHEN vec_id % 11 <> 0 THEN embedding::DOUBLE[] END ORDER BY vec_id) AS vs, count(*) AS n FROM embeddings GROUP BY label),
w AS (SELECT sl.video_id, -1::BIGINT AS f, 1::BIGINT AS pos, list_transform(ids, lambda x: TRUE) AS keep, 'open' AS ended FROM sl UNION ALL
SELECT w.video_id, k.frame_index, CASE WHEN key IN ('y', 'n', 'd') THEN least(pos + 1, n) WHEN key = 'a' THEN greatest(pos - 1, 1) ELSE pos END,
CASE WHEN key IN ('y', 'n') THEN list_concat(keep[:pos - 1], [key = 'y'], keep[pos + 1:]) WHEN key = 'u' THEN list_concat(keep[:pos - 1], [NOT keep[pos]], keep[pos + 1:]) WHEN key = 'q' THEN list_transform(ids, lambda x: TRUE)
WHEN key = 'r' THEN list_reduce(range(1, n + 1), lambda a, i: CASE WHEN NOT keep[i] THEN {{'keep': list_append(a.keep, FALSE), 'last': a.last}} WHEN vs[i] IS NULL THEN {{'keep': list_append(a.keep, TRUE), 'last': a.last}}
    WHEN a.last > 0 AND list_cosine_similarity(vs[a.last], vs[i]) >= 0.2 THEN {{'keep': list_append(a.keep, FALSE), 'last': a.last}} ELSE {{'keep': list_append(a.keep, TRUE), 'last': i}} END, {{'keep': []::BOOLEAN[], 'last': 0::BIGINT}}).keep ELSE keep END,
CASE key WHEN 's' THEN 'save' WHEN 'q' THEN 'quit' ELSE 'open' END FROM w JOIN k ON k.video_id = w.video_id AND k.frame_index = w.f + 1 JOIN sl ON sl.video_id = w.video_id WHERE ended = 'open'),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f DESC) AS r FROM w)
SELECT z.video_id, unnest(ids) AS vec_id, unnest(keep) AS keep, ended FROM z JOIN sl USING (video_id) WHERE r = 1""")
def curation_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key sessions over the slides of a label, with removal of like slides, saving and quitting."""
    pictures = slides(spark, sf_dir).select(F.col("video_id").cast("long").alias("video_id"), F.col("vec_id").alias("place"), F.when(F.col("vec_id") % 11 != 0, F.col("vector")).alias("vector"))
    keys = frames(spark, sf_dir).select("video_id", F.col("frame_index").alias("place"), F.expr(_SESSION_KEYS).alias("key"))
    return sequential.key_session(pictures, keys, "place", "vector", "key", 0.2).withColumnRenamed("place", "vec_id")


@query(f"""WITH {FRAMES}, hits AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM frames WHERE signal >= 100 WINDOW w AS (PARTITION BY video_id ORDER BY t)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY t) AS cluster FROM hits),
marks AS (SELECT video_id, frame_index, t FROM islands QUALIFY row_number() OVER (PARTITION BY video_id, cluster ORDER BY signal DESC, t, frame_index) = 1),
spans AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY video_id ORDER BY t), 0) AS start, row_number() OVER (PARTITION BY video_id ORDER BY t) AS slide FROM marks),
raw AS (SELECT *, greatest(t - {24 * HOUR}, start + {HOUR}) AS a, t - {HOUR} AS b FROM spans),
win AS (SELECT *, CASE WHEN a >= b THEN greatest(0, t - {2 * HOUR}) ELSE a END AS ws, CASE WHEN a >= b THEN greatest(greatest(0, t - {2 * HOUR}) + {HOUR}, t - {HOUR / 2}) ELSE b END AS we FROM raw),
cand AS (SELECT w.*, f.t AS ft, f.signal, row_number() OVER (PARTITION BY w.video_id, w.frame_index ORDER BY f.signal DESC, f.frame_index) AS k FROM win w LEFT JOIN frames f ON w.video_id = f.video_id AND f.t BETWEEN ws AND we)
SELECT video_id, slide, start, t AS "end", coalesce(ft, t) AS capture, concat('### Slide ', slide, chr(10), printf('**Time:** %.1fs - %.1fs', start, t)) AS note FROM cand WHERE k = 1""")
def note_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scores to slides in one plan: threshold, peak suppression, intervals, best frame of each window, note header."""
    f = frames(spark, sf_dir)
    marks = cluster.suppress(f, "signal", 100.0, HOUR).where("smoothed = 1").select("video_id", "frame_index", "t")
    spans = windows.previous_interval(windows.renumber(marks, "t", out="slide"), "t")
    best = intervals.best_in_window(marks, f, 24 * HOUR, "signal", HOUR, point="frame_index")
    chain = spans.join(best, ["video_id", "frame_index"])
    note = F.concat(F.lit("### Slide "), F.col("slide").cast("string"), F.format_string("\n**Time:** %ss - %ss", scalars.fixed(F.col("start"), 1), scalars.fixed(F.col("t"), 1)))
    return chain.select("video_id", "slide", "start", F.col("t").alias("end"), "capture", note.alias("note"))
