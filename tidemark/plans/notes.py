"""Queries over transcripts, notes and documents: alignment, markdown, reports, scans.

Conversations stand for transcripts; markdown is built from their turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars, text
from ..operators import intervals, rules
from ..session import table
from .registry import FRAMES, frames, query, r6

# --- alignment -----------------------------------------------------------------------------

_SEGMENTS = """seg AS (SELECT conv_id AS video_id, turn, text AS seg_text, (sum(length(text)) OVER w - length(text))::DOUBLE AS seg_start, (sum(length(text)) OVER w)::DOUBLE AS seg_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
slide AS (SELECT video_id, index, index * 1000.0::DOUBLE AS start, (index + 1) * 1000.0::DOUBLE AS "end" FROM (SELECT video_id, unnest(range(0, (floor(max(seg_end) / 1000) + 1)::BIGINT)) AS index FROM seg GROUP BY video_id))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("video_id"), "turn", F.col("text").alias("seg_text"), (end - F.length("text")).cast("double").alias("seg_start"), end.cast("double").alias("seg_end"))


def _slides(seg: DataFrame) -> DataFrame:
    ends = seg.groupBy("video_id").agg(F.max("seg_end").alias("m"))
    spans = ends.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 1000))).alias("index"))
    return spans.select("video_id", "index", (F.col("index") * 1000.0).alias("start"), ((F.col("index") + 1) * 1000.0).alias("end"))


@query(f"""WITH {_SEGMENTS} SELECT s.video_id, s.index, coalesce(string_agg(g.seg_text, ' ' ORDER BY g.seg_start), '') AS transcript, count(g.seg_start) AS n_segments
FROM slide s LEFT JOIN seg g ON s.video_id = g.video_id AND g.seg_start >= s.start AND g.seg_end <= s."end" GROUP BY s.video_id, s.index""")
def transcript_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    return intervals.align_segments(_slides(seg), seg)


@query(f"""WITH {_SEGMENTS}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY index) AS position FROM slide), b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY turn) AS position FROM seg)
SELECT video_id, position, index, turn FROM a JOIN b USING (video_id, position)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    return intervals.zip_by_position(_slides(seg).select("video_id", "index"), seg.select("video_id", "turn"), "index", "turn").select("video_id", "position", "index", "turn")


@query(f"WITH {_SEGMENTS} SELECT video_id, index AS slide, index * 60.0::DOUBLE AS start, (index + 1) * 60.0::DOUBLE AS \"end\" FROM slide")
def dummy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty-second slides where a recording has none of its own."""
    return _slides(segments(spark, sf_dir)).select("video_id", F.col("index").alias("slide"), (F.col("index") * 60.0).alias("start"), ((F.col("index") + 1) * 60.0).alias("end"))


@query(f"WITH {_SEGMENTS}, done AS (SELECT video_id, max(turn) AS last FROM seg WHERE length(seg_text) < 300 GROUP BY video_id) SELECT s.video_id, s.turn FROM seg s LEFT JOIN done d ON s.video_id = d.video_id WHERE s.turn > coalesce(d.last, -1)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work left after the last finished item of each entity: a left join against what is done."""
    seg = segments(spark, sf_dir)
    done = seg.where(F.length("seg_text") < 300).groupBy("video_id").agg(F.max("turn").alias("last"))
    return seg.join(done, "video_id", "left").where(F.col("turn") > F.coalesce("last", F.lit(-1))).select("video_id", "turn")


# --- markdown ------------------------------------------------------------------------------

_MD = """turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN concat('## Slide ', turn + 1, ': part', chr(10), '### ', string_split(text, chr(10))[1])
    WHEN 'assistant' THEN concat(text, chr(10), '- point ', turn, chr(10), '1. step', chr(10), '![Slide](img/', turn, '.png)', chr(10), '---') ELSE concat('# ', string_split(text, chr(10))[1]) END AS md FROM conversations),
notes AS (SELECT conv_id, string_agg(md, chr(10) ORDER BY turn) AS md FROM turns GROUP BY conv_id),
lines AS (SELECT conv_id, unnest(range(1, len(l) + 1)) AS line_no, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line FROM (SELECT conv_id, string_split(md, chr(10)) AS l FROM notes))"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.split("text", "\n"), F.lit(0))
    n = F.col("turn").cast("string")
    md = (
        F.when(F.col("role") == "user", F.concat(F.lit("## Slide "), (F.col("turn") + 1).cast("string"), F.lit(": part\n### "), first))
        .when(F.col("role") == "assistant", F.concat("text", F.lit("\n- point "), n, F.lit("\n1. step\n![Slide](img/"), n, F.lit(".png)\n---")))
        .otherwise(F.concat(F.lit("# "), first))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", md.alias("md"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.joined(_turns(spark, sf_dir), "turn", F.col("md"), "md", "\n", "conv_id")


@query(f"""WITH {_MD}, k AS (SELECT *, CASE WHEN line = '' OR starts_with(line, '```') THEN NULL WHEN starts_with(line, '# ') THEN 'h1' WHEN starts_with(line, '## ') THEN 'h2' WHEN starts_with(line, '### ') THEN 'h3' WHEN starts_with(line, '- ') OR starts_with(line, '* ') THEN 'bullet'
WHEN regexp_matches(line, '^[0-9]+\\. ') THEN 'number' WHEN starts_with(line, '![') THEN 'image' WHEN line = '---' THEN 'rule' ELSE 'paragraph' END AS kind FROM lines)
SELECT conv_id, line_no, kind, CASE WHEN kind = 'image' THEN regexp_extract(line, '!\\[.*?\\]\\((.*?)\\)', 1) ELSE regexp_replace(line, '^(#{{1,3}} |[-*] |[0-9]+\\. )', '') END AS content FROM k WHERE kind IS NOT NULL""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.markdown_blocks(_notes(spark, sf_dir), "md", "conv_id")


@query(f"""WITH {_MD}, m AS (SELECT *, starts_with(line, '### ') OR starts_with(line, '#### ') AS asks, coalesce(last_value(CASE WHEN starts_with(line, '## Slide ') THEN substr(line, 4) END IGNORE NULLS) OVER w, 'Unknown') AS here, sum(CASE WHEN starts_with(line, '### ') OR starts_with(line, '#### ') THEN 1 ELSE 0 END) OVER w AS card FROM lines WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)),
c AS (SELECT conv_id, card::BIGINT AS card, max(CASE WHEN asks THEN trim(replace(line, '###', '')) END) AS question, string_agg(line, chr(10) ORDER BY line_no) FILTER (line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '---')) AS answer, arg_max(here, line_no) AS slide FROM m WHERE card > 0 GROUP BY conv_id, card)
SELECT * FROM c WHERE answer IS NOT NULL""")
def flashcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.flashcards(_notes(spark, sf_dir), "md", "conv_id")


@query(f"""WITH {_MD} SELECT conv_id, string_agg(concat(turn + 1, '. [', replace(replace(string_split(md, chr(10))[1], '## ', ''), '#', ''), '](#slide-', turn + 1, ') (', turn * 60, 's)'), chr(10) ORDER BY turn) AS toc FROM turns GROUP BY conv_id""")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("turn") + 1).cast("string")
    entry = F.concat(n, F.lit(". ["), text.first_heading(F.col("md")), F.lit("](#slide-"), n, F.lit(") ("), (F.col("turn") * 60).cast("string"), F.lit("s)"))
    return text.joined(_turns(spark, sf_dir), "turn", entry, "toc", "\n", "conv_id")


@query(f"WITH {_MD} SELECT conv_id, coalesce(list_max(list_transform(regexp_extract_all(md, '## Slide ([0-9]+)', 1), lambda x: x::BIGINT)), 0) AS last_slide FROM notes")
def completed_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest slide number among a document's headings."""
    found = F.transform(F.regexp_extract_all("md", F.lit(r"## Slide ([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    return _notes(spark, sf_dir).select("conv_id", F.coalesce(F.array_max(found), F.lit(0).cast("long")).alias("last_slide"))


@query(f"""WITH {_MD}, h AS (SELECT conv_id, md, regexp_extract_all(md, '(?m)^## Slide ([0-9]+):', 1) AS heads FROM notes), r AS (SELECT *, heads[len(heads)]::BIGINT AS last, trim(string_split(md, '## Slide ' || heads[len(heads)] || ':')[-1], ' ' || chr(10) || chr(9)) AS rest FROM h)
SELECT conv_id, CASE WHEN len(heads) = 0 THEN 0 WHEN length(rest) < 50 OR starts_with(rest, '##') THEN greatest(last - 1, 0) ELSE last END AS resume_at, ceil(len(heads) / 20)::BIGINT AS days FROM r""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to go on, and days needed at twenty slides a day."""
    heads = F.regexp_extract_all("md", F.lit(r"(?m)^## Slide ([0-9]+):"), F.lit(1))
    return _notes(spark, sf_dir).select("conv_id", text.resume_point(F.col("md")).alias("resume_at"), F.ceil(F.size(heads) / 20).alias("days"))


@query(f"""WITH {_MD} SELECT conv_id, concat('---', chr(10), 'title: conversation ', conv_id, chr(10), '---', chr(10), CASE WHEN contains(md, '## ') THEN concat(split_part(md, '## ', 1), '> exported', chr(10), '## ', substr(md, strpos(md, '## ') + 3)) ELSE md END) AS page FROM notes""")
def notion_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, and a line put before the first heading of level two."""
    at = F.instr("md", "## ")
    body = F.when(at > 0, F.concat(F.substring("md", F.lit(1), at - 1), F.lit("> exported\n## "), F.substring("md", at + 3, F.length("md")))).otherwise(F.col("md"))
    return _notes(spark, sf_dir).select("conv_id", F.concat(F.lit("---\ntitle: conversation "), F.col("conv_id").cast("string"), F.lit("\n---\n"), body).alias("page"))


@query("""SELECT conv_id, string_agg(concat('### Slide ', turn + 1, chr(10), '**Time:** ', turn * 60, 's - ', turn * 60 + 60, 's', chr(10), chr(10), '![Slide ', turn + 1, '](slides/', turn + 1, '.png)', chr(10), chr(10), text, chr(10), chr(10), '---'), chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id""")
def markdown_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental notes document of each lecture."""
    n, t = (F.col("turn") + 1).cast("string"), F.col("turn") * 60
    part = F.concat(F.lit("### Slide "), n, F.lit("\n**Time:** "), t.cast("string"), F.lit("s - "), (t + 60).cast("string"), F.lit("s\n\n![Slide "), n, F.lit("](slides/"), n, F.lit(".png)\n\n"), F.col("text"), F.lit("\n\n---"))
    return text.joined(table(spark, sf_dir, "conversations"), "turn", part, "markdown", "\n", "conv_id")


@query("""SELECT conv_id, turn, concat('Context: ', text, chr(10), 'Role: ', role, chr(10), 'Write notes.') AS prompt, text AS notes FROM conversations""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic part of model calls: the prompt, and the text used when a call fails."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit("Context: "), "text", F.lit("\nRole: "), "role", F.lit("\nWrite notes.")).alias("prompt"), F.col("text").alias("notes"))


# --- reports and documents -------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT video_id, event_id, printf('%02d:%02d', floor(t / 60)::BIGINT, floor(t)::BIGINT % 60) AS at FROM frames")
def format_mmss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("video_id", "event_id", scalars.mmss(F.col("t")).alias("at"))


@query(f"WITH {FRAMES}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t) AS index FROM frames WHERE event_type = 'purchase') SELECT video_id, string_agg(printf('%3d. %s (%.2fs)', index, printf('%02d:%02d', floor(signal / 60)::BIGINT, floor(signal)::BIGINT % 60), signal), chr(10) ORDER BY index) AS report FROM m GROUP BY video_id")
def transitions_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).where("event_type = 'purchase'").withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("t")))
    return text.joined(m, "index", F.format_string("%3d. %s (%ss)", F.col("index"), scalars.mmss(F.col("signal")), scalars.fixed(F.col("signal"), 2)), "report", "\n", "video_id")


@query(f"""WITH {FRAMES}, m AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t) AS index FROM frames WHERE event_type = 'purchase')
SELECT video_id, index, printf('ffmpeg -i "videos/%d.mp4" -ss %.2f -t %.2f -vn -acodec libmp3lame -q:a 2 "audio/%d_%03d.mp3"', video_id, signal, signal, video_id, index) AS command FROM m""")
def ffmpeg_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frames(spark, sf_dir).where("event_type = 'purchase'").withColumn("index", F.row_number().over(Window.partitionBy("video_id").orderBy("t")).cast("long"))
    at = scalars.fixed(F.col("signal"), 2)
    cmd = F.format_string('ffmpeg -i "videos/%d.mp4" -ss %s -t %s -vn -acodec libmp3lame -q:a 2 "audio/%d_%03d.mp3"', "video_id", at, at, "video_id", "index")
    return m.select("video_id", "index", cmd.alias("command"))


@query("SELECT label AS video_id, string_agg(concat('<div class=\"slide\"><img src=\"data:image/jpeg;base64,', base64(encode(concat('frame-', vec_id))), '\"><p>#', vec_id, '</p></div>'), chr(10) ORDER BY vec_id) AS html FROM embeddings GROUP BY label")
def html_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id").cast("string")
    card = F.concat(F.lit('<div class="slide"><img src="data:image/jpeg;base64,'), F.base64(F.encode(F.concat(F.lit("frame-"), i), "UTF-8")), F.lit('"><p>#'), i, F.lit("</p></div>"))
    return text.joined(table(spark, sf_dir, "embeddings"), "vec_id", card, "html", "\n", F.col("label").alias("video_id"))


@query("""SELECT label AS video_id, concat('{"video_id":', label, ',"total":', count(*), ',"transitions":[', string_agg(concat('{"index":', k, ',"vec_id":', vec_id, '}'), ',' ORDER BY k), ']}') AS document FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) GROUP BY label""")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("index", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    grouped = e.groupBy(F.col("label").alias("video_id")).agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("index", "vec_id"))).alias("transitions"))
    return grouped.select("video_id", F.to_json(F.struct("video_id", "total", "transitions")).alias("document"))


@query(f"WITH {FRAMES} SELECT printf('videos: %d, frames: %d, positives: %d', count(DISTINCT video_id), count(*), sum(label)::BIGINT) AS report FROM frames")
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).agg(F.countDistinct("video_id").alias("v"), F.count("*").alias("n"), F.sum("label").alias("p"))
    return f.select(F.format_string("videos: %d, frames: %d, positives: %d", "v", "n", "p").alias("report"))


@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def dashboard_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    joined = d.join(m, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries without a file: an anti join on the listing."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text, (doc_id % 10) / 10::DOUBLE AS confidence FROM documents),
s AS (SELECT CASE WHEN trim(text) = '' THEN 'EMPTY' WHEN confidence < 0.75 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS status FROM o) SELECT status, count(*) AS n FROM s GROUP BY status""")
def ocr_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    o = d.select(F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("text"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("confidence"))
    return rules.text_status(o, "text", "confidence").groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT label AS video_id, vec_id, unnest(embedding)::DOUBLE AS c FROM embeddings) SELECT video_id, vec_id, count(*) AS blocks, round(min(c), 6) AS lowest, round(max(c), 6) AS highest, round(avg(c), 6) AS mean FROM b GROUP BY video_id, vec_id""")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, least, greatest and mean of a nested array; zeros for an empty one."""
    b = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), "vec_id", b.alias("b"))
    mean = F.when(F.size("b") > 0, F.aggregate("b", F.lit(0.0), lambda a, x: a + x) / F.size("b")).otherwise(0.0)
    zero = F.lit(0.0)
    return e.select("video_id", "vec_id", F.size("b").cast("long").alias("blocks"), r6(F.coalesce(F.array_min("b"), zero)).alias("lowest"), r6(F.coalesce(F.array_max("b"), zero)).alias("highest"), r6(mean).alias("mean"))


@query("""WITH b AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS y FROM embeddings) SELECT vec_id, string_agg('w' || i, ' ' ORDER BY y, i) AS text FROM b GROUP BY vec_id""")
def sort_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised blocks in order of height on the page, joined."""
    e = table(spark, sf_dir, "embeddings")
    ordered = F.array_sort(F.transform("embedding", lambda y, i: F.struct(y.alias("y"), (i + 1).alias("i"))))
    return e.select("vec_id", F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("w"), x["i"].cast("string"))), " ").alias("text"))


@query("""WITH m AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey) SELECT k AS video_id, unnest(range(1, len(v) + 1)) AS index, unnest(v) AS slide FROM m""")
def map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of arrays, as result documents hold them, back to rows."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    one = o.select(F.explode(F.create_map("o_custkey", "v")).alias("video_id", "v"))
    return one.select("video_id", F.posexplode("v").alias("p", "slide")).select("video_id", (F.col("p") + 1).cast("long").alias("index"), "slide")


@query("""SELECT DISTINCT source, regexp_replace(source || '_features', '_features$', '') AS stem, printf('%03d', regexp_extract(source, '[0-9]+')::BIGINT) AS padded, upper(left(source, 1)) || substr(source, 2) || ' Notes' AS title, (('0x' || left(md5(source), 15))::BIGINT) % 10000000000 AS deck FROM documents""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, zero-padded number, title case and deck number of a name."""
    s = F.col("source")
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", F.regexp_replace(F.concat(s, F.lit("_features")), "_features$", "").alias("stem"), F.format_string("%03d", F.regexp_extract(s, "[0-9]+", 0).cast("long")).alias("padded"), scalars.title(F.concat(s, F.lit("_notes"))).alias("title"), scalars.deck_id(s).alias("deck"))


@query("""WITH p AS (SELECT doc_id // 3 AS video_id, CASE doc_id % 3 WHEN 0 THEN 'avi' WHEN 1 THEN 'mp4' ELSE 'MP3' END AS ext, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY list_position(['mp4', 'mp3', 'wav', 'avi'], lower(ext)), doc_id) AS k FROM p) SELECT video_id, concat('media/', video_id, '.', ext) AS path FROM r WHERE k = 1""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first existing file over a list of extensions."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, "avi").when(F.col("doc_id") % 3 == 1, "mp4").otherwise("MP3")
    rank = F.array_position(F.array(*map(F.lit, ("mp4", "mp3", "wav", "avi"))), F.lower("ext"))
    best = F.min(F.struct("rank", "doc_id", "ext")).alias("b")
    files = d.select(F.floor(F.col("doc_id") / 3).alias("video_id"), ext.alias("ext"), "doc_id").withColumn("rank", rank)
    return files.groupBy("video_id").agg(best).select("video_id", F.concat(F.lit("media/"), F.col("video_id").cast("string"), F.lit("."), F.col("b.ext")).alias("path"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON documents by an explicit schema, absent ones by default."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("missing", T.StringType())])
    p = F.from_json("props", schema, {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query("""WITH l AS (SELECT event_id, user_id AS video_id, CASE WHEN event_id % 10 = 0 THEN '# Total: 3' WHEN event_id % 10 = 1 THEN '' WHEN event_id % 10 = 2 THEN 'abc' WHEN event_id % 10 = 3 THEN '  12.5 ' ELSE value::VARCHAR END AS line FROM events)
SELECT video_id, event_id, try_cast(trim(line) AS DOUBLE) AS t FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND try_cast(trim(line) AS DOUBLE) IS NOT NULL""")
def ground_truth_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number per line; comments, blank lines and what is no number are skipped."""
    from ..sources.readers import parse_times

    e, m = table(spark, sf_dir, "events"), F.col("event_id") % 10
    line = F.when(m == 0, "# Total: 3").when(m == 1, "").when(m == 2, "abc").when(m == 3, "  12.5 ").otherwise(F.col("value").cast("string"))
    return parse_times(e.select(F.col("user_id").alias("video_id"), "event_id", line.alias("line")), "line").select("video_id", "event_id", "t")
