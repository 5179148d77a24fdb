"""Queries over frames and slide sequences: kernels, similarity, sequential dedup, quality rules.

The 64 numbers of an embedding, scaled to 0-255, stand for an 8 x 8 gray frame; frames of a
label in order of vec_id stand for a recording's slides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, scalars
from ..operators import rules, sequential
from ..session import table
from .registry import query, r6

SIDE = 8


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, vec_id, vector, px): px holds the frame's pixels by row."""
    pixel = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.6) * 200).cast("int")))
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("video_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.transform("embedding", pixel).alias("px"))


_PX = """px AS (SELECT label AS video_id, vec_id, i, i % 8 AS x, i // 8 AS y, least(255, greatest(0, floor((e::DOUBLE + 0.6) * 200)))::INT AS v
    FROM (SELECT label, vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
SLIDE_SEQUENCE = _SEQ = "s AS (SELECT label AS video_id, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)"


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _share(a: Column, test) -> Column:
    return F.size(F.filter(a, test)) / F.size(a)


def _prev(c: str) -> Column:
    return F.lag(c).over(Window.partitionBy("video_id").orderBy("vec_id"))


# --- kernels with an SQL form --------------------------------------------------------------


@query(f"""WITH {_PX}, o AS (SELECT video_id, vec_id, lag(vec_id) OVER (PARTITION BY video_id ORDER BY vec_id) AS before FROM (SELECT DISTINCT video_id, vec_id FROM px))
SELECT o.video_id, o.vec_id, round(avg((a.v - b.v) * (a.v - b.v)), 6) AS mse FROM o JOIN px a ON a.vec_id = o.vec_id JOIN px b ON b.vec_id = o.before AND a.i = b.i GROUP BY o.video_id, o.vec_id""")
def frame_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = slides(spark, sf_dir).withColumn("before", _prev("px")).where(F.col("before").isNotNull())
    return pairs.select("video_id", "vec_id", r6(_mean(F.zip_with("px", "before", lambda a, b: ((a - b) * (a - b)).cast("double")))).alias("mse"))


@query(f"WITH {_PX} SELECT video_id, vec_id, round(avg(CASE WHEN v < 50 THEN 1 ELSE 0 END), 6) AS black, round(avg(CASE WHEN v BETWEEN 100 AND 140 THEN 1 ELSE 0 END), 6) AS mid, round(least(1, avg(CASE WHEN v < 50 THEN 1 ELSE 0 END) + avg(CASE WHEN v BETWEEN 100 AND 140 THEN 1 ELSE 0 END)), 6) AS presence FROM px GROUP BY video_id, vec_id")
def pixel_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark share, share of a tone range, and their clipped sum."""
    black, mid = _share(F.col("px"), lambda v: v < 50), _share(F.col("px"), lambda v: v.between(100, 140))
    return slides(spark, sf_dir).select("video_id", "vec_id", r6(black).alias("black"), r6(mid).alias("mid"), r6(scalars.clip(black + mid, 0.0, 1.0)).alias("presence"))


_ZONE = "CASE WHEN x < 2 THEN 'left' WHEN x < 4 THEN 'center' ELSE 'right' END"


@query(f"WITH {_PX} SELECT video_id, vec_id, {_ZONE} AS zone, round(avg(v), 6) AS mean, round(avg(CASE WHEN v >= 128 THEN 1 ELSE 0 END), 6) AS density, round(avg(CASE WHEN v >= 128 THEN 1 ELSE 0 END) FILTER (y >= 6), 6) AS bottom_density FROM px GROUP BY ALL")
def zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vertical zones (width // 3 columns, the last takes the rest), whole height and lowest fifth."""
    px = F.col("px")
    part = lambda lo, hi, top: F.filter(px, lambda v, i: (i % SIDE >= lo) & (i % SIDE < hi) & (F.floor(i / SIDE) >= top))
    rows = [F.struct(F.lit(n).alias("zone"), part(lo, hi, 0).alias("a"), part(lo, hi, 6).alias("b")) for n, lo, hi in (("left", 0, 2), ("center", 2, 4), ("right", 4, 8))]
    each = slides(spark, sf_dir).select("video_id", "vec_id", F.inline(F.array(*rows)))
    return each.select("video_id", "vec_id", "zone", r6(_mean(F.col("a"))).alias("mean"), r6(_share(F.col("a"), lambda v: v >= 128)).alias("density"), r6(_share(F.col("b"), lambda v: v >= 128)).alias("bottom_density"))


_LAPLACE = _PX + """, lap AS (SELECT a.video_id, a.vec_id, a.i, a.v, l.v + r.v + u.v + d.v - 4 * a.v AS z FROM px a
JOIN px l ON l.vec_id = a.vec_id AND l.y = a.y AND l.x = abs(a.x - 1) JOIN px r ON r.vec_id = a.vec_id AND r.y = a.y AND r.x = 7 - abs(7 - (a.x + 1))
JOIN px u ON u.vec_id = a.vec_id AND u.x = a.x AND u.y = abs(a.y - 1) JOIN px d ON d.vec_id = a.vec_id AND d.x = a.x AND d.y = 7 - abs(7 - (a.y + 1)))"""


def _laplacian(px: Column) -> Column:
    """Sum of the four neighbours less four times the pixel, borders mirrored, by position in px."""

    def at(i: Column, v: Column) -> Column:
        x, y = i % SIDE, F.floor(i / SIDE).cast("int")
        mirror = lambda k: (SIDE - 1) - F.abs((SIDE - 1) - F.abs(k))
        get = lambda a, b: F.get(px, mirror(b) * SIDE + mirror(a))
        return (get(x - 1, y) + get(x + 1, y) + get(x, y - 1) + get(x, y + 1) - 4 * v).cast("double")

    return F.transform(px, lambda v, i: at(i, v))


def _variance(a: str) -> Column:
    """Population variance of an array column of whole numbers."""
    return _mean(F.transform(F.col(a), lambda v: v * v)) - _mean(F.col(a)) * _mean(F.col(a))


def _measured(df: DataFrame) -> DataFrame:
    """df with sharpness (Laplacian variance), brightness, contrast and teacher (dark share in percent)."""
    laid = df.withColumn("lap", _laplacian(F.col("px"))).withColumn("pd", F.col("px").cast("array<double>"))
    return laid.select("video_id", "vec_id", r6(_variance("lap")).alias("sharpness"), r6(_mean(F.col("px"))).alias("brightness"), r6(F.sqrt(_variance("pd"))).alias("contrast"), r6(100 * _share(F.col("px"), lambda v: v < 70)).alias("teacher"))


_MEASURED = f"WITH {_LAPLACE}, m AS (SELECT video_id, vec_id, round(avg(z * z) - avg(z) * avg(z), 6) AS sharpness, round(avg(v), 6) AS brightness, round(sqrt(avg(v * v) - avg(v) * avg(v)), 6) AS contrast, round(100 * (avg(CASE WHEN v < 70 THEN 1 ELSE 0 END)), 6) AS teacher FROM lap GROUP BY video_id, vec_id)"


@query(f"{_MEASURED} SELECT video_id, vec_id, sharpness AS variance, round(least(sharpness / 200, 1), 6) AS sharpness FROM m")
def sharpness_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(slides(spark, sf_dir)).select("video_id", "vec_id", F.col("sharpness").alias("variance"), r6(F.least(F.col("sharpness") / 200, F.lit(1.0))).alias("sharpness"))


@query(f"{_MEASURED} SELECT video_id, vec_id, brightness, contrast FROM m")
def brightness_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(slides(spark, sf_dir)).select("video_id", "vec_id", "brightness", "contrast")


_EDGES = _PX + """, edge AS (SELECT a.*, CASE WHEN a.x > 0 AND abs(a.v - b.v) >= 40 THEN 1 ELSE 0 END AS e FROM px a LEFT JOIN px b ON a.vec_id = b.vec_id AND b.i = a.i - 1),
cell AS (SELECT video_id, vec_id, x // 2 AS cx, y // 2 AS cy, avg(e) AS d FROM edge WHERE x < 6 AND y < 6 GROUP BY ALL),
dist AS (SELECT video_id, vec_id, CASE WHEN avg(d) = 0 THEN 0.5 ELSE greatest(1 - (stddev_pop(d) / (avg(d) + 1e-6)) / 2, 0.3) END AS distribution FROM cell GROUP BY ALL),
share AS (SELECT video_id, vec_id, sum(e)::BIGINT AS edge_count, avg(e) AS edge_share FROM edge GROUP BY ALL)"""


def _edges(df: DataFrame) -> DataFrame:
    """df with e (0/1 horizontal edges by position), edge_count, edge_share and distribution over a 3 x 3 grid."""
    px = F.col("px")
    e = F.transform(px, lambda v, i: F.when((i % SIDE > 0) & (F.abs(v - F.get(px, i - 1)) >= 40), 1).otherwise(0))
    cell = lambda cx, cy: _mean(F.filter("e", lambda v, i: (F.floor(i % SIDE / 2) == cx) & (F.floor(F.floor(i / SIDE) / 2) == cy)).cast("array<double>"))
    cells = df.withColumn("e", e).withColumn("cells", F.array(*[cell(x, y) for y in range(3) for x in range(3)]))
    mean = _mean(F.col("cells"))
    spread = F.sqrt(_mean(F.transform("cells", lambda d: (d - F.col("cell_mean")) * (d - F.col("cell_mean")))))
    return cells.withColumn("cell_mean", mean).withColumns({"distribution": F.when(F.col("cell_mean") == 0, F.lit(0.5)).otherwise(F.greatest(1 - spread / (F.col("cell_mean") + 1e-6) / 2, F.lit(0.3))), "edge_count": _sum(F.col("e")).cast("long"), "edge_share": _mean(F.col("e"))})


@query(f"WITH {_EDGES} SELECT video_id, vec_id, edge_count, round(edge_share, 6) AS edge_share, round(distribution, 5) AS distribution FROM share JOIN dist USING (video_id, vec_id)")
def edge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(slides(spark, sf_dir)).select("video_id", "vec_id", "edge_count", r6("edge_share").alias("edge_share"), F.round("distribution", 5).alias("distribution"))


@query(f"WITH {_EDGES} SELECT video_id, vec_id, round(coalesce(edge_share - lag(edge_share) OVER w, 0), 6) AS signed, round(coalesce(abs(edge_share - lag(edge_share) OVER w), 0), 6) AS absolute, edge_share < 0.4 AS is_blank FROM share WINDOW w AS (PARTITION BY video_id ORDER BY vec_id)")
def edge_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the edge share, signed and absolute, and the blank flag (share under a threshold)."""
    e = _edges(slides(spark, sf_dir)).select("video_id", "vec_id", "edge_share")
    change = F.col("edge_share") - _prev("edge_share")
    return e.select("video_id", "vec_id", r6(F.coalesce(change, F.lit(0.0))).alias("signed"), r6(F.coalesce(F.abs(change), F.lit(0.0))).alias("absolute"), (F.col("edge_share") < 0.4).alias("is_blank"))


_SCORED = f"""WITH {_EDGES}, base AS (SELECT video_id, vec_id, avg(CASE WHEN v >= 110 THEN 1 ELSE 0 END) AS board, avg(v) AS mean, avg(CASE WHEN v < 50 THEN 1 ELSE 0 END) AS teacher FROM px GROUP BY ALL),
pos AS (SELECT video_id, vec_id, CASE WHEN n = 1 THEN 1.0 ELSE k / (n - 1) END AS proximity FROM (SELECT video_id, vec_id, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM base)),
q AS (SELECT *, pow(board * edge_share * distribution, 1 / 3) AS content, CASE WHEN mean BETWEEN 80 AND 150 THEN 1 WHEN mean < 80 THEN greatest(mean / 80, 0.3) ELSE greatest((255 - mean) / 105, 0.3) END AS bright FROM base JOIN share USING (video_id, vec_id) JOIN dist USING (video_id, vec_id) JOIN pos USING (video_id, vec_id))"""


@query(f"{_SCORED} SELECT video_id, vec_id, round(content, 5) AS content, round(content * bright, 5) AS quality, round(content * bright / (1 + 5 * teacher) * (1 + 0.15 * proximity), 5) AS final FROM q")
def slide_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content (cube root of board, edges, evenness), times brightness, penalty and proximity."""
    w = Window.partitionBy("video_id")
    k, n = F.row_number().over(w.orderBy("vec_id")) - 1, F.count("*").over(w)
    df = _edges(slides(spark, sf_dir)).withColumns({"k": k.cast("double"), "n": n.cast("double")})
    content = scalars.cube_root(_share(F.col("px"), lambda v: v >= 110) * F.col("edge_share") * F.col("distribution"))
    quality = F.col("content") * scalars.brightness_quality(_mean(F.col("px")))
    near = scalars.proximity(F.col("k"), F.lit(0.0), F.col("n") - 1)
    final = F.col("quality") * scalars.teacher_penalty(_share(F.col("px"), lambda v: v < 50)) * (1 + 0.15 * near)
    out = df.withColumn("content", content).withColumn("quality", quality).withColumn("final", final)
    return out.select("video_id", "vec_id", *[F.round(c, 5).alias(c) for c in ("content", "quality", "final")])


# --- kernels without one: tested against plain loops ----------------------------------------


def _colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three channels: the pixels, and two fixed rearrangements of them."""
    mixed = F.flatten(F.transform("px", lambda v, i: F.array(v, F.get(F.col("px"), i * 7 % 64), F.get(F.col("px"), i * 13 % 64))))
    return slides(spark, sf_dir).withColumn("bgr", mixed).withColumn("before", _prev("bgr"))



def _one(kernel, column: str = "bgr") -> Column:
    return kernels.frame_udf(kernel)(F.col(column), F.lit(SIDE), F.lit(SIDE))


def _two(kernel, missing: float) -> Column:
    return kernels.pair_udf(kernel, missing)(F.col("bgr"), F.col("before"), F.lit(SIDE), F.lit(SIDE))


@query()
def frame_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-frame kernels: dark, skin, teacher, board, edges, sharpness, brightness, contrast."""
    found = {
        "black": kernels.black_ratio,
        "skin_offline": kernels.skin_ratio,
        "skin_online": lambda f: kernels.skin_ratio(f, kernels.SKIN_ONLINE),
        "teacher": kernels.teacher_presence,
        "board": kernels.board_visibility,
        "canny": lambda f: kernels.canny(kernels.gray(f)).mean(),
        "sharpness": kernels.sharpness,
        "brightness": kernels.brightness,
        "contrast": kernels.contrast,
        "edge_evenness": lambda f: kernels.edge_score(f)[1],
        "binary_share": lambda f: (kernels.adaptive_binary(f) > 0).mean(),
    }
    return _colour(spark, sf_dir).select("video_id", "vec_id", *[_one(k).alias(n) for n, k in found.items()])


@query()
def pair_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels of a frame and the one before: SSIM in three forms, MSE, histogram correlation, zones."""
    found = {
        "ssim": (lambda a, b: kernels.ssim(kernels.gray(a), kernels.gray(b)), 0.0),
        "board_ssim": (kernels.board_ssim, 1.0),
        "small_ssim": (kernels.smaller_ssim, 0.0),
        "mse": (kernels.mse, 0.0),
        "histogram": (kernels.histogram_correlation, 0.0),
        "gray_histogram": (lambda a, b: kernels.histogram_correlation(a, b, colour=False), 1.0),
        "left_density": (lambda a, b: kernels.zones(a, b, bottom_only=False)[0][1], 0.0),
    }
    return _colour(spark, sf_dir).select("video_id", "vec_id", *[_two(k, m).alias(n) for n, (k, m) in found.items()])


# --- similarity ----------------------------------------------------------------------------

_SIM = f"WITH {_SEQ}, sim AS (SELECT b.video_id, b.k - 1 AS slide_from, b.k AS slide_to, list_cosine_similarity(a.e, b.e) AS similarity FROM s a JOIN s b ON a.video_id = b.video_id AND b.k = a.k + 1)"


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each slide with the one before."""
    w = Window.partitionBy("video_id").orderBy("vec_id")
    df = slides(spark, sf_dir).withColumn("before", _prev("vector")).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("before").isNotNull())
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y))
    cosine = dot("vector", "before") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("before", "before")))
    return df.select("video_id", (F.col("k") - 1).alias("slide_from"), F.col("k").alias("slide_to"), cosine.alias("similarity"))


@query(f"{_SIM} SELECT video_id, slide_from, slide_to, round(similarity, 6) AS similarity FROM sim")
def consecutive_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).withColumn("similarity", r6("similarity"))


@query(f"{_SIM} SELECT video_id, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median, round(stddev_pop(similarity), 6) AS deviation, round(avg(CASE WHEN similarity >= 0.15 THEN 1 ELSE 0 END), 6) AS high_share, round(avg(CASE WHEN similarity >= 0.1 THEN 1 ELSE 0 END), 6) AS medium_share FROM sim GROUP BY video_id")
def similarity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.distribution(_similar(spark, sf_dir), "similarity", 0.15, 0.1)


@query(f"""{_SIM}, d AS (SELECT video_id, avg(CASE WHEN similarity >= 0.1 THEN 1 ELSE 0 END) AS h FROM sim GROUP BY video_id)
SELECT video_id, CASE WHEN h > 0.30 THEN 'INCREMENTAL_WRITING' WHEN h > 0.15 THEN 'MIXED' ELSE 'DISCRETE_SLIDES' END AS video_type, CASE WHEN h > 0.30 THEN 0.80 WHEN h > 0.15 THEN 0.85 ELSE 0.92 END::DOUBLE AS threshold FROM d""")
def video_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.video_type(rules.distribution(_similar(spark, sf_dir), "similarity", 0.1, 0.05, digits=None))


_LEVELS = [0.05, 0.1, 0.15, 0.2, 0.25]


@query(f"""{_SIM} SELECT video_id, threshold, count(*) FILTER (similarity >= threshold) AS duplicates, count(*) + 1 AS total, count(*) + 1 - count(*) FILTER (similarity >= threshold) AS final, round(100.0 * count(*) FILTER (similarity >= threshold) / (count(*) + 1), 6) AS reduction_percent
FROM sim, (SELECT unnest({_LEVELS})::DOUBLE AS threshold) GROUP BY video_id, threshold""")
def impact_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.impact(_similar(spark, sf_dir), "similarity", _LEVELS)


@query(f"{_SIM} SELECT video_id, slide_from, slide_to, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY similarity DESC, slide_from) <= 5")
def sample_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar pairs per entity: the limit is the report's."""
    w = Window.partitionBy("video_id").orderBy(F.desc("similarity"), "slide_from")
    rows = _similar(spark, sf_dir).where("similarity >= 0.1").withColumn("r", F.row_number().over(w)).where("r <= 5")
    return rows.select("video_id", "slide_from", "slide_to", r6("similarity").alias("similarity"))


# --- sequential deduplication ----------------------------------------------------------------


@query(f"""WITH RECURSIVE {_SEQ}, w AS (SELECT video_id, k, vec_id, e AS le, vec_id AS lid, TRUE AS kept, 0::DOUBLE AS sim FROM s WHERE k = 1 UNION ALL
SELECT video_id, k, vec_id, CASE WHEN ok THEN ne ELSE le END, CASE WHEN ok THEN vec_id ELSE lid END, ok, c FROM (SELECT *, c < CASE WHEN vec_id - lid < 12 THEN 0.25 ELSE 0.15 END AS ok
FROM (SELECT w.video_id, s.k, s.vec_id, s.e AS ne, w.le, w.lid, list_cosine_similarity(w.le, s.e) AS c FROM w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1)))
SELECT video_id, vec_id, round(sim, 6) AS similarity FROM w WHERE kept""")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequential.keep_first(slides(spark, sf_dir), 0.15, 0.25, 12, "vec_id", "vector")
    return found.select("video_id", "vec_id", r6("similarity").alias("similarity"))


@query(f"""WITH RECURSIVE {_SEQ}, w AS (SELECT video_id, k, [vec_id] AS ids, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE e END AS le FROM s WHERE k = 1 UNION ALL
SELECT w.video_id, s.k, CASE WHEN s.vec_id % 11 <> 0 AND w.le IS NOT NULL AND list_cosine_similarity(w.le, s.e) >= 0.1 THEN list_append(w.ids[:len(w.ids) - 1], s.vec_id) ELSE list_append(w.ids, s.vec_id) END,
CASE WHEN s.vec_id % 11 = 0 THEN w.le ELSE s.e END FROM w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1),
z AS (SELECT video_id, ids, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) AS r FROM w),
o AS (SELECT video_id, unnest(ids) AS vec_id, generate_subscripts(ids, 1) AS index FROM z WHERE r = 1)
SELECT video_id, vec_id, coalesce(lag(vec_id) OVER (PARTITION BY video_id ORDER BY index), 0) AS audio_start, index FROM o""")
def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh slide lacks its image: it stays and is never compared with."""
    with_gaps = slides(spark, sf_dir).withColumn("vector", F.when(F.col("vec_id") % 11 != 0, F.col("vector")))
    return sequential.keep_latest(with_gaps, 0.1, "vec_id", "vector")


@query(f"""WITH RECURSIVE {_SEQ}, p AS (SELECT s.*, (vec_id * 37 % 100)::DOUBLE AS pen FROM s),
w AS (SELECT video_id, k, [vec_id] AS ids, [0::BIGINT] AS starts, [vec_id] AS ends, e AS le, pen AS lp FROM p WHERE k = 1 UNION ALL
SELECT video_id, nk, CASE WHEN NOT dup THEN list_append(ids, nid) WHEN npen < lp THEN list_append(ids[:len(ids) - 1], nid) ELSE ids END, CASE WHEN NOT dup THEN list_append(starts, ends[len(ends)]) ELSE starts END, CASE WHEN NOT dup THEN list_append(ends, nid) ELSE ends END,
CASE WHEN NOT dup OR npen < lp THEN ne ELSE le END, CASE WHEN NOT dup OR npen < lp THEN npen ELSE lp END
FROM (SELECT w.*, p.k AS nk, p.vec_id AS nid, p.e AS ne, p.pen AS npen, list_cosine_similarity(w.le, p.e) >= 0.1 AS dup FROM w JOIN p ON p.video_id = w.video_id AND p.k = w.k + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k DESC) AS r FROM w)
SELECT video_id, unnest(ids) AS vec_id, unnest(starts) AS audio_start, unnest(ends) AS audio_end FROM z WHERE r = 1""")
def dedup_keep_cleaner(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalised = slides(spark, sf_dir).withColumn("penalty", (F.col("vec_id") * 37 % 100).cast("double"))
    return sequential.keep_cleaner(penalised, 0.1, "vec_id", "vector", "penalty")


_CURATED = f"""WITH RECURSIVE {_SEQ}, w AS (SELECT video_id, k, vec_id, e AS le, TRUE AS keep FROM s WHERE k = 1 UNION ALL
SELECT w.video_id, s.k, s.vec_id, CASE WHEN list_cosine_similarity(w.le, s.e) >= 0.1 THEN w.le ELSE s.e END, list_cosine_similarity(w.le, s.e) < 0.1 FROM w JOIN s ON s.video_id = w.video_id AND s.k = w.k + 1)"""


@query(f"{_CURATED} SELECT video_id, vec_id, keep FROM w")
def dedup_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.curate(slides(spark, sf_dir), 0.1, "vec_id", "vector")


@query(f"{_CURATED} SELECT video_id, vec_id, row_number() OVER (PARTITION BY video_id ORDER BY vec_id) AS index, original_count FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS original_count FROM w) WHERE keep")
def curation_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept slides renumbered, with the count before curation."""
    w = Window.partitionBy("video_id")
    flagged = sequential.curate(slides(spark, sf_dir), 0.1, "vec_id", "vector").withColumn("original_count", F.count("*").over(w))
    return flagged.where("keep").select("video_id", "vec_id", F.row_number().over(w.orderBy("vec_id")).cast("long").alias("index"), "original_count")


# --- quality rules ---------------------------------------------------------------------------

_QUALITY = f"""{_MEASURED}, q AS (SELECT *, 100 - CASE WHEN sharpness < 9000 THEN 30 ELSE 0 END - CASE WHEN brightness < 118 OR brightness > 124 THEN 20 ELSE 0 END - CASE WHEN teacher > 3 THEN 25 ELSE 0 END - CASE WHEN contrast < 25 THEN 15 ELSE 0 END AS score,
list_filter([CASE WHEN sharpness < 9000 THEN 'blurry' END, CASE WHEN brightness < 118 THEN 'too dark' WHEN brightness > 124 THEN 'too bright' END, CASE WHEN teacher > 3 THEN 'teacher blocking' END, CASE WHEN contrast < 25 THEN 'low contrast' END], lambda x: x IS NOT NULL) AS issues FROM m),
c AS (SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'ACCEPTABLE' ELSE 'POOR' END AS class FROM q)"""
#: Thresholds moved to where the 8 x 8 frames have their spread.
_LIMITS = rules.QualityLimits(sharpness=9000, dark=118, bright=124, teacher=3, contrast=25)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_measured(slides(spark, sf_dir)), _LIMITS)


@query(f"{_QUALITY} SELECT video_id, vec_id, score, class, issues FROM c")
def quality_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("video_id", "vec_id", "score", "class", "issues")


@query(f"{_QUALITY} SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c GROUP BY class")
def quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.histogram(_classified(spark, sf_dir), "class")


@query(f"{_QUALITY} SELECT video_id, vec_id, score, issues FROM c WHERE score < 70")
def flagged_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).where("score < 70").select("video_id", "vec_id", "score", "issues")


@query(f"WITH {_EDGES} SELECT video_id, count(*) AS total, count(*) FILTER (edge_share < 0.4) AS blank, count(*) FILTER (edge_share >= 0.4) AS content FROM share GROUP BY video_id")
def blank_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(slides(spark, sf_dir)).select("video_id", "edge_share")
    return e.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("edge_share") < 0.4).alias("blank"), F.count_if(F.col("edge_share") >= 0.4).alias("content"))
