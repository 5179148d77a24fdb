"""Mixing sources to target weights by pivotal dependent rounding, native operations only.

A source's copy rate is target / size. Its whole part goes to every document; the
fractional parts are rounded together. Documents meet in pairs: mass (fraction times words) moves
from one to the other, in a random direction whose chances keep each document's
expected copies, until one of the two is integral. Total mass never changes, so
after all pairings one fractional document a block is left. Blocks hold about
BLOCK documents by seeded hash; their residuals meet in the next level of a reduction
tree with the same fan-in, until one residual per source is left, which is rounded to the nearer side: a
source's words differ from its target by half a document at most.

A unit is one row. Rows equal in source, doc_id and text are counted
first, with partial sums on the map side, and told apart by number, so that repeated and null ids are rounded row
by row and a hot key is one row to each task. Edge cases: null text has
size 0; null source is a source of its own, last in order; sizes of zero take nothing;
extra columns pass through apply_mix() unless they bear the name of a result
column, which replaces them; an empty table gives an empty result. Decisions depend on
rows and seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, hashable, word_count

BLOCK = 96
#: Equal rows that are told apart, or written, in one go.
STRETCH = 4096
SEED = 7_919
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, n, target) for rows (source, size, rows): water-filling of all words over the sources.

    With caps of MAX_COPIES times a source's size, the level L solves
    sum(min(cap, L * weight)) = total. Sources ordered by cap / weight: the first k
    are capped, where k is the first at which the level of the rest fits below its
    own ratio. The windows run over one row per source.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order)
    weighted = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("double")).withColumn("cap", F.col("source_size").cast("double") * MAX_COPIES)
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    up_to = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        weighted.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(ratio))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("final", F.coalesce(F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(everything)["level"], F.lit(0.0)))
    )
    return levels.select("source", "source_size", "n", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def _pivot_block(level: int, seed: int) -> str:
    """SQL of the fold over `units`, an array of struct(id, mass, size) with 0 < mass < size but for the last."""
    u = f"(shiftrightunsigned(xxhash64({seed}, {level}, source, a.cur.id, x.id, a.cur.size), 11) * {2.0**-53!r})"
    up, down = "least(a.cur.size - a.cur.mass, x.mass)", "least(a.cur.mass, x.size - x.mass)"
    return f"""
    aggregate(slice(units, 2, greatest(size(units) - 1, 0)),
      named_struct('cur', units[0], 'done', slice(transform(units, y -> named_struct('id', y.id, 'take', 0)), 1, 0)),
      (a, x) -> transform(array(named_struct('up', {up}, 'down', {down}, 'u', {u})), v -> CASE
        WHEN v.u * (v.up + v.down) < v.down AND a.cur.size - a.cur.mass <= x.mass THEN
          named_struct('cur', named_struct('id', x.id, 'mass', x.mass - v.up, 'size', x.size), 'done', array_append(a.done, named_struct('id', a.cur.id, 'take', 1)))
        WHEN v.u * (v.up + v.down) < v.down THEN
          named_struct('cur', named_struct('id', a.cur.id, 'mass', a.cur.mass + v.up, 'size', a.cur.size), 'done', array_append(a.done, named_struct('id', x.id, 'take', 0)))
        WHEN a.cur.mass <= x.size - x.mass THEN
          named_struct('cur', named_struct('id', x.id, 'mass', x.mass + v.down, 'size', x.size), 'done', array_append(a.done, named_struct('id', a.cur.id, 'take', 0)))
        ELSE
          named_struct('cur', named_struct('id', a.cur.id, 'mass', a.cur.mass - v.down, 'size', a.cur.size), 'done', array_append(a.done, named_struct('id', x.id, 'take', 1)))
        END)[0])"""


def round_fractions(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(source, id, take) for units (source, id, mass, size, n): mass is fraction times size, n the source's units."""
    found = None
    level, most = 0, units.agg(F.max("n")).first()[0] or 1
    blocks = F.ceil(F.col("n") / block).cast("long")
    rows = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), blocks)).withColumn("n", blocks)
    while True:
        # large documents first: the small ones that follow can settle them, and what is left is small
        item = F.struct((-F.col("size")).alias("s"), F.xxhash64(F.lit(seed), F.lit(level), "id").alias("h"), "id", "mass", "size")
        gathered = rows.groupBy("source", "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("units")).withColumn("units", F.expr("transform(units, y -> named_struct('id', y.id, 'mass', y.mass, 'size', y.size))"))
        folded = durable(gathered.withColumn("fold", F.expr(_pivot_block(level, seed))).select("source", "block", "n", "fold"))
        done = folded.select("source", F.explode("fold.done").alias("d")).select("source", "d.id", "d.take")
        found = done if found is None else found.unionByName(done)
        left = folded.select("source", "n", "block", "fold.cur.*")
        most = -(-most // block)
        if most <= 1:
            break
        level += 1
        rows = left.withColumn("block", F.floor(F.col("block") / block)).withColumn("n", F.ceil(F.col("n") / block).cast("long"))
    last = left.select("source", "id", (F.col("mass") * 2 >= F.col("size")).cast("int").alias("take"))
    return found.unionByName(last)


def _each(counted: DataFrame, *more: str) -> DataFrame:
    """counted (source, id, size, rows and perhaps first, the number before the first) with a row per row, told apart by its number in the id; many rows in stretches."""
    first = F.col("first") if "first" in counted.columns else F.lit(0).cast("long")
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / STRETCH)))
    number = F.explode(F.sequence(first + F.col("stretch") * STRETCH, first + F.least(F.col("rows"), (F.col("stretch") + 1) * STRETCH) - 1))
    return counted.withColumn("stretch", stretch).withColumn("number", number).select("source", F.struct("id", "number").alias("id"), "size", *more)


def _counted(rows: DataFrame) -> DataFrame:
    """(source, id, size, rows): rows counted by source and by id, which holds their other columns but size."""
    others = [c for c in rows.columns if c not in ("source", "size")]
    return durable(rows.groupBy("source", F.struct(*others).alias("id"), "size").agg(F.count("*").alias("rows")))


def _rates(counted: DataFrame) -> DataFrame:
    """(source, source_size, n, target, whole, part): the copies of each source's rows."""
    targets = source_targets(counted.select("source", (F.col("size") * F.col("rows")).alias("size"), "rows"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_COPIES)))).otherwise(F.lit(0.0))
    return durable(targets.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.floor("rate")))


def _same(a: str, b: str, *columns: str) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


def _takes(each: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """(source, id, take): the fractions of all units, rounded."""
    units = each.alias("u").join(rates.alias("r"), _same("u", "r", "source")).where((F.col("u.size") > 0) & (F.col("r.part") > 0))
    return round_fractions(units.select("u.source", "u.id", (F.col("r.part") * F.col("u.size")).alias("mass"), F.col("u.size").cast("double").alias("size"), "r.n"), seed)


def mix_copies(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, size, source_size, target, copies), a row per row of rows (source, doc_id, size and, if texts share ids, digest)."""
    counted = _counted(rows)
    rates, each = _rates(counted), _each(counted)
    taken = each.alias("d").join(_takes(each, rates, seed).alias("k"), _same("d", "k", "source", "id"), "left").select("d.*", F.coalesce("k.take", F.lit(0)).alias("take"))
    out = taken.alias("d").join(rates.alias("r"), _same("d", "r", "source"))
    return out.select("d.source", "d.id.id.doc_id", "d.size", "r.source_size", "r.target", (F.col("r.whole") + F.col("d.take")).alias("copies"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """The digest rows that mixing works on, written once so that each text is read once."""
    return durable(docs.select("source", "doc_id", word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("digest")))


def _variants(rows: DataFrame) -> DataFrame:
    """(source, id, size, rest, rows, first): rows counted, and how many of the same source and id come in front of them.

    Sums run within parts of an id's variants and then over its parts, of which there are STRETCH at most.
    """
    counted = durable(rows.groupBy("source", F.struct("doc_id", "digest").alias("id"), "size", "rest").agg(F.count("*").alias("rows")))
    own = counted.withColumn("part", F.pmod("rest", F.lit(STRETCH))).withColumn("k", F.struct("source", "id"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = own.groupBy("k", "part").agg(F.sum("rows").alias("n")).select("k", "part", before(Window.partitionBy("k").orderBy("part"), "n").alias("outer"))
    inner = own.withColumn("inner", before(Window.partitionBy("k", "part").orderBy("rest"), "rows"))
    return durable(inner.join(parts, ["k", "part"]).select("source", "id", "size", "rest", "rows", (F.col("outer") + F.col("inner")).alias("first")))


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with each row as often as mix_copies() takes it; rows equal in every column share the copies that all of them get."""
    named = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("source"), F.col("doc_id"), F.xxhash64("text").alias("digest"), F.xxhash64(*hashable(docs)).alias("rest"))
    variants = _variants(durable(docs.select(key.alias("k"), word_count(F.col("text")).alias("size")).select("k.*", "size")))
    counted = variants.groupBy("source", "id", "size").agg(F.sum("rows").alias("rows"))
    rates = _rates(counted)
    takes = _takes(_each(counted), rates, seed).where("take > 0")
    taken = _each(variants, "rest").alias("d").join(takes.alias("k"), _same("d", "k", "source", "id")).groupBy("d.source", F.col("d.id.id").alias("id"), "d.rest").agg(F.count("*").alias("take"))
    some = variants.alias("d").join(taken.alias("k"), _same("d", "k", "source", "id", "rest"), "left").join(rates.alias("r"), _same("d", "r", "source"))
    copies = some.select(F.struct("d.source", "d.id.doc_id", "d.id.digest", "d.rest").alias("k"), (F.col("r.whole") * F.col("d.rows") + F.coalesce("k.take", F.lit(0))).alias("copies")).where("copies > 0")
    # equal rows meet as one, on the map side already, and leave as often as they are taken, in stretches
    distinct = docs.select(key.alias("k"), F.struct(*named).alias("row")).groupBy("k").agg(F.first("row").alias("row"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRETCH)))
    joined = distinct.join(copies, "k").select("row", "copies", stretch.alias("stretch"))
    once_more = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(STRETCH).cast("long"), F.col("copies") - F.col("stretch") * STRETCH)))
    return joined.select("row", once_more.alias("copy")).select("row.*")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_copies(sized(documents(spark, sf_dir).select("doc_id", "source", "text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
