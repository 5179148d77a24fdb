"""Source divergence audit: how far the sources of a language differ in their smoothed term shares.

Plain relational: matches of TERM are exploded and counted by (lang, source, term); terms in at least MIN_DOCS
documents of a language are kept; the groups of the language meet the kept terms, so that terms a group
lacks count zero; a self-join on (lang, term) gives the differences of all pairs of groups, which are summed and
ranked. Shares are whole numbers of SCALE parts, p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), in exact arithmetic.

Joins on the language alone have few keys: they are dealt over SALTS hashes of the other side's rows. Documents
count once per term by the distinct terms of their array, so no (document, term) row is shuffled and
the counts combine before the exchange.

Edge cases: null text, lang and source are ''; texts without terms make their group occur; a language
without kept terms gives all pairs with value 0; repeated rows count as documents each; extra columns are not
read; an empty table gives no rows. Only A-Z are lower-cased.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, documents, durable, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of the term in the group and its documents with it.

    A text's matches are the pieces between runs of other characters; all of them are exploded, and the distinct ones once more.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    terms = docs.select("lang", "source", F.split(lower, BETWEEN).alias("terms"))
    both = F.array(F.struct(F.lit(0).alias("first"), F.col("terms")), F.struct(F.lit(1).alias("first"), F.array_distinct("terms").alias("terms")))
    each = terms.select("lang", "source", F.explode(both).alias("x")).select("lang", "source", "x.first", F.explode("x.terms").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("first") == 0).alias("n"), F.count_if(F.col("first") == 1).alias("docs"))


def _on_lang(many: DataFrame, few: DataFrame, key: Column) -> DataFrame:
    """many.join(few, "lang"), the rows of many dealt over SALTS tasks a language by a hash of key."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "_salt"]).drop("_salt")


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) without rounding on the way."""
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0))) div cast({total} + {SMOOTH} * {kept} as decimal(20, 0)) as long)")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(w).alias("rank"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources, part 'term' the source's own terms."""
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(term_counts(plain), "term-counts")
    kept = durable(counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    found = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = durable(plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v", "total_lang"]))

    dense = _on_lang(kept.select("lang", "term"), groups.select("lang", "source", "total", "v"), F.col("term"))
    filled = dense.join(found.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    shares = stored(filled.select("lang", "term", "source", _share("n", "total", "v").alias("p")), "shares")
    a, b = shares.alias("a"), shares.alias("b")
    same = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source"))
    sums = a.join(b, same).groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("low"), F.col("b.source").alias("high")).agg(F.sum(F.abs(F.col("a.p") - F.col("b.p"))).alias("value"))
    named = groups.select("lang", "source")
    pairs = _on_lang(named, named.select("lang", F.col("source").alias("item")), F.col("source")).where("source <> item")
    valued = pairs.withColumns({"low": F.least("source", "item"), "high": F.greatest("source", "item")}).join(sums, ["lang", "low", "high"], "left").na.fill(0, ["value"])

    own = found.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total", "v").alias("p"), _share("n_lang", "total_lang", "v").alias("q"))
    marked = own.where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    return _ranked(valued, "pair").unionByName(_ranked(marked, "term").where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n, any_value(n_lang) AS n_lang FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM found GROUP BY lang, source),
pools AS (SELECT DISTINCT lang, source FROM docs),
shares AS (SELECT p.lang, p.source, k.term, 1 + ({SCALE}::HUGEINT * (coalesce(f.n, 0) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * s.v) AS p,
    1 + ({SCALE}::HUGEINT * (k.n_lang + {SMOOTH})) // (s.total_lang + {SMOOTH} * s.v) AS q, coalesce(f.n, 0) AS n
    FROM pools p JOIN kept k ON k.lang = p.lang JOIN sizes s ON s.lang = p.lang LEFT JOIN totals t ON t.lang = p.lang AND t.source = p.source
    LEFT JOIN found f ON f.lang = p.lang AND f.source = p.source AND f.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM pools a JOIN pools b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= {TOP}
"""
