"""Filter interaction audit: what each of five filters removes in every order, by part of the corpus.

A relational pipeline: the words of each different text are exploded, aggregated by (text, word) and
then by text for totals and distincts; the other flags of the text join from outside; then one aggregate
by part counts the 32 combinations of failures, and all 120 orders follow from these counts alone.
Texts move once: both word aggregates and the join use the partitioning by digest of one exchange.

Filters: A under MIN_WORDS words; B distinct words under MIN_DISTINCT % of all; C upper-case A-Z over MAX_UPPER %
of code points; D holds one of SYMBOLS; E the text of a row with a smaller doc_id.

Edge cases: null text is empty and fails A alone; null and empty source are one part; a null doc_id is neither
smaller than another nor has one smaller; rows of one doc_id and text are not copies of each other; repeated rows
count each; several labels of a doc_id count as one, good or toxic where any says so; labels without a
document count nowhere; extra columns are not read; an empty table gives no rows. Digests are SHA-256.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, durable, heavy, join_salted, words

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
SYMBOLS = "#$%&*|"
#: All sets of filters, as bits: A is 1, E is 16.
SETS = 1 << len(LETTERS)
KINDS = ("n", "good", "toxic")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(digest, text) of docs (text): a row per digest; said to be never null, so that a join adds no filter and both its sides share one exchange."""
    return docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").where(F.col("digest").isNotNull()).dropDuplicates(["digest"])


def word_stats(texts: DataFrame) -> DataFrame:
    """(digest, n_words, n_distinct) of texts (digest, text), a row per digest; texts without words are missing."""
    each = texts.select("digest", F.explode(words(F.col("text"))).alias("word"))
    return each.groupBy("digest", "word").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << LETTERS.index(letter))).otherwise(F.lit(0))


def text_masks(texts: DataFrame) -> DataFrame:
    """(digest, mask) of texts (digest, text), a row per digest: the bits of A to D that the text fails."""
    t = F.col("text")
    others = texts.select("digest", (_bit((F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) * 100 > F.length(t) * MAX_UPPER, "C") + _bit(t.rlike(f"[{SYMBOLS}]"), "D")).alias("mask"))
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    of_words = _bit(n < MIN_WORDS, "A") + _bit(distinct * 100 < n * MIN_DISTINCT, "B")
    return others.join(word_stats(texts), "digest", "left").select("digest", (F.col("mask") + of_words).alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (doc_id, ...) with good and toxic; rows are distinct, so heavy ids can be salted."""
    any_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    named = rows.where(F.col("doc_id").isNotNull())
    hot = heavy(named.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    found = join_salted(named, judged, "doc_id", hot, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return found.unionByName(rows.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays of the numbers of docs (doc_id, text, source) whose failures are exactly each of the 32 sets."""
    base = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = durable(base.groupBy("doc_id", "part", "digest").agg(F.count("*").alias("n")))
    nulls = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    groups = durable(_labelled(rows, labels).groupBy("digest", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), nulls.alias("n_null")))
    firsts = groups.groupBy("digest").agg(F.min("least").alias("first"))
    flags = text_masks(distinct_texts(base)).join(firsts, "digest")
    joined = join_salted(groups, flags, "digest", heavy(groups.groupBy("digest").agg(F.count("*").alias("n")), "digest"))
    passing = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    copies = F.lit(1 << LETTERS.index("E"))
    split = joined.select("part", "good", "toxic", "mask", "n", passing.alias("passing")).select(
        "part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("x")
    )
    weight = {"n": F.col("x.n"), "good": F.col("x.n") * F.col("good"), "toxic": F.col("x.n") * F.col("toxic")}
    sums = [F.sum(F.when(F.col("x.mask") == k, w).otherwise(0)).alias(f"{c}{k}") for c, w in weight.items() for k in range(SETS)]
    return split.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{c}{k}" for k in range(SETS)]).alias(c) for c in weight])


def _passing(counts: str) -> Column:
    """For each set of filters the number of documents that fail none of it."""
    every = F.sequence(F.lit(0), F.lit(SETS - 1))
    return F.transform(every, lambda s: F.aggregate(every, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(s) == 0, F.get(F.col(counts), m)).otherwise(0)))


def _shapley(letter: str) -> Column:
    """What the filter removes, summed over all orders: each set in front of it stands in |S|! (4 - |S|)! of them."""
    bit, most = 1 << LETTERS.index(letter), len(LETTERS) - 1
    sets = [s for s in range(SETS) if not s & bit]
    return sum(((F.get("p_n", F.lit(s)) - F.get("p_n", F.lit(s | bit))) * (factorial(s.bit_count()) * factorial(most - s.bit_count())) for s in sets), F.lit(0).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the numbers of documents of that step."""
    passing = failure_counts(docs, labels).withColumns({f"p_{c}": _passing(c) for c in KINDS})
    known = passing.withColumn("shapley", F.array(*map(_shapley, LETTERS)))
    orders = F.split(F.lit(" ".join(map("".join, permutations(LETTERS)))), " ")
    each = known.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    before = sum((_bit(F.instr("filter_order", x) < F.col("step"), x) for x in LETTERS), F.lit(0))
    stepped = each.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1))).withColumn("at", F.instr(F.lit(LETTERS), F.col("filter")) - 1).withColumn("bit", F.expr("shiftleft(1, at)")).withColumn("before", before)
    lost = lambda c: F.get(f"p_{c}", F.col("before")) - F.get(f"p_{c}", F.col("before") + F.col("bit"))
    failing = F.get("p_n", F.lit(0)) - F.get("p_n", F.col("bit"))
    return stepped.select(
        "part",
        "filter_order",
        "step",
        F.get("p_n", F.col("before") + F.col("bit")).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("at")).alias("shapley"),
        "filter",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
judged AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
words AS (SELECT t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, first FROM firsts),
masks AS (SELECT t, first, (len(w) < {MIN_WORDS})::INT AS a, (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::INT AS b,
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_UPPER} * length(t))::INT AS c, regexp_matches(t, '[{SYMBOLS}]')::INT AS d FROM words),
flags AS (SELECT part, a, b, c, d, coalesce(doc_id > first, FALSE)::INT AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM texts JOIN masks USING (t) LEFT JOIN judged USING (doc_id)),
counts AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, k::INT AS step, filter_order[k] AS filter, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, range(1, 6) r(k)),
told AS (SELECT part, filter_order, step, filter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM told
"""
