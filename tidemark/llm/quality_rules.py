"""Quality rules: a threshold table compiled into one Spark projection.

Each rule names a measure (a length, symbol, stop-word or line ratio), the range it
must lie in and the number of words from which it applies. compile_rules() turns the
table into columns; no user function runs and no row moves, so the plan is a scan
with one projection per let-bound layer and no exchange.

Edge cases: null text counts as no words and fails the base rule; an empty text does
too; white space of any length between words changes nothing; repeated rows get equal
verdicts; further columns pass through unless they bear the name of a result column,
which then replaces them; an empty table gives an empty result. Texts of any length
are measured whole (arrays of a text's words live in one row's memory).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, let, words

# Frequent function words of English, French, German and Spanish; words equal to one of them count.
STOP_WORDS = (
    "the of and to in a is that it for was on with as be by this are at from "
    "de la le et les en des un du que une est pour qui dans au par sur pas "
    "der die und den von zu das mit sich des für im auf ist nicht dem eine ein "
    "el y los se del las por con no una su para es al lo"
).split()
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Rule:
    """measure must lie in [low, high] on documents of min_words or more."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("mean_word_length", 2.5, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("punctuation_share", None, 0.25),
    Rule("stop_word_share", 0.01, None, 100),
    Rule("dup_line_share", None, 0.3),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5


def _repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    Window hashes are compared first: as many distinct hashes as windows proves that no
    window repeats. Only otherwise are hashes sorted and neighbours matched: as longs
    of the upper 44 hash bits over the start where that is exact (up to 2**20 windows and no
    two hashes that differ in the lower bits alone), else as (hash, start) pairs.
    """
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    low = F.lit((1 << 20) - 1).cast("long")

    def covered(at: Column) -> Column:
        # each start adds its window up to the next start
        return F.aggregate(at, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"])

    def matched(s: Column, hash_of, start_of) -> Column:
        same = lambda x, k: F.coalesce(hash_of(F.get(s, k)) == hash_of(x), F.lit(False))
        at = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), start_of(x)))
        return let(F.sort_array(F.filter(at, lambda i: i.isNotNull())), covered)

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: matched(s, lambda x: x["h"], lambda x: x["i"]))

    def by_longs(h: Column) -> Column:
        top, start = (lambda x: F.shiftright(x, 20)), (lambda x: x.bitwiseAND(low).cast("int"))
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~((1 << 20) - 1)).cast("long")).bitwiseOR(i.cast("long"))))
        tops = F.size(F.array_distinct(F.transform(h, top)))
        exact = (F.size(h) <= (1 << 20)) & (tops == F.size(F.array_distinct(h)))
        return F.when(exact, let(keys, lambda s: matched(s, top, start))).otherwise(by_pairs(h))

    return F.when(n < WINDOW, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(by_longs(h)))).cast("long")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The verdict of the table as one boolean column over the measures."""
    ok = F.lit(True)
    for r in rules:
        m, inside = F.col(r.measure), F.lit(True)
        if r.low is not None:
            inside = inside & (m >= r.low)
        if r.high is not None:
            inside = inside & (m <= r.high)
        ok = ok & (inside | (F.col("n_words") < r.min_words))
    return ok


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and ratios that rules speak of."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: (F.length(t) - F.length(F.regexp_replace(t, "[" + re.sub(r"(\W)", r"\\\1", chars) + "]+", ""))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    stop = lambda w: w.isin(STOP_WORDS)
    begins = lambda x: F.ltrim(x).rlike(r"^[-*•]")
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, stop)).cast("long").alias("n_stop_words"),
    )
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, begins)).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(x, lambda y: F.rtrim(y).endswith("..."))).cast("long").alias("n_ellipsis_lines"),
    )
    w, x = fresh(docs, "_w"), fresh(docs, "_l")
    counted = docs.withColumns({w: let(words(F.col(text)), of_words), x: let(lines, of_lines), "n_symbols": without(SYMBOLS), "n_punctuation": without(PUNCTUATION)})
    flat = counted.withColumns({c: F.col(f"{w}.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")} | {c: F.col(f"{x}.{c}") for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}).drop(w, x)
    return flat.withColumns(
        {
            "mean_word_length": _share(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": _share(F.col("n_symbols"), F.col("n_words")),
            "punctuation_share": _share(F.col("n_punctuation"), F.col("word_chars")),
            "stop_word_share": _share(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_share": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "bullet_line_share": _share(F.col("n_bullet_lines"), F.col("n_lines")),
            "ellipsis_line_share": _share(F.col("n_ellipsis_lines"), F.col("n_lines")),
        }
    )


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with all measures, base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return measure(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns as they were.

    The verdict goes through a generator of one row, past which no filter is pushed: a filter on the
    measures themselves would be evaluated below them, each measure once more for every rule that reads it.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    judged = apply_rules(held, rules).select("_row", F.explode(F.array("kept")).alias("kept"))
    return judged.where("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_punctuation", "base_failed", "kept")


def _sql_rules() -> str:
    parts = []
    for r in RULES:
        inside = [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
        parts.append(f"(({' AND '.join(inside)}) OR n_words < {r.min_words})")
    return " AND ".join(parts)


_GAP_SQL = "[^\\x20\\x09-\\x0D]+"
_quoted = "'" + PUNCTUATION.replace("'", "''") + "'"
_stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: Up to "measured": doc_id and all measures of `documents`; then the verdict. The pipeline reuses it.
MEASURED_SQL = f"""
tokens AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_GAP_SQL}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_GAP_SQL}')) AS l FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM tokens WHERE len(w) >= {WINDOW}),
texts AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM grams),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM texts),
steps AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step FROM twice WHERE n > 1),
repeated AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id),
counts AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    (length(t) - length(translate(t, {_quoted}, '')))::BIGINT AS n_punctuation,
    len(list_filter(w, lambda x: x IN ({_stops})))::BIGINT AS n_stop_words,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(l, lambda x: rtrim(x) LIKE '%...'))::BIGINT AS n_ellipsis_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM tokens t LEFT JOIN repeated r ON t.doc_id IS NOT DISTINCT FROM r.doc_id),
measured AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
    CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols_per_word,
    CASE WHEN word_chars > 0 THEN n_punctuation::DOUBLE / word_chars ELSE 0 END AS punctuation_share,
    CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stop_word_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
    CASE WHEN n_lines > 0 THEN n_bullet_lines::DOUBLE / n_lines ELSE 0 END AS bullet_line_share,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines::DOUBLE / n_lines ELSE 0 END AS ellipsis_line_share,
    (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM counts)
"""
ORACLE_SQL = f"""
WITH {MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_punctuation, base_failed,
    (NOT base_failed AND {_sql_rules()}) AS kept FROM measured
"""
