"""Text derivations as DataFrame operations: markdown blocks, cards, contents, resume points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BR = "\n"


def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no, line): stripped lines, numbered from 1."""
    return df.select(*keys, F.posexplode(F.split(text, BR)).alias("p", "l")).select(*keys, (F.col("p") + 1).cast("long").alias("line_no"), F.btrim("l", F.lit(" \t\r")).alias("line"))


def block_kind(line: Column) -> Column:
    """Class of a stripped line; null where it makes no block (blank lines, fences)."""
    return (
        F.when((line == "") | line.startswith("```"), F.lit(None))
        .when(line.startswith("# "), "h1")
        .when(line.startswith("## "), "h2")
        .when(line.startswith("### "), "h3")
        .when(line.startswith("- ") | line.startswith("* "), "bullet")
        .when(line.rlike(r"^[0-9]+\. "), "number")
        .when(line.startswith("!["), "image")
        .when(line == "---", "rule")
        .otherwise("paragraph")
    )


def markdown_blocks(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no, kind, content) of a markdown column; content is the line without its mark, an image's path."""
    lines = lines_of(df, text, *keys).withColumn("kind", block_kind(F.col("line"))).where(F.col("kind").isNotNull())
    content = F.when(F.col("kind") == "image", F.regexp_extract("line", r"!\[.*?\]\((.*?)\)", 1)).otherwise(F.regexp_replace("line", r"^(#{1,3} |[-*] |[0-9]+\. )", ""))
    return lines.select(*keys, "line_no", "kind", content.alias("content"))


def flashcards(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, card, question, answer, slide): headings of level 3 and 4 ask, the lines after them answer.

    Cards without an answer are dropped; slide is the last `## Slide` heading before the card is
    closed, "Unknown" without one.
    """
    line = F.col("line")
    w = Window.partitionBy(*keys).orderBy("line_no")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    asks = line.startswith("### ") | line.startswith("#### ")
    marked = lines_of(df, text, *keys).withColumns({"asks": asks, "here": F.coalesce(F.last(F.when(line.startswith("## Slide "), F.substring(line, 4, 1_000_000)), ignorenulls=True).over(running), F.lit("Unknown")), "card": F.sum(asks.cast("long")).over(running)}).where("card > 0")
    said = (line != "") & ~line.startswith("#") & ~line.startswith("---")
    cards = marked.groupBy(*keys, "card").agg(
        F.max(F.when(F.col("asks"), F.btrim(F.replace(line, F.lit("###"), F.lit(""))))).alias("question"),
        F.sort_array(F.collect_list(F.when(said, F.struct("line_no", "line")))).alias("said"),
        F.max(F.struct("line_no", "here")).alias("end"),
    )
    return cards.where(F.size("said") > 0).select(*keys, "card", "question", F.array_join(F.transform("said", lambda x: x["line"]), BR).alias("answer"), F.col("end.here").alias("slide"))


def first_heading(notes: Column) -> Column:
    """First line of a note without heading marks."""
    return F.replace(F.replace(F.get(F.split(notes, BR), F.lit(0)), F.lit("## "), F.lit("")), F.lit("#"), F.lit(""))


def joined(df: DataFrame, order: str, value: Column, out: str, separator: str, *keys: str) -> DataFrame:
    """value of each group's rows in order, joined."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), separator).alias(out))


def resume_point(text: Column, least: int = 50) -> Column:
    """The last slide (`## Slide N:` heading) with at least `least` characters after it; the one before if it has fewer."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^## Slide ([0-9]+):"), F.lit(1))
    number = F.element_at(heads, -1)
    last, zero = number.cast("long"), F.lit(0).cast("long")
    rest = F.btrim(F.element_at(F.split(text, F.concat(F.lit("## Slide "), number, F.lit(":"))), -1), F.lit(" \n\t"))
    short = (F.length(rest) < least) | rest.startswith("##")
    return F.when(F.size(heads) == 0, zero).when(short, F.greatest(last - 1, zero)).otherwise(last)
