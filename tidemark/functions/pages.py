"""Whole documents as text columns: final notes, reports, galleries, an index, commands for both shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import fixed
from .text import first_heading, joined


def _text(c: Column) -> Column:
    return c.cast("string")


def final_notes(slides: DataFrame, lectures: DataFrame, part: str = "video_id") -> DataFrame:
    """(entity, document): a lecture's notes with summary, contents and anchored slides.

    slides has (entity, slide, start, end, image, notes), lectures (entity, title, language, summary, generated).
    """
    n, at, end = _text(F.col("slide")), F.col("start"), F.col("end")
    entry = F.concat(n, F.lit(". ["), first_heading(F.col("notes")), F.lit("](#slide-"), n, F.lit(") (⏱️ "), fixed(at, 0), F.lit("s)"))
    # The marks and headings of the notes format, which readers of such files look for.
    body = F.concat(
        F.lit("<a id='slide-"), n, F.lit("'></a>\n\n### Slide "), n,
        F.format_string("\n**Time:** %ss - %ss\n**Duration:** %ss\n\n", fixed(at, 1), fixed(end, 1), fixed(end - at, 1)),
        F.lit("![Slide "), n, F.lit("]("), F.col("image"), F.lit(")\n\n"), F.col("notes"), F.lit("\n\n---\n"),
    )
    rows = slides.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("slide", entry.alias("entry"), body.alias("body")))).alias("_s"))
    lines = lambda name: F.array_join(F.transform("_s", lambda x: x[name]), "\n")
    document = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("title"), F.lit("\n")),
        F.concat(F.lit("**Generated:** "), F.col("generated")),
        F.concat(F.lit("**Source Language:** "), F.upper("language")),
        F.lit("**Notes Language:** English"),
        F.concat(F.lit("**Total Slides:** "), _text(F.size("_s"))),
        F.lit("\n---\n"),
        F.lit("## 📋 Executive Summary\n"),
        F.col("summary"),
        F.lit("\n---\n"),
        F.lit("## 📑 Table of Contents\n"),
        lines("entry"),
        F.lit("\n---\n"),
        lines("body"),
        F.lit("\n## 📝 Generation Details\n"),
        F.concat(F.lit("- **Project:** "), _text(F.col(part))),
    )
    return rows.join(lectures, part).select(part, document.alias("document"))


def comparison_report(frame_counts: DataFrame, event_counts: DataFrame, tolerance: float) -> DataFrame:
    """One row, report: frame-level and event-level counts and ratios as text.

    frame_counts has one row (tp, fp, fn, tn), event_counts a row per entity (tp, fp, fn).
    """
    f = frame_counts.select(*[F.col(c).alias(f"f_{c}") for c in ("tp", "fp", "fn", "tn")])
    e = event_counts.agg(F.count("*").alias("videos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    percent = lambda name, r: F.format_string(f"  {name:<10} %s (%s%%)", fixed(r, 4), fixed(r * 100, 2))
    tp, fp, fn, tn = (F.col(f"f_{c}") for c in ("tp", "fp", "fn", "tn"))
    etp, efp, efn = F.col("tp"), F.col("fp"), F.col("fn")
    line = F.lit("=" * 70)
    report = F.concat_ws(
        "\n",
        F.lit("COMPARISON ANALYSIS REPORT"),
        line,
        F.lit("1. FRAMES"),
        F.format_string("Total Frames Analyzed: %,d", tp + fp + fn + tn),
        F.format_string("Manual Positives: %,d", tp + fn),
        F.format_string("Predicted Positives: %,d", tp + fp),
        F.format_string("  TN: %,d\n  FP: %,d\n  FN: %,d\n  TP: %,d", tn, fp, fn, tp),
        percent("Accuracy:", ratio(tp + tn, tp + fp + fn + tn)),
        percent("Precision:", ratio(tp, tp + fp)),
        percent("Recall:", ratio(tp, tp + fn)),
        F.format_string("  F1 Score:  %s", fixed(ratio(2 * tp, 2 * tp + fp + fn), 4)),
        line,
        F.lit("2. EVENTS"),
        F.lit(f"Matching Tolerance: ±{tolerance:g}s"),
        F.format_string("Total Videos: %d\nManual Transitions: %d\nPredicted Transitions: %d", "videos", etp + efn, etp + efp),
        F.format_string("  TP: %d (correctly detected)\n  FP: %d (false alarms)\n  FN: %d (missed transitions)", etp, efp, efn),
        percent("Precision:", ratio(etp, etp + efp)),
        percent("Recall:", ratio(etp, etp + efn)),
        F.format_string("  F1 Score:  %s", fixed(ratio(2 * etp, 2 * etp + efp + efn), 4)),
        line,
    )
    # both sides are one row
    return f.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k").select(report.alias("report"))


def escaped(c: Column) -> Column:
    """Text made safe for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def gallery_pages(slides: DataFrame, per_page: int, part: str = "video_id") -> DataFrame:
    """(entity, page, html): pages of at most per_page cards, so that a long recording is several bounded rows.

    slides has (entity, index, caption, picture, kind); index counts from 1, picture is an encoded image, kind its media type.
    """
    image = F.concat(F.lit('<img src="data:'), F.col("kind"), F.lit(";base64,"), F.base64("picture"), F.lit('" alt="'), escaped(F.col("caption")), F.lit('">'))
    card = F.concat(F.lit('<figure id="slide-'), _text(F.col("index")), F.lit('">'), image, F.lit("<figcaption>#"), _text(F.col("index")), F.lit(" "), escaped(F.col("caption")), F.lit("</figcaption></figure>"))
    pages = joined(slides.withColumn("page", F.floor((F.col("index") - 1) / per_page) + 1), "index", card, "cards", "\n", part, "page")
    head = F.concat(F.lit("<!DOCTYPE html>\n<html><head><title>"), _text(F.col(part)), F.lit(" - "), _text(F.col("page")), F.lit("</title></head><body>\n"))
    return pages.select(part, "page", F.concat(head, F.col("cards"), F.lit("\n</body></html>")).alias("html"))


def index_page(videos: DataFrame, per_page: int, part: str = "video_id") -> DataFrame:
    """(page, html): cards that link each entity's gallery, with its counts; videos has (entity, position, slides, blanks)."""
    name = _text(F.col(part))
    card = F.concat(F.lit('<div class="video-card"><a href="'), name, F.lit('/gallery.html">'), escaped(name), F.lit("</a><span>"), _text(F.col("slides")), F.lit(" slides, "), _text(F.col("blanks")), F.lit(" blank</span></div>"))
    pages = joined(videos.withColumn("page", F.floor((F.col("position") - 1) / per_page) + 1), "position", card, "cards", "\n", "page")
    return pages.select("page", F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), F.col("cards"), F.lit("\n</body></html>")).alias("html"))


def dashboard(totals: DataFrame, title: str) -> DataFrame:
    """One row, html: a card per column of totals (one row), named after it."""
    cards = [F.concat(F.lit(f'<div class="metric-card"><b>{c}</b> '), _text(F.col(c)), F.lit("</div>")) for c in totals.columns]
    return totals.select(F.concat(F.lit(f"<!DOCTYPE html>\n<html><body><h1>{title}</h1>\n"), F.concat_ws("\n", *cards), F.lit("\n</body></html>")).alias("html"))


def posix_quoted(c: Column) -> Column:
    """A word for a POSIX shell, whatever characters it has."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def windows_quoted(c: Column) -> Column:
    """A word for a Windows batch file: backslashes between folders, quotes dropped (no path has them), percent signs doubled."""
    plain = F.replace(F.replace(c, F.lit("/"), F.lit("\\")), F.lit('"'), F.lit(""))
    return F.concat(F.lit('"'), F.replace(plain, F.lit("%"), F.lit("%%")), F.lit('"'))


def audio_command(video: Column, start: Column, end: Column, audio: Column, quoted=posix_quoted) -> Column:
    """The command that cuts [start, end] out of a video's sound."""
    # Fixed value: the arguments of the encoder.
    return F.concat(F.lit("ffmpeg -i "), quoted(video), F.format_string(" -ss %s -t %s -vn -acodec libmp3lame -q:a 2 ", fixed(start, 2), fixed(end - start, 2)), quoted(audio))


def cleaning_prompt(seen: Column, heard: Column, language: Column) -> Column:
    """What a model is asked to repair recognised text: the whole text, the whole speech of its interval, the language."""
    return F.concat(F.lit("Repair this recognised slide text; change nothing that is right and add nothing.\n\n[slide text]\n"), seen, F.lit("\n\n[speech]\n"), heard, F.lit("\n\n[speech language] "), language, F.lit("\n\nAnswer with the repaired text, in English, line by line.\n"))


def notes_prompt(slide: Column, seen: Column, heard: Column, language: Column, start: Column, end: Column) -> Column:
    """What a model is asked to write a slide's notes from: number, repaired text, speech, language and times."""
    head = F.concat(F.lit("Write lecture notes in English from this slide and its speech alone.\n\n[slide] "), _text(slide), F.format_string("\n[time] %ss - %ss\n[speech language] ", fixed(start, 1), fixed(end, 1)), language)
    return F.concat(head, F.lit("\n\n[slide text]\n"), seen, F.lit("\n\n[speech]\n"), heard, F.lit("\n\nBegin with a ## heading; use bullets for ideas and numbers for steps; mark what is called important or examined; write formulas as LaTeX.\n"))
