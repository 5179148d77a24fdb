"""Printed decimals come from the exact binary value, as SQL's printf has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pages, scalars
from tidemark.plans import catalogue

HALVES = [1704096628.715, 1705282822.955, 1705813425.25, 0.125, 0.375, 2.5, 0.5, 0.05, 1.005, -0.125, -0.001, 0.0]


@pytest.mark.parametrize("digits", [0, 1, 2, 4])
def test_fixed_prints_like_printf(spark, digits):
    got = [r.s for r in spark.createDataFrame([(x,) for x in HALVES], "x double").select(scalars.fixed(F.col("x"), digits).alias("s")).collect()]
    assert got == [duckdb.sql(f"SELECT printf('%.{digits}f', {x!r}::DOUBLE)").fetchall()[0][0] for x in HALVES] == [f"{x:.{digits}f}" for x in HALVES]


def test_audio_command_cuts_at_the_time_printf_gives(spark):
    at = lambda x: F.lit(x)
    made = pages.audio_command(F.lit("a"), at(1704096628.715), at(1704120810.325), F.lit("b"))
    assert spark.range(1).select(made.alias("c")).first().c == "ffmpeg -i 'a' -ss 1704096628.71 -t 24181.61 -vn -acodec libmp3lame -q:a 2 'b'"


def test_note_chain_prints_times_like_its_sql(spark, tmp_path):
    """A peak at .25 s: printed .2, not .3."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS event_id, make_timestamp(1705813425250000 + i * 7200000000) AS ts, 1 AS user_id, 'view' AS event_type, 150.0 + i AS value FROM range(3) t(i)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(catalogue.ORACLES["note_chain"]).fetchall()
    got = catalogue.QUERIES["note_chain"](spark, str(tmp_path)).select("video_id", "slide", "start", "end", "capture", "note").collect()
    assert len(want) == 3 and sorted(map(tuple, got)) == sorted(want)
