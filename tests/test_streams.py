"""Streams whose events come out of order, and a sink that is killed in the middle of its work."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ledger, ordered

EVENTS = "video_id long, at timestamp, value double"
DAY = dt.datetime(2024, 1, 1)


def events(spark, folder, files):
    """A stream that takes a file in each micro-batch, in the order given; times are seconds."""
    for k, rows in enumerate(files):
        made = [(v, None if t is None else DAY + dt.timedelta(seconds=t), x) for v, t, x in rows]
        spark.createDataFrame(made, EVENTS).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/in")


def seconds(df, *columns):
    base = F.lit(DAY.replace(tzinfo=dt.timezone.utc).timestamp())
    return df.select("video_id", *[(F.col(c) - base).alias(c) for c in columns], *[c for c in df.columns if c not in ("video_id", *columns)])


ROWS = [(1, 0.0, 1.0), (1, 7.0, None), (1, 12.0, 5.0), (1, 13.5, 2.0), (1, 30.0, 3.0), (1, 30.0, 4.0), (2, 5.0, 1.0), (2, 40.0, None), (2, 55.0, 9.0), (1, 61.0, 0.0), (3, 1000.0, 0.0)]


@pytest.mark.parametrize("order", [range(11), [4, 2, 0, 6, 1, 3, 8, 5, 7, 9, 10], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 10]])
def test_order_of_arrival_does_not_count(spark, tmp_path, order):
    # within the allowed lateness, so nothing is left out; the last event lets the others go
    files = [[ROWS[i] for i in order[k : k + 3]] for k in range(0, 11, 3)]
    stream = events(spark, tmp_path, [*files[:-1], [*files[-1], (7, None, 1.0)]])
    kept = ordered.run_ordered(ordered.spaced_in_order(stream, 10.0, "100 seconds"), f"{tmp_path}/a", f"{tmp_path}/as")
    assert sorted(map(tuple, seconds(kept, "t").collect())) == [(1, 0.0), (1, 12.0), (1, 30.0), (1, 61.0), (2, 5.0), (2, 40.0), (2, 55.0)]
    runs = ordered.run_ordered(ordered.sessions_in_order(stream, 10.0, "100 seconds"), f"{tmp_path}/b", f"{tmp_path}/bs")
    assert sorted(map(tuple, seconds(runs, "start", "end").collect()), key=lambda r: r[:2]) == [(1, 0.0, 13.5, 4, 5.0), (1, 30.0, 30.0, 2, 4.0), (2, 5.0, 5.0, 1, 1.0), (2, 40.0, 40.0, 1, None)]


def test_state_outlives_the_run(spark, tmp_path):
    stream = events(spark, tmp_path, [[(1, 0.0, 1.0), (2, 300.0, 1.0)]])
    plan = ordered.spaced_in_order(stream, 10.0, "100 seconds")
    assert seconds(ordered.run_ordered(plan, f"{tmp_path}/a", f"{tmp_path}/s"), "t").collect() == [(1, 0.0)]
    events(spark, tmp_path / "more", [[(1, 250.0, 1.0), (1, 245.0, 1.0), (2, 900.0, 1.0)]])
    (tmp_path / "more/in/0").rename(tmp_path / "in/1")
    got = seconds(ordered.run_ordered(plan, f"{tmp_path}/a", f"{tmp_path}/s"), "t").collect()
    assert sorted(map(tuple, got)) == [(1, 0.0), (1, 245.0), (2, 300.0)]


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["stage", "enter"])
@pytest.mark.parametrize("late", [False, True])
def test_ledger_after_a_kill(spark, tmp_path, monkeypatch, where, late):
    stream = events(spark, tmp_path, [[(k, float(k), 1.0), (k, float(k), 1.0)] for k in range(3)])
    work, attempts = getattr(ledger.Ledger, where), []

    def killed(self, batch, batch_id):
        attempts.append(batch_id)
        if late:
            work(self, batch, batch_id)
        if attempts == [0, 1]:
            raise Killed
        if not late:
            work(self, batch, batch_id)

    monkeypatch.setattr(ledger.Ledger, where, killed)
    with pytest.raises(Exception, match="Killed"):
        ledger.run_resumable(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    done = 2 if where == "enter" and late else 1
    assert ledger.Ledger(spark, f"{tmp_path}/out").read(stream.schema).count() == 2 * done
    out = ledger.run_resumable(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    # which of the files a micro-batch takes is the source's choice: ids, not batches, are compared
    assert sorted(r.video_id for r in out.collect()) == [0, 0, 1, 1, 2, 2] and out.schema == stream.schema
    assert attempts == ([0, 1, 2] if done == 2 else [0, 1, 1, 2])
    again = ledger.run_resumable(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert again.count() == 6 and ledger.Ledger(spark, f"{tmp_path}/out").entries().count() == 3


def test_ledger_without_batches(spark, tmp_path):
    schema = spark.createDataFrame([], EVENTS).schema
    assert ledger.Ledger(spark, f"{tmp_path}/out").read(schema).count() == 0
