"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = [tuple(map(norm, r)) for r in df.select(*columns).collect()]
    want = [tuple(map(norm, r)) for r in expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["frame_kernels", "pair_kernels", "rounded_for_sinks", "stream_sessions", "slide_gallery"])
def test_runs_without_oracle(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_registry_has_every_oracle():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
