"""Exact percentiles against numpy, on skewed and repeated values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_percentiles


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles_by_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    groups = {"hot": np.round(rng.lognormal(0, 4, 3000), 2), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([7.5]), "two": np.array([-1e300, 1e300]), None: rng.normal(size=40)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "kind string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(r.kind, r.share): (r.n, r.percentile) for r in exact_percentiles(df, ["kind"], "v", shares, accuracy).collect()}
    assert set(got) == {(k, s) for k in groups for s in shares}
    for (k, s), (n, p) in got.items():
        assert n == len(groups[k]) and np.isclose(p, np.quantile(groups[k], s), rtol=1e-12, atol=0)
    whole = exact_percentiles(df, [], "v", [0.5], accuracy).first()
    assert np.isclose(whole.percentile, np.median([v for _, v in rows if v is not None]), rtol=1e-12)


def test_percentiles_of_nothing(spark):
    assert exact_percentiles(spark.createDataFrame([], "kind string, v double"), ["kind"], "v", [0.5]).count() == 0


def test_only_the_ranges_are_sorted(spark):
    df = spark.range(100_000).select(F.lit("a").alias("kind"), F.hash("id").cast("double").alias("v"))
    plan = exact_percentiles(df, ["kind"], "v", [0.5])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
    values = sorted(r.v for r in df.collect())
    assert plan.first().percentile == (values[49_999] + values[50_000]) / 2
