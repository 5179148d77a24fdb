"""Boosting by histograms against a plain one over rows, and its sampling, order and edge cases."""

import math

import numpy as np
import pytest

from tidemark.operators import boosting
from tidemark.operators.boosting import Settings

EDGES = [[-1.0, -0.5, 0.0, 0.25, 1.0], [2.0, 4.0, 6.0], []]
NAMES = ["a", "b c", "d.e"]


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n).round(2), rng.integers(0, 9, n).astype(float), np.ones(n)], 1)
    x[rng.random(n) < 0.1, 0] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=1.0) + x[:, 1] / 4 + rng.normal(size=n) / 2) > 1.5).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, *(None if i % 2 and math.isnan(v) else float(v) for v in r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, `b c` double, `d.e` double, label int")


def plain(x, y, s):
    """Probabilities of boosting that looks at every row and cut, recursively."""
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    shrink = lambda g: math.copysign(max(abs(g) - s.alpha, 0.0), g)
    score = lambda i: shrink(g[i].sum()) ** 2 / (h[i].sum() + s.ridge)
    margin = np.zeros(len(y))
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * w, p * (1 - p) * w
        add = np.zeros(len(y))

        def build(rows, depth):
            best = None
            for f, edges in enumerate(EDGES) if depth < s.depth else ():
                for e in [*edges, math.inf]:
                    for with_lost in (True, False):
                        lost = np.isnan(x[rows, f])
                        left = np.where(lost, with_lost, x[rows, f] <= e)
                        a, b = rows[left], rows[~left]
                        if min(h[a].sum(), h[b].sum()) >= s.least_weight:
                            gain = score(a) + score(b) - score(rows)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = gain, a, b
            if best:
                left, right = build(best[1], depth + 1), build(best[2], depth + 1)
                if best[0] >= s.gamma or len(left) > 1 or len(right) > 1:
                    return left + right
            return [rows]

        for leaf in build(np.arange(len(y)), 0):
            add[leaf] = -s.rate * shrink(g[leaf].sum()) / (h[leaf].sum() + s.ridge)
        margin += add
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("shape", [Settings(trees=3, depth=3, rows=1.0, columns=1.0), Settings(trees=2, depth=2, rows=1.0, columns=1.0, gamma=12.0, alpha=2.0, ridge=5.0, least_weight=9.0, rate=0.5)])
def test_equals_plain_boosting(spark, shape):
    x, y = data()
    df = frame(spark, x, y)
    model = boosting.fit(df, NAMES, settings=shape, edges=EDGES)
    got = {r.id: r.probability for r in boosting.predict(model, df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], plain(x, y, shape), atol=1e-5)


def test_same_model_for_any_order_and_after_saving(spark, tmp_path):
    x, y = data()
    df = frame(spark, x, y)
    shape = Settings(trees=12, depth=2, bins=8)  # past the point where margins are written
    one = boosting.fit(df, NAMES, settings=shape, edges=EDGES, key=["id"])
    two = boosting.fit(df.orderBy("label", "b c").repartition(7), NAMES, settings=shape, edges=EDGES, key=["id"])
    assert one == two
    one.save(spark, f"{tmp_path}/m")
    assert boosting.Boosted.load(spark, f"{tmp_path}/m") == one
    scored = boosting.predict(one, df, 0.5).collect()
    assert np.mean([r.prediction == r.label for r in scored]) > 0.8
    ranked = boosting.importances(spark, one).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and math.isclose(sum(r.importance for r in ranked), 1.0) and ranked[2].importance == 0.0


def test_columns_and_rows_are_sampled(spark):
    x, y = data()
    model = boosting.fit(frame(spark, x, y), NAMES, settings=Settings(trees=4, depth=1, rows=0.5, columns=0.4), edges=EDGES)
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in model.trees)
    assert len({t.gain[1] for t in model.trees}) > 1


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0, 0], [None, 0]])
def test_no_rows_or_one_label(spark, labels):
    df = spark.createDataFrame([(float(i), None, math.nan, t) for i, t in enumerate(labels)], "a double, `b c` double, `d.e` double, label int")
    model = boosting.fit(df, NAMES, settings=Settings(trees=2, depth=2, rows=1.0))
    assert all(f < 0 for t in model.trees for f in t.feature)
    assert boosting.predict(model, df).where("probability between 0 and 1").count() == len(labels)


def test_a_level_is_one_job(spark):
    x, y = data()
    df = frame(spark, x, y).cache()
    spark.sparkContext.setJobGroup("levels", "jobs of a fit")
    try:
        model = boosting.fit(df, NAMES, settings=Settings(trees=6, depth=4), edges=EDGES, key=["id"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    levels = sum(t.depth() for t in model.trees)
    assert levels == 24 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("levels")) <= levels + 10


def test_same_model_however_it_is_dealt(spark, monkeypatch):
    """Margins written after every third tree, many small tasks, sums added up in tasks."""
    x, y = data()
    df, shape = frame(spark, x, y), Settings(trees=8, depth=3)
    one = boosting.fit(df, NAMES, settings=shape, edges=EDGES, key=["id"])
    for name, value in {"PENDING": 3, "TASK_ROWS": 40, "FEW_TASKS": 2}.items():
        monkeypatch.setattr(boosting, name, value)
    many = boosting.fit(df.repartition(7), NAMES, settings=shape, edges=EDGES, key=["id"])
    assert [t.feature for t in one.trees] == [t.feature for t in many.trees] and [t.cut for t in one.trees] == [t.cut for t in many.trees]
    assert np.allclose([t.value for t in one.trees], [t.value for t in many.trees], atol=1e-6)
