"""The boosted queries fit the published model, once for all three."""

from dataclasses import astuple, replace

from tidemark.operators import boosting
from tidemark.plans import catalogue, models

SF = "/root/testdata/sf0.001"


def test_boosted_queries_share_one_published_model(spark, monkeypatch):
    whole, asked = boosting.fit, []

    def short(train, features, **given):
        asked.append(given.get("settings") or boosting.Settings())
        return whole(train, features, **given | {"settings": replace(asked[-1], trees=3)})

    models._fitted.cache_clear()
    monkeypatch.setattr(boosting, "fit", short)
    scored = catalogue.QUERIES["gbt_predict"](spark, SF)
    assert scored.where("prediction = cast(probability >= 0.5 as int)").count() == scored.count() > 0
    assert catalogue.QUERIES["gbt_metrics"](spark, SF).count() > 0
    assert [r["rank"] for r in catalogue.QUERIES["gbt_importances"](spark, SF).collect()] == [1, 2, 3, 4, 5]
    assert [astuple(s) for s in asked] == [(200, 6, 0.1, 0.8, 0.8, 3.0, 0.1, 0.1, 1.0, 64, 42)]
    models._fitted.cache_clear()
