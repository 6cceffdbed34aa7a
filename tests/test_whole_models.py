"""Registered models take all features, the full grids and held-out rows."""

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketframe.operators import ml
from marketframe.plans import ml_queries


def test_models_run_whole(spark, monkeypatch):
    seen, searched = [], []
    fit, search, ridge = ml._fit, ml.search, ml.ridge_search

    def watched_ridge(df, columns, penalties, folds=5):
        searched.append((list(columns), list(penalties), folds))
        return ridge(df, columns, penalties, folds)

    monkeypatch.setattr(ml, "ridge_search", watched_ridge)

    def watched_fit(df, columns, name, task, classes=2, **params):
        seen.append((list(columns), name, params))
        return fit(df, columns, name, task, classes, **params)

    def watched_search(df, columns, name, task, grid=None, folds=5, draws=None):
        assert (grid, folds, draws) == (None, 5, None)
        assert df.agg(F.max("ts")).first()[0] < test.agg(F.min("ts")).first()[0]
        return search(df, columns, name, task)

    train, test, columns = ml_queries._dataset(spark, SMALL)
    assert len(columns) > 20 and train.count() > 0
    monkeypatch.setattr(ml, "_fit", watched_fit)
    monkeypatch.setattr(ml, "search", watched_search)
    predicted = entry.queries()["l11_l12_grid_search"](spark, SMALL)
    assert predicted.select("asset_id", "ts").exceptAll(test.select(F.col("symbol").alias("asset_id"), "ts")).count() == 0
    assert predicted.count() == test.count() > 0
    # every fold and penalty comes from one scan, only the chosen model is fitted
    assert searched == [(columns, ml.GRIDS["ridge"]["regParam"], 5)]
    assert len(seen) == 1 and seen[0][0] == columns and seen[0][2]["regParam"] in ml.GRIDS["ridge"]["regParam"]
    for name in ("random_forest", "gradient_boosting"):
        seen.clear()
        entry.queries()[f"l08_l10_l13_{name}_classification"](spark, SMALL)
        assert seen == [(columns, name, {})]


def test_balanced_training_weighs_classes_alike(spark, monkeypatch):
    df = spark.createDataFrame([(float(n), float(n < 50)) for n in range(1000)] + [(1.0, None)], "x double, target double")
    weights = {(r.target, r.weight and round(r.weight, 6)) for r in ml.balanced_weights(df).select("target", "weight").distinct().collect()}
    assert weights == {(0.0, round(1000 / 1900, 6)), (1.0, 10.0), (None, None)}
    assert ml.estimator("logistic_regression", "classification", weights=True).getWeightCol() == "weight"
    assert not ml.estimator("random_forest", "classification").isDefined("weightCol")
    seen = []
    monkeypatch.setattr(ml, "_fit", lambda rows, columns, name, task, classes, **params: seen.append((rows.columns, params)))
    for balanced in (True, False):
        ml.train(df, ["x"], "logistic_regression", "classification", balanced=balanced)
    assert seen == [(["target", "x", "weight"], {"weights": True}), (["x", "target"], {})]
