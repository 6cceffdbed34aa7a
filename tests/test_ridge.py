"""The closed-form ridge search against fitting every fold and penalty."""

import numpy as np
import pytest

from marketframe.operators import ml


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, 100]
    y = x @ [0.5, -0.2, 8.0, 0.01] + rng.normal(size=n) * 0.3
    rows = []
    for i in range(n):
        values = [float(v) for v in x[i]]
        if i % 9 == 0:
            values[1] = None
        rows.append((float(i), *values, 7.0, float(y[i])))
    df = spark.createDataFrame(rows, "i double, a double, b double, c double, d double, k double, target double")
    return df.selectExpr("*", "timestamp_seconds(cast(i * 60 as long)) as ts").drop("i")


def test_solution_equals_spark_ml(spark, data):
    columns = ["a", "b", "c", "k"]
    gram = ml.gram_matrices(data.selectExpr("*", "0 as fold"), columns)[0]
    median = data.filter("b is not null").approxQuantile("b", [0.5], 0.001)[0]
    for penalty in (0.0, 0.1, 1.0, 10.0):
        model = ml.train(data, ["a", "b", "c"], "ridge", "regression", regParam=penalty)
        w, b = ml.solve_ridge(gram, np.array([0.0, median, 0.0, 0.0]), penalty)
        assert w[3] == 0.0
        got = model.transform(data).select("a", "b", "c", "prediction").collect()
        want = [b + w[0] * r.a + w[1] * (median if r.b is None else r.b) + w[2] * r.c for r in got]
        np.testing.assert_allclose([r.prediction for r in got], want, rtol=1e-6, atol=1e-6)


def test_search_equals_fitting_all(spark, data):
    columns, penalties = ["a", "b", "c", "d"], [0.1, 1.0, 10.0]
    got = ml.ridge_search(data, columns, penalties)
    renamed = data
    tagged = ml.expanding_folds(renamed, 5).cache()
    for penalty in penalties:
        scores = []
        for k in range(1, 6):
            model = ml._fit(tagged.filter(f"fold < {k}"), ["a", "b", "c", "d"], "ridge", "regression", regParam=penalty)
            scores.append(ml._score(model.transform(tagged.filter(f"fold = {k}")), "regression"))
        assert got[penalty] == pytest.approx(sum(scores) / 5, rel=1e-3)
    best, score = ml.search(renamed, ["a", "b", "c", "d"], "ridge", "regression")
    assert best == {"regParam": max(got, key=got.get)} and score == pytest.approx(max(got.values()), rel=1e-9)
