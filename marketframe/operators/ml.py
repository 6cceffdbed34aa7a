"""Training, prediction and ensembles on Spark ML."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.numeric import ratio, zero
from marketframe.operators.features import constant_features
from marketframe.operators.lineage import cut
from marketframe.operators.ordered import row_chunks
from marketframe.operators.ranking import exact_quantiles, top_k

# Search grids per model.
GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15]},
    "gradient_boosting": {"maxIter": [50, 100], "maxDepth": [3, 5, 7], "stepSize": [0.05, 0.1]},
    "logistic_regression": {"regParam": [0.1, 1.0, 10.0], "elasticNetParam": [0.0, 1.0]},
    "linear_regression": {"regParam": [0.0]},
    "ridge": {"regParam": [0.1, 1.0, 10.0]},
}


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows with ``weight`` = rows / (classes * rows of the class), so that every class counts alike."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))  # one row
    share = counts.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(share, label, "left")


def estimator(name: str, task: str, classes: int = 2, weights: bool = False, **params):
    """Spark ML estimator for a model name and a task (classification or regression); with ``weights`` rows count by the
    column ``weight``."""
    common = {"featuresCol": "features", "labelCol": "target"} | ({"weightCol": "weight"} if weights else {})
    if task == "classification":
        if name == "random_forest":
            return RandomForestClassifier(**common, seed=42, **params)
        if name == "gradient_boosting":
            base = GBTClassifier(**common, seed=42, **params)
            return base if classes == 2 else OneVsRest(classifier=base, **common)
        if name == "logistic_regression":
            return LogisticRegression(**common, **params)
    elif name == "random_forest":
        return RandomForestRegressor(**common, seed=42, **params)
    elif name == "gradient_boosting":
        return GBTRegressor(**common, seed=42, **params)
    elif name in ("linear_regression", "ridge"):
        return LinearRegression(**common, elasticNetParam=0.0, **params)
    raise ValueError(f"no {task} model named {name}")


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that are not constant (a list of names, read by the driver)."""
    constant = {r["feature"] for r in constant_features(df, columns).collect()}
    return [c for c in columns if c not in constant]


def preprocessing(columns: Sequence[str]) -> list:
    """Median fill, assembly and robust scaling; fitted with the model, on training rows only."""
    columns = list(columns)
    filled = [f"_f_{c}" for c in columns]
    return [
        Imputer(strategy="median", inputCols=columns, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        RobustScaler(inputCol="_raw", outputCol="features", withCentering=True),
    ]


def train(df: DataFrame, columns: Sequence[str], name: str, task: str, classes: int = 2, balanced: bool = False, **params) -> PipelineModel:
    """Fit preprocessing and model; the training rows are materialised once, as fitting reads them repeatedly. With
    ``balanced`` the classes of a classification count alike, whatever their numbers of rows."""
    rows = df.select(*columns, "target")
    if balanced and task == "classification":
        return _fit(cut(balanced_weights(rows)), columns, name, task, classes, weights=True, **params)
    return _fit(cut(rows), columns, name, task, classes, **params)


def _fit(df: DataFrame, columns: Sequence[str], name: str, task: str, classes: int = 2, **params) -> PipelineModel:
    return Pipeline(stages=[*preprocessing(columns), estimator(name, task, classes, **params)]).fit(df)


def expanding_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Tag rows 0..folds by time: fold k is validated after training on the folds before it."""
    sec = df.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    cuts = exact_quantiles(sec, [], "_s", {f"_q{i}": i / (folds + 1) for i in range(1, folds + 1)})
    out = sec.crossJoin(F.broadcast(cuts))  # one row
    fold: Column = F.lit(0)
    for i in range(1, folds + 1):
        fold = fold + (F.col("_s") > F.col(f"_q{i}")).cast("int")
    return out.withColumn("fold", fold).drop("_s", *[f"_q{i}" for i in range(1, folds + 1)])


def _score(predicted: DataFrame, task: str) -> float:
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol="target", metricName="f1").evaluate(predicted)
    return -RegressionEvaluator(labelCol="target", metricName="mse").evaluate(predicted)


def search(
    df: DataFrame, columns: Sequence[str], name: str, task: str, grid: dict | None = None, folds: int = 5, draws: int | None = None
) -> tuple[dict, float]:
    """Best parameters by the mean score over expanding time folds; ``draws`` limits a random search. Linear models are
    searched in closed form, others fitted one after the other."""
    grid = GRIDS[name] if grid is None else grid
    if task == "regression" and name in ("linear_regression", "ridge") and set(grid) == {"regParam"} and draws is None:
        means = ridge_search(df, columns, grid["regParam"], folds)
        best_penalty = max(means, key=means.get)  # of equals the first one of the grid
        return {"regParam": best_penalty}, means[best_penalty]
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if draws is not None and draws < len(combos):
        import random

        combos = random.Random(42).sample(combos, draws)
    tagged = cut(expanding_folds(df, folds))
    # a long average may have no value yet in the first folds
    usable = {k: usable_columns(tagged.filter(F.col("fold") < k), columns) for k in range(1, folds + 1)}
    best: tuple[dict, float] = ({}, float("-inf"))
    for params in combos:
        scores = []
        for k in range(1, folds + 1):
            model = _fit(tagged.filter(F.col("fold") < k), usable[k], name, task, **params)
            scores.append(_score(model.transform(tagged.filter(F.col("fold") == k)), task))
        mean = sum(scores) / len(scores)
        if mean > best[1]:
            best = (params, mean)
    return best


def gram_matrices(df: DataFrame, columns: Sequence[str]) -> dict[int, np.ndarray]:
    """Products of 1, the columns (missing as 0), their missing marks and the target, summed per ``fold``.

    One pass: a task sums its own rows, one matrix per fold leaves it; their size depends on the number of columns only.
    """
    p = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:-1]], axis=1) if p else np.empty((len(fold), 0))
            y = batch.column(p + 1).to_numpy(zero_copy_only=False).astype(float)
            missing = np.isnan(x)
            z = np.hstack([np.ones((len(fold), 1)), np.where(missing, 0.0, x), missing, y[:, None]])
            for f in np.unique(fold):
                part = z[fold == f]
                sums[int(f)] = sums.get(int(f), 0.0) + part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["fold", "sums"])

    rows = df.filter(F.col("target").isNotNull()).select(F.col("fold").cast("int"), *[F.col(f"`{c}`").cast("double") for c in columns], F.col("target").cast("double"))
    size = 2 * p + 2
    out: dict[int, np.ndarray] = {}
    # a row per task and fold
    for row in rows.mapInArrow(products, "fold int, sums binary").toLocalIterator():
        out[row.fold] = out.get(row.fold, 0.0) + np.frombuffer(row.sums).reshape(size, size)
    return out


def solve_ridge(gram: np.ndarray, fill: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge regression on standardised columns from their Gram matrix; missing values are
    ``fill``. The penalty counts in deviations of the target, as in Spark ML; constant columns get 0."""
    p = len(fill)
    take = np.zeros((p + 2, 2 * p + 2))  # 1, filled columns, target
    take[0, 0] = take[p + 1, 2 * p + 1] = 1
    take[np.arange(1, p + 1), np.arange(1, p + 1)] = 1
    take[np.arange(1, p + 1), np.arange(p + 1, 2 * p + 1)] = fill
    g = take @ gram @ take.T
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    used = np.flatnonzero(spread[:p] > 1e-12 * (1 + np.abs(mean[:p])))
    w = np.zeros(p)
    if len(used) and spread[p] > 0:
        scale = spread[used]
        left = cov[np.ix_(used, used)] / np.outer(scale, scale) + penalty / spread[p] * np.eye(len(used))
        w[used] = np.linalg.lstsq(left, cov[used, p] / scale, rcond=None)[0] / scale
    return w, float(mean[p] - w @ mean[:p])


def ridge_search(df: DataFrame, columns: Sequence[str], penalties: Sequence[float], folds: int = 5) -> dict[float, float]:
    """Mean score (negative squared error) of each penalty over expanding time folds, from one scan of the tagged rows:
    every fold and penalty is solved from the Gram matrices of the folds, and its error follows from them, too."""
    tagged = cut(expanding_folds(df, folds).select("fold", *[F.col(f"`{c}`") for c in columns], "target"))
    grams = gram_matrices(tagged, columns)
    p = len(columns)
    middle = lambda k, c: F.percentile_approx(F.when(F.col("fold") < k, F.col(f"`{c}`").cast("double")), 0.5, 1000)
    fills = tagged.agg(*[F.array(*[F.coalesce(middle(k, c), F.lit(0.0)) for c in columns]).alias(f"k{k}") for k in range(1, folds + 1)]).first()
    scores: dict[float, list[float]] = {penalty: [] for penalty in penalties}
    for k in range(1, folds + 1):
        before = sum(m for f, m in grams.items() if f < k)
        if k not in grams or isinstance(before, int):
            continue
        fill = np.array(fills[f"k{k}"])
        for penalty in penalties:
            w, b = solve_ridge(before, fill, penalty)
            error = np.concatenate([[-b], -w, -w * fill, [1.0]])  # target - prediction as a combination of the products
            scores[penalty].append(-float(error @ grams[k] @ error) / grams[k][0, 0])
    return {penalty: sum(s) / len(s) if s else float("-inf") for penalty, s in scores.items()}


def train_many(df: DataFrame, columns: Sequence[str], names: Sequence[str], task: str, test: DataFrame) -> tuple[dict, DataFrame]:
    """Fit several models and return them with one experiment row per model."""
    models, rows = {}, []
    for name in names:
        begin = time.time()
        models[name] = train(df, columns, name, task)
        rows.append((name, task, _score(models[name].transform(test), task), time.time() - begin, list(columns)))
    spark = df.sparkSession
    schema = "model_id string, task string, score double, seconds double, feature_names array<string>"
    return models, spark.createDataFrame(rows, schema)


def save_model(model: PipelineModel, folder: str, model_id: str, version: int, metrics: dict[str, float], spark: SparkSession, **info) -> None:
    """Write the fitted pipeline and append its registry row."""
    path = f"{folder}/models/{model_id}/{version}"
    model.write().overwrite().save(path)
    row = (model_id, version, path, metrics, info.get("model_type", ""), info.get("target_type", ""), info.get("feature_names", []), info.get("tags", []))
    schema = ("model_id string, version int, path string, metrics map<string,double>, model_type string, target_type string, "
              "feature_names array<string>, tags array<string>")
    spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").parquet(
        f"{folder}/registry"
    )


def load_model(spark: SparkSession, folder: str, model_id: str, version: int | None = None) -> PipelineModel:
    registry = spark.read.parquet(f"{folder}/registry").filter(F.col("model_id") == model_id)
    if version is not None:
        registry = registry.filter(F.col("version") == version)
    return PipelineModel.load(registry.orderBy(F.desc("version")).select("path").first()["path"])


# ---------------------------------------------------------------- prediction


def predict(model: PipelineModel, df: DataFrame, model_id: str, task: str, key: str = "symbol") -> DataFrame:
    """asset_id, ts, prediction, confidence (largest probability, 0.7 for regression) and probabilities."""
    scored = model.transform(df)
    if task == "classification" and "probability" in scored.columns:
        scored = scored.withColumn("probabilities", vector_to_array("probability"))
        confidence = F.array_max("probabilities")
    else:
        scored = scored.withColumn("probabilities", F.lit(None).cast("array<double>"))
        confidence = F.lit(0.7 if task == "regression" else 0.5)
    return scored.select(
        F.col(key).alias("asset_id"), "ts", F.lit(model_id).alias("model_id"), F.col("prediction").alias("prediction_value"),
        confidence.alias("confidence"), "probabilities",
    )




def combine(predictions: DataFrame, method: str = "average", keys: Sequence[str] = ("asset_id", "ts"), weights: DataFrame | None = None) -> DataFrame:
    """One combined prediction per key.

    average, median, weighted (``weights``: model_id, weight; normalised over the models present),
    confidence, or the votes: voting and weighted_voting. Vote ties go to the first model's value.
    """
    keys = list(keys)
    data = predictions
    if weights is not None:
        data = data.join(weights, "model_id", "left").withColumn("weight", zero(F.col("weight")))
    v, conf = F.col("prediction_value"), F.avg("confidence").alias("confidence")
    n = F.count(F.lit(1)).alias("n_models")
    if method in ("voting", "weighted_voting"):
        w = F.col("weight") if method == "weighted_voting" else F.lit(1.0)
        per_value = data.groupBy(*keys, "prediction_value").agg(F.sum(w).alias("_w"), F.min("model_id").alias("_first"))
        winner = per_value.groupBy(*keys).agg(
            F.min_by("prediction_value", F.struct(-F.col("_w"), F.col("_first"))).alias("prediction_value")
        )
        return winner.join(data.groupBy(*keys).agg(conf, n), keys)
    value = {
        "average": F.avg(v),
        "median": F.median(v),
        "confidence": ratio(F.sum(v * F.col("confidence")), F.sum("confidence")),
        "weighted": ratio(F.sum(v * F.col("weight")), F.sum("weight")) if weights is not None else F.avg(v),
    }[method]
    return data.groupBy(*keys).agg(value.alias("prediction_value"), conf, n)


def average_probabilities(predictions: DataFrame, keys: Sequence[str] = ("asset_id", "ts")) -> DataFrame:
    """Mean probability per class over the models."""
    long = predictions.select(*keys, F.posexplode("probabilities").alias("_i", "_p"))
    per = long.groupBy(*keys, "_i").agg(F.avg("_p").alias("_p"))
    return per.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda s: s["_p"]).alias("probabilities")
    )


def dynamic_weights(scored: DataFrame, window: int = 100, minimum: int = 10) -> DataFrame:
    """Model weights as of each time: inverse mean error of the model's last ``window`` earlier actuals.

    ``scored`` has model_id, ts, prediction_value and actual. Weights are normalised over the
    models that predicted at that time.
    """
    c = row_chunks(scored.filter(F.col("actual").isNotNull()), ("model_id",), tie=("pred_id",), halo=window + 2)
    frame = c.order.rowsBetween(-window, -1)
    error = F.abs(F.col("actual") - F.col("prediction_value"))
    c = c.with_columns({"_err": error})
    mean = F.when(F.count("_err").over(frame) >= minimum, F.avg("_err").over(frame))
    return c.with_columns({"mean_error": mean, "raw_weight": F.lit(1.0) / (mean + 1e-8)}).own().drop("_err")


def normalised_weights(weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = weights.groupBy(*keys).agg(F.sum("raw_weight").alias("_total"))
    return weights.join(total, list(keys)).withColumn("weight", ratio("raw_weight", "_total")).drop("_total")


def stack(predictions: DataFrame, actuals: DataFrame, model_ids: Sequence[str], task: str = "regression") -> tuple[PipelineModel, DataFrame]:
    """Meta-learner over the models' predictions: the fitted model and its input table."""
    wide = stacking_table(predictions, model_ids).join(actuals, ["asset_id", "ts"])
    meta = LogisticRegression(labelCol="target") if task == "classification" else LinearRegression(labelCol="target")
    assembler = VectorAssembler(inputCols=list(model_ids), outputCol="features")
    wide = cut(wide)
    return Pipeline(stages=[assembler, meta]).fit(wide), wide


def stacking_table(predictions: DataFrame, model_ids: Sequence[str]) -> DataFrame:
    """One row per asset and time with a column per model (0 where a model is silent)."""
    return predictions.groupBy("asset_id", "ts").agg(
        *[zero(F.avg(F.when(F.col("model_id") == m, F.col("prediction_value")))).alias(m) for m in model_ids]
    )


# ---------------------------------------------------------------- evaluation and registry


def classification_metrics(predicted: DataFrame, label: str = "target", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 from the confusion counts, per key."""
    keys = list(keys)
    conf = predicted.groupBy(*keys, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    hit = F.when(F.col("_y") == F.col("_p"), F.col("_c")).otherwise(0)
    by_label = conf.groupBy(*keys, F.col("_y").alias("_k")).agg(F.sum("_c").alias("_support"), F.sum(hit).alias("_tp"))
    by_pred = conf.groupBy(*keys, F.col("_p").alias("_k")).agg(F.sum("_c").alias("_predicted"))
    both = by_label.join(by_pred, [*keys, "_k"], "left")
    precision, recall = zero(ratio("_tp", "_predicted")), ratio("_tp", "_support")
    both = both.withColumns({"_pr": precision, "_re": recall})
    both = both.withColumn("_f1", zero(ratio(F.col("_pr") * F.col("_re") * 2.0, F.col("_pr") + F.col("_re"))))
    total = F.sum("_support")
    mean = lambda c: F.sum(F.col(c) * F.col("_support")) / total
    return both.groupBy(*keys).agg(
        (F.sum("_tp") / total).alias("accuracy"), mean("_pr").alias("precision"), mean("_re").alias("recall"), mean("_f1").alias("f1")
    )


def auc(predicted: DataFrame, label: str = "target", raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw).evaluate(predicted)


def regression_metrics(predicted: DataFrame, label: str = "target", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    mse, n = F.avg(e * e), F.count(e)
    return predicted.groupBy(*keys).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - ratio(F.sum(e * e), F.var_pop(label) * n)).alias("r2"),
        F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"),
    )


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Counts and mean confidence overall, per model and per asset."""
    return predictions.groupingSets([(F.col("model_id"),), (F.col("asset_id"),), ()], "model_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n_predictions"), F.avg("confidence").alias("avg_confidence")
    )


def prediction_history(predictions: DataFrame, asset: str | None = None, model: str | None = None, last: int | None = None) -> DataFrame:
    out = predictions
    if asset:
        out = out.filter(F.col("asset_id") == asset)
    if model:
        out = out.filter(F.col("model_id") == model)
    out = out.orderBy(F.desc("ts"), F.desc("pred_id"))
    return out if last is None else out.limit(last)


def list_models(registry: DataFrame, model_type: str | None = None, target: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Registry rows by type, target and having all tags."""
    out = registry
    if model_type:
        out = out.filter(F.col("model_type") == model_type)
    if target:
        out = out.filter(F.col("target_type") == target)
    if tags:
        wanted = F.array(*[F.lit(t) for t in tags])
        out = out.filter(F.size(F.array_except(wanted, "tags")) == 0)
    return out


def best_model(registry: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    value = F.try_element_at("metrics", F.lit(metric))
    out = registry.filter(value.isNotNull())
    return out.orderBy(F.asc(value) if ascending else F.desc(value), "model_id", "version").limit(1)


def latest_versions(registry: DataFrame) -> DataFrame:
    return top_k(registry, ["model_id"], [F.desc("created_at"), F.desc("version")], 1)


def retention_candidates(registry: DataFrame, as_of: str, keep: int = 5, days: int = 30) -> DataFrame:
    """Versions beyond the newest ``keep`` of their model that are older than ``days``."""
    newest = top_k(registry.select("model_id", "version", "created_at"), ["model_id"], [F.desc("created_at"), F.desc("version")], keep)
    old = registry.filter(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    return old.join(newest.select("model_id", "version"), ["model_id", "version"], "left_anti")


def registry_summary(registry: DataFrame) -> DataFrame:
    """Models per type and target with size, training time and the newest model."""
    return registry.groupBy("model_type", "target_type").agg(
        F.count(F.lit(1)).alias("n_models"), F.sum("size_mb").alias("total_mb"), F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("avg_seconds"), F.max_by("model_id", F.struct("created_at", "model_id")).alias("latest_model"),
    )


def ensemble_error(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col("actual") - F.col("prediction_value")
    return scored.filter(F.col("actual").isNotNull()).groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )


