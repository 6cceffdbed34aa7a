"""Queries over predictions, ensembles, model evaluation and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.functions.numeric import lit_array
from marketframe.operators import bars as B
from marketframe.operators import features as M
from marketframe.operators import ml as L
from marketframe.operators.lineage import cut
from marketframe.plans.sqlkit import PREDICTIONS, rounded, rsql, with_sql
from marketframe.sources import derived

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _pred(spark, folder):
    """Predictions on an hourly grid, so that several models meet; class is the rounded value."""
    p = derived.predictions(spark, folder).withColumn("actual", F.least(F.col("value") / 100.0, F.lit(1.0)))
    return p.withColumns({"ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"), "event_ts": F.col("ts")})


PR = "pr as (select * replace (date_trunc('hour', ts)::timestamp as ts), ts as event_ts, least(value / 100.0::double, 1.0::double) as actual from predictions)"
K = ["asset_id", "ts"]


def _one_per_model(spark, folder):
    return _pred(spark, folder).groupBy(*K, "model_id").agg(F.max_by("prediction_value", "pred_id").alias("prediction_value"), F.max_by("confidence", "pred_id").alias("confidence"), F.max_by("actual", "pred_id").alias("actual"))


ONE = "one as (select asset_id, ts, model_id, arg_max(prediction_value, pred_id) as v, arg_max(confidence, pred_id) as c, arg_max(actual, pred_id) as actual from pr group by 1, 2, 3)"


def _weights(spark):
    return spark.createDataFrame([("m0", 0.5), ("m1", 0.3), ("m2", 0.2)], "model_id string, weight double")


_W = "case model_id when 'm0' then 0.5 when 'm1' then 0.3 else 0.2 end::double"
for _m, _e in (("average", "avg(v)"), ("median", "median(v)"), ("confidence", "sum(v * c) / sum(c)"), ("weighted", f"sum(v * {_W}) / sum({_W})")):
    _add(
        f"l14_l15_combine_{_m}",
        lambda s, f, m=_m: rounded(L.combine(_one_per_model(s, f), m, weights=_weights(s) if m == "weighted" else None)),
        rsql(with_sql([PREDICTIONS, PR, ONE], f"select asset_id, ts, {_e} as prediction_value, avg(c) as confidence, count(*) as n_models from one group by 1, 2"), [*K, "n_models"], ["prediction_value", "confidence"]),
    )
for _m, _w in (("voting", "1.0::double"), ("weighted_voting", _W)):
    _add(
        f"l14_l15_combine_{_m}",
        lambda s, f, m=_m: rounded(L.combine(_one_per_model(s, f).withColumn("prediction_value", F.round("prediction_value", 0)), m, weights=_weights(s) if m == "weighted_voting" else None)),
        rsql(with_sql([PREDICTIONS, PR, ONE, f"vt as (select asset_id, ts, round(v, 0) as val, sum({_w}) as w, min(model_id) as fm from one group by 1, 2, 3)",
                       "wn as (select asset_id, ts, val from vt qualify row_number() over (partition by asset_id, ts order by w desc, fm) = 1)"],
                      "select asset_id, ts, val as prediction_value, ac as confidence, n as n_models from wn join (select asset_id, ts, avg(c) as ac, count(*) as n from one group by 1, 2) using (asset_id, ts)"), [*K, "n_models"], ["prediction_value", "confidence"]),
    )


def q_probabilities(spark, folder):
    p = _one_per_model(spark, folder).withColumn("probabilities", F.array(1.0 - F.col("prediction_value"), F.col("prediction_value")))
    out = L.average_probabilities(p)
    return rounded(out.select(*K, F.col("probabilities")[0].alias("p0"), F.col("probabilities")[1].alias("p1")))


_add("l14_average_probabilities", q_probabilities, rsql(with_sql([PREDICTIONS, PR, ONE], "select asset_id, ts, avg(1 - v) as p0, avg(v) as p1 from one group by 1, 2"), K, ["p0", "p1"]))


def q_dynamic(spark, folder):
    p = derived.predictions(spark, folder).withColumn("actual", F.least(F.col("value") / 100.0, F.lit(1.0)))
    return rounded(L.dynamic_weights(p).select("pred_id", "model_id", "mean_error", "raw_weight"))


DYN = """dy as (select *, case when count(err) over w >= 10 then avg(err) over w end as mean_error from (select *, abs(least(value / 100.0::double, 1.0::double) - prediction_value) as err from predictions)
 window w as (partition by model_id order by ts, pred_id rows between 100 preceding and 1 preceding))"""
_add("w46_dynamic_weights", q_dynamic, rsql(with_sql([PREDICTIONS, DYN], "select pred_id, model_id, mean_error, 1 / (mean_error + 1e-8) as raw_weight from dy"), ["pred_id", "model_id"], ["mean_error", "raw_weight"]))


def q_feedback(spark, folder):
    """Weights recomputed after actuals arrived: the latest row of each model, normalised."""
    p = derived.predictions(spark, folder).withColumn("actual", F.least(F.col("value") / 100.0, F.lit(1.0)))
    last = L.top_k(L.dynamic_weights(p), ["model_id"], [F.desc("ts"), F.desc("pred_id")], 1).withColumn("run", F.lit(0))
    return rounded(L.normalised_weights(last, ["run"]).select("model_id", "weight"))


_add("l18_updated_weights", q_feedback, rsql(with_sql([PREDICTIONS, DYN, "la as (select *, 1 / (mean_error + 1e-8) as rw from dy qualify row_number() over (partition by model_id order by ts desc, pred_id desc) = 1)"], "select model_id, rw / sum(rw) over () as weight from la"), ["model_id"], ["weight"]))
_add(
    "a17_prediction_summary",
    lambda s, f: rounded(L.prediction_summary(_pred(s, f))),
    rsql(with_sql([PREDICTIONS, PR], "select model_id, asset_id, count(*) as n_predictions, avg(confidence) as avg_confidence from pr group by grouping sets ((model_id), (asset_id), ())"), ["model_id", "asset_id", "n_predictions"], ["avg_confidence"]),
)
_add(
    "a19_ensemble_error",
    lambda s, f: rounded(L.ensemble_error(_pred(s, f), ["model_id"])),
    rsql(with_sql([PREDICTIONS, PR], "select model_id, avg(power(actual - prediction_value, 2)) as mse, sqrt(avg(power(actual - prediction_value, 2))) as rmse, count(*) as n from pr group by 1"), ["model_id", "n"], ["mse", "rmse"]),
)
_add(
    "p26_prediction_history",
    lambda s, f: L.prediction_history(derived.predictions(s, f), "view", "m1", 50).select("pred_id"),
    with_sql([PREDICTIONS], "select pred_id from predictions where asset_id = 'view' and model_id = 'm1' order by ts desc, pred_id desc limit 50"),
)
_cm = ["accuracy", "precision", "recall", "f1"]
_add(
    "a14_classification_metrics",
    lambda s, f: rounded(L.classification_metrics(_pred(s, f).withColumns({"target": F.floor(F.col("actual") * 4), "prediction": F.floor(F.col("prediction_value") * 4)}), keys=["model_id"])),
    rsql(with_sql([PREDICTIONS, PR, "cf as (select model_id, floor(actual * 4) as y, floor(prediction_value * 4) as p, count(*) as c from pr group by 1, 2, 3)",
                   "bl as (select model_id, y as k, sum(c) as sup, sum(case when y = p then c else 0 end) as tp from cf group by 1, 2)", "bp as (select model_id, p as k, sum(c) as np from cf group by 1, 2)",
                   "mx as (select *, coalesce(tp / np, 0) as pr_, tp / sup as re_ from bl left join bp using (model_id, k))", "my as (select *, case when pr_ + re_ > 0 then 2 * pr_ * re_ / (pr_ + re_) else 0 end as f_ from mx)"],
                  "select model_id, sum(tp) / sum(sup) as accuracy, sum(pr_ * sup) / sum(sup) as precision, sum(re_ * sup) / sum(sup) as recall, sum(f_ * sup) / sum(sup) as f1 from my group by 1"), ["model_id"], _cm),
)
_rm = ["mse", "rmse", "mae", "r2", "mean_residual", "std_residual"]
_add(
    "a15_regression_metrics",
    lambda s, f: rounded(L.regression_metrics(_pred(s, f), "actual", "prediction_value", ["model_id"])),
    rsql(with_sql([PREDICTIONS, PR, "er as (select model_id, actual, actual - prediction_value as e from pr)"], "select model_id, avg(e * e) as mse, sqrt(avg(e * e)) as rmse, avg(abs(e)) as mae, 1 - sum(e * e) / (var_pop(actual) * count(*)) as r2, avg(e) as mean_residual, stddev_pop(e) as std_residual from er group by 1"), ["model_id"], _rm),
)


def _registry(spark, folder):
    """Model registry rows drawn from the part table."""
    p = derived.read(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("model"), (k % 40).cast("string")).alias("model_id"), F.floor(k / 40).cast("int").alias("version"),
        F.get(lit_array(["random_forest", "ridge", "gradient_boosting"]), (k % 3).cast("int")).alias("model_type"),
        F.get(lit_array(["binary", "regression"]), (k % 2).cast("int")).alias("target_type"),
        F.timestamp_seconds(F.lit(1704067200) + k * 3600).cast("timestamp_ntz").alias("created_at"),
        F.create_map(F.lit("score"), F.col("p_retailprice")).alias("metrics"), (F.col("p_size") * 1.0).alias("size_mb"), (F.col("p_size") * 2.5).alias("seconds"),
        F.array_compact(F.array(F.lit("all"), F.when(k % 5 == 0, F.lit("prod")), F.when(k % 7 == 0, F.lit("gold")))).alias("tags"),
    )


REG = """reg as (select 'model' || (p_partkey % 40) as model_id, (p_partkey // 40)::int as version, ['random_forest', 'ridge', 'gradient_boosting'][(p_partkey % 3 + 1)::int] as model_type, ['binary', 'regression'][(p_partkey % 2 + 1)::int] as target_type,
 timestamp '2024-01-01 00:00:00' + p_partkey * interval 1 hour as created_at, p_retailprice as score, p_size * 1.0::double as size_mb, p_size * 2.5::double as seconds, p_partkey % 5 = 0 as prod, p_partkey % 7 = 0 as gold from part)"""
_add("p27_model_listing", lambda s, f: L.list_models(_registry(s, f), "ridge", "binary", ["prod", "gold"]).select("model_id", "version"), with_sql([REG], "select model_id, version from reg where model_type = 'ridge' and target_type = 'binary' and prod and gold"))
_add("t09_best_model", lambda s, f: L.best_model(_registry(s, f), "score").select("model_id", "version"), with_sql([REG], "select model_id, version from reg order by score desc, model_id, version limit 1"))
_add("t10_latest_versions", lambda s, f: L.latest_versions(_registry(s, f)).select("model_id", "version"), with_sql([REG], "select model_id, version from reg qualify row_number() over (partition by model_id order by created_at desc, version desc) = 1"))
_add(
    "t10_retention_candidates",
    lambda s, f: L.retention_candidates(_registry(s, f), "2024-03-10 00:00:00").select("model_id", "version"),
    with_sql([REG], "select model_id, version from (select *, row_number() over (partition by model_id order by created_at desc, version desc) as rn from reg) where rn > 5 and created_at < timestamp '2024-03-10 00:00:00' - interval 30 day"),
)
_add(
    "a16_a18_registry_summary",
    lambda s, f: rounded(L.registry_summary(_registry(s, f))),
    rsql(with_sql([REG], "select model_type, target_type, count(*) as n_models, sum(size_mb) as total_mb, sum(seconds) as total_seconds, avg(seconds) as avg_seconds, arg_max(model_id, (created_at, model_id)) as latest_model from reg group by 1, 2"), ["model_type", "target_type", "n_models", "latest_model"], ["total_mb", "total_seconds", "avg_seconds"]),
)

# ------------------------------------------------------------------ trained models (no SQL counterpart)


def _dataset(spark, folder):
    """Training and held-out rows of all bar features, and the features that vary in training."""
    train, _, test = M.time_split(cut(M.ml_dataset(B.bar_features(derived.bars(spark, folder)), min_samples=50)))
    train = cut(train)
    return train, test, L.usable_columns(train, M.numeric_columns(train))


def q_train(name, task):
    def run(spark, folder):
        train, test, columns = _dataset(spark, folder)
        if task == "classification":
            train = train.withColumn("target", (F.col("target") > 0).cast("double"))
        model = L.train(train, columns, name, task)
        return L.predict(model, test, name, task).drop("probabilities")

    return run


for _n, _t in (("logistic_regression", "classification"), ("random_forest", "classification"), ("gradient_boosting", "classification"), ("ridge", "regression"), ("random_forest", "regression")):
    _add(f"l08_l10_l13_{_n}_{_t}", q_train(_n, _t))


def q_balanced(spark, folder):
    """Class weights of a skewed target (a large return up): rows and total weight of each class."""
    p = _pred(spark, folder).withColumn("target", (F.col("actual") > 0.9).cast("double"))
    weighted = L.balanced_weights(p.select("asset_id", "target"))
    return rounded(weighted.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight"), F.sum("weight").alias("total")))


_add(
    "l10_class_weights",
    q_balanced,
    rsql(with_sql([PREDICTIONS, PR, "tg as (select (actual > 0.9)::int::double as target, count(*) as n from pr group by 1)"], """select target, n, (select sum(n) from tg) / ((select count(*) from tg) * n) as weight,
    (select sum(n) from tg) / (select count(*) from tg) as total from tg"""), ["target", "n"], ["weight", "total"]),
)


def q_search(spark, folder):
    train, test, columns = _dataset(spark, folder)
    params, _ = L.search(train, columns, "ridge", "regression")
    model = L.train(train, columns, "ridge", "regression", **params)
    return L.predict(model, test, "ridge", "regression").drop("probabilities")


_add("l11_l12_grid_search", q_search)


def q_stacking(spark, folder):
    p = _one_per_model(spark, folder)
    actual = p.groupBy(*K).agg(F.avg("actual").alias("target"))
    model, wide = L.stack(p, actual, ["m0", "m1", "m2"])
    return model.transform(wide).select(*K, "prediction")


#: Least squares in closed form: the covariances of three models and the target, solved by Cramer's rule.
_DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_CELLS = ["c00", "c01", "c02", "c01", "c11", "c12", "c02", "c12", "c22"]


def _cramer(column: int) -> str:
    cells = list(_CELLS)
    for row in range(3):
        cells[3 * row + column] = f"b{row}"
    return _DET.format(*cells)


_WIDE = "wide as (select asset_id, ts, " + ", ".join(f"coalesce(avg(v) filter (model_id = 'm{i}'), 0) as x{i}" for i in range(3)) + ", avg(actual) as y from one group by 1, 2)"
_COV = "cov as (select " + ", ".join([f"covar_pop(x{i}, x{j}) as c{i}{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop(x{i}, y) as b{i}, avg(x{i}) as a{i}" for i in range(3)]) + ", avg(y) as ay from wide)"
_FIT = "fit as (select *, " + ", ".join(f"{_cramer(i)} / {_DET.format(*_CELLS)} as w{i}" for i in range(3)) + " from cov)"
_add(
    "l16_stacking",
    lambda s, f: rounded(q_stacking(s, f)),
    rsql(with_sql([PREDICTIONS, PR, ONE, _WIDE, _COV, _FIT], "select asset_id, ts, ay + w0 * (x0 - a0) + w1 * (x1 - a1) + w2 * (x2 - a2) as prediction from wide, fit"), K, ["prediction"]),
)
