"""Operators without a SQL counterpart, and invariance to chunk sizes."""

import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from marketframe.functions import text as X
from marketframe.operators import allocation as A
from marketframe.operators import event_features as E
from marketframe.operators import event_store as S
from marketframe.operators import features as M
from marketframe.operators import ml
from marketframe.operators import performance as P
from marketframe.operators import sentiment_features as N
from marketframe.operators import signals as G
from marketframe.plans.sqlkit import rounded
from marketframe.sources import derived, feeds, sinks


def test_event_features_do_not_depend_on_chunks(spark):
    bars, events = derived.bars(spark, SMALL), derived.detections(spark, SMALL)
    a = rounded(E.event_features(bars, events, pieces=9))
    b = rounded(E.event_features(bars, events, pieces=1))
    assert a.exceptAll(b).count() == 0


def test_sentiment_features_do_not_depend_on_chunks(spark):
    bars = derived.bars(spark, SMALL).filter("ts < '2024-01-06'")
    news = X.score_sentiment(derived.news(spark, SMALL))
    keep = ["symbol", "ts", "sentiment_avg_3d", "sentiment_std_7d", "news_count_7d", "sentiment_decay_3d", "sentiment_volatility_7d"]
    a = rounded(N.sentiment_features(bars, news, windows=(3, 7), pieces=9).select(*keep))
    b = rounded(N.sentiment_features(bars, news, windows=(3, 7), pieces=1).select(*keep))
    assert a.exceptAll(b).count() == 0


def test_ledger_matches_hand_calculation(spark):
    rows = [("p", "s", i, side, q, price, 1.0) for i, (side, q, price) in enumerate(
        [("buy", 10.0, 100.0), ("buy", 10.0, 110.0), ("sell", 5.0, 120.0), ("sell", 50.0, 130.0), ("sell", 15.0, 90.0), ("buy", 1.0, 50.0)])]
    fills = spark.createDataFrame(rows, "portfolio string, symbol string, order_id long, side string, quantity double, price double, commission double")
    got = [tuple(r) for r in P.trade_ledger(fills, order=("order_id",)).orderBy("order_id").select("accepted", "cash_effect", "position", "avg_price", "realized_pnl").collect()]
    assert got == [
        (True, -1001.0, 10.0, 100.0, 0.0), (True, -1101.0, 20.0, 105.0, 0.0), (True, 599.0, 15.0, 105.0, 74.0),
        (False, 0.0, 15.0, 105.0, 0.0), (True, 1349.0, 0.0, 0.0, -226.0), (True, -51.0, 1.0, 50.0, 0.0)]


def test_cash_runs_out_in_order(spark):
    rows = [("r", f"s{i}", "long", 0.9, 0.2, price, 0.02) for i, price in enumerate([50.0, 33.0, 70.0, 20.0, 11.0, 90.0, 10.0])]
    sig = spark.createDataFrame(rows, "run_id string, signal_id string, direction string, confidence double, position_size double, current_price double, volatility double")
    got = G.size_positions(sig).orderBy("signal_id").toPandas()
    cash = 95_000.0
    for row in got.itertuples():
        dollars = min(row.wanted_size, cash / 100_000.0) * 100_000.0
        shares = int(dollars // row.current_price)
        assert row.shares == shares
        cash -= shares * row.current_price
    assert got["final_size"].sum() <= 1.0


def test_greedy_clusters(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "a", 0.9), (1, "b", "c", 0.8), (1, "c", "b", 0.8), (1, "d", "e", 0.1)], "run_id int, a string, b string, corr double")
    got = {r["asset_id"]: r["cluster"] for r in A.correlation_clusters(pairs).collect()}
    assert got == {"a": "a", "b": "a"}


def test_stratified_split_keeps_shares(spark):
    df = spark.range(20_000).withColumn("label", F.when(F.col("id") % 50 == 0, "rare").otherwise("common"))
    got = M.stratified_split(df, "label", ["id"]).groupBy("label", "split").count().toPandas().pivot(index="label", columns="split", values="count")
    assert got.loc["rare"].tolist() == [80, 240, 80] or (got.loc["rare", "train"] == pytest.approx(240, abs=1))
    assert got.loc["common", "train"] == pytest.approx(0.6 * 19_600, abs=1)


def test_failing_scorer_is_labelled(spark):
    def make():
        def scorer(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [("POSITIVE", 1.0)] * len(texts)
        return scorer
    df = spark.createDataFrame([("good",), ("bad",), ("fine",)], "title string").coalesce(1)
    got = {r["title"]: (r["sentiment_label"], r["sentiment_numeric"]) for r in X.analyze_text_column(df, make_scorer=make, batch_size=1).collect()}
    assert got == {"good": ("POSITIVE", 1.0), "bad": ("ERROR", 0.0), "fine": ("POSITIVE", 1.0)}


def test_entities_and_impact_of_one_article(spark):
    df = spark.createDataFrame([(1, "Apple and $TSLA rally: Tesla quarterly earnings beat estimates, revenue up 12%", "x")], "doc_id int, title string, content string")
    row = X.link_entities(X._article_text(df), F.col("_full")).first()
    assert [(e["text"], e["ticker"]) for e in row["entities"]] == [("TSLA", "TSLA"), ("TSLA", "TSLA"), ("Apple Inc.", "AAPL"), ("Tesla Inc.", "TSLA")]
    scored = X.score_impact(X.detected_events(df, keep=["doc_id"])).filter("event_type = 'earnings'").first()
    assert scored["impact_level"] in ("high", "extreme") and "Earnings beat estimates - increased impact" in scored["reasoning"]


def test_fallback_score(spark):
    df = spark.createDataFrame([("t", "d", None, "AAPL", None)], "title string, description string, event_type string, entity string, confidence double")
    row = X.score_impact(df).first()
    assert (row["impact_level"], row["impact_score"], row["impact_confidence"]) == ("minimal", 0.1, 0.3)


def test_event_store_keeps_all_batches_once(spark, tmp_path):
    events = S.news_to_events(derived.news(spark, SMALL))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for batch in (0, 1, 1, None):
        S.write_events(events.filter(half == (batch or 0)), str(tmp_path), batch)
    stored = S.read_events(spark, str(tmp_path))
    assert stored.select("event_id").exceptAll(events.select("event_id")).count() == 0
    assert stored.count() == events.count() > 0
    assert S.read_entities(spark, str(tmp_path)).join(stored, "event_id", "left_anti").count() == 0


def test_counters_are_observed(spark):
    news = derived.news(spark, SMALL)
    seen, found, a, e = S.with_counters(news, S.news_to_events(news))
    seen.write.format("noop").mode("overwrite").save()
    found.write.format("noop").mode("overwrite").save()
    assert a.get["articles_processed"] == news.count() and e.get["events_detected"] > 0


def test_bar_files_news_files_and_lists(spark, tmp_path):
    pd.DataFrame({"timestamp": ["2024-01-01 00:00:00", "2024-01-02 00:00:00"], "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 10}).to_csv(tmp_path / "ABC_market_data.csv", index=False)
    bars = feeds.read_bar_files(spark, str(tmp_path), start="2024-01-02")
    assert [(r["symbol"], r["close"]) for r in bars.collect()] == [("ABC", 1.5)]
    (tmp_path / "list.md").write_text("# t\n- AAPL\n- MSFT\n\ntext\n")
    assert sorted(r["symbol"] for r in feeds.read_symbol_list(spark, str(tmp_path / "list.md")).collect()) == ["AAPL", "MSFT"]
    (tmp_path / "macro.csv").write_text("id,description,frequency\nA,B,daily\n")
    assert feeds.read_macro_series(spark, str(tmp_path / "macro.csv")).first()["frequency"] == "daily"
    cal = '{"symbol":"A","event_type":"earnings","event_time":"2024-01-01T00:00:00","description":"d","impact_level":"high","metadata":{"q":"1"}}'
    (tmp_path / "a.json").write_text(cal)
    (tmp_path / "b.json").write_text(cal)
    assert feeds.read_calendar(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).count() == 2


def test_feature_cache_replaces_only_written_dates(spark, tmp_path):
    bars = derived.bars(spark, SMALL)
    sinks.write_features(bars, str(tmp_path / "f"))
    sinks.write_features(bars.filter("to_date(ts) = '2024-01-03'").withColumn("close", F.lit(0.0)), str(tmp_path / "f"))
    back = sinks.read_features(spark, str(tmp_path / "f"), start="2024-01-03", end="2024-01-03")
    assert back.filter("close <> 0").count() == 0
    assert sinks.read_features(spark, str(tmp_path / "f")).count() == bars.count()
    for symbol in ("view", "click"):
        sinks.write_features(bars.filter(F.col("symbol") == symbol), str(tmp_path / "g"))
    assert sinks.read_features(spark, str(tmp_path / "g")).count() == bars.filter("symbol in ('view', 'click')").count()
    assert sinks.read_features(spark, str(tmp_path / "g"), symbols=["view"]).filter("symbol <> 'view'").count() == 0


def test_exports(spark, tmp_path):
    df = spark.range(3)
    sinks.export_backtest(df, df, df, str(tmp_path / "x"))
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_model_round_trip(spark, tmp_path):
    df = spark.range(200).select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("a"), F.when(F.col("id") % 7 > 0, F.rand(1)).alias("b"), (F.col("id") * 2.0).alias("target"))
    model = ml.train(df, ["a", "b"], "linear_regression", "regression")
    ml.save_model(model, str(tmp_path), "m", 1, {"r2": 0.9}, spark, tags=["t"])
    again = ml.load_model(spark, str(tmp_path), "m")
    out = ml.predict(again, df, "m", "regression")
    assert out.agg(F.max(F.abs(F.col("prediction_value") - F.unix_seconds(F.col("ts").cast("timestamp")) * 2))).first()[0] < 1e-6
    assert ml.best_model(spark.read.parquet(f"{tmp_path}/registry"), "r2").count() == 1
    models, log = ml.train_many(df, ["a", "b"], ["linear_regression", "ridge"], "regression", df)
    assert set(models) == {"linear_regression", "ridge"} and log.count() == 2


def test_expanding_folds_are_ordered_in_time(spark):
    df = spark.range(600).select(F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    got = ml.expanding_folds(df, 5).groupBy("fold").agg(F.min("ts"), F.max("ts"), F.count("*")).orderBy("fold").collect()
    assert len(got) == 6 and all(a[2] < b[1] for a, b in zip(got, got[1:]))


def test_strategy_registry(spark):
    G.register_strategy("none", lambda bars: G.momentum_signals(bars).limit(0))
    assert G.generate_signals(derived.bars(spark, SMALL), names=("none",)).count() == 0
