"""Streams over landed files agree with the batch operators for on-time data."""

import os
import shutil
from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators import latency as L
from marketframe.operators import orders as O
from marketframe.sources import derived
from marketframe.streaming import pipelines as T


def collect(df, folder, mode="append"):
    out = str(folder / "out")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = T.run_available(df, write, str(folder / "ckpt"), mode)
    query.awaitTermination(120)
    return df.sparkSession.read.parquet(out)


def land(df, folder, files=4):
    path = str(folder / "in")
    df.repartitionByRange(files, "ts").write.parquet(path)
    return path


@pytest.fixture()
def ticks(spark, tmp_path):
    df = derived.ticks(spark, SMALL)
    return df, T.landed(spark, land(df, tmp_path), "symbol string, ts timestamp_ntz, price double")


def test_bars(spark, ticks, tmp_path):
    df, stream = ticks
    got = collect(T.bars(stream), tmp_path).drop("batch").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = B.bars_from_ticks(df)
    assert got.exceptAll(want).count() == 0
    assert want.count() - got.count() < 12  # periods the watermark has not closed


def test_latest(spark, ticks, tmp_path):
    df, stream = ticks
    got = collect(T.latest_per_symbol(stream), tmp_path, "update")
    last = got.groupBy("symbol").agg(F.max("ts").alias("ts"))
    assert last.exceptAll(df.groupBy("symbol").agg(F.max("ts").alias("ts"))).count() == 0


def test_alerts_and_counts(spark, tmp_path):
    df = derived.latency(spark, SMALL)
    stream = T.landed(spark, land(df, tmp_path), "event_id long, order_id long, metric string, ts timestamp_ntz, latency_ms double")
    got = collect(T.latency_alerts(stream), tmp_path).drop("batch")
    assert got.count() == L.alerts(df).count()
    (tmp_path / "c").mkdir()
    counts = collect(T.alert_counts(stream), tmp_path / "c")
    assert 0 < counts.agg(F.sum("n_alerts")).first()[0] <= got.count()


def test_news_events_are_not_repeated(spark, tmp_path):
    df = derived.news(spark, SMALL)
    schema = "doc_id long, ts timestamp_ntz, title string, content string, source string, lang string, symbol string"
    stream = T.landed(spark, land(df.unionByName(df), tmp_path, 1), schema)
    got = collect(T.news_events(stream), tmp_path)
    assert got.count() == got.select("event_id").distinct().count() > 0


def test_interval_join(spark, tmp_path):
    bars = derived.bars(spark, SMALL)
    (tmp_path / "b").mkdir()
    (tmp_path / "e").mkdir()
    events = derived.detections(spark, SMALL)
    left = T.landed(spark, land(bars, tmp_path / "b", 1), "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    right = T.landed(spark, land(events, tmp_path / "e", 1), "event_id long, symbol string, ts timestamp_ntz, event_type string, impact_score double")
    got = collect(T.events_near_bars(left, right), tmp_path)
    want = bars.alias("b").join(events.alias("e"), F.expr("b.symbol = e.symbol and abs(unix_micros(cast(e.ts as timestamp)) - unix_micros(cast(b.ts as timestamp))) < 3600000000"))
    assert got.count() == want.count()


def test_order_updates_become_fills(spark, tmp_path):
    items = derived.read(spark, SMALL, "lineitem")
    updates = items.select(F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"), F.lit("partially_filled").alias("status"), F.col("l_quantity").alias("filled_qty"), F.col("l_extendedprice").alias("filled_avg_price"))
    stream = T.landed(spark, land(updates, tmp_path, 1), "order_id long, ts timestamp_ntz, status string, filled_qty double, filled_avg_price double")
    got = collect(T.order_fills(stream), tmp_path)
    want = O.incremental_fills(updates.withColumn("seq", F.col("filled_qty")))
    assert got.agg(F.sum("fill_quantity")).first()[0] == pytest.approx(want.agg(F.sum("fill_quantity")).first()[0])


def test_order_state_is_dropped_by_a_timer(spark, tmp_path):
    """An idle order is forgotten once the watermark passes its timer; before that only increases count."""
    schema = "order_id long, ts timestamp_ntz, seq long, status string, filled_qty double, filled_avg_price double"
    steps = [
        [(1, "2024-01-01 10:00:00", 1, 5.0), (1, "2024-01-01 10:00:00", 0, 2.0), (2, "2024-01-01 10:00:01", 0, 1.0)],
        [(1, "2024-01-01 10:30:00", 0, 5.0), (1, "2024-01-01 10:31:00", 0, 6.0), (3, "2024-01-01 10:31:00", 0, None)],
        [(4, "2024-01-03 00:00:00", 0, 1.0)],
        [(4, "2024-01-03 00:10:00", 0, 1.0)],
        [(1, "2024-01-03 00:20:00", 0, 7.0)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(steps):
        batch = spark.createDataFrame([(i, datetime.fromisoformat(t), s, "filled", q, 9.5) for i, t, s, q in rows], schema)
        batch.coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        part = next((tmp_path / f"b{n}").glob("part-*.parquet"))
        shutil.copy(part, folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = T.landed(spark, str(folder), schema, files_per_trigger=1)
    got = sorted((r.order_id, r.fill_quantity, r.latency_ms) for r in collect(T.order_fills(stream, idle_minutes=60), tmp_path).collect())
    assert got == [(1, 1.0, 31 * 60_000), (1, 2.0, 0), (1, 3.0, 0), (1, 7.0, 0), (2, 1.0, 0), (4, 1.0, 0)]


def test_rates_streaks_and_refresh(spark, tmp_path):
    log = derived.order_log(spark, SMALL).withColumnRenamed("created_at", "ts")
    stream = T.landed(spark, land(log, tmp_path), "order_id long, portfolio string, ts timestamp_ntz, status string, order_value double, signal_id long")
    assert collect(T.rates_per_minute(stream), tmp_path).count() > 0
    (tmp_path / "s").mkdir()
    errors = derived.ticks(spark, SMALL).filter("symbol = 'error'").select(F.lit("x").alias("source"), "ts")
    es = T.landed(spark, land(errors, tmp_path / "s"), "source string, ts timestamp_ntz")
    assert collect(T.error_streaks(es, "120 minutes"), tmp_path / "s").filter("halt").count() > 0
    (tmp_path / "r").mkdir()
    bars = derived.bars(spark, SMALL)
    bs = T.landed(spark, land(bars, tmp_path / "r"), "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double", files_per_trigger=1)
    writer = T.refresh_features(str(tmp_path / "r/store"), 5, lambda b: b.withColumn("range", F.col("high") - F.col("low")), str(tmp_path / "r/out"))
    T.run_available(bs, writer, str(tmp_path / "r/ckpt")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "r/out"))
    assert out.count() == out.select("symbol", "ts").distinct().count() == bars.count()
    # a corrected bar counts once, in its latest version
    fixed = bars.orderBy("symbol", "ts").limit(1).withColumn("high", F.lit(1e6))
    writer(fixed, 10_000)
    again = spark.read.parquet(str(tmp_path / "r/out"))
    assert again.count() == bars.count() and again.filter("high = 1e6").count() == 1


def test_ingest_goes_on_after_a_failed_sink(spark, tmp_path):
    """A batch that broke off after writing part of its rows is written again as a whole; a repeated file adds nothing."""
    log = derived.order_log(spark, SMALL).withColumnRenamed("created_at", "ts")
    schema = "order_id long, portfolio string, ts timestamp_ntz, status string, order_value double, signal_id long"
    landing = land(log, tmp_path, 4)
    log.filter("order_id % 3 = 0").coalesce(1).write.mode("append").parquet(landing)
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "check")

    def broken(batch, batch_id):
        batch.filter(f"order_id % 2 = 0 or {batch_id} < 2").write.mode("overwrite").parquet(f"{store}/orders/batch={batch_id}")
        if batch_id == 2:
            raise RuntimeError("the sink is away")

    stream = lambda: T.landed(spark, landing, schema, files_per_trigger=1)
    first = T.run_available(stream(), broken, f"{checkpoint}/orders")
    with pytest.raises(Exception, match="the sink is away"):
        first.awaitTermination(120)
    assert 0 < T.ingested(spark, store, "orders", ["order_id"]).count() < log.count()
    for _ in range(2):  # a run without new files changes nothing
        for query in T.ingest({"orders": stream()}, store, checkpoint):
            query.awaitTermination(120)
        got = T.ingested(spark, store, "orders", ["order_id"])
        assert got.count() == log.count() and got.select(log.columns).exceptAll(log).count() == 0
