"""Streams over the given tables, run to the end of the landed files, against their batch SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.plans.sqlkit import BARS, LATENCY, rounded, rsql, with_sql
from marketframe.plans.text_queries import STORE_CTES
from marketframe.session import checkpoint_folder
from marketframe.sources import derived, sinks
from marketframe.streaming import pipelines as T

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files: a pattern may name either, a path only a folder."""
    schema = derived.read(spark, folder, table).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}[.]parquet")


def _finished(df: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run a stream over what has landed; each batch, in the given shape, writes its own folder, so a retry replaces it."""
    spark = df.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    query = T.run_available(df, write, f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def q_bars(spark, folder):
    ticks = _stream(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))
    out = _finished(T.bars(ticks))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def q_alerts(spark, folder):
    events = _stream(spark, folder, "events")
    metric = F.when(F.col("event_type") == "click", "signal_to_order").when(F.col("event_type") == "view", "order_submission")
    metric = metric.when(F.col("event_type") == "purchase", "broker_response").when(F.col("event_type") == "signup", "end_to_end")
    latency = events.select("event_id", metric.otherwise("network_rtt").alias("metric"), F.col("value").alias("latency_ms"))
    return _finished(T.latency_alerts(latency))


_add(
    "st8_stream_bars",
    q_bars,
    with_sql([BARS], "select * from bars where ts + interval 1 hour <= (select max(ts) from events) - interval 10 minute"),
)
_add(
    "st5_stream_latency_alerts",
    q_alerts,
    with_sql([LATENCY], """select event_id, metric, latency_ms, threshold, case when latency_ms > 2 * threshold then 'HIGH' else 'MEDIUM' end as severity from
    (select *, case metric when 'signal_to_order' then 5 when 'order_submission' then 10 when 'broker_response' then 50 when 'end_to_end' then 100 end::double as threshold from latency) where latency_ms > threshold"""),
)
_add(
    "st4_latest_bar",
    lambda s, f: B.latest_bar(derived.bars(s, f)),
    with_sql([BARS], "select * from bars qualify row_number() over (partition by symbol order by ts desc) = 1"),
)


def q_latest(spark, folder):
    """Latest tick per symbol, kept up to date by a stream; each batch hands out all symbols, the last one counts."""
    ticks = _stream(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    base = f"{checkpoint_folder(spark)}/latest-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    T.run_available(T.latest_per_symbol(ticks, tie=["event_id"]), write, f"{base}/checkpoint", mode="complete").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    newest = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == newest).drop("batch")


_add(
    "st4_stream_latest",
    q_latest,
    "select event_type as symbol, ts, event_id, value from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1",
)


def q_news_events(spark, folder):
    events = _finished(T.news_events(derived.news_of(_stream(spark, folder, "documents"))))
    return events.select("event_id", "doc_id", "event_type", "ticker")


def q_rates(spark, folder):
    log = _stream(spark, folder, "events").select("ts", F.when(F.col("event_type") == "purchase", "filled").otherwise("submitted").alias("status"))
    return _finished(T.rates_per_minute(log)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def q_near(spark, folder):
    bars = _stream(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"))
    other = _stream(spark, folder, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id")
    # all pairs are met, but only their sums are kept: the pairs grow with the square of the events
    sums = lambda met: met.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("event_id").alias("ids"))
    near = _finished(T.events_near_bars(bars, other, totals=["event_id"]), sums)
    return near.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def q_streaks(spark, folder):
    errors = _stream(spark, folder, "events").filter(F.col("event_type") == "error").select((F.col("user_id") % 3).cast("string").alias("source"), "ts")
    out = _finished(T.error_streaks(errors, "60 minutes"))
    return out.withColumn("first_error", F.col("first_error").cast("timestamp_ntz"))


def q_refresh(spark, folder):
    """Features of bars that arrive in three batches, read back from the refreshed store."""
    base = f"{checkpoint_folder(spark)}/refresh-{uuid.uuid4().hex}"
    write = T.refresh_features(f"{base}/bars", 3, lambda b: b.withColumn("range", F.col("high") - F.col("low")), f"{base}/features")
    bars = derived.bars(spark, folder)
    for batch in (2, 0, 1):
        write(bars.filter(F.pmod(F.xxhash64("symbol", "ts"), F.lit(3)) == batch), batch)
    return sinks.read_features(spark, f"{base}/features").select("symbol", "ts", "range")


def q_order_updates(spark, folder):
    """Every line of an order is an update with the quantity filled so far."""
    items = _stream(spark, folder, "lineitem")
    updates = items.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"),
        (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.lit("partially_filled").alias("status"), F.col("l_quantity").alias("filled_qty"), F.col("l_extendedprice").alias("filled_avg_price"),
    )
    fills = _finished(T.order_fills(updates, idle_minutes=100 * 365 * 24 * 60))
    return fills.select("order_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "fill_quantity", "fill_price", "latency_ms")


_add(
    "st10_stream_order_fills",
    q_order_updates,
    """select order_id, ts, seq, filled_qty - best as fill_quantity, price as fill_price, date_diff('millisecond', first, ts) as latency_ms from (
    select l_orderkey as order_id, l_shipdate::timestamp as ts, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as seq, l_quantity as filled_qty, l_extendedprice as price,
    coalesce(max(l_quantity) over (partition by l_orderkey order by l_shipdate, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey rows between unbounded preceding and 1 preceding), 0) as best,
    min(l_shipdate::timestamp) over (partition by l_orderkey) as first from lineitem) where filled_qty > best""",
)
_add("st3_s15_refreshed_features", lambda s, f: rounded(q_refresh(s, f)), rsql(with_sql([BARS], "select symbol, ts, high - low as range from bars"), ["symbol", "ts"], ["range"]))
_add("st2_stream_news_events", q_news_events, with_sql(STORE_CTES, "select event_id, doc_id, event_type, ticker from store"))
_add(
    "st7_stream_rates",
    q_rates,
    """select date_trunc('minute', ts)::timestamp as window_start, count(*) as orders, count(*) filter (event_type = 'purchase') as filled from events group by 1
    having window_start + interval 1 minute <= (select max(ts) from events) - interval 10 minute""",
)
_add(
    "st6_stream_events_near_bars",
    q_near,
    """select b.event_type as symbol, count(*) as n, sum(e.event_id)::bigint as ids from events b join events e on b.event_type = e.event_type
    and e.ts > b.ts - interval 1 hour and e.ts < b.ts + interval 1 hour group by 1""",
)
_add(
    "st9_stream_error_streaks",
    q_streaks,
    """select source, min(ts)::timestamp as first_error, count(*) as streak, count(*) >= 3 as halt, count(*) >= 5 as circuit_breaker from (
    select *, sum(new) over (partition by source order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by source order by ts, event_id) < interval 60 minute then 0 else 1 end as new
    from (select event_id, cast(user_id % 3 as varchar) as source, ts from events where event_type = 'error')))
    group by source, k having max(ts) + interval 60 minute <= (select max(ts) from events where event_type = 'error') - interval 10 minute""",
)
