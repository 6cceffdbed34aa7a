"""Structured Streaming versions of the operators; state is bounded by watermarks everywhere.

Sources are landing folders read with an explicit schema. The builders take and return
streaming (or batch) DataFrames; only :func:`run_available` starts a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketframe.functions.numeric import lit_map
from marketframe.operators.bars import TIMEFRAMES
from marketframe.operators.event_store import news_to_events
from marketframe.operators.latency import THRESHOLDS
from marketframe.operators.orders import map_status
from marketframe.session import checkpoint_folder
from marketframe.sources.sinks import write_features

LATE = "10 minutes"


def landed(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def run_available(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    mode: str = "append",
    every: str | None = None,
):
    """Start a query that hands each micro-batch to ``write`` (which must be idempotent per batch id).

    Without ``every`` it processes what is there and stops; with it, it polls at that interval.
    """
    writer = df.writeStream.outputMode(mode).foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint or checkpoint_folder(df.sparkSession))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def ingest(feeds: dict[str, DataFrame], store: str, checkpoint: str, every: str | None = None) -> list:
    """Start one query per landing feed that keeps its files as they come.

    A micro-batch is one folder, replaced as a whole, so a batch that is repeated after a failure changes nothing; the
    checkpoint knows which files have been taken. See :func:`ingested` for reading.
    """

    def keep(name: str) -> Callable[[DataFrame, int], None]:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{store}/{name}/batch={batch_id}")

        return write

    return [run_available(df, keep(name), f"{checkpoint}/{name}", every=every) for name, df in feeds.items()]


def ingested(spark: SparkSession, store: str, name: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """Rows of a feed, each of ``keys`` once: a row that came again counts as it came last."""
    reader = spark.read.schema(f"{schema}, batch long") if schema else spark.read
    rows = reader.option("basePath", f"{store}/{name}").parquet(f"{store}/{name}")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _with_event_time(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def news_events(news: DataFrame, min_impact: float = 0.3, late: str = LATE) -> DataFrame:
    """News to scored and linked events; an event id seen again within the watermark is dropped."""
    events = news_to_events(news, min_impact)
    return _with_event_time(events, late).dropDuplicatesWithinWatermark(["event_id"])


def bars(ticks: DataFrame, timeframe: str = "1h", late: str = LATE) -> DataFrame:
    """OHLC bars of ticks (symbol, ts, price), emitted when their period is closed by the watermark."""
    timed = _with_event_time(ticks, late)
    return (
        timed.groupBy(F.window("ts", TIMEFRAMES[timeframe]).alias("_w"), "symbol")
        .agg(
            F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", F.struct("ts", "price")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def latest_per_symbol(bars: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Most recent bar per symbol (update or complete mode; one row of state per symbol); ``tie`` decides equal times."""
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    latest = F.max_by(F.struct("ts", *rest), F.struct("ts", *tie, *[c for c in rest if c not in tie]))
    return bars.groupBy("symbol").agg(latest.alias("_b")).select("symbol", "_b.*")


def latency_alerts(latency: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Measurements above their metric's threshold (stateless)."""
    limits = lit_map({**THRESHOLDS, **(thresholds or {})})
    out = latency.withColumn("threshold", F.try_element_at(limits, F.col("metric")))
    out = out.filter(F.col("latency_ms") > F.col("threshold"))
    return out.withColumn("severity", F.when(F.col("latency_ms") > F.col("threshold") * 2, "HIGH").otherwise("MEDIUM"))


def alert_counts(latency: DataFrame, late: str = LATE) -> DataFrame:
    """Alerts per metric and five minutes."""
    timed = _with_event_time(latency_alerts(latency), late)
    out = timed.groupBy(F.window("ts", "5 minutes").alias("_w"), "metric").agg(F.count(F.lit(1)).alias("n_alerts"))
    return out.select(F.col("_w.start").alias("window_start"), "metric", "n_alerts")


def rates_per_minute(log: DataFrame, late: str = LATE) -> DataFrame:
    """Orders and filled orders per minute."""
    timed = _with_event_time(log, late)
    out = timed.groupBy(F.window("ts", "1 minute").alias("_w")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") == "filled").alias("filled")
    )
    return out.select(F.col("_w.start").alias("window_start"), "orders", "filled")


def events_near_bars(bars: DataFrame, events: DataFrame, late: str = LATE, totals: Sequence[str] | None = None) -> DataFrame:
    """Stream-stream interval join: events within one hour of a bar of their symbol.

    Both sides meet by symbol and hour (a bar goes to its own hour and the ones beside it), so a symbol's state is spread
    over tasks and a row is compared with an hour's rows only.

    The pairs grow with the square of the rows. With ``totals`` (whole-number columns of the events) they are met but not
    written out: rows are symbol, n and the sum of each column over the pairs that are new, some rows for each symbol and
    batch. A row finds those near it in the sorted times of the other side and takes their sums off running sums, so the
    work grows with the rows. The state of an hour (RocksDB; sets the session's state store) goes when the watermark has
    passed all that may still come near it.
    """
    hour = F.floor(F.unix_seconds("ts") / 3600)
    left = _with_event_time(bars, late).withColumn("_hour", F.explode(F.array(hour - 1, hour, hour + 1)))
    right = _with_event_time(events, late).withColumn("_hour", hour)
    if totals is not None:
        return _near_totals(left, right, list(totals))
    left, right = left.alias("b"), right.alias("e")
    near = F.expr(
        "b.symbol = e.symbol and b._hour = e._hour and e.ts > b.ts - interval 1 hour and e.ts < b.ts + interval 1 hour"
    )
    keep = [c for c in events.columns if c not in ("symbol", "ts")]
    return left.join(right, near).select(
        F.col("b.symbol").alias("symbol"), F.col("b.ts").alias("bar_ts"), F.col("e.ts").alias("event_ts"), *[F.col(f"e.{c}") for c in keep]
    )


def _near_totals(bars: DataFrame, events: DataFrame, totals: list[str]) -> DataFrame:
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # names that begin with an underscore do not reach pandas
    values = [f"value{i}" for i in range(len(totals))]
    same = ["symbol", F.col("_hour").alias("hour"), "ts", F.unix_micros("ts").alias("us")]
    # a missing value is 0 beside a mark: as one column of both pandas would make fractions of whole numbers
    none = [x for v in values for x in (F.lit(0).cast("long").alias(v), F.lit(False).alias(f"{v}_there"))]
    value = [F.col(c).cast("long") for c in totals]
    there = [x for c, v in zip(value, values) for x in (F.coalesce(c, F.lit(0).cast("long")).alias(v), c.isNotNull().alias(f"{v}_there"))]
    left, right = bars.select(*same, F.lit(True).alias("bar"), *none), events.select(*same, F.lit(False).alias("bar"), *there)
    both = left.unionByName(right).filter("symbol is not null and us is not null")
    kind = bars.schema["symbol"].dataType.simpleString()
    sums = both.groupBy("symbol", "hour").transformWithStateInPandas(
        _Near(values), f"symbol {kind}, n long" + "".join(f", {v} long" for v in values), "Append", "EventTime"
    )
    return sums.withColumnsRenamed(dict(zip(values, totals)))


class _Near(StatefulProcessor):
    """Counts and sums of the pairs of bars and events of one symbol and hour that are less than an hour apart.

    The state are the times of both sides and the values of the events, packed. New bars meet all events, new events the
    bars there were before: every pair once.
    """

    REACH_US = 3_600_000_000

    def __init__(self, values: list[str]):
        self.values = values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "bars binary, events binary")

    def _held(self) -> tuple[np.ndarray, np.ndarray]:
        """Times of bars; of events a row of times and, for each value, one of values and one of whether they are there."""
        bars, events = self.seen.get() if self.seen.exists() else (b"", b"")
        return np.frombuffer(bars, np.int64), np.frombuffer(events, np.int64).reshape(1 + 2 * len(self.values), -1)

    def _meet(self, bars: np.ndarray, events: np.ndarray) -> list[int]:
        """Pairs, and for each value its sum over the pairs and in how many it is there."""
        events = events[:, np.argsort(events[0], kind="stable")]
        low = np.searchsorted(events[0], bars - self.REACH_US, "right")
        high = np.searchsorted(events[0], bars + self.REACH_US, "left")
        out = [int((high - low).sum())]
        for row in events[1:]:
            # halves of a number cannot overflow in running sums, nor Python's whole numbers
            total = 0
            for part, unit in ((row >> 32, 1 << 32), (row & 0xFFFFFFFF, 1)):
                running = np.concatenate([[0], np.cumsum(part)])
                total += sum(int(s.sum()) for s in np.array_split(running[high] - running[low], len(bars) // 1024 + 1)) * unit
            out.append(total)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new_bars, new_events = [], []
        for some in rows:
            times, bar = some["us"].to_numpy(np.int64), some["bar"].to_numpy(bool)
            columns = [some[c].to_numpy(np.int64)[~bar] for v in self.values for c in (v, f"{v}_there")]
            new_bars.append(times[bar])
            new_events.append(np.stack([times[~bar], *columns]))
        old_bars, old_events = self._held()
        bars, events = np.concatenate([old_bars, *new_bars]), np.concatenate([old_events, *new_events], axis=1)
        first = self._meet(bars[len(old_bars) :], events)
        second = self._meet(old_bars, events[:, old_events.shape[1] :])
        met = [a + b for a, b in zip(first, second)]
        self.seen.update((bars.tobytes(), events.tobytes()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # the last bar that an event of this hour may meet is before the end of the next hour
        self.handle.registerTimer(max((int(key[1]) + 2) * 3_600_000, timerValues.getCurrentWatermarkInMs() + 1))
        if met[0]:
            sums = {v: pd.array([met[1 + 2 * i] if met[2 + 2 * i] else None], "Int64") for i, v in enumerate(self.values)}
            yield pd.DataFrame({"symbol": [key[0]], "n": [met[0]], **sums})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def error_streaks(errors: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """Runs of errors per source without a longer pause, as session windows."""
    timed = _with_event_time(errors, late)
    out = timed.groupBy("source", F.session_window("ts", gap).alias("_w")).agg(F.count(F.lit(1)).alias("streak"))
    return out.select("source", F.col("_w.start").alias("first_error"), "streak", (F.col("streak") >= 3).alias("halt"),
                      (F.col("streak") >= 5).alias("circuit_breaker"))


class _Fills(StatefulProcessor):
    """Best filled quantity and first time of the orders of one bucket; a timer drops those that have been idle.

    The state of a bucket is read and written as a whole and its updates are worked through together, so that an order
    costs no call of its own.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "order_id string, best double, first long, until long")

    def _held(self) -> pd.DataFrame:
        held = pd.DataFrame(list(self.seen.get()), columns=["order_id", "best", "first", "until"])
        return held.astype({"order_id": object, "best": "float64", "first": "int64", "until": "int64"})

    def _keep(self, held: pd.DataFrame) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(held):
            ids = [None if pd.isna(i) else i for i in held["order_id"]]
            self.seen.put(list(zip(ids, *[held[c].tolist() for c in ("best", "first", "until")])))
            self.handle.registerTimer(int(held["until"].min()))
        else:
            self.seen.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        updates = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable", ignore_index=True)
        held = self._held()
        # one number per order; a missing id is an order too
        both = pd.concat([held["order_id"], updates["order_id"].astype(object)], ignore_index=True)
        order, ids = pd.factorize(both.mask(both.isna(), None), use_na_sentinel=False)
        known, order = order[: len(held)], pd.Series(order[len(held) :])
        state = pd.DataFrame({"order_id": ids, "best": 0.0, "first": pd.NA, "until": 0})
        state.loc[known, ["best", "first", "until"]] = held[["best", "first", "until"]].astype({"first": object}).to_numpy(object)
        state = state.astype({"best": "float64", "first": "Int64", "until": "int64"})
        times = updates["ts"].astype("datetime64[us]").astype("int64") // 1000
        starts = times.groupby(order).first()  # in the order of ts
        first = state["first"].copy()
        first.loc[starts.index] = starts
        state["first"] = pd.concat([state["first"], first], axis=1).min(axis=1).astype("int64")
        quantity = updates["filled_qty"].fillna(0.0)
        best = state["best"].loc[order].reset_index(drop=True)
        before = quantity.groupby(order).cummax().groupby(order).shift(1)
        before = before.fillna(best).clip(lower=best)
        more = quantity > before
        most, last = quantity.groupby(order).max(), times.groupby(order).max()
        state.loc[most.index, "best"] = state["best"].loc[most.index].clip(lower=most)
        state.loc[last.index, "until"] = last.clip(lower=timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self._keep(state)
        if more.any():
            new = updates[more]
            yield pd.DataFrame(
                {
                    "order_id": new["order_id"], "ts": new["ts"], "seq": new["seq"], "status": new["status"],
                    "fill_quantity": (quantity - before)[more], "fill_price": new["filled_avg_price"],
                    "latency_ms": (times - state["first"].loc[order].reset_index(drop=True))[more],
                }
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self._keep(held[held["until"] > timerValues.getCurrentWatermarkInMs()])
        return iter([])

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of orders that keep their state together; a task works on one at a time.
FILL_BUCKETS = 512


def order_fills(updates: DataFrame, late: str = LATE, idle_minutes: int = 24 * 60, buckets: int = FILL_BUCKETS) -> DataFrame:
    """New fills out of cumulative broker updates (order_id, ts, status, filled_qty, filled_avg_price, and seq as order
    among equal times): the increase over the order's best so far, and the milliseconds since its first update.

    The state of an order is two numbers, kept in RocksDB (sets the session's state store) with those of the other orders
    of its bucket, a hash of the order id; a timer in event time drops them when no update came for ``idle_minutes``. An
    update of a dropped order starts anew. Missing quantities are 0. A checkpoint belongs to its number of buckets.
    """
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    seq = F.col("seq").cast("long") if "seq" in updates.columns else F.lit(0).cast("long")
    timed = _with_event_time(updates.withColumns({"status": map_status(F.col("status")), "seq": seq}), late)
    kind = updates.schema["order_id"].dataType.simpleString()
    timed = timed.select(
        F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("order_id").cast("string").alias("order_id"), "ts", "seq", "status",
        F.col("filled_qty").cast("double").alias("filled_qty"), F.col("filled_avg_price").cast("double").alias("filled_avg_price"),
    )
    fills = timed.groupBy("bucket").transformWithStateInPandas(
        _Fills(idle_minutes * 60_000),
        "order_id string, ts timestamp, seq long, status string, fill_quantity double, fill_price double, latency_ms long",
        "Append",
        "EventTime",
    )
    return fills.withColumn("order_id", F.col("order_id").cast(kind))


def refresh_features(
    store: str, lookback_days: int, features: Callable[[DataFrame], DataFrame], out: str
) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps bars by date and recomputes the features that a batch can change.

    Bars are stored by date and batch; of several versions of a bar that of the latest batch counts. A batch
    touches a symbol's days from its first bar to ``lookback_days`` after its last, so a late bar also renews the
    days that look back on it. Features are stored by date and symbol and replaced as a whole, so each bar has one
    row of features and a repeated batch leaves the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumns({"date": F.to_date("ts"), "batch": F.lit(batch_id)})
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(store)
        touched = dated.groupBy("symbol").agg(F.min("date").alias("_from"), F.date_add(F.max("date"), lookback_days).alias("_to"))
        bounds = dated.agg(F.min("date"), F.max("date")).first()
        if bounds[0] is None:
            return
        near = F.col("date").between(F.date_sub(F.lit(bounds[0]), lookback_days), F.date_add(F.lit(bounds[1]), lookback_days))
        rows = spark.read.parquet(store).filter(near).join(touched.select("symbol"), "symbol", "left_semi")
        rest = [c for c in rows.columns if c not in ("symbol", "ts", "date", "batch")]
        latest = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), "batch").alias("_bar")).select("symbol", "ts", "_bar.*")
        fresh = features(latest).join(touched, "symbol").filter(F.to_date("ts").between(F.col("_from"), F.col("_to")))
        write_features(fresh.drop("_from", "_to"), out)

    return write
