"""Latency measurements: statistics, percentiles, alerts, per-order components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import lit_map
from marketframe.operators.ranking import exact_quantiles, top_k

# Alert thresholds in milliseconds.
THRESHOLDS = {"signal_to_order": 5.0, "order_submission": 10.0, "broker_response": 50.0, "end_to_end": 100.0}
COMPONENTS = ["signal_to_order", "order_creation", "order_validation", "order_submission", "broker_response"]
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p99_9": 0.999}


def recent(latency: DataFrame, last: int) -> DataFrame:
    """The latest measurements of every metric."""
    return top_k(latency, ["metric"], [F.desc("ts"), F.desc("event_id")], last)


def latency_stats(latency: DataFrame, last: int | None = None) -> DataFrame:
    """Count, mean, median, p95, p99, range and deviation per metric; with ``last`` over so many of its latest measurements."""
    rows = recent(latency, last) if last else latency
    basic = rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("count"), F.avg("latency_ms").alias("mean"), F.min("latency_ms").alias("min_value"),
        F.max("latency_ms").alias("max_value"), F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("std_dev"),
    )
    median = exact_quantiles(rows, ["metric"], "latency_ms", {"median": 0.5})
    tails = exact_quantiles(rows, ["metric"], "latency_ms", {"p95": 0.95, "p99": 0.99}, interpolate=False)
    return basic.join(median, "metric").join(tails, "metric")


def percentile_breakdown(latency: DataFrame, last: int | None = None) -> DataFrame:
    rows = recent(latency, last) if last else latency
    return exact_quantiles(rows, ["metric"], "latency_ms", PERCENTILES, interpolate=False)


def alerts(latency: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Measurements above their metric's threshold; HIGH above twice the threshold."""
    limits = lit_map({**THRESHOLDS, **(thresholds or {})})
    out = latency.withColumn("threshold", F.try_element_at(limits, F.col("metric")))
    out = out.filter(F.col("latency_ms") > F.col("threshold"))
    return out.withColumn("severity", F.when(F.col("latency_ms") > F.col("threshold") * 2, "HIGH").otherwise("MEDIUM"))


def recent_alerts(latency: DataFrame, n: int | None = None) -> DataFrame:
    """Alerts, newest first; with ``n`` so many."""
    out = alerts(latency).orderBy(F.desc("ts"), F.desc("event_id"))
    return out if n is None else out.limit(n)


def latency_summary(latency: DataFrame, alert_seconds: int = 300) -> DataFrame:
    """One row: orders, mean latency per order, orders per second, metrics and recent alerts."""
    total = latency.agg(
        F.count_if(F.col("metric") == "end_to_end").alias("total_orders"),
        F.sum("latency_ms").alias("_sum"),
        F.count_distinct("metric").alias("metrics_tracked"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
    )
    late = alerts(latency).crossJoin(F.broadcast(total.select("_last")))  # one row
    n = late.filter(F.col("ts") > F.col("_last") - F.expr(f"interval {alert_seconds} seconds")).agg(
        F.count(F.lit(1)).alias("recent_alerts")
    )
    seconds = (F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))) / 1e6
    orders = F.greatest(F.col("total_orders"), F.lit(1))
    out = total.crossJoin(F.broadcast(n))  # one row each
    return out.select(
        "total_orders", (F.col("_sum") / orders).alias("average_latency"),
        (F.col("total_orders") / F.greatest(seconds, F.lit(1.0))).alias("orders_per_second"),
        "metrics_tracked", "recent_alerts",
    )


def order_components(latency: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Last value of each component per order and their total."""
    last = latency.groupBy("order_id").agg(
        *[
            F.max_by("latency_ms", F.when(F.col("metric") == m, F.struct("ts", "event_id"))).alias(m)
            for m in components
        ]
    )
    total = F.lit(0.0)
    for m in components:
        total = total + F.coalesce(m, F.lit(0.0))
    return last.withColumn("total_latency", total)
