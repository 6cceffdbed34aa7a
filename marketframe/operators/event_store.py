"""Detected events as tables: the news-to-events pipeline, the store, its queries and statistics."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketframe.functions import text as X
from marketframe.functions.numeric import flag, us
from marketframe.operators.lineage import cut

EVENT_COLUMNS = [
    "event_id", "doc_id", "ts", "title", "description", "entity", "event_type", "classification_confidence",
    "impact_level", "impact_score", "price_target_change", "volatility_increase", "time_horizon", "impact_confidence",
    "source_name", "ticker", "sector",
]


def event_id() -> Column:
    """Deterministic key, so that storing the same event twice writes the same id."""
    return F.sha2(F.concat_ws("|", "title", "event_type", F.col("ts").cast("string"), "source", F.col("doc_id").cast("string")), 256)


def news_to_events(news: DataFrame, min_impact: float = 0.3, conditions=None) -> DataFrame:
    """Detect, score and link the events of every article; one narrow stage, no shuffle.

    The event time is the article's own time. ``entities`` is computed once per article.
    """
    # only articles with events are linked: without a text there is nothing to search
    found = X.link_entities(X.detect(news), F.when(F.size("detected") > 0, F.col("_full")))
    linked = found.withColumns({"_ticker": X.primary_ticker(F.col("entities")), "_sector": X.primary_sector(F.col("entities"))})
    # the article's ticker and sector travel inside the exploded struct: a later filter on them
    # then stays above the explode instead of repeating the linking inside a filter below it
    tagged = F.transform(
        "detected",
        lambda d: F.struct(
            d["event_type"].alias("event_type"),
            d["confidence"].alias("confidence"),
            F.col("_ticker").alias("ticker"),
            F.col("_sector").alias("sector"),
        ),
    )
    rows = linked.select(
        "doc_id", "ts", "source", "entity", "entities",
        F.col("_title").alias("title"),
        X.truncated(F.col("_content"), 200).alias("description"),
        F.col("_content").alias("content"),
        F.explode_outer(tagged).alias("_e"),
    ).filter(F.col("_e").isNotNull())
    scored = X.score_impact(rows.select("*", "_e.*").drop("_e"), conditions)
    return scored.filter(F.col("impact_score") >= min_impact).withColumns(
        {"event_id": event_id(), "classification_confidence": F.col("confidence"), "source_name": F.col("source")}
    ).select(*EVENT_COLUMNS, "entities")


def event_entities(events: DataFrame) -> DataFrame:
    """Child rows of the stored events."""
    return X.explode_entities(events, ["event_id"])


def write_events(events: DataFrame, folder: str, batch: str | int | None = None) -> None:
    """Add events and entities to the store, as Parquet by event date and batch.

    A batch replaces only what the same batch wrote before, so batches of one date stand side by side and a
    repeated batch changes nothing. Without a name a batch gets a new one; ids are deterministic, and
    :func:`read_events` returns an event that several batches hold once. The events are computed once for both tables.
    """
    name = str(uuid.uuid4().hex if batch is None else batch)
    dated = cut(events.withColumns({"date": F.to_date("ts"), "batch": F.lit(f"b{name}")}))
    for part, table in (
        ("events", dated.drop("entities")),
        ("entities", X.explode_entities(dated, ["event_id", "date", "batch"])),
    ):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(
            f"{folder}/{part}"
        )


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events, each once."""
    return spark.read.parquet(f"{folder}/events").drop("batch", "date").dropDuplicates(["event_id"])


def read_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of the stored events, each once."""
    return spark.read.parquet(f"{folder}/entities").drop("batch", "date").distinct()


def query_events(
    events: DataFrame,
    event_type: str | None = None,
    ticker: str | None = None,
    min_impact: float | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
    tie: str = "event_id",
) -> DataFrame:
    """Stored events by optional filters; with ``limit`` the newest, newest first. An empty or zero filter is no filter."""
    out = filter_events(events, event_type, ticker, min_impact, start, end)
    if limit is None:
        return out
    return out.orderBy(F.desc("ts"), F.asc(tie)).limit(limit)


def filter_events(events, event_type=None, ticker=None, min_impact=None, start=None, end=None) -> DataFrame:
    out = events
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    if ticker:
        out = out.filter(F.col("ticker") == ticker)
    if min_impact:
        out = out.filter(F.col("impact_score") >= min_impact)
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def events_for_features(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events that can influence features in [start, end]: 60 days before to 30 days after."""
    return events.filter(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz") - F.expr("interval 60 days"))
        & (F.col("ts") <= F.lit(end).cast("timestamp_ntz") + F.expr("interval 30 days"))
    )


def statistics(events: DataFrame) -> DataFrame:
    """Totals and counts per type, level, ticker and sector in one pass (long format)."""
    return (
        events.groupingSets(
            [(F.col("event_type"),), (F.col("impact_level"),), (F.col("ticker"),), (F.col("sector"),), ()],
            "event_type", "impact_level", "ticker", "sector",
        )
        .agg(
            F.grouping_id().alias("_gid"),
            F.count(F.lit(1)).alias("n_events"),
            F.avg("impact_score").alias("avg_impact"),
            F.max("impact_score").alias("max_impact"),
            F.min("impact_score").alias("min_impact"),
            F.count_if(F.col("impact_score") >= 0.6).alias("high_impact"),
        )
        .withColumns(
            {
                "dimension": F.when(F.col("_gid") == 7, "event_type").when(F.col("_gid") == 11, "impact_level")
                .when(F.col("_gid") == 13, "ticker").when(F.col("_gid") == 14, "sector").otherwise("all"),
                "member": F.coalesce("event_type", "impact_level", "ticker", "sector"),
            }
        )
        .filter((F.col("dimension") == "all") | F.col("member").isNotNull())
        .select("dimension", "member", "n_events", "avg_impact", "max_impact", "min_impact", "high_impact")
    )


def distribution(events: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts per value, largest first (ties by value)."""
    out = events.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_events"))
    out = out.orderBy(F.desc("n_events"), F.asc(column))
    return out.limit(top) if top else out


def ticker_timeline(events: DataFrame, ticker: str, as_of: str, days: int = 30, min_impact: float = 0.4) -> DataFrame:
    end = F.lit(as_of).cast("timestamp_ntz")
    out = filter_events(events, ticker=ticker, min_impact=min_impact)
    out = out.filter((F.col("ts") >= end - F.expr(f"interval {days} days")) & (F.col("ts") <= end))
    return out.withColumns(
        {"date": F.to_date("ts"), "hour": F.hour("ts"), "day_of_week": F.date_format("ts", "EEEE")}
    )


def backtest_dataset(
    events: DataFrame, start: str, end: str, tickers: Sequence[str] = (), min_impact: float = 0.4
) -> DataFrame:
    out = filter_events(events, min_impact=min_impact, start=start, end=end)
    if tickers:
        out = out.filter(F.col("ticker").isin(list(tickers)))
    return out.withColumns(
        {
            "date": F.to_date("ts"),
            "time": F.date_format("ts", "HH:mm:ss"),
            "is_market_hours": F.hour("ts").between(9, 16),
            "is_weekend": F.weekday("ts") >= 5,
        }
    )


def market_moving(events: DataFrame, as_of: str, days: int = 7, min_impact: float = 0.7, limit: int | None = None) -> DataFrame:
    """Events above the threshold, most important first; with ``limit`` only so many of the latest."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = filter_events(events, min_impact=min_impact).filter(
        (F.col("ts") >= end - F.expr(f"interval {days} days")) & (F.col("ts") <= end)
    )
    latest = recent if limit is None else recent.orderBy(F.desc("ts"), F.asc("event_id")).limit(limit)
    return latest.orderBy(F.desc("impact_score"), F.asc("event_id"))


def with_counters(news: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, Observation, Observation]:
    """Attach article and event counters that are filled while the tables are computed."""
    articles, found = Observation("articles"), Observation("events")
    return (
        news.observe(articles, F.count(F.lit(1)).alias("articles_processed")),
        events.observe(
            found,
            F.count(F.lit(1)).alias("events_detected"),
            F.count_if(F.col("impact_score") >= 0.6).alias("high_impact_events"),
        ),
        articles,
        found,
    )


# ---------------------------------------------------------------- scheduled-event calendar


def combine_calendar(*feeds: DataFrame) -> DataFrame:
    """Union of the calendar feeds by column name."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def _time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def current_calendar(calendar: DataFrame, as_of: str) -> DataFrame:
    """Events that are not more than an hour old."""
    return calendar.filter(F.col("event_time") > _time(as_of) - F.expr("interval 1 hour"))


def upcoming(calendar: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    return calendar.filter(F.col("event_time") <= _time(as_of) + F.expr(f"interval {hours} hours"))


def calendar_for_symbol(calendar: DataFrame, symbol: str) -> DataFrame:
    return calendar.filter(F.upper("symbol") == symbol.upper())


def high_impact_calendar(calendar: DataFrame) -> DataFrame:
    return calendar.filter(F.lower("impact_level") == "high")


def calendar_report(calendar: DataFrame, as_of: str) -> DataFrame:
    hours = (us("event_time") - us(_time(as_of))) / 3.6e9
    return calendar.withColumns({"hours_until": hours, "is_crypto": flag(is_crypto("symbol"))})


def is_crypto(symbol: str) -> Column:
    return F.upper(symbol).rlike("BTC|ETH|SOL|ADA|DOT")
