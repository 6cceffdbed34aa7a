"""Domain tables derived from the driver's Parquet tables (see FIXTURES.md, part B).

Each builder returns a lazy DataFrame over the whole input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NTZ = "timestamp_ntz"

# Headline stems put in front of the document text, chosen by doc_id % 10.
HEADLINES = [
    "Apple Inc. beats estimates as quarterly results show record revenue growth of 12.5%",
    "Microsoft announces acquisition agreement, a $3.2 billion takeover deal",
    "FDA approval for new drug lifts pharma shares, regulatory filing says",
    "CEO resigns at Tesla as board of directors names new chief executive",
    "Weekly digest",
    "Fed raises interest rate as inflation and cpi jobs report surprise, economic data weak",
    "Nvidia unveils breakthrough technology in new product launch",
    "Amazon and Intel sign partnership agreement, joint venture contract",
    "Analyst downgrade hits GOOG stock price, price target cut on heavy trading volume",
    "Earnings miss estimates, guidance lowered 8% after $450 million charge and lawsuit",
]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    return (
        events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast(NTZ).alias("hour"))
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("hour").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


# Event types in code order.
TYPE_CODES = [
    "earnings",
    "merger_acquisition",
    "product_launch",
    "regulatory",
    "leadership_change",
    "partnership",
    "legal_issue",
    "market_movement",
    "economic_data",
]


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Every event row seen as a detected event."""
    events = read(spark, folder, "events")
    code = (F.col("user_id") % 9).cast("int")
    return events.select(
        "event_id",
        F.col("event_type").alias("symbol"),
        "ts",
        F.get(F.array(*[F.lit(t) for t in TYPE_CODES]), code).alias("event_type"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("impact_score"),
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    return news_of(read(spark, folder, "documents"))


def news_of(docs: DataFrame) -> DataFrame:
    """News articles of a (streaming) table of documents."""
    stem = F.get(F.array(*[F.lit(h) for h in HEADLINES]), (F.col("doc_id") % 10).cast("int"))
    slot = F.col("doc_id") % 6
    symbol = (
        F.when(slot == 0, "click").when(slot == 1, "view").when(slot == 2, "purchase").when(slot == 3, "signup")
        .when(slot == 4, "error")
    )
    start = F.lit(1704067200)  # 2024-01-01 00:00:00 UTC
    return docs.select(
        "doc_id",
        F.timestamp_seconds(start + (F.col("doc_id") % 720) * 3600).cast(NTZ).alias("ts"),
        F.concat_ws(" ", stem, F.substring_index("text", "\n", 1)).alias("title"),
        F.col("text").alias("content"),
        "source",
        "lang",
        symbol.alias("symbol"),
    )


def spread(news: DataFrame) -> DataFrame:
    """The same rows in even parts, for work that costs much per row: a file may hold all its rows in one row group, which
    one task would read and work through."""
    return news.repartition(F.monotonically_increasing_id())


def fills(spark: SparkSession, folder: str) -> DataFrame:
    items, orders = read(spark, folder, "lineitem"), read(spark, folder, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("fill_no"),
        (F.col("o_custkey") % 20).cast("string").alias("portfolio"),
        F.col("o_orderdate").alias("ts"),
        (F.col("l_partkey") % 50).cast("string").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_extendedprice") * 0.001).alias("commission"),
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_custkey") % 20).cast("string").alias("portfolio"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "partially_filled")
        .otherwise("submitted").alias("status"),
        F.col("o_totalprice").alias("order_value"),
        F.col("o_custkey").alias("signal_id"),
    )


def latency(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    metric = (
        F.when(F.col("event_type") == "click", "signal_to_order")
        .when(F.col("event_type") == "view", "order_submission")
        .when(F.col("event_type") == "purchase", "broker_response")
        .when(F.col("event_type") == "signup", "end_to_end")
        .otherwise("network_rtt")
    )
    return events.select(
        "event_id", F.col("user_id").alias("order_id"), metric.alias("metric"), "ts", F.col("value").alias("latency_ms")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("pred_id"),
        F.col("event_type").alias("asset_id"),
        "ts",
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"),
        (F.col("event_id") % 1000 / 1000.0).alias("prediction_value"),
        (F.lit(0.5) + F.col("user_id") % 50 / 100.0).alias("confidence"),
        F.col("value"),
    )
