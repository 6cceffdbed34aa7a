"""Writers: feature cache, backtest exports, registry rows and optional SQL stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, folder: str) -> None:
    """Feature matrix by date and symbol, sorted inside the files; only the days and symbols written are replaced.

    The folder names carry a copy of the symbol, so that its type survives the way through them.
    """
    dated = features.withColumns({"date": F.to_date("ts"), "_part": F.concat(F.lit("s"), F.col("symbol").cast("string"))})
    dated.repartition("date", "_part").sortWithinPartitions("date", "_part", "ts").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("date", "_part").parquet(folder)


def read_features(spark: SparkSession, folder: str, symbols=(), start=None, end=None) -> DataFrame:
    """Cached features; dates prune partitions, symbols are pushed to the files."""
    out = spark.read.parquet(folder)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    if symbols:
        out = out.filter(F.col("_part").isin([f"s{s}" for s in symbols]))
    return out.drop("date", "_part")


def export_backtest(equity: DataFrame, fills: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Equity curve and transactions as CSV, metrics as JSON (one folder each)."""
    equity.write.mode("overwrite").option("header", True).csv(f"{folder}/equity_curve")
    fills.write.mode("overwrite").option("header", True).csv(f"{folder}/transactions")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")


def write_report(report: DataFrame, folder: str) -> None:
    """Walk-forward report as JSON."""
    report.write.mode("overwrite").json(folder)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a SQL table; each task writes its own rows."""
    df.write.mode("append").format("jdbc").options(url=url, dbtable=table, **options).save()
