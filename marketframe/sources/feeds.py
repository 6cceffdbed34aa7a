"""Readers for landed files: bars, news, calendars, macro series and symbol lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators.lineage import cut

BAR_SCHEMA = "ts timestamp_ntz, open double, high double, low double, close double, volume double"
NEWS_SCHEMA = (
    "doc_id long, published_at timestamp_ntz, title string, content string, description string, source string, "
    "url string, target_symbol string, raw string"
)
CALENDAR_SCHEMA = (
    "symbol string, event_type string, event_time timestamp_ntz, description string, impact_level string, "
    "metadata map<string,string>"
)
MACRO_SCHEMA = "id string, description string, frequency string"


def read_bar_files(spark: SparkSession, folder: str, start=None, end=None, lookback_days: int = 0) -> DataFrame:
    """Bars from files, or folders of files, named ``{symbol}_market_data.csv``; the symbol comes from the name."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv(f"{folder}/*_market_data.csv")
    path = F.col("_metadata.file_path")
    out = raw.select(F.regexp_extract(path, r"([^/=]+)_market_data\.csv(?:/[^/]*)?$", 1).alias("symbol"), *raw.columns)
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {int(lookback_days)} days"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def write_bar_files(bars: DataFrame, folder: str) -> None:
    """One folder of CSV files per symbol, named so that :func:`read_bar_files` finds them."""
    named = bars.withColumn("file", F.concat("symbol", F.lit("_market_data.csv")))
    named.select("file", "ts", "open", "high", "low", "close", "volume").write.option("header", True).mode("overwrite").partitionBy("file").csv(folder)


def read_news_files(spark: SparkSession, path: str, fmt: str = "csv", start=None, end=None) -> DataFrame:
    """News under the library's names; null symbol means market-wide."""
    reader = spark.read.schema(NEWS_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    out = normalise_news(reader.format(fmt).load(path))
    return between(out, "ts", start, end)


def write_news_files(news: DataFrame, path: str, fmt: str = "csv") -> None:
    """News under the names of the feeds; texts keep their quotes, line breaks and outer blanks."""
    names = {"ts": "published_at", "symbol": "target_symbol"}
    known = [f.split(" ")[0] for f in NEWS_SCHEMA.split(", ")]
    out = news.withColumnsRenamed({c: n for c, n in names.items() if c in news.columns})
    out = out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in known])
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def normalise_news(raw: DataFrame) -> DataFrame:
    """Map the feeds' differing names for publish time and symbol to ``ts`` and ``symbol``."""
    names = {
        "ts": ["published_at", "published_date", "publishedAt", "timestamp"],
        "symbol": ["target_symbol", "ticker"],
    }
    out = raw
    for target, sources in names.items():
        present = [c for c in sources if c in out.columns]
        if target not in out.columns:
            out = out.withColumn(target, F.coalesce(*present) if present else F.lit(None).cast("string"))
        out = out.drop(*present)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Closed range filter; skipped when the column is missing."""
    if column not in df.columns:
        return df
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df


def read_calendar(spark: SparkSession, *paths: str, fmt: str = "json") -> DataFrame:
    """Union of calendar feeds (earnings, macro, unlocks) landed as files."""
    from marketframe.operators.event_store import combine_calendar

    return combine_calendar(*[spark.read.schema(CALENDAR_SCHEMA).format(fmt).load(p) for p in paths])


def read_macro_series(spark: SparkSession, path: str) -> DataFrame:
    """Dimension of macro series: id, description, frequency."""
    return spark.read.schema(MACRO_SCHEMA).option("header", True).csv(path)


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols written as ``- SYMBOL`` bullet lines."""
    lines = spark.read.text(path)
    return lines.filter(F.startswith("value", F.lit("- "))).select(
        F.trim(F.replace("value", F.lit("- "), F.lit(""))).alias("symbol")
    )


def _mentions(text: Column, query: str) -> Column:
    """Query terms joined by OR; any of them must occur."""
    terms = [t.strip().lower() for t in query.split(" OR ") if t.strip()]
    cond = F.contains(text, F.lit(terms[0]))
    for term in terms[1:]:
        cond = cond | F.contains(text, F.lit(term))
    return cond


def search_news(
    news: DataFrame,
    query: str,
    start=None,
    end=None,
    language: str | None = "en",
    page_size: int | None = None,
) -> DataFrame:
    """Newest articles that contain one of the OR-ed query terms in title or content."""
    out = between(news, "ts", start, end)
    if language and "lang" in out.columns:
        out = out.filter(F.col("lang") == language)
    text = F.lower(F.concat_ws(" ", "title", "content"))
    out = out.filter(_mentions(text, query))
    return out if page_size is None else out.orderBy(F.desc("ts"), F.asc("doc_id")).limit(page_size)


MARKET_QUERY = "stock market OR trading OR finance"


def trailing_news(times: DataFrame, news: DataFrame, hours: float) -> DataFrame:
    """Pairs of every time (distinct ``ts`` of ``times``) and the news of the ``hours`` up to it, ends included.

    Both meet by slots of that length: a time sees its own slot and the one before, news go to one slot. A frequent slot
    can be split by adaptive execution, as neither side of the join is an aggregate.
    """
    width = int(hours * 3_600_000_000)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slot = lambda c: F.floor(us(c) / F.lit(width))
    wanted = cut(times.select(F.col("ts").alias("at")).filter(F.col("at").isNotNull()).distinct())
    wanted = wanted.withColumn("_slot", F.explode(F.array(slot("at") - 1, slot("at"))))
    dated = news.withColumn("_slot", slot("ts"))
    found = wanted.join(dated, "_slot").filter((F.col("ts") <= F.col("at")) & (us("ts") >= us("at") - width))
    return found.drop("_slot")


def market_news(news: DataFrame, **kwargs) -> DataFrame:
    return search_news(news, MARKET_QUERY, **kwargs)


def company_news(news: DataFrame, companies: DataFrame, name: str = "company", start=None, end=None) -> DataFrame:
    """News of every company in a table, matched by name for all companies in one join."""
    from marketframe.functions.text import match_dictionary

    dated = between(news, "ts", start, end)
    hits = match_dictionary(dated, companies, word=name)
    return dated.join(hits, "doc_id")


def symbol_coverage(universe: DataFrame, bars: DataFrame, as_of: str) -> DataFrame:
    """Bars per symbol of the universe: any in the last 10 days, any in the last day."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = bars.filter((F.col("ts") > end - F.expr("interval 10 days")) & (F.col("ts") <= end))
    counts = recent.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars_10d"),
        F.count_if(F.col("ts") > end - F.expr("interval 1 day")).alias("bars_1d"),
    )
    out = universe.join(counts, "symbol", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("bars_10d", "bars_1d")}).withColumns(
        {"has_daily": F.col("bars_10d") > 0, "has_minute": F.col("bars_1d") > 0}
    )


def uncovered(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Symbols of the universe without any bar."""
    return universe.join(bars.select("symbol"), "symbol", "left_anti")


def tag_and_union(market: DataFrame, company: DataFrame) -> DataFrame:
    """Market-wide news (null symbol) and company news in one table."""
    return market.withColumn("symbol", F.lit(None).cast("string")).unionByName(company, allowMissingColumns=True)


