"""Round trips through files and stores: tables are written in the feeds' formats, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators import features as M
from marketframe.operators import ml as L
from marketframe.operators import performance as P
from marketframe.operators.lineage import cut
from marketframe.plans.performance_queries import QUERIES as PERFORMANCE
from marketframe.plans.performance_queries import SQL as PERFORMANCE_SQL
from marketframe.plans.sqlkit import BARS, FILLS, NEWS, rounded, rsql, with_sql
from marketframe.session import checkpoint_folder
from marketframe.sources import derived, feeds, sinks
from marketframe.streaming import pipelines as T

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ landed files


def q_bar_files(spark, folder):
    """Hourly bars as one CSV per symbol, read back from the tenth of January on with a look-back of five days."""
    path = _folder(spark, "bars")
    feeds.write_bar_files(derived.bars(spark, folder), path)
    return rounded(feeds.read_bar_files(spark, path, start="2024-01-10 00:00:00", end="2024-02-20 12:00:00", lookback_days=5))


_add(
    "s01_bar_files",
    q_bar_files,
    rsql(with_sql([BARS], "select * from bars where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-02-20 12:00:00'"), ["symbol", "ts"], ["open", "high", "low", "close", "volume"]),
)


def q_news_files(spark, folder):
    """All articles as quoted CSV, read back under the library's names with their whole texts."""
    path = _folder(spark, "news")
    feeds.write_news_files(derived.news(spark, folder), path)
    news = feeds.read_news_files(spark, path, start="2024-01-02 00:00:00")
    return news.select("doc_id", "ts", "symbol", "source", F.md5("title").alias("title"), F.md5("content").alias("content"))


_add(
    "s02_news_files",
    q_news_files,
    with_sql([NEWS], "select doc_id, ts, symbol, source, md5(title) as title, md5(content) as content from news where ts >= timestamp '2024-01-02 00:00:00'"),
)


def q_macro(spark, folder):
    """Macro series drawn from the nations: id, description, frequency."""
    path = _folder(spark, "macro")
    nation = derived.read(spark, folder, "nation")
    series = nation.select(F.concat(F.lit("SERIES"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.col("n_name"), F.lit(", seasonally adjusted")).alias("description"),
                           F.when(F.col("n_regionkey") % 2 == 0, "Monthly").otherwise("Quarterly").alias("frequency"))
    series.write.option("header", True).csv(path)
    return feeds.read_macro_series(spark, path)


_add(
    "s10_macro_series",
    q_macro,
    "select 'SERIES' || n_nationkey as id, n_name || ', seasonally adjusted' as description, case when n_regionkey % 2 = 0 then 'Monthly' else 'Quarterly' end as frequency from nation",
)


def q_universe(spark, folder):
    """Symbols as bullet lines between headings and remarks; one per customer."""
    path = _folder(spark, "universe")
    customer = derived.read(spark, folder, "customer").select("c_custkey")
    lines = customer.select(F.explode(F.array(F.concat(F.lit("## "), F.col("c_custkey").cast("string")), F.concat(F.lit("- S"), F.col("c_custkey").cast("string"), F.lit(" ")), F.lit("plain - line"))).alias("value"))
    lines.write.text(path)
    return feeds.read_symbol_list(spark, path)


_add("s11_symbol_list", q_universe, "select 'S' || c_custkey as symbol from customer")

# ------------------------------------------------------------------ models, exports, reports


def q_model_store(spark, folder):
    """Two versions of a model are stored; the latest is loaded and predicts what the fitted one predicts."""
    path = _folder(spark, "store")
    bars = cut(B.bar_features(derived.bars(spark, folder), ("price", "momentum"), regime=False, calendar=False))
    data = cut(M.ml_dataset(bars, min_samples=50))
    columns = L.usable_columns(data, M.numeric_columns(data))
    for version, penalty in ((1, 10.0), (2, 0.1)):
        model = L.train(data, columns, "ridge", "regression", regParam=penalty)
        L.save_model(model, path, "ridge", version, {"penalty": penalty}, spark, model_type="ridge", feature_names=columns)
    stored = L.load_model(spark, path, "ridge")
    fitted = L.predict(model, data, "m", "regression").select("asset_id", "ts", F.col("prediction_value").alias("_v"))
    loaded = L.predict(stored, data, "m", "regression")
    both = loaded.join(fitted, ["asset_id", "ts"])
    counted = both.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction_value") == F.col("_v")).alias("n_equal"))
    versions = spark.read.parquet(f"{path}/registry").agg(F.count(F.lit(1)).alias("n_versions"))  # one row
    return counted.crossJoin(F.broadcast(versions))


# every bar but the last of a symbol has a target
_add("s17_model_store", q_model_store, with_sql([BARS], "select symbol as asset_id, count(*) - 1 as n, count(*) - 1 as n_equal, 2 as n_versions from bars group by 1 having count(*) - 1 >= 50"))


def _exported(spark, folder):
    path = _folder(spark, "export")
    fills = derived.fills(spark, folder)
    equity = P.equity_curve(fills)
    metrics = fills.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"), F.sum("commission").alias("commission"))
    sinks.export_backtest(equity, fills, metrics, path)
    return path, fills


def q_export(spark, folder):
    """Transactions and metrics read back from an export, summed per portfolio."""
    path, fills = _exported(spark, folder)
    rows = spark.read.schema(fills.schema).option("header", True).csv(f"{path}/transactions")
    metrics = spark.read.json(f"{path}/metrics")
    sums = rows.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n_fills"), F.sum(F.col("quantity") * F.col("price")).alias("traded"), F.max("ts").alias("last"))
    curve = spark.read.option("header", True).csv(f"{path}/equity_curve").groupBy("portfolio").agg(F.count(F.lit(1)).alias("periods"))
    out = sums.join(metrics, "portfolio").join(curve, "portfolio")
    return rounded(out.select("portfolio", "n_fills", "traded", F.col("last").cast("timestamp_ntz").alias("last"), "n", "commission", (F.col("periods") > 0).alias("has_curve")), 3)


_add(
    "s18_backtest_export",
    q_export,
    rsql(with_sql([FILLS], """select portfolio, count(*) as n_fills, sum(quantity * price) as traded, max(ts)::timestamp as last, count(*) as n, sum(commission) as commission,
    count(distinct date_trunc('month', ts)) > 0 as has_curve from fills group by 1"""), ["portfolio", "n_fills", "last", "n", "has_curve"], ["traded", "commission"], 3),
)


def q_report(spark, folder):
    """The walk-forward report as JSON, read back."""
    path = _folder(spark, "report")
    report = PERFORMANCE["a36_walk_forward_report"](spark, folder)
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_add("s19_walk_forward_report", q_report, PERFORMANCE_SQL["a36_walk_forward_report"])

# ------------------------------------------------------------------ news of the hours before


def q_trailing(spark, folder):
    """News of the 36 hours up to every hourly bar time, counted per time."""
    found = feeds.trailing_news(derived.bars(spark, folder), derived.news(spark, folder), 36)
    return found.groupBy(F.col("at").alias("bar_ts")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.max("ts").alias("last"))


_add(
    "p16_trailing_news",
    q_trailing,
    with_sql([BARS, NEWS], """select t as bar_ts, count(*) as n, sum(doc_id)::bigint as ids, max(news.ts) as last from (select distinct ts as t from bars) join news on news.ts <= t and news.ts >= t - interval 36 hour group by 1"""),
)

# ------------------------------------------------------------------ polling ingest


INGESTED = {"events": ("event_id", "value"), "orders": ("o_orderkey", "o_totalprice"), "customer": ("c_custkey", "c_acctbal")}


def _landing(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    return T.landed(spark, f"{base}/landing/{name}", schema, files_per_trigger=1)


def q_ingest(spark, folder):
    """Three feeds of several files, a batch each; the second run goes on where the first one ended and also meets a late
    file and one that repeats rows of others."""
    base = _folder(spark, "ingest")
    tables = {name: derived.read(spark, folder, name) for name in INGESTED}
    for part in (0, 1):
        for name, df in tables.items():
            half = df.filter(F.pmod(F.xxhash64(INGESTED[name][0]), F.lit(2)) == part)
            half.repartition(3).write.mode("append").parquet(f"{base}/landing/{name}")
            if part:
                again = df.filter(F.pmod(F.xxhash64(INGESTED[name][0]), F.lit(5)) == 0)
                again.coalesce(1).write.mode("append").parquet(f"{base}/landing/{name}")
        streams = {name: _landing(spark, base, name, df.schema) for name, df in tables.items()}
        for query in T.ingest(streams, f"{base}/store", f"{base}/checkpoint"):
            query.awaitTermination()
    out = None
    for name, (key, value) in INGESTED.items():
        rows = T.ingested(spark, f"{base}/store", name, [key])
        rows = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("ids"), F.sum(F.col(value).cast("double")).alias("total"))
        rows = rows.withColumn("feed", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 2)


_add(
    "st1_polling_ingest",
    q_ingest,
    rsql("""select 'events' as feed, count(*) as n, sum(event_id)::bigint as ids, sum(value)::double as total from events
    union all select 'orders', count(*), sum(o_orderkey)::bigint, sum(o_totalprice)::double from orders
    union all select 'customer', count(*), sum(c_custkey)::bigint, sum(c_acctbal)::double from customer""", ["feed", "n", "ids"], ["total"], 2),
)
