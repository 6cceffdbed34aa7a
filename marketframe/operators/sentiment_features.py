"""Per-bar features of scored news.

A bar sees the news of its symbol and the market-wide news (null symbol). Market-wide articles
are not copied to every symbol: both sources are summarised on their own (market-wide news at
the distinct bar times only) and the summaries are combined per bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import MICROS_PER_DAY, MICROS_PER_HOUR, PARTS, centred, day_number, millis, ratio, us, whole, zero
from marketframe.operators.lineage import cut
from marketframe.operators.ordered import rolling, row_chunks
from marketframe.operators.timeline import RangeTimeline, pieces_of

WINDOWS = (1, 3, 7, 14, 30)
HALF_LIVES = (1, 3, 7)
VOLATILITY_DAYS = (7, 14, 30)
HISTORY = 100
MILLIS_PER_DAY = MICROS_PER_DAY / 1000
DAILY_COLUMNS = {
    "sentiment_score": ("composite_sentiment", 0.0),
    "sentiment_positive": ("vader_positive", 0.0),
    "sentiment_negative": ("vader_negative", 0.0),
    "sentiment_neutral": ("vader_neutral", 0.0),
    "sentiment_compound": ("vader_compound", 0.0),
    "sentiment_subjectivity": ("textblob_subjectivity", 0.5),
}


def _with_history(news: DataFrame, keys: list[str]) -> DataFrame:
    """Articles with the array of the last 100 (time, score) pairs up to each of them."""
    c = row_chunks(news, keys, tie=("doc_id",), halo=HISTORY, bucket_us=MICROS_PER_HOUR, tasks=pieces_of(news.count()))
    last = F.collect_list(F.struct(us("ts").alias("u"), F.col("doc_id"), F.col("composite_sentiment").alias("s")))
    return c.with_columns({"_last": last.over(c.last_rows(HISTORY))}).own()


def _summaries(points: DataFrame, news: DataFrame, keys: list[str], tag: str, windows, pieces: int | None) -> DataFrame:
    """Window sums, sums of the first and last day in part, and the last articles at every point (columns prefixed with
    ``tag``). Sums are whole numbers: scores in parts of 1e-12, times in milliseconds."""
    articles = _with_history(news, keys).withColumn("_t", us("ts"))
    line = RangeTimeline(points, articles, keys, ["composite_sentiment", "_t"], ["_last"], ["doc_id"], pieces, weight=HISTORY // 5)
    s = F.col("composite_sentiment")
    y, t, one = whole(s), millis(F.col("_t")), F.lit(1)
    some = s.isNotNull()
    terms = {
        "n": F.when(some, one), "pos": F.when(s > 0.1, one), "neg": F.when(s < -0.1, one), "s": y, "ss": y * y,
        "t": F.when(some, t), "tt": F.when(some, t * t), "st": y * t,
    }
    cols = {f"{tag}_last": line.previous()["_last"]}
    for d in windows:
        cols |= {f"{tag}_{name}_{d}": line.total(term, d) for name, term in terms.items()}
        cols |= {f"{tag}_min_{d}": line.lowest("composite_sentiment", d), f"{tag}_max_{d}": line.highest("composite_sentiment", d)}
    for d in (0, *VOLATILITY_DAYS):
        cols |= {f"{tag}_ps_{d}": line.day_total(y, d) / F.lit(PARTS), f"{tag}_pn_{d}": line.day_total(terms["n"], d)}
    return line.bars(cols)


def _combine(d: int) -> dict[str, Column]:
    """Sums over own and market-wide articles in the d-day window."""
    add = lambda x: (
        F.coalesce(F.col(f"o_{x}_{d}"), F.lit(0)).cast("decimal(38,0)") + F.coalesce(F.col(f"m_{x}_{d}"), F.lit(0)).cast("decimal(38,0)")
    )
    return {f"_n_{d}": add("n").cast("double")} | {f"_{x}_{d}": add(x).cast("decimal(38,0)") for x in ("s", "ss", "t", "tt", "st")}


def _deviations(windows: Sequence[int]) -> Column:
    """Sums of squared deviations of scores (s), of days (t), and of both (st) for each window."""
    names = ("n", "s", "ss", "t", "tt", "st")
    sums = F.array(*[F.struct(*[F.col(f"_{x}_{d}").alias(x) for x in names]) for d in windows])
    # one expression over an array: written out for every window, the generated code is too long to compile
    return F.transform(
        sums,
        lambda w: F.struct(
            (centred(w["n"], w["s"], w["s"], w["ss"]) / F.lit(PARTS * PARTS)).alias("s"),
            (centred(w["n"], w["t"], w["t"], w["tt"]) / F.lit(MILLIS_PER_DAY * MILLIS_PER_DAY)).alias("t"),
            (centred(w["n"], w["s"], w["t"], w["st"]) / F.lit(PARTS * MILLIS_PER_DAY)).alias("st"),
        ),
    )


def daily_grid(bars: DataFrame, own: DataFrame, market: DataFrame) -> DataFrame:
    """One row per symbol and calendar day with the day's news totals and their recent history.

    The grid has symbols x days rows; it is small next to bars and news.
    """
    reach = max(VOLATILITY_DAYS) + 1
    grid = (
        bars.groupBy("symbol")
        .agg(F.min(day_number("ts")).alias("lo"), F.max(day_number("ts")).alias("hi"))
        .select("symbol", F.explode(F.sequence(F.col("lo") - reach, F.col("hi"))).alias("_day"))
    )
    sources = {source: name for name, (source, _) in DAILY_COLUMNS.items()}

    def totals(news, keys, tag):
        return news.groupBy(*keys, day_number("ts").alias("_day")).agg(
            F.count("composite_sentiment").alias(f"{tag}_n"), *[F.sum(c).alias(f"{tag}_{c}") for c in sources]
        )

    joined = grid.join(totals(own, ["symbol"], "o"), ["symbol", "_day"], "left").join(
        totals(market, [], "m"), ["_day"], "left"
    )
    n = zero(F.col("o_n").cast("double")) + zero(F.col("m_n").cast("double"))
    cols = {"day_n": n}
    for source in sources:
        cols[f"day_{source}"] = zero(F.col(f"o_{source}")) + zero(F.col(f"m_{source}"))
    out = joined.withColumns(cols)
    by_day = Window.partitionBy("symbol").orderBy("_day")
    mean = ratio("day_composite_sentiment", "day_n")
    out = out.withColumn("day_mean", mean)
    history = {"mean_1": F.lag("day_mean", 1).over(by_day), "mean_3": F.lag("day_mean", 3).over(by_day)}
    for d in VOLATILITY_DAYS:
        full = by_day.rangeBetween(-(d - 1), -1)
        history[f"fn_{d}"] = F.count("day_mean").over(full)
        history[f"f1_{d}"] = zero(F.sum("day_mean").over(full))
        history[f"f2_{d}"] = zero(F.sum(F.col("day_mean") * F.col("day_mean")).over(full))
        history[f"an_{d}"] = zero(F.lag("day_n", d).over(by_day))
        history[f"as_{d}"] = zero(F.lag("day_composite_sentiment", d).over(by_day))
    keep = ["day_n", *[f"day_{s}" for s in sources], "day_mean", *history]
    return out.withColumns(history).select("symbol", "_day", *keep)


def sentiment_features(
    bars: DataFrame,
    sentiment: DataFrame,
    windows: Sequence[int] = WINDOWS,
    half_lives: Sequence[int] = HALF_LIVES,
    pieces: int | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Bars (unique per symbol and ts) with daily, rolling, decayed and volume features of news.

    ``sentiment`` is the output of ``score_sentiment`` with doc_id, ts and a nullable symbol.
    """
    windows = tuple(sorted({*windows, *VOLATILITY_DAYS}))
    # scored once: the texts behind it are read by several steps below
    sentiment = cut(sentiment.select("doc_id", "ts", "symbol", *[source for source, _ in DAILY_COLUMNS.values()]))
    own = sentiment.filter(F.col("symbol").isNotNull())
    market = sentiment.filter(F.col("symbol").isNull()).drop("symbol")
    points = bars.select("symbol", "ts")
    times = bars.select("ts").distinct()
    # the row windows come first, on the narrow table, so that the wide one is not evaluated twice
    daily = bars.withColumn("_day", day_number("ts")).join(daily_grid(bars, own, market), ["symbol", "_day"], "left")
    for k in (1, 3):
        daily = daily.withColumn(f"sentiment_change_{k}d", zero(F.col("day_mean") - F.col(f"mean_{k}")))
    extra = {"chunk_rows": chunk_rows} if chunk_rows else {}
    c = row_chunks(daily, halo=6, **extra)
    change = F.col("sentiment_change_1d")
    daily = c.with_columns(
        {
            "sentiment_acceleration": change - F.lag("sentiment_change_1d").over(c.order),
            "sentiment_momentum_5d": rolling(c, change, 5),
        }
    ).own()
    # the small one is stored: the plan of both in one takes much of the driver's memory
    o = _summaries(points, own, ["symbol"], "o", windows, pieces)
    m = cut(_summaries(times, market, [], "m", windows, pieces))
    joined = daily.join(o, ["symbol", "ts"], "left").join(m, ["ts"], "left")
    moments: dict[str, Column] = {}
    for d in windows:
        moments |= _combine(d)
    out = joined.withColumns(moments).withColumn("_dev", _deviations(windows))

    cols: dict[str, Column] = {}
    for name, (source, default) in DAILY_COLUMNS.items():
        cols[name] = F.coalesce(ratio(f"day_{source}", "day_n"), F.lit(default))
    for d in windows:
        n = F.col(f"_n_{d}")
        dev = F.col("_dev")[windows.index(d)]
        dev_s, dev_t, dev_st = dev["s"], dev["t"], dev["st"]
        cols[f"sentiment_avg_{d}d"] = F.when(n > 0, ratio(F.col(f"_s_{d}") / F.lit(PARTS), n)).otherwise(0.0)
        cols[f"sentiment_std_{d}d"] = F.when(n == 0, 0.0).when(n > 1, F.sqrt(dev_s / (n - 1)))
        cols[f"sentiment_min_{d}d"] = zero(F.least(f"o_min_{d}", f"m_min_{d}"))
        cols[f"sentiment_max_{d}d"] = zero(F.greatest(f"o_max_{d}", f"m_max_{d}"))
        # spreads at rounding level (a constant series, or articles within seconds) count as none
        vs, vt = ratio(dev_s, n), ratio(dev_t, n)
        trend = F.when((vs > 1e-12) & (vt > 1e-9), ratio(dev_st, F.sqrt(dev_s * dev_t)))
        cols[f"sentiment_trend_{d}d"] = zero(F.when(n >= 3, trend))
        cols[f"news_count_{d}d"] = n.cast("long")
        for side, label in (("pos", "positive"), ("neg", "negative")):
            both = F.coalesce(f"o_{side}_{d}", F.lit(0)) + F.coalesce(f"m_{side}_{d}", F.lit(0))
            cols[f"{label}_news_count_{d}d"] = both
    empty = F.array().cast("array<struct<u:bigint,doc_id:bigint,s:double>>")
    merged = F.slice(
        F.reverse(F.array_sort(F.concat(F.coalesce("o_last", empty), F.coalesce("m_last", empty)))), 1, HISTORY
    )
    out = out.withColumns({**cols, "_hist": merged})
    latest = F.get("_hist", F.lit(0))
    later = {"last_sentiment": zero(latest["s"])}
    for h in half_lives:
        later[f"sentiment_decay_{h}d"] = _decayed_mean(latest, h)
    for d in VOLATILITY_DAYS:
        later[f"sentiment_volatility_{d}d"] = _volatility(d)
    later["news_frequency"] = F.col("news_count_7d") / 7.0
    for label in ("positive", "negative"):
        later[f"{label}_news_ratio"] = ratio(f"{label}_news_count_7d", F.col("news_count_7d") + 1)
    out = out.withColumns(later)
    momentum = ["sentiment_change_1d", "sentiment_change_3d", "sentiment_acceleration", "sentiment_momentum_5d"]
    return out.select(*bars.columns, *cols, *later, *momentum)


def _decayed_mean(latest: Column, half_life: int) -> Column:
    """Mean of the history weighted by 2^(-age / half life).

    Ages are taken from the newest article: the bar's own time cancels out of the mean.
    """

    def weight(e: Column) -> Column:
        return F.pow(F.lit(2.0), (e["u"] - latest["u"]) / float(half_life * MICROS_PER_DAY))

    total = F.aggregate("_hist", F.lit(0.0), lambda a, e: a + weight(e) * e["s"])
    weights = F.aggregate("_hist", F.lit(0.0), lambda a, e: a + weight(e))
    return zero(ratio(total, weights))


def _volatility(d: int) -> Column:
    """Deviation of the daily means in [t - d, t]: full days from the grid, first and last day in part."""
    head_n = F.col(f"an_{d}") - F.coalesce(f"o_pn_{d}", F.lit(0)) - F.coalesce(f"m_pn_{d}", F.lit(0))
    head_s = F.col(f"as_{d}") - zero(F.col(f"o_ps_{d}")) - zero(F.col(f"m_ps_{d}"))
    tail_n = F.coalesce("o_pn_0", F.lit(0)) + F.coalesce("m_pn_0", F.lit(0))
    tail_s = zero(F.col("o_ps_0")) + zero(F.col("m_ps_0"))
    head, tail = ratio(head_s, head_n), ratio(tail_s, tail_n)
    n = F.col(f"fn_{d}") + F.when(head_n > 0, 1).otherwise(0) + F.when(tail_n > 0, 1).otherwise(0)
    s1 = F.col(f"f1_{d}") + zero(head) + zero(tail)
    s2 = F.col(f"f2_{d}") + zero(head * head) + zero(tail * tail)
    var = ratio(s2 - ratio(s1 * s1, n), n - 1)
    return zero(F.when((F.col(f"_n_{d}") >= 3) & (n > 1), F.sqrt(F.greatest(var, F.lit(0.0)))))
