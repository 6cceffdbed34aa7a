"""Bar building and the per-bar indicator families.

The families work on :class:`~marketframe.operators.ordered.Chunks`, so one chunking of the
bars feeds all of them with a single sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import flag, ratio, us
from marketframe.operators.ordered import BLOCK, CHUNK_ROWS, Chunks, ewm, rolling, row_chunks, running_sums, wilder
from marketframe.operators.ranking import exact_quantiles

# Bar timeframes.
TIMEFRAMES = {
    "1min": "1 minute",
    "5min": "5 minutes",
    "15min": "15 minutes",
    "30min": "30 minutes",
    "1h": "1 hour",
    "1d": "1 day",
    "1w": "week",
    "1mo": "month",
}

MA_WINDOWS = (5, 10, 20, 50, 200)
VOL_WINDOWS = (5, 10, 20)
VOLUME_WINDOWS = (5, 10, 20)
FULL_HALO = 5 * BLOCK  # covers the 200-row averages, their slope and every exponential mean


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Roll bars up to a longer timeframe; one row per symbol and period start."""
    step = TIMEFRAMES[timeframe]
    if step in ("week", "month"):
        period = F.date_trunc(step, "ts")
    else:
        period = F.window("ts", step)["start"]
    return (
        bars.withColumn("_period", period.cast("timestamp_ntz"))
        .groupBy("symbol", F.col("_period").alias("_p"))
        .agg(
            # equal times are decided by the price itself
            F.min_by("open", F.struct("ts", "open")).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", F.struct("ts", "close")).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("_p", "ts")
        .select("symbol", "ts", "open", "high", "low", "close", "volume")
    )


def bars_from_ticks(
    ticks: DataFrame, timeframe: str = "1h", symbol: str = "symbol", price: str = "price", tie: Sequence[str] = ()
) -> DataFrame:
    """OHLC bars of single observations; volume is the number of observations. Equal times are decided by ``tie``, then
    by the price."""
    step = TIMEFRAMES[timeframe]
    period = F.date_trunc(step, "ts") if step in ("week", "month") else F.window("ts", step)["start"]
    return (
        ticks.withColumn("_period", period.cast("timestamp_ntz"))
        .groupBy(F.col(symbol).alias("symbol"), F.col("_period").alias("_p"))
        .agg(
            F.min_by(price, F.struct("ts", *tie, price)).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, F.struct("ts", *tie, price)).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("_p", "ts")
        .select("symbol", "ts", "open", "high", "low", "close", "volume")
    )


def latest_bar(bars: DataFrame) -> DataFrame:
    """Most recent bar of every symbol."""
    rest = [c for c in bars.columns if c != "symbol"]
    last = F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_b")
    return bars.groupBy("symbol").agg(last).select("symbol", *[f"_b.{c}" for c in rest])


def price_features(c: Chunks) -> Chunks:
    prev = F.lag("close").over(c.order)
    c = c.with_columns({"_prev": prev})
    close, low, high, open_ = F.col("close"), F.col("low"), F.col("high"), F.col("open")
    gap = ratio(open_ - F.col("_prev"), F.col("_prev"))
    return c.with_columns(
        {
            "price_change": close - F.col("_prev"),
            "price_change_pct": ratio(close - F.col("_prev"), "_prev"),
            "log_return": F.when((close > 0) & (F.col("_prev") > 0), F.ln(ratio(close, "_prev"))),
            "high_low_pct": ratio(high - low, close),
            "open_close_pct": ratio(close - open_, open_),
            "gap_up": F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))),
            "gap_down": F.when(gap.isNotNull(), F.greatest(-gap, F.lit(0.0))),
            "typical_price": (high + low + close) / 3.0,
            "weighted_close": (high + low + close * 2.0) / 4.0,
        }
    )


def moving_averages(c: Chunks, windows: Sequence[int] = MA_WINDOWS) -> Chunks:
    c = c.with_columns({f"sma_{w}": rolling(c, F.col("close"), w) for w in windows})
    c = c.with_columns({f"ema_{w}": ewm(c, F.col("close"), w) for w in windows})
    derived = {}
    for w in windows:
        derived[f"price_sma_{w}_ratio"] = ratio("close", f"sma_{w}")
        derived[f"price_ema_{w}_ratio"] = ratio("close", f"ema_{w}")
        derived[f"sma_{w}_slope"] = (F.col(f"sma_{w}") - F.lag(f"sma_{w}", 5).over(c.order)) / 5.0
    for a, b in ((10, 20), (20, 50), (50, 200)):
        if a in windows and b in windows:
            derived[f"sma_{a}_{b}_cross"] = flag(F.col(f"sma_{a}") > F.col(f"sma_{b}"))
    return c.with_columns(derived)


def volatility_features(c: Chunks, windows: Sequence[int] = VOL_WINDOWS) -> Chunks:
    spread = F.col("high") - F.col("low")
    log_range = F.when((F.col("high") > 0) & (F.col("low") > 0), F.ln(ratio("high", "low")))
    c = c.with_columns({"_spread": spread, "_log_range": log_range})
    cols = {}
    for w in windows:
        cols[f"volatility_{w}"] = rolling(c, F.col("log_return"), w, F.stddev_samp)
        cols[f"range_volatility_{w}"] = ratio(rolling(c, F.col("_spread"), w), "close")
        cols[f"parkinson_vol_{w}"] = F.sqrt(rolling(c, F.col("_log_range"), w) * 0.361)
    return c.with_columns(cols)


def volume_features(c: Chunks, windows: Sequence[int] = VOLUME_WINDOWS) -> Chunks:
    c = c.with_columns({f"volume_sma_{w}": rolling(c, F.col("volume"), w) for w in windows})
    cols = {f"volume_ratio_{w}": ratio("volume", f"volume_sma_{w}") for w in windows}
    if 20 in windows:
        cols["volume_spike"] = flag(F.col("volume") > F.col("volume_sma_20") * 2.0)
    return c.with_columns(cols)


def volume_totals() -> dict[str, Column]:
    """Terms of the running totals obv, vpt and ad_line (needs price_features)."""
    close, low, high, volume = F.col("close"), F.col("low"), F.col("high"), F.col("volume")
    location = ratio((close - low) - (high - close), high - low)
    return {
        "obv": F.signum("price_change") * volume,
        "vpt": F.col("price_change_pct") * volume,
        "ad_line": location * volume,
    }


def momentum_features(c: Chunks) -> Chunks:
    cols = {}
    for n in (1, 5, 10, 20):
        past = F.lag("close", n).over(c.order)
        cols[f"roc_{n}"] = ratio(F.col("close") - past, past) * 100.0
        if n > 1:
            cols[f"momentum_{n}"] = F.col("close") - past
    for n in (14, 20):
        top, bottom = rolling(c, F.col("high"), n, F.max), rolling(c, F.col("low"), n, F.min)
        cols[f"williams_r_{n}"] = ratio((top - F.col("close")) * -100.0, top - bottom)
    return c.with_columns(cols)


def _relative_strength(gain: Column, loss: Column) -> Column:
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(F.lit(100.0) - ratio(100.0 * loss, gain + loss))


def indicator_features(c: Chunks) -> Chunks:
    """RSI (simple means), MACD and Bollinger bands."""
    delta = F.col("close") - F.lag("close").over(c.order)
    c = c.with_columns({"_delta": delta})
    c = c.with_columns(
        {
            "_gain": rolling(c, F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0), 14),
            "_loss": rolling(c, F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0), 14),
            "macd": ewm(c, F.col("close"), 12) - ewm(c, F.col("close"), 26),
            "bb_middle": rolling(c, F.col("close"), 20),
            "_dev": rolling(c, F.col("close"), 20, F.stddev_samp),
        }
    )
    c = c.with_columns(
        {
            "rsi_14": _relative_strength(F.col("_gain"), F.col("_loss")),
            "macd_signal": ewm(c, F.col("macd"), 9),
            "bb_upper": F.col("bb_middle") + F.col("_dev") * 2.0,
            "bb_lower": F.col("bb_middle") - F.col("_dev") * 2.0,
        }
    )
    return c.with_columns(
        {
            "macd_histogram": F.col("macd") - F.col("macd_signal"),
            "bb_width": ratio(F.col("bb_upper") - F.col("bb_lower"), "bb_middle"),
            "bb_position": ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")),
        }
    )


def extended_indicators(c: Chunks) -> Chunks:
    """Wilder RSI, stochastic (5,3,3), ADX(14), CCI(14) and population-deviation bands."""
    prev_close, prev_high, prev_low = (F.lag(x).over(c.order) for x in ("close", "high", "low"))
    c = c.with_columns({"_pc": prev_close, "_ph": prev_high, "_pl": prev_low})
    up, down = F.col("high") - F.col("_ph"), F.col("_pl") - F.col("low")
    delta = F.col("close") - F.col("_pc")
    low5, high5 = rolling(c, F.col("low"), 5, F.min), rolling(c, F.col("high"), 5, F.max)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    c = c.with_columns(
        {
            "_up": F.when(up.isNotNull(), F.when((up > down) & (up > 0), up).otherwise(0.0)),
            "_down": F.when(down.isNotNull(), F.when((down > up) & (down > 0), down).otherwise(0.0)),
            "_range": F.when(
                F.col("_pc").isNotNull(),
                F.greatest(
                    F.col("high") - F.col("low"),
                    F.abs(F.col("high") - F.col("_pc")),
                    F.abs(F.col("low") - F.col("_pc")),
                ),
            ),
            "_rise": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "_drop": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
            "_fast_k": ratio((F.col("close") - low5) * 100.0, high5 - low5),
            "_tp": typical,
        }
    )
    c = c.with_columns(
        {
            "_plus": wilder(c, F.col("_up"), 14, 13),
            "_minus": wilder(c, F.col("_down"), 14, 13),
            "_true": wilder(c, F.col("_range"), 14, 13),
            "_avg_rise": wilder(c, F.col("_rise"), 14, 14),
            "_avg_drop": wilder(c, F.col("_drop"), 14, 14),
            "stoch_k": rolling(c, F.col("_fast_k"), 3),
            "_tp_list": F.collect_list("_tp").over(c.last_rows(14)),
            "_mid": rolling(c, F.col("close"), 20),
            "_pdev": rolling(c, F.col("close"), 20, F.stddev_pop),
        }
    )
    mean = F.aggregate("_tp_list", F.lit(0.0), lambda a, x: a + x) / 14.0
    c = c.with_columns({"_tp_mean": F.when(F.size("_tp_list") == 14, mean)})
    spread = F.aggregate("_tp_list", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tp_mean"))) / 14.0
    plus, minus = ratio("_plus", "_true") * 100.0, ratio("_minus", "_true") * 100.0
    c = c.with_columns(
        {
            "_dx": F.when(F.col("_rn") >= 14, F.coalesce(ratio(F.abs(plus - minus) * 100.0, plus + minus), F.lit(0.0))),
            "rsi_14_wilder": _relative_strength(F.col("_avg_rise"), F.col("_avg_drop")),
            "stoch_d": rolling(c, F.col("stoch_k"), 3),
            "cci": F.when(
                F.col("_tp_mean").isNotNull(),
                F.coalesce(ratio(F.col("_tp") - F.col("_tp_mean"), spread * 0.015), F.lit(0.0)),
            ),
            "bb_upper_pop": F.col("_mid") + F.col("_pdev") * 2.0,
            "bb_lower_pop": F.col("_mid") - F.col("_pdev") * 2.0,
        }
    )
    return c.with_columns({"adx": wilder(c, F.col("_dx"), 14, 27)})


def pattern_features(c: Chunks) -> Chunks:
    o, h, l, k = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    po, ph, pl, pk = (F.lag(x).over(c.order) for x in ("open", "high", "low", "close"))
    body = F.abs(k - o)
    lower, upper = F.least(o, k) - l, h - F.greatest(o, k)
    c = c.with_columns(
        {
            "is_doji": flag(ratio(body, h - l) < 0.1),
            "is_hammer": flag((lower > body * 2.0) & (upper < body)),
            "bullish_engulfing": flag((o < k) & (po > pk) & (o < pk) & (k > po)),
            "gap_up_pattern": flag(l > ph),
            "gap_down_pattern": flag(h < pl),
            "higher_high": flag(h > ph),
            "higher_low": flag(l > pl),
        }
    )
    return c.with_columns({"uptrend_signal": flag((F.col("higher_high") == 1) & (F.col("higher_low") == 1))})


def time_features(df: DataFrame) -> DataFrame:
    """Clock and calendar columns of the bar time (Monday is day 0)."""
    hour, dow = F.hour("ts"), F.weekday("ts")
    month_end = F.datediff(F.last_day("ts"), F.col("ts").cast("date"))
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": F.dayofmonth("ts"),
            "month": F.month("ts"),
            "quarter": F.quarter("ts"),
            "is_market_open": flag((hour >= 9) & (hour < 16)),
            "is_pre_market": flag((hour >= 4) & (hour < 9)),
            "is_after_market": flag((hour >= 16) & (hour < 20)),
            "is_weekend": flag(dow >= 5),
            "is_monday": flag(dow == 0),
            "is_friday": flag(dow == 4),
            "days_to_month_end": month_end,
            "is_month_end": flag(month_end <= 3),
        }
    )


def with_volatility_regime(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Tercile label of volatility_20 within the whole series of its key, and fear_index."""
    cuts = exact_quantiles(df, keys, "volatility_20", {"_q33": 0.33, "_q67": 0.67})
    v = F.col("volatility_20")
    label = F.when(v <= F.col("_q33"), "low").when(v <= F.col("_q67"), "medium").when(v.isNotNull(), "high")
    return (
        df.join(cuts, list(keys), "left")
        .withColumns({"vol_regime": label, "fear_index": v * 100.0})
        .drop("_q33", "_q67")
    )


FAMILIES = {
    "price": (price_features, 2),
    "moving_averages": (moving_averages, FULL_HALO),
    "volatility": (volatility_features, 32),
    "volume": (volume_features, 32),
    "momentum": (momentum_features, 32),
    "indicators": (indicator_features, 3 * BLOCK),
    "extended": (extended_indicators, 4 * BLOCK),
    "patterns": (pattern_features, 2),
}


def bar_features(
    bars: DataFrame,
    families: Sequence[str] = ("price", "moving_averages", "volatility", "volume", "momentum", "indicators", "patterns"),
    totals: bool = True,
    regime: bool = True,
    calendar: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Bars with the chosen indicator families appended (helper columns removed)."""
    wanted = list(dict.fromkeys(["price", *families] if "volatility" in families else families))
    halo = max(FAMILIES[f][1] for f in wanted)
    chunks = row_chunks(bars, halo=halo, chunk_rows=chunk_rows)
    for family in wanted:
        chunks = FAMILIES[family][0](chunks)
    with_totals = totals and "volume" in wanted and "price" in wanted
    out = running_sums(chunks, volume_totals()) if with_totals else chunks.own()
    if regime and "volatility" in wanted:
        out = with_volatility_regime(out)
    if calendar:
        out = time_features(out)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def bars_between(bars: DataFrame, start=None, end=None, lookback_days: int = 0, symbols: Sequence[str] = ()) -> DataFrame:
    """Bars in [start - lookback, end] of the given symbols; filters reach the scan."""
    out = bars
    if symbols:
        out = out.filter(F.col("symbol").isin(list(symbols)))
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz") - F.expr(f"interval {int(lookback_days)} days"))
    if end is not None:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def enough_history(bars: DataFrame, minimum: int = 20) -> DataFrame:
    """Bars that have at least ``minimum`` bars of their symbol up to and including themselves."""
    chunks = row_chunks(bars)
    return chunks.df.filter(F.col("_rn") >= minimum - 1).drop("_rn", "_chunk", "_block", "_j", "_own")


def history_ready(bars: DataFrame, minimum: int = 20) -> DataFrame:
    """One row: whether every symbol has at least ``minimum`` bars."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("fewest_bars"), F.coalesce(F.min("n") >= minimum, F.lit(False)).alias("ready"))


