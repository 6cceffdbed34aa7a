"""Market context of a bar: index regime, sectors, macro series, volatility index, crypto, calendar.

Reference series live in one table ``refs(name, ts, close)``. Their features are computed once
per reference time and joined to the bars of all symbols on that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import centred, flag, ratio, whole, zero
from marketframe.operators.ordered import rolling, row_chunks, running_last
from marketframe.operators.timeline import RangeTimeline, asof_join

REGIME_WINDOWS = (20, 50, 200)
SECTOR_DAYS = (5, 10, 20, 50)
CORRELATION_DAYS = (20, 60)
REGIMES = ("bull", "neutral", "bear")
VOL_REGIMES = ("low", "medium", "high", "extreme")


def _pct(now: Column, past: Column, factor: float = 100.0) -> Column:
    return F.when(past > 0, ratio(now - past, past) * factor)


def past_close(refs: DataFrame, days: float, name: str) -> DataFrame:
    """Reference rows with the close at or before ``days`` earlier."""
    out = asof_join(refs, refs, ["name"], ["close"], "_past", offset_days=days)
    return out.withColumn(name, F.col("_past.close")).drop("_past")


def market_regime(bars: DataFrame, refs: DataFrame, index: str, compat: bool = False) -> DataFrame:
    """Regime, trend against the 20- and 50-row averages and position to the 200-row average.

    Before the 200-row average exists the regime is neutral, or bear with ``compat``.
    """
    series = refs.filter(F.col("name") == index)
    c = row_chunks(series, ("name",), halo=max(REGIME_WINDOWS))
    c = c.with_columns({f"_ma{w}": rolling(c, F.col("close"), w) for w in REGIME_WINDOWS})
    close, ma50, ma200 = F.col("close"), F.col("_ma50"), F.col("_ma200")
    regime = F.when(ma200.isNull(), "bear" if compat else "neutral").when(
        close > ma200, F.when(close > ma50, "bull").otherwise("neutral")
    )
    feats = c.own().select(
        "ts", F.lit(True).alias("_hit"), regime.otherwise("bear").alias("market_regime"),
        _pct(close, F.col("_ma20")).alias("market_trend_20d"), _pct(close, ma50).alias("market_trend_50d"),
        F.when(ma200.isNotNull(), (close > ma200).cast("int")).alias("market_above_ma200"),
    )
    out = bars.join(feats, "ts", "left").select(*bars.columns, *[c for c in feats.columns if c != "ts"])
    miss = F.col("_hit").isNull()
    filled = ["market_trend_20d", "market_trend_50d", "market_above_ma200"]
    out = out.withColumns({x: F.when(miss, F.lit(0)).otherwise(F.col(x)) for x in filled})
    out = out.withColumn("market_regime", F.coalesce("market_regime", F.lit("neutral"))).drop("_hit")
    out = running_last(row_chunks(out), filled).na.fill(0, filled)
    out = out.withColumn("market_above_ma200", F.col("market_above_ma200").cast("int"))
    return out.withColumns({f"regime_{r}": flag(F.col("market_regime") == r) for r in REGIMES})


def sector_performance(bars: DataFrame, refs: DataFrame, sectors: Sequence[str], days: Sequence[int] = SECTOR_DAYS) -> DataFrame:
    """Best, worst and dispersion of the sectors' returns over calendar days; 0 without any."""
    series = refs.filter(F.col("name").isin(list(sectors)))
    cols = []
    for d in days:
        series = past_close(series, d, f"_past_{d}")
        series = series.withColumn(f"_ret_{d}", _pct(F.col("close"), F.col(f"_past_{d}")))
        cols += [
            F.max(f"_ret_{d}").alias(f"best_sector_performance_{d}d"),
            F.min(f"_ret_{d}").alias(f"worst_sector_performance_{d}d"),
            F.stddev_pop(f"_ret_{d}").alias(f"sector_dispersion_{d}d"),
        ]
    per_time = series.groupBy("ts").agg(*cols)
    names = [c for c in per_time.columns if c != "ts"]
    return bars.join(per_time, "ts", "left").select(*bars.columns, *names).na.fill(0.0, names)


def macro_indicators(bars: DataFrame, refs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Price and 1- and 5-day returns of each series (``names``: series -> column prefix), filled forward then 0."""
    series = refs.filter(F.col("name").isin(list(names)))
    series = past_close(past_close(series, 1, "_p1"), 5, "_p5")
    close = F.col("close")
    series = series.withColumns({"_r1": _pct(close, F.col("_p1")), "_r5": _pct(close, F.col("_p5"))})
    aggs = []
    for key, prefix in names.items():
        mine = F.col("name") == key
        aggs += [
            F.max(F.when(mine, close)).alias(f"{prefix}_price"),
            F.max(F.when(mine, F.col("_r1"))).alias(f"{prefix}_return_1d"),
            F.max(F.when(mine, F.col("_r5"))).alias(f"{prefix}_return_5d"),
        ]
    per_time = series.groupBy("ts").agg(*aggs)
    cols = [c for c in per_time.columns if c != "ts"]
    out = bars.join(per_time, "ts", "left").select(*bars.columns, *cols)
    for prefix in names.values():
        miss = F.col(f"{prefix}_price").isNull()
        out = out.withColumns(
            {f"{prefix}_{x}": F.when(miss, F.lit(0.0)).otherwise(F.col(f"{prefix}_{x}")) for x in ("return_1d", "return_5d", "price")}
        )
    return running_last(row_chunks(out), cols).na.fill(0.0, cols)


def volatility_regime(bars: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """Level, regime and one-day spike (> 20 %) of the volatility index; medium, 20, 0 where it has no row."""
    series = past_close(refs.filter(F.col("name") == name), 1, "_p1")
    level = F.col("close")
    regime = F.when(level < 15, "low").when(level < 25, "medium").when(level < 35, "high").otherwise("extreme")
    feats = series.select(
        "ts", level.alias("vix_level"), regime.alias("volatility_regime"),
        flag(_pct(level, F.col("_p1"), 1.0) > 0.2).alias("vix_spike"),
    )
    out = bars.join(feats, "ts", "left").select(*bars.columns, "vix_level", "volatility_regime", "vix_spike")
    out = out.na.fill({"vix_level": 20.0, "volatility_regime": "medium", "vix_spike": 0})
    return out.withColumns({f"vol_regime_{r}": flag(F.col("volatility_regime") == r) for r in VOL_REGIMES})


def crypto_market(bars: DataFrame, refs: DataFrame, btc: str, eth: str) -> DataFrame:
    """20-day trend and volatility of the lead coin and its return gap to the second one."""
    series = past_close(refs.filter(F.col("name").isin(btc, eth)), 20, "_p20")
    c = row_chunks(series, ("name",), halo=24)
    prev = F.lag("close").over(c.order)
    c = c.with_columns({"_ret": ratio(F.col("close") - prev, prev)})
    c = c.with_columns({"_vol": rolling(c, F.col("_ret"), 20, F.stddev_samp) * (365.0**0.5) * 100.0})
    series = c.own().withColumn("_r20", _pct(F.col("close"), F.col("_p20"), 1.0))
    lead, second = F.col("name") == btc, F.col("name") == eth
    per_time = series.groupBy("ts").agg(
        F.max(F.when(lead, F.col("close"))).alias("_btc"),
        F.max(F.when(lead, F.col("_r20"))).alias("_rb"),
        F.max(F.when(lead, F.col("_vol"))).alias("_vb"),
        F.max(F.when(second, F.col("_r20"))).alias("_re"),
    )
    both = F.col("_rb").isNotNull() & F.col("_re").isNotNull()
    has = F.col("_btc").isNotNull()
    feats = per_time.select(
        "ts", F.when(has, F.col("_rb") * 100.0).alias("crypto_market_trend"), F.when(has, F.col("_vb")).alias("crypto_volatility"),
        F.when(has & both, F.col("_rb") - F.col("_re")).alias("crypto_dominance_signal"),
    )
    names = [c for c in feats.columns if c != "ts"]
    return bars.join(feats, "ts", "left").select(*bars.columns, *names).na.fill(0.0, names)


def index_correlation(
    bars: DataFrame, refs: DataFrame, indexes: dict[str, str], days: Sequence[int] = CORRELATION_DAYS,
    min_obs: int = 10, pieces: int | None = None,
) -> DataFrame:
    """Correlation of bar returns with index returns over the last n calendar days (``indexes``: prefix -> series)."""

    def returns(df, key):
        c = row_chunks(df, (key,), halo=2)
        prev = F.lag("close").over(c.order)
        return c.with_columns({"_ret": ratio(F.col("close") - prev, prev)}).own()

    own = returns(bars, "symbol").select("symbol", "ts", F.col("_ret").alias("_x"))
    series = returns(refs.filter(F.col("name").isin(list(indexes.values()))), "name")
    per_time = series.groupBy("ts").agg(
        *[F.max(F.when(F.col("name") == n, F.col("_ret"))).alias(f"_y_{p}") for p, n in indexes.items()],
        *[F.max(F.when(F.col("name") == n, F.lit(True))).alias(f"_has_{p}") for p, n in indexes.items()],
    )
    pairs = own.join(per_time, "ts").filter(F.col("_x").isNotNull())
    probe = bars.join(per_time.select("ts", *[f"_has_{p}" for p in indexes]), "ts", "left").select(*bars.columns, *[f"_has_{p}" for p in indexes])
    line = RangeTimeline(probe, pairs, ["symbol"], ["_x", *[f"_y_{p}" for p in indexes]], pieces=pieces)
    cols = {}
    for p in indexes:
        y = F.col(f"_y_{p}")
        x = whole(F.when(y.isNotNull(), F.col("_x")))
        y = whole(y)
        for d in days:
            n = line.total(F.when(y.isNotNull(), F.lit(1)), d)
            cols[f"_n_{p}_{d}"] = n
            for tag, term in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)):
                cols[f"_{tag}_{p}_{d}"] = line.total(term, d)
    out = line.bars(cols)
    corrs = {}
    for p in indexes:
        for d in days:
            n, sx, sy, sxx, syy, sxy = [F.col(f"_{tag}_{p}_{d}") for tag in ("n", "sx", "sy", "sxx", "syy", "sxy")]
            vx, vy = centred(n, sx, sx, sxx), centred(n, sy, sy, syy)
            corr = F.when((vx > 0) & (vy > 0), centred(n, sx, sy, sxy) / F.sqrt(vx * vy))
            known = (n >= min_obs) & F.coalesce(f"_has_{p}", F.lit(False))
            corrs[f"{p}_correlation_{d}d"] = zero(F.when(known, corr))
    return out.withColumns(corrs).drop(*cols, *[f"_has_{p}" for p in indexes])


def calendar_context(df: DataFrame) -> DataFrame:
    """Distance to month, quarter and year end, options-expiry week and earnings season."""
    d = F.to_date("ts")
    month = F.datediff(F.last_day("ts"), d)
    quarter_end = F.date_sub(F.add_months(F.trunc("ts", "quarter"), 3), 1)
    quarter = F.datediff(quarter_end, d)
    year = F.datediff(F.make_date(F.year("ts"), F.lit(12), F.lit(31)), d)
    third_friday = F.next_day(F.make_date(F.year("ts"), F.month("ts"), F.lit(14)), "Fri")
    return df.withColumns(
        {
            "days_to_month_end": month,
            "is_month_end": flag(month <= 3),
            "days_to_quarter_end": quarter,
            "is_quarter_end": flag(quarter <= 5),
            "is_year_end": flag(year <= 10),
            "is_options_expiry_week": flag(F.abs(F.datediff(third_friday, d)) <= 3),
            "is_earnings_season": flag(F.month("ts").isin(1, 4, 7, 10) & F.dayofmonth("ts").between(10, 25)),
        }
    )
