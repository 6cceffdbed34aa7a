"""Queries over price bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators.ordered import row_chunks, running_sums
from marketframe.plans.sqlkit import BARS, rounded, rsql, with_sql
from marketframe.sources import derived

ID = ["symbol", "ts"]
OHLCV = ["open", "high", "low", "close", "volume"]


def _family(*names, keep, totals=False, regime=False, digits=6, **special):
    def run(spark, folder):
        out = B.bar_features(derived.bars(spark, folder), names, totals=totals, regime=regime, calendar=False)
        return rounded(out.select(*ID, *keep), digits, **special)

    return run


def _lag(col, n=1):
    return f"lag({col}, {n}) over w"


def _full(expr, n, frame_col=None):
    """SQL for a full-window aggregate over the last n rows."""
    col = frame_col or expr[expr.index("(") + 1 : -1]
    fr = f"over (partition by symbol order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({col}) {fr} = {n} then {expr} {fr} end"


W = "window w as (partition by symbol order by ts)"
PRICE = f"""p as (select *, close - {_lag('close')} as price_change, (close - {_lag('close')}) / {_lag('close')} as price_change_pct,
 ln(close / {_lag('close')}) as log_return, (high - low) / close as high_low_pct, (close - open) / open as open_close_pct,
 case when {_lag('close')} is not null then greatest((open - {_lag('close')}) / {_lag('close')}, 0) end as gap_up,
 case when {_lag('close')} is not null then greatest(({_lag('close')} - open) / {_lag('close')}, 0) end as gap_down,
 (high + low + close) / 3 as typical_price, (high + low + 2 * close) / 4 as weighted_close,
 row_number() over w - 1 as rn from bars {W})"""
PRICE_COLS = [
    "price_change", "price_change_pct", "log_return", "high_low_pct", "open_close_pct", "gap_up", "gap_down",
    "typical_price", "weighted_close",
]


def _ewm_sql(src, value, span):
    """Correlated sum over the history of the series: value and weight decay by row distance."""
    q = f"(1.0::double - 2.0::double / {span + 1})"
    return (
        f"(select sum(b.{value} * power({q}, a.rn - b.rn)) / sum(power({q}, a.rn - b.rn)) "
        f"from {src} b where b.symbol = a.symbol and b.rn <= a.rn)"
    )


def _sma_cols():
    return [f"sma_{w}" for w in B.MA_WINDOWS]


SMA = "m as (select *, " + ", ".join(_full("avg(close)", w) + f" as sma_{w}" for w in B.MA_WINDOWS) + " from p)"


def q_resample(timeframe):
    def run(spark, folder):
        return rounded(B.resample(derived.bars(spark, folder), timeframe))

    return run


def sql_resample(period):
    return with_sql(
        [BARS],
        f"""select symbol, cast({period} as timestamp) as ts, min_by(open, ts) as open, max(high) as high,
        min(low) as low, max_by(close, ts) as close, sum(volume) as volume from bars group by 1, 2""",
    )


def q_ticks_15min(spark, folder):
    return B.bars_from_ticks(derived.ticks(spark, folder), "15min")


def q_minimum_slice(spark, folder):
    """Hourly bars, returns, averages, volatility and cross flag; latest row per symbol."""
    out = B.bar_features(
        derived.bars(spark, folder), ("price", "moving_averages", "volatility"), totals=False, regime=False, calendar=False
    )
    cols = [*ID, "close", "price_change_pct", "sma_5", "sma_20", "volatility_20", "sma_10_20_cross"]
    return rounded(B.latest_bar(out.select(*cols)))


def q_totals(spark, folder):
    c = B.price_features(row_chunks(derived.bars(spark, folder), halo=2))
    return rounded(running_sums(c, B.volume_totals()).select(*ID, "obv", "vpt", "ad_line"), 4)


def q_time(spark, folder):
    return B.time_features(derived.bars(spark, folder)).drop(*OHLCV)


def q_regime(spark, folder):
    out = B.bar_features(derived.bars(spark, folder), ("price", "volatility"), totals=False, regime=True, calendar=False)
    return rounded(out.select(*ID, "vol_regime", "fear_index"))


def q_history(spark, folder):
    return B.enough_history(derived.bars(spark, folder)).select(*ID, "close")


def q_ready(spark, folder):
    return B.history_ready(derived.bars(spark, folder))


def q_range(spark, folder):
    out = B.bars_between(
        derived.bars(spark, folder), "2024-01-15 00:00:00", "2024-01-20 00:00:00", 3, ["click", "view", "nosuch"]
    )
    return out


def q_latest(spark, folder):
    bars = derived.bars(spark, folder)
    end = bars.agg(F.max("ts").alias("_end"))
    recent = bars.crossJoin(F.broadcast(end)).filter(F.col("ts") >= F.col("_end") - F.expr("interval 1 day"))
    return recent.drop("_end")


QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql):
    QUERIES[name] = query
    SQL[name] = sql


_add("s05_resample_1d", q_resample("1d"), sql_resample("date_trunc('day', ts)"))
_add("s05_resample_1w", q_resample("1w"), sql_resample("date_trunc('week', ts)"))
_add("s05_resample_1mo", q_resample("1mo"), sql_resample("date_trunc('month', ts)"))
_add(
    "s05_bars_15min_from_ticks",
    q_ticks_15min,
    """select event_type as symbol, time_bucket(interval '15 minutes', ts) as ts, min_by(value, ts) as open, max(value) as high,
    min(value) as low, max_by(value, ts) as close, cast(count(*) as double) as volume from events group by 1, 2""",
)
_add(
    "s03_bars_by_symbol_and_range",
    q_range,
    with_sql([BARS], """select * from bars where symbol in ('click', 'view', 'nosuch')
    and ts >= timestamp '2024-01-12 00:00:00' and ts <= timestamp '2024-01-20 00:00:00'"""),
)
_add(
    "s04_latest_bars",
    q_latest,
    with_sql([BARS], "select * from bars where ts >= (select max(ts) from bars) - interval 1 day"),
)
_add(
    "minimum_slice_latest_features",
    q_minimum_slice,
    rsql(
        with_sql(
            [BARS, PRICE, SMA],
            f"""select symbol, ts, close, price_change_pct, sma_5, sma_20,
            {_full('stddev_samp(log_return)', 20)} as volatility_20, coalesce(sma_10 > sma_20, false)::int as sma_10_20_cross
            from m qualify row_number() over (partition by symbol order by ts desc) = 1""",
        ),
        [*ID, "sma_10_20_cross"],
        ["close", "price_change_pct", "sma_5", "sma_20", "volatility_20"],
    ),
)
_add(
    "w01_w03_price_features",
    _family("price", keep=PRICE_COLS),
    rsql(with_sql([BARS, PRICE], "select * from p"), ID, PRICE_COLS),
)
_ma_cols = [c for w in B.MA_WINDOWS for c in (f"sma_{w}", f"price_sma_{w}_ratio", f"sma_{w}_slope")]
_cross = ["sma_10_20_cross", "sma_20_50_cross", "sma_50_200_cross"]
_add(
    "w04_w06_w07_moving_averages",
    _family("price", "moving_averages", keep=[*_ma_cols, *_cross]),
    rsql(
        with_sql(
            [BARS, PRICE, SMA],
            "select symbol, ts, "
            + ", ".join(
                f"sma_{w}, close / sma_{w} as price_sma_{w}_ratio, (sma_{w} - lag(sma_{w}, 5) over w) / 5 as sma_{w}_slope"
                for w in B.MA_WINDOWS
            )
            + ", "
            + ", ".join(f"coalesce(sma_{a} > sma_{b}, false)::int as sma_{a}_{b}_cross" for a, b in ((10, 20), (20, 50), (50, 200)))
            + f" from m {W}",
        ),
        [*ID, *_cross],
        _ma_cols,
    ),
)
_ema_cols = [c for w in B.MA_WINDOWS for c in (f"ema_{w}", f"price_ema_{w}_ratio")]
_add(
    "w05_w06_exponential_averages",
    _family("moving_averages", keep=_ema_cols),
    rsql(
        with_sql(
            [BARS, PRICE, "e as (select symbol, ts, close, " + ", ".join(f"{_ewm_sql('p', 'close', w)} as ema_{w}" for w in B.MA_WINDOWS) + " from p a)"],
            "select symbol, ts, " + ", ".join(f"ema_{w}, close / ema_{w} as price_ema_{w}_ratio" for w in B.MA_WINDOWS) + " from e",
        ),
        ID,
        _ema_cols,
    ),
)
_vol_cols = [c for w in B.VOL_WINDOWS for c in (f"volatility_{w}", f"range_volatility_{w}", f"parkinson_vol_{w}")]
_vol_sql = ", ".join(
    f"{_full('stddev_samp(log_return)', w)} as volatility_{w}, ({_full('avg(high - low)', w)}) / close as range_volatility_{w}, "
    f"sqrt(0.361::double * ({_full('avg(ln(high / low))', w)})) as parkinson_vol_{w}"
    for w in B.VOL_WINDOWS
)
_add(
    "w08_volatility",
    _family("volatility", keep=_vol_cols),
    rsql(with_sql([BARS, PRICE], f"select symbol, ts, {_vol_sql} from p"), ID, _vol_cols),
)
_add(
    "w09_volatility_regime",
    q_regime,
    rsql(
        with_sql(
            [BARS, PRICE, f"v as (select symbol, ts, {_full('stddev_samp(log_return)', 20)} as v from p)",
             "q as (select symbol, quantile_cont(v, 0.33) as a, quantile_cont(v, 0.67) as b from v where v is not null group by 1)"],
            """select symbol, ts, case when v <= a then 'low' when v <= b then 'medium' when v is not null then 'high' end as vol_regime,
            v * 100 as fear_index from v left join q using (symbol)""",
        ),
        [*ID, "vol_regime"],
        ["fear_index"],
    ),
)
_volume_cols = [c for w in B.VOLUME_WINDOWS for c in (f"volume_sma_{w}", f"volume_ratio_{w}")]
_add(
    "w10_volume_features",
    _family("volume", keep=[*_volume_cols, "volume_spike"]),
    rsql(
        with_sql(
            [BARS, "v as (select *, " + ", ".join(f"{_full('avg(volume)', w)} as volume_sma_{w}" for w in B.VOLUME_WINDOWS) + " from bars)"],
            "select symbol, ts, " + ", ".join(f"volume_sma_{w}, volume / volume_sma_{w} as volume_ratio_{w}" for w in B.VOLUME_WINDOWS)
            + ", coalesce(volume > 2 * volume_sma_20, false)::int as volume_spike from v",
        ),
        [*ID, "volume_spike"],
        _volume_cols,
    ),
)


def _cum(term):
    return f"case when {term} is not null then sum({term}) over (partition by symbol order by ts rows unbounded preceding) end"


_clv = "((close - low) - (high - close)) / nullif(high - low, 0)"
_add(
    "w11_running_volume_totals",
    q_totals,
    rsql(
        with_sql(
            [BARS, PRICE],
            f"""select symbol, ts, {_cum('(sign(price_change) * volume)')} as obv, {_cum('(price_change_pct * volume)')} as vpt,
            {_cum(f'({_clv} * volume)')} as ad_line from p""",
        ),
        ID,
        ["obv", "vpt", "ad_line"],
        4,
    ),
)
_mom_cols = ["roc_1", "roc_5", "roc_10", "roc_20", "momentum_5", "momentum_10", "momentum_20", "williams_r_14", "williams_r_20"]
_mom_sql = ", ".join(f"(close - {_lag('close', n)}) / {_lag('close', n)} * 100 as roc_{n}" for n in (1, 5, 10, 20))
_mom_sql += ", " + ", ".join(f"close - {_lag('close', n)} as momentum_{n}" for n in (5, 10, 20))
_mom_sql += ", " + ", ".join(
    f"-100 * (({_full('max(high)', n)}) - close) / nullif(({_full('max(high)', n)}) - ({_full('min(low)', n)}), 0) as williams_r_{n}"
    for n in (14, 20)
)
_add(
    "w12_w13_momentum",
    _family("momentum", keep=_mom_cols),
    rsql(with_sql([BARS], f"select symbol, ts, {_mom_sql} from bars {W}"), ID, _mom_cols),
)
_ind_cols = ["rsi_14", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_position"]
_RSI = f"""g as (select *, {_full('avg(gain)', 14)} as ag, {_full('avg(loss)', 14)} as al, {_full('avg(close)', 20)} as mid,
 {_full('stddev_samp(close)', 20)} as dev from (select *, case when price_change > 0 then price_change else 0 end as gain,
 case when price_change < 0 then -price_change else 0 end as loss from p))"""
_MACD = f"k as (select symbol, ts, rn, {_ewm_sql('p', 'close', 12)} - {_ewm_sql('p', 'close', 26)} as macd from p a)"
_SIG = f"s as (select symbol, ts, macd, {_ewm_sql('k', 'macd', 9)} as macd_signal from k a)"
_add(
    "w14_w15_w16_indicators",
    _family("indicators", keep=_ind_cols),
    rsql(
        with_sql(
            [BARS, PRICE, _RSI, _MACD, _SIG],
            """select g.symbol, g.ts, case when al = 0 and ag > 0 then 100 when al = 0 then null else 100 - 100 / (1 + ag / nullif(al, 0)) end as rsi_14,
            macd, macd_signal, macd - macd_signal as macd_histogram, mid + 2 * dev as bb_upper, mid as bb_middle, mid - 2 * dev as bb_lower,
            4 * dev / mid as bb_width, (close - (mid - 2 * dev)) / nullif(4 * dev, 0) as bb_position
            from g join s using (symbol, ts)""",
        ),
        ID,
        _ind_cols,
    ),
)


def _wilder_sql(src, value, period, first):
    q = f"(1.0::double - 1.0::double / {period})"
    return (
        f"case when a.rn >= {first} then (select sum(b.{value} * power({q}, a.rn - greatest(b.rn, {first}))) / {period} "
        f"from {src} b where b.symbol = a.symbol and b.rn <= a.rn) end"
    )


_ext_cols = ["rsi_14_wilder", "stoch_k", "stoch_d", "adx", "cci", "bb_upper_pop", "bb_lower_pop"]
_XT = """x as (select *, case when pc is not null then case when high - ph > pl - low and high - ph > 0 then high - ph else 0 end end as up,
 case when pc is not null then case when pl - low > high - ph and pl - low > 0 then pl - low else 0 end end as dn,
 case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr,
 case when pc is not null then greatest(close - pc, 0) end as rise, case when pc is not null then greatest(pc - close, 0) end as fall,
 (high + low + close) / 3 as tp from (select *, lag(close) over w as pc, lag(high) over w as ph, lag(low) over w as pl from p
 window w as (partition by symbol order by ts)))"""
_XK = f"y as (select *, ({_full('min(low)', 5)}) as l5, ({_full('max(high)', 5)}) as h5, ({_full('avg(tp)', 14)}) as tpm, " \
      f"({_full('avg(close)', 20)}) as mid, ({_full('stddev_pop(close)', 20)}) as pdev from x)"
_XF = "f as (select *, (close - l5) * 100 / nullif(h5 - l5, 0) as fk from y)"
_XS = f"st as (select *, {_full('avg(fk)', 3)} as stoch_k from f)"
_XW = "wl as (select a.symbol, a.ts, a.rn, " + ", ".join(
    f"{_wilder_sql('x', v, 14, n)} as {o}"
    for v, n, o in (("up", 13, "plus"), ("dn", 13, "minus"), ("tr", 13, "tru"), ("rise", 14, "ar"), ("fall", 14, "af"))
) + " from x a)"
_XD = """dx as (select *, case when rn >= 14 then coalesce(abs(plus / nullif(tru, 0) - minus / nullif(tru, 0)) * 100
 / nullif(plus / nullif(tru, 0) + minus / nullif(tru, 0), 0), 0) end as dxv from wl)"""
_XA = f"ad as (select a.symbol, a.ts, {_wilder_sql('dx', 'dxv', 14, 27)} as adx, ar, af from dx a)"
_XC = """cc as (select a.symbol, a.ts, sum(abs(b.tp - a.tpm)) / 14 as md from y a join y b on a.symbol = b.symbol and b.rn between a.rn - 13 and a.rn
 where a.tpm is not null group by 1, 2)"""
_add(
    "w17_extended_indicators",
    _family("extended", keep=_ext_cols),
    rsql(
        with_sql(
            [BARS, PRICE, _XT, _XK, _XF, _XS, _XW, _XD, _XA, _XC],
            f"""select st.symbol, st.ts, case when af = 0 and ar > 0 then 100 when ar is not null then 100 - 100 * af / nullif(ar + af, 0) end as rsi_14_wilder,
            stoch_k, {_full('avg(stoch_k)', 3)} as stoch_d, adx, case when tpm is not null then coalesce((tp - tpm) / nullif(0.015::double * md, 0), 0) end as cci,
            mid + 2 * pdev as bb_upper_pop, mid - 2 * pdev as bb_lower_pop
            from st join ad using (symbol, ts) left join cc using (symbol, ts)""",
        ),
        ID,
        _ext_cols,
    ),
)
_pat_cols = ["is_doji", "is_hammer", "bullish_engulfing", "gap_up_pattern", "gap_down_pattern", "higher_high", "higher_low", "uptrend_signal"]


def _f(cond):
    return f"coalesce({cond}, false)::int"


_add(
    "w18_w19_patterns",
    _family("patterns", keep=_pat_cols),
    with_sql(
        [BARS, "z as (select *, abs(close - open) as body, lag(open) over w as po, lag(close) over w as pk, lag(high) over w as ph, lag(low) over w as pl from bars " + W + ")"],
        f"""select symbol, ts, {_f('body / nullif(high - low, 0) < 0.1')} as is_doji,
        {_f('least(open, close) - low > 2 * body and high - greatest(open, close) < body')} as is_hammer,
        {_f('open < close and po > pk and open < pk and close > po')} as bullish_engulfing,
        {_f('low > ph')} as gap_up_pattern, {_f('high < pl')} as gap_down_pattern, {_f('high > ph')} as higher_high,
        {_f('low > pl')} as higher_low, {_f('high > ph and low > pl')} as uptrend_signal from z""",
    ),
)
_add(
    "f19_time_features",
    q_time,
    with_sql(
        [BARS],
        f"""select symbol, ts, hour(ts)::int as hour, (isodow(ts) - 1)::int as day_of_week, day(ts)::int as day_of_month, month(ts)::int as month,
        quarter(ts)::int as quarter, {_f('hour(ts) >= 9 and hour(ts) < 16')} as is_market_open, {_f('hour(ts) >= 4 and hour(ts) < 9')} as is_pre_market,
        {_f('hour(ts) >= 16 and hour(ts) < 20')} as is_after_market, {_f('isodow(ts) >= 6')} as is_weekend, {_f('isodow(ts) = 1')} as is_monday,
        {_f('isodow(ts) = 5')} as is_friday, (last_day(ts) - ts::date)::int as days_to_month_end,
        {_f('last_day(ts) - ts::date <= 3')} as is_month_end from bars""",
    ),
)
_add(
    "p17_bars_with_enough_history",
    q_history,
    with_sql([BARS], "select symbol, ts, close from bars qualify row_number() over (partition by symbol order by ts) >= 20"),
)
_add(
    "p17_history_ready",
    q_ready,
    with_sql([BARS], "select min(n)::bigint as fewest_bars, min(n) >= 20 as ready from (select symbol, count(*) as n from bars group by 1)"),
)
