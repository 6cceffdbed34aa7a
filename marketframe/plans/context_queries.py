"""Queries for market context, targets and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators import context as C
from marketframe.operators import features as M
from marketframe.operators import targets as T
from marketframe.plans.bar_queries import PRICE, _full
from marketframe.plans.sqlkit import BARS, DETECTIONS, rounded, rsql, with_sql
from marketframe.sources import derived

QUERIES: dict = {}
SQL: dict = {}
ID = ["symbol", "ts"]
SYMBOLS = ["click", "view", "purchase", "signup", "error"]


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _refs(spark, folder):
    return derived.bars(spark, folder).select(F.col("symbol").alias("name"), "ts", "close")


def _bars(spark, folder):
    return derived.bars(spark, folder).select(*ID, "close")


REFS = "refs as (select symbol as name, ts, close from bars)"


def _past(d):
    return f"(select arg_max(p.close, p.ts) from refs p where p.name = r.name and p.ts <= r.ts - interval {d} day)"


def _ff(col, default="0"):
    return f"coalesce(last_value({col} ignore nulls) over (partition by symbol order by ts rows unbounded preceding), {default})"


def _ref_full(expr, col, n):
    fr = f"over (partition by name order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({col}) {fr} = {n} then {expr} {fr} end"


_reg = [f"regime_{r}" for r in C.REGIMES]
_add(
    "w35_j09_market_regime",
    lambda s, f: rounded(C.market_regime(_bars(s, f), _refs(s, f), "view").drop("close")),
    rsql(
        with_sql(
            [BARS, REFS, "mv as (select *, " + ", ".join(f"{_ref_full('avg(close)', 'close', w)} as ma{w}" for w in (20, 50, 200)) + " from refs where name = 'view')",
             """fx as (select ts, case when ma200 is null then 'neutral' when close > ma200 then case when close > ma50 then 'bull' else 'neutral' end else 'bear' end as reg, (close - ma20) / ma20 * 100 as t20,
             (close - ma50) / ma50 * 100 as t50, case when ma200 is not null then (close > ma200)::int end as ab from mv)""",
             "jn as (select b.symbol, b.ts, coalesce(reg, 'neutral') as market_regime, case when reg is null then 0 else t20 end as t20, case when reg is null then 0 else t50 end as t50, case when reg is null then 0 else ab end as ab from bars b left join fx using (ts))"],
            f"select symbol, ts, market_regime, {_ff('t20')} as market_trend_20d, {_ff('t50')} as market_trend_50d, {_ff('ab')}::int as market_above_ma200, "
            + ", ".join(f"(market_regime = '{r}')::int as regime_{r}" for r in C.REGIMES) + " from jn",
        ),
        [*ID, "market_regime", "market_above_ma200", *_reg],
        ["market_trend_20d", "market_trend_50d"],
    ),
)
_sec = [f"{p}_{d}d" for d in C.SECTOR_DAYS for p in ("best_sector_performance", "worst_sector_performance", "sector_dispersion")]
_add(
    "w36_j10_sector_performance",
    lambda s, f: rounded(C.sector_performance(_bars(s, f), _refs(s, f), SYMBOLS).drop("close")),
    rsql(
        with_sql(
            [BARS, REFS, "sr as (select ts, " + ", ".join(f"(close - {_past(d)}) / {_past(d)} * 100 as r{d}" for d in C.SECTOR_DAYS) + " from refs r)",
             "sp as (select ts, " + ", ".join(f"max(r{d}) as best_sector_performance_{d}d, min(r{d}) as worst_sector_performance_{d}d, stddev_pop(r{d}) as sector_dispersion_{d}d" for d in C.SECTOR_DAYS) + " from sr group by 1)"],
            "select symbol, ts, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _sec) + " from bars left join sp using (ts)",
        ),
        ID,
        _sec,
    ),
)
MACRO = {"click": "treasury_20y", "purchase": "gold", "signup": "dollar_index", "error": "volatility"}
_mac = [f"{p}_{x}" for p in MACRO.values() for x in ("price", "return_1d", "return_5d")]
_add(
    "w37_macro_indicators",
    lambda s, f: rounded(C.macro_indicators(_bars(s, f), _refs(s, f), MACRO).drop("close")),
    rsql(
        with_sql(
            [BARS, REFS, f"mr as (select name, ts, close, (close - {_past(1)}) / {_past(1)} * 100 as r1, (close - {_past(5)}) / {_past(5)} * 100 as r5 from refs r)",
             "mp as (select b.symbol, b.ts, " + ", ".join(
                 f"case when m{i}.ts is null then 0 else m{i}.close end as {p}_price, case when m{i}.ts is null then 0 else m{i}.r1 end as {p}_return_1d, case when m{i}.ts is null then 0 else m{i}.r5 end as {p}_return_5d" for i, p in enumerate(MACRO.values()))
             + " from bars b " + " ".join(f"left join (select * from mr where name = '{n}') m{i} on m{i}.ts = b.ts" for i, n in enumerate(MACRO)) + ")"],
            "select symbol, ts, " + ", ".join(f"{_ff(c)} as {c}" for c in _mac) + " from mp",
        ),
        ID,
        _mac,
    ),
)
_vr = [f"vol_regime_{r}" for r in C.VOL_REGIMES]
_add(
    "w38_f21_volatility_regime",
    lambda s, f: rounded(C.volatility_regime(_bars(s, f), _refs(s, f), "error").drop("close")),
    rsql(
        with_sql(
            [BARS, REFS, f"vx as (select ts, close as v, case when close < 15 then 'low' when close < 25 then 'medium' when close < 35 then 'high' else 'extreme' end as reg, coalesce((close - {_past(1)}) / {_past(1)} > 0.2::double, false)::int as sp from refs r where name = 'error')"],
            "select symbol, ts, vix_level, volatility_regime, vix_spike, " + ", ".join(f"(volatility_regime = '{r}')::int as vol_regime_{r}" for r in C.VOL_REGIMES)
            + " from (select symbol, ts, coalesce(v, 20) as vix_level, coalesce(reg, 'medium') as volatility_regime, coalesce(sp, 0)::int as vix_spike from bars left join vx using (ts))",
        ),
        [*ID, "volatility_regime", "vix_spike", *_vr],
        ["vix_level"],
    ),
)
_cry = ["crypto_market_trend", "crypto_volatility", "crypto_dominance_signal"]
_add(
    "w39_crypto_market",
    lambda s, f: rounded(C.crypto_market(_bars(s, f), _refs(s, f), "click", "purchase").drop("close")),
    rsql(
        with_sql(
            [BARS, REFS, f"c0 as (select name, ts, (close - {_past(20)}) / {_past(20)} as r20, (close - lag(close) over (partition by name order by ts)) / lag(close) over (partition by name order by ts) as ret from refs r)",
             f"c1 as (select *, {_ref_full('stddev_samp(ret)', 'ret', 20)} * sqrt(365.0::double) * 100 as vol from c0)",
             "c2 as (select b.ts, coalesce(b.r20 * 100, 0) as crypto_market_trend, coalesce(b.vol, 0) as crypto_volatility, coalesce(b.r20 - e.r20, 0) as crypto_dominance_signal from (select * from c1 where name = 'click') b left join (select * from c1 where name = 'purchase') e using (ts))"],
            "select symbol, ts, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _cry) + " from bars left join c2 using (ts)",
        ),
        ID,
        _cry,
    ),
)
_cor = [f"{p}_correlation_{d}d" for p in ("spy", "qqq") for d in C.CORRELATION_DAYS]


def _corr_cte(p, name, d):
    return f"""{p}{d} as (select b.symbol, b.ts, case when count(y.ret) >= 10 then covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0) end as c from rt b
 join (select ts from rt where symbol = '{name}') h on h.ts = b.ts join rt x on x.symbol = b.symbol and x.ts >= b.ts - interval {d} day and x.ts <= b.ts and x.ret is not null
 join (select ts, ret from rt where symbol = '{name}' and ret is not null) y on y.ts = x.ts group by 1, 2)"""


_add(
    "w40_j11_index_correlation",
    lambda s, f: rounded(C.index_correlation(_bars(s, f), _refs(s, f), {"spy": "view", "qqq": "error"}).drop("close")),
    rsql(
        with_sql(
            [BARS, "rt as (select symbol, ts, (close - lag(close) over w) / lag(close) over w as ret from bars window w as (partition by symbol order by ts))",
             *[_corr_cte(p, n, d) for p, n in (("spy", "view"), ("qqq", "error")) for d in C.CORRELATION_DAYS]],
            "select b.symbol, b.ts, " + ", ".join(f"coalesce({p}{d}.c, 0) as {p}_correlation_{d}d" for p in ("spy", "qqq") for d in C.CORRELATION_DAYS)
            + " from bars b " + " ".join(f"left join {p}{d} on {p}{d}.symbol = b.symbol and {p}{d}.ts = b.ts" for p in ("spy", "qqq") for d in C.CORRELATION_DAYS),
        ),
        ID,
        _cor,
    ),
)


def q_calendar(spark, folder):
    orders = derived.read(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return C.calendar_context(orders)


_add(
    "f20_calendar_context",
    q_calendar,
    """select o_orderkey, ts, (last_day(d) - d)::int as days_to_month_end, (last_day(d) - d <= 3)::int as is_month_end, (qe - d)::int as days_to_quarter_end, (qe - d <= 5)::int as is_quarter_end,
    (make_date(year(d), 12, 31) - d <= 10)::int as is_year_end, (abs(tf - d) <= 3)::int as is_options_expiry_week, (month(d) in (1, 4, 7, 10) and day(d) between 10 and 25)::int as is_earnings_season
    from (select *, (date_trunc('quarter', d) + interval 3 month)::date - 1 as qe, (date_trunc('month', d)::date + 14 + ((5 - isodow(date_trunc('month', d)::date + 14) + 7) % 7)::int) as tf from (select o_orderkey, o_orderdate as ts, o_orderdate::date as d from orders))""",
)

# ------------------------------------------------------------------ targets

FWD = "fw as (select *, " + ", ".join(f"(lead(close, {n}) over w - close) / close as f{n}" for n in (1, 3, 5, 10)) + ", lead(high) over w as nh, lead(low) over w as nl from p window w as (partition by symbol order by ts))"


def _targets(keep, digits=6):
    def run(spark, folder):
        return rounded(T.all_targets(derived.bars(spark, folder)).select(*ID, *keep), digits)

    return run


def _f(cond):
    return f"coalesce({cond}, false)::int"


_bin = ["target_binary_return", "target_binary_return_005bp", "target_binary_return_020bp", "target_binary_return_050bp", "target_binary_strong"]
_add(
    "l1_binary_targets",
    _targets(_bin),
    with_sql([BARS, PRICE, FWD], f"""select symbol, ts, {_f('f1 > 0.01::double')} as target_binary_return, {_f('f1 > 0.005::double')} as target_binary_return_005bp, {_f('f1 > 0.02::double')} as target_binary_return_020bp,
    {_f('f1 > 0.05::double')} as target_binary_return_050bp, (case when f1 > 0.01::double then 1 when f1 < -0.01::double then -1 else 0 end)::int as target_binary_strong from fw"""),
)
_regc = ["target_return", "target_log_return", "target_return_3p", "target_return_5p", "target_return_10p"]


def _clip(c):
    return f"case when {c} is not null then greatest(-0.1::double, least({c}, 0.1::double)) end"


_add(
    "l2_regression_targets",
    _targets(_regc),
    rsql(with_sql([BARS, PRICE, FWD], f"select symbol, ts, {_clip('f1')} as target_return, ln(1 + {_clip('f1')}) as target_log_return, {_clip('f3')} as target_return_3p, {_clip('f5')} as target_return_5p, {_clip('f10')} as target_return_10p from fw"), ID, _regc),
)
_volt = ["target_volatility", "target_volatility_annualized", "target_intraday_volatility"]
VOLT = f"""vt as (select symbol, ts, lead(rv) over w as target_volatility, lead(iv) over w as target_intraday_volatility from (select *, {_full('stddev_samp(price_change_pct)', 5)} as rv, {_full('avg((high - low) / close)', 5)} as iv from p)
 window w as (partition by symbol order by ts)), vq as (select symbol, quantile_cont(target_volatility, 0.7) as cut from vt where target_volatility is not null group by 1)"""
_add(
    "l3_volatility_targets",
    _targets([*_volt, "target_high_volatility"]),
    rsql(with_sql([BARS, PRICE, VOLT], f"select symbol, ts, target_volatility, target_volatility * sqrt(252.0::double) as target_volatility_annualized, target_intraday_volatility, {_f('target_volatility > cut')} as target_high_volatility from vt left join vq using (symbol)"),
         [*ID, "target_high_volatility"], _volt),
)
_brk = ["target_upward_breakout", "target_downward_breakout", "target_any_breakout", "target_strong_breakout"]
_add(
    "l4_breakout_targets",
    _targets(_brk),
    with_sql([BARS, PRICE, FWD, f"bk as (select *, {_full('max(high)', 20)} as top, {_full('min(low)', 20)} as bot from fw)"],
             f"""select symbol, ts, {_f('nh > top * 1.02::double')} as target_upward_breakout, {_f('nl < bot * 0.98::double')} as target_downward_breakout, greatest({_f('nh > top * 1.02::double')}, {_f('nl < bot * 0.98::double')}) as target_any_breakout,
             greatest({_f('nh > top * 1.05::double')}, {_f('nl < bot * 0.95::double')}) as target_strong_breakout from bk"""),
)
MCL = """mc as (select symbol, ts, case when f1 is null then null when f1 <= -0.02::double then 'strong_down' when f1 <= -0.01::double then 'down' when f1 <= 0.01::double then 'neutral' when f1 <= 0.02::double then 'up' else 'strong_up' end as k,
 (case when f1 is null then -1 when f1 <= -0.02::double then 0 when f1 <= -0.01::double then 1 when f1 <= 0.01::double then 2 when f1 <= 0.02::double then 3 else 4 end)::int as code from fw)"""
_add(
    "l5_multiclass_targets",
    _targets(["target_return_class", "target_return_class_numeric", *[f"target_class_{k}" for k in T.CLASSES]]),
    with_sql([BARS, PRICE, FWD, MCL], "select symbol, ts, k as target_return_class, code as target_return_class_numeric, " + ", ".join(f"coalesce(k = '{k}', false)::int as target_class_{k}" for k in T.CLASSES) + " from mc"),
)
_ev = ["target_pre_event_return", "target_post_event_return"]
EVT = """er as (select e.symbol, e.ts as ets, e.event_id, (arg_max(b.close, b.ts) filter (b.ts < e.ts) - arg_min(b.close, b.ts) filter (b.ts < e.ts)) / arg_min(b.close, b.ts) filter (b.ts < e.ts) as pre,
 (arg_max(b.close, b.ts) filter (b.ts > e.ts) - arg_min(b.close, b.ts) filter (b.ts > e.ts)) / arg_min(b.close, b.ts) filter (b.ts > e.ts) as post from detections e join bars b on b.symbol = e.symbol and b.ts >= e.ts - interval 24 hour and b.ts <= e.ts + interval 24 hour group by 1, 2, 3)"""
_add(
    "l6_j12_event_study_targets",
    lambda s, f: rounded(T.event_targets(derived.bars(s, f), derived.detections(s, f)).select(*ID, *_ev, "target_event_impact", "target_has_event_soon")),
    rsql(
        with_sql([BARS, DETECTIONS, EVT,
                  "pa as (select b.symbol, b.ts, arg_max(pre, (ets, event_id)) as pr from bars b join er on er.symbol = b.symbol and ets > b.ts and ets <= b.ts + interval 24 hour group by 1, 2)",
                  "po as (select b.symbol, b.ts, arg_max(post, (ets, event_id)) as ps, max((abs(post) > 0.01::double)::int) as im from bars b join er on er.symbol = b.symbol and ets < b.ts and ets >= b.ts - interval 24 hour group by 1, 2)"],
                 "select symbol, ts, coalesce(pr, 0) as target_pre_event_return, coalesce(ps, 0) as target_post_event_return, coalesce(im, 0)::int as target_event_impact, (pa.ts is not null)::int as target_has_event_soon from bars left join pa using (symbol, ts) left join po using (symbol, ts)"
                 .replace("(pa.ts is not null)", "(pr is not null)")),
        [*ID, "target_event_impact", "target_has_event_soon"],
        _ev,
    ),
)
_sumt = ["target_return", "target_return_3p", "target_binary_return", "target_volatility"]
_sumv = ["mean", "std", "min", "max"]
_add(
    "a09_target_summary",
    lambda s, f: rounded(T.target_summary(T.all_targets(derived.bars(s, f)), _sumt)),
    rsql(
        with_sql([BARS, PRICE, FWD, VOLT, f"tt as (select {_clip('f1')} as target_return, {_clip('f3')} as target_return_3p, {_f('f1 > 0.01::double')}::double as target_binary_return, target_volatility from fw join vt using (symbol, ts))"],
                 " union all ".join(f"select '{c}' as target, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, max({c}) as max, count(*) - count({c}) as null_count from tt" for c in _sumt)),
        ["target", "null_count"],
        _sumv,
    ),
)
_add(
    "a10_class_distribution",
    lambda s, f: T.class_distribution(T.all_targets(derived.bars(s, f)), ["target_return_class", "target_binary_strong"]),
    with_sql([BARS, PRICE, FWD, MCL], "select 'target_return_class' as target, k as value, count(*) as n from mc group by 2 union all select 'target_binary_strong', (case when f1 > 0.01::double then 1 when f1 < -0.01::double then -1 else 0 end)::varchar, count(*) from fw group by 2"),
)
_add(
    "a10_volatility_quartiles",
    lambda s, f: rounded(T.volatility_quartiles(T.all_targets(derived.bars(s, f)))),
    rsql(with_sql([BARS, PRICE, VOLT], "select symbol, quantile_cont(target_volatility, 0.25) as q25, quantile_cont(target_volatility, 0.5) as q50, quantile_cont(target_volatility, 0.75) as q75 from vt where target_volatility is not null group by 1"), ["symbol"], ["q25", "q50", "q75"]),
)

# ------------------------------------------------------------------ feature matrix

FEATS = ["price_change", "price_change_pct", "high_low_pct", "open_close_pct", "typical_price", "volatility_5"]
FT = f"ft as (select *, {_full('stddev_samp(log_return)', 5)} as volatility_5, 1.0::double as constant_one from p)"


def _matrix(spark, folder):
    out = B.bar_features(derived.bars(spark, folder), ("price", "volatility"), totals=False, regime=False, calendar=False)
    return out.withColumn("constant_one", F.lit(1.0))


def _gappy(spark, folder):
    """Bars with about a third of the closes missing."""
    gap = (F.hour("ts") % 3 == 0) | (F.dayofmonth("ts") % 7 == 0)
    return derived.bars(spark, folder).select(*ID, F.when(~gap, F.col("close")).alias("x"))


GAP = "gp as (select symbol, ts, case when not (hour(ts) % 3 = 0 or day(ts) % 7 = 0) then close end as x, row_number() over (partition by symbol order by ts) as rn from bars)"
_add(
    "w41_fill_missing",
    lambda s, f: M.fill_missing(_gappy(s, f), ["x"]).select(*ID, "x"),
    with_sql([BARS, GAP], f"select symbol, ts, {_ff('x')} as x from gp"),
)
_add(
    "w41_fill_missing_both_ways",
    lambda s, f: M.fill_missing(_gappy(s, f), ["x"], lookahead=True).select(*ID, "x"),
    with_sql([BARS, GAP], "select symbol, ts, coalesce(last_value(x ignore nulls) over (partition by symbol order by ts rows unbounded preceding), first_value(x ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following), 0) as x from gp"),
)
_add(
    "w41_interpolate",
    lambda s, f: rounded(M.fill_missing(_gappy(s, f), ["x"], "interpolate").select(*ID, "x")),
    rsql(with_sql([BARS, GAP, """ip as (select *, last_value(case when x is not null then rn end ignore nulls) over a as pr, last_value(x ignore nulls) over a as pv, first_value(case when x is not null then rn end ignore nulls) over b as nr,
    first_value(x ignore nulls) over b as nv from gp window a as (partition by symbol order by ts rows unbounded preceding), b as (partition by symbol order by ts rows between current row and unbounded following))"""],
                  "select symbol, ts, coalesce(x, case when nr is null then pv else pv + (nv - pv) * (rn - pr) / (nr - pr) end, 0) as x from ip"), ID, ["x"]),
)
_add(
    "w41_drop_missing",
    lambda s, f: M.fill_missing(_gappy(s, f), ["x"], "drop").select(*ID, "x"),
    with_sql([BARS, GAP], "select symbol, ts, x from gp where x is not null"),
)


def _imp_sql(keys, group):
    sel = ", ".join(keys) + ", " if keys else ""
    tail = f" group by {group}" if group else ""
    return " union all ".join(
        f"select {sel}'{c}' as feature, coalesce(covar_pop({c}, y) / nullif(stddev_pop({c}) filter ({c} is not null and y is not null) * stddev_pop(y) filter ({c} is not null and y is not null), 0), 0) as corr from ny{tail}"
        for c in [*FEATS, "constant_one"]
    )


NY = "ny as (select *, lead(price_change_pct) over (partition by symbol order by ts) as y from ft)"
_add("a06_feature_importance", lambda s, f: rounded(M.importance(_matrix(s, f), [*FEATS, "constant_one"], "price_change_pct")), rsql(with_sql([BARS, PRICE, FT, NY], _imp_sql([], "")), ["feature"], ["corr"]))
_add("a07_feature_importance_by_symbol", lambda s, f: rounded(M.importance(_matrix(s, f), [*FEATS, "constant_one"], "price_change_pct", ["symbol"])), rsql(with_sql([BARS, PRICE, FT, NY], _imp_sql(["symbol"], "symbol")), ["symbol", "feature"], ["corr"]))


def q_top_features(spark, folder):
    m = _matrix(spark, folder)
    names = M.top_features(m, FEATS, "price_change_pct", 3)
    return rounded(M.summary(m, names).select("feature", "mean"))


_add("t08_top_features", q_top_features,
     rsql(with_sql([BARS, PRICE, FT, NY, "im as (" + _imp_sql([], "") + ")", "tp as (select feature from im where feature <> 'constant_one' order by abs(corr) desc, feature limit 3)"],
                   "select feature, mean from (" + " union all ".join(f"select '{c}' as feature, avg({c}) as mean from ft" for c in FEATS) + ") join tp using (feature)"), ["feature"], ["mean"]))
_add(
    "a08_feature_summary",
    lambda s, f: rounded(M.summary(_matrix(s, f), [*FEATS, "constant_one"])),
    rsql(with_sql([BARS, PRICE, FT], " union all ".join(f"select '{c}' as feature, count(*) as n_rows, count(*) - count({c}) as missing, (count(*) - count({c})) * 100.0::double / count(*) as missing_percent, min({c}) as min, max({c}) as max, avg({c}) as mean from ft" for c in [*FEATS, "constant_one"])),
         ["feature", "n_rows", "missing"], ["missing_percent", "min", "max", "mean"]),
)
_add("a11_medians", lambda s, f: rounded(M.medians(_matrix(s, f), FEATS)), rsql(with_sql([BARS, PRICE, FT], " union all ".join(f"select '{c}' as feature, quantile_cont({c}, 0.5) as median from ft where {c} is not null" for c in FEATS)), ["feature"], ["median"]))
_add("a12_constant_features", lambda s, f: M.constant_features(_matrix(s, f), [*FEATS, "constant_one"]), with_sql([BARS, PRICE, FT], "select feature from (" + " union all ".join(f"select '{c}' as feature, min({c}) as lo, max({c}) as hi from ft" for c in [*FEATS, "constant_one"]) + ") where lo is null or lo = hi"))
_add(
    "a13_symbols_with_enough_rows",
    lambda s, f: M.with_enough_rows(derived.bars(s, f), 650).select(*ID),
    with_sql([BARS], "select symbol, ts from bars where symbol in (select symbol from bars group by 1 having count(*) >= 650)"),
)
_add(
    "a47_correlated_features",
    lambda s, f: rounded(M.correlated_features(_matrix(s, f), FEATS, 0.5)),
    rsql(with_sql([BARS, PRICE, FT], "select * from (" + " union all ".join(
        f"select '{a}' as a, '{b}' as b, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) as corr from ft where {a} is not null and {b} is not null" for i, a in enumerate(FEATS) for b in FEATS[i + 1 :]) + ") where abs(corr) > 0.5"), ["a", "b"], ["corr"]),
)
_add(
    "p28_p30_u06_aligned_columns",
    lambda s, f: rounded(M.align_columns(_matrix(s, f), ["volatility_5", "price_change", "not_there"])),
    rsql(with_sql([BARS, PRICE, FT], "select symbol, ts, coalesce(volatility_5, 0) as volatility_5, coalesce(price_change, 0) as price_change, 0::double as not_there from ft"), ID, ["volatility_5", "price_change", "not_there"]),
)
_ml = [*FEATS, "target"]
_add(
    "l7_ml_dataset",
    lambda s, f: rounded(M.ml_dataset(_matrix(s, f), features=FEATS, min_samples=100).select(*ID, *_ml)),
    rsql(with_sql([BARS, PRICE, FT, "lt as (select * from (select *, lead(price_change_pct) over (partition by symbol order by ts) as target, count(*) over (partition by symbol) as n from ft) where target is not null and n >= 100)"],
                  "select symbol, ts, " + ", ".join(FEATS) + ", target from lt"), ID, _ml),
)


def q_time_split(spark, folder):
    parts = M.time_split(derived.bars(spark, folder).select(*ID))
    out = None
    for name, part in zip(("train", "val", "test"), parts):
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_add("l9_time_split", q_time_split,
     with_sql([BARS, "q as (select quantile_cont(epoch_us(ts)::double, 0.6) as a, quantile_cont(epoch_us(ts)::double, 0.8) as b from bars)"], "select symbol, ts, case when epoch_us(ts) <= a then 'train' when epoch_us(ts) <= b then 'val' else 'test' end as split from bars, q"))


def q_stratified(spark, folder):
    labels = derived.read(spark, folder, "events")
    out = M.stratified_split(labels, "event_type", ["event_id"])
    return out.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"))


_add(
    "l9_stratified_split",
    q_stratified,
    """select event_type, split, count(*) as n from (select event_type, case when u <= quantile_cont(u, 0.6) over (partition by event_type) then 'train'
    when u <= quantile_cont(u, 0.8) over (partition by event_type) then 'val' else 'test' end as split
    from (select event_type, ('0x' || substr(md5(event_id::varchar), 1, 10))::bigint::double as u from events)) group by 1, 2""",
)
