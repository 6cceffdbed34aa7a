"""Queries over signals, sizing and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.functions.numeric import lit_array, ratio
from marketframe.operators import allocation as A
from marketframe.operators import signals as G
from marketframe.operators.orders import signals_to_orders
from marketframe.operators.ordered import row_chunks
from marketframe.plans.bar_queries import PRICE, _full
from marketframe.plans.sqlkit import BARS, rounded, rsql, with_sql
from marketframe.sources import derived

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


REGIMES, SECTORS = ["bull", "bear", "sideways", "volatile"], ["Technology", "Energy", "Financial"]
FEATURES = ["momentum_5", "vol_20", "breakout_x", "mean_gap", "other"]


def _predictions(spark, folder):
    p = derived.predictions(spark, folder)
    k = F.col("pred_id")
    return p.withColumns(
        {
            "event_impact_score": F.when(k % 3 == 0, F.col("value") / 100.0),
            "time_to_event_hours": F.when(k % 4 == 0, (k % 9).cast("double")),
            "regime": F.get(lit_array(REGIMES), (k % 5).cast("int")),
            "sector": F.get(lit_array(SECTORS), (k % 4).cast("int")),
            "volatility": (k % 60) / 1000.0,
            "features_used": F.create_map(F.get(lit_array(FEATURES), (k % 5).cast("int")), F.lit(1.0)),
            "run_id": F.floor(k / 200),
        }
    )


def _positions(spark, folder):
    return derived.read(spark, folder, "supplier").select(F.col("s_name").alias("asset_id"), (F.col("s_acctbal") / 100000.0).alias("weight"))


PRED = """pr as (select event_id as pred_id, event_type as asset_id, ts, 'm' || (user_id % 3) as model_id, (event_id % 1000) / 1000.0::double as p, 0.5::double + (user_id % 50) / 100.0::double as conf,
 case when event_id % 3 = 0 then value / 100.0::double end as impact, case when event_id % 4 = 0 then (event_id % 9)::double end as hrs, ['bull', 'bear', 'sideways', 'volatile'][(event_id % 5 + 1)::int] as regime,
 ['Technology', 'Energy', 'Financial'][(event_id % 4 + 1)::int] as sector, (event_id % 60) / 1000.0::double as vol, ['momentum_5', 'vol_20', 'breakout_x', 'mean_gap', 'other'][(event_id % 5 + 1)::int] as feat,
 event_id // 200 as run_id from events)"""


def _sig_sql(held):
    risk = "0.0" if not held else "case when sector is null then 0.3 when big then case when sector = 'Technology' then 0.6 else 0.3 end else 0.1 end"
    source = "pr" if not held else "pr, (select max(s_acctbal / 100000.0::double > 0.05::double) as big from supplier)"
    return f"""sg as (select *, case when adj >= 0.9 then 'extreme' when adj >= 0.8 then 'strong' when adj >= 0.7 then 'moderate' else 'weak' end as strength,
 greatest(least(least(adj / 0.8::double, 1) * (abs(p - 0.5::double) * 2) * 0.2::double, 0.2::double), 0.01::double) as position_size, least(0.02::double, adj * 0.02::double) as max_risk_pct,
 case when vol < 0.01 then 0.8 when vol < 0.03 then 1.0 when vol < 0.05 then 1.3 else 1.6 end::double as volatility_adj,
 case when p >= 0.55::double then 'long' else 'short' end as direction, case when impact > 0.3::double then 'event_driven' when feat like '%momentum%' then 'momentum' when feat like '%vol%' then 'volatility'
 when feat like '%breakout%' then 'breakout' when feat like '%mean%' then 'reversal' else 'ensemble' end as signal_type,
 case when hrs < 2 then 'high' when hrs < 6 then case when adj >= 0.9 then 'high' else 'normal' end when impact > 0.8::double then case when adj >= 0.8 then 'high' else 'normal' end
 when adj >= 0.9 then 'high' when adj >= 0.8 then 'normal' else 'low' end as urgency, asset_id || '_' || model_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') as signal_id
 from (select *, least(conf * case regime when 'bull' then 1.0 when 'bear' then 0.7 when 'sideways' then 0.8 when 'volatile' then 0.6 else 1.0 end::double, 1.0::double) as adj, {risk}::double as correlation_risk from {source}
 where conf >= 0.6::double and not coalesce(impact <> 0 and impact < 0.3::double, false) and (p >= 0.55::double or p <= 0.45::double)))"""


_plain = ["signal_id", "asset_id", "signal_type", "direction", "strength", "model_id", "urgency"]
_num = ["confidence", "position_size", "max_risk_pct", "volatility_adj", "correlation_risk", "prediction_value"]


def _signals(spark, folder, held=True):
    return G.evaluate_predictions(_predictions(spark, folder), _positions(spark, folder) if held else None)


for _held in (True, False):
    _add(
        "f22_f27_prediction_signals" + ("" if _held else "_without_positions"),
        lambda s, f, h=_held: rounded(_signals(s, f, h).select(*_plain, *_num)),
        rsql(with_sql([PRED, _sig_sql(_held)], "select *, adj as confidence, p as prediction_value from sg"), _plain, _num),
    )
_add(
    "p18_p20_p21_high_priority_signals",
    lambda s, f: G.valid_signals(_signals(s, f), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 0.05)
    .withColumns({"priority": G.execution_priority(), "action": G.action()}).filter(F.col("priority") >= 3).select("signal_id", "model_id", "priority", "action"),
    with_sql([PRED, _sig_sql(True)], """select signal_id, model_id, priority, action from (select *, least(case urgency when 'low' then 1 when 'normal' then 2 else 3 end + (adj > 0.8)::int + (strength in ('strong', 'extreme'))::int, 5)::int as priority,
    case direction when 'long' then 'buy' else 'sell' end as action from sg where ts + interval 24 hour >= timestamp '2024-01-15 00:00:00' and adj >= 0.5 and position_size >= 0.05) where priority >= 3"""),
)


def q_quarantine(spark, folder):
    p = derived.read(spark, folder, "events").select("event_id", (F.col("value") / 50.0).alias("confidence"), (F.col("user_id") / 100.0).alias("position_size"))
    good, bad = G.split_valid(p)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False)))


_add(
    "p19_signal_validation_split",
    q_quarantine,
    "select event_id, value / 50.0::double as confidence, user_id / 100.0::double as position_size, value / 50.0::double between 0 and 1 and user_id / 100.0::double between 0 and 1 as valid from events",
)
_add(
    "a20_evaluation_summary",
    lambda s, f: rounded(G.evaluation_summary(_signals(s, f))),
    rsql(with_sql([PRED, _sig_sql(True)], "select direction, strength, count(*) as n_signals, avg(adj) as avg_confidence, avg(position_size) as avg_position_size from sg group by grouping sets ((direction), (strength), ())"),
         ["direction", "strength", "n_signals"], ["avg_confidence", "avg_position_size"]),
)

# ------------------------------------------------------------------ rules

_rs = ["confidence", "position_size", "stop_loss", "take_profit"]
_rp = ["asset_id", "ts", "signal_type", "direction", "strength", "model_id", "trigger"]
MOM = f"""mo as (select symbol as asset_id, ts, 'momentum' as signal_type, case when up then 'long' else 'short' end as direction, 'moderate' as strength, case when up then 0.7 else 0.6 end::double as confidence,
 case when up then 0.1 else 1.0 end::double as position_size, close * case when up then 0.95 else 1.05 end::double as stop_loss, close * case when up then 1.1 else 0.9 end::double as take_profit, 'momentum_strategy' as model_id,
 case when up then 'momentum_breakout' else 'momentum_breakdown' end as trigger from (select *, a > b and b > c and close > a * 1.01::double as up, a < b and b < c and close < a * 0.99::double as dn from
 (select *, {_full('avg(close)', 5)} as a, {_full('avg(close)', 10)} as b, {_full('avg(close)', 20)} as c from bars)) where up or dn)"""
REV = f"""re as (select symbol as asset_id, ts, 'reversal' as signal_type, case when lo then 'long' else 'short' end as direction, 'strong' as strength, 0.75::double as confidence, case when lo then 0.05 else 0.5 end::double as position_size,
 close * case when lo then 0.98 else 1.02 end::double as stop_loss, m as take_profit, 'mean_reversion_strategy' as model_id, case when lo then 'oversold_condition' else 'overbought_condition' end as trigger from
 (select *, close < m - 2 * d as lo, close > m + 2 * d as hi from (select *, {_full('avg(close)', 20)} as m, {_full('stddev_samp(close)', 20)} as d from bars)) where lo or hi)"""


def _scored_events(spark, folder):
    e = derived.read(spark, folder, "events")
    return e.select(
        "event_id", F.col("event_type").alias("symbol"), "ts", (F.lit(0.5) + F.col("event_id") % 50 / 100.0).alias("confidence"),
        ((F.col("event_id") % 21 - 10) / 10.0).alias("sentiment"),
    )


EVS = "evs as (select event_id, event_type as symbol, ts, 0.5::double + (event_id % 50) / 100.0::double as conf, (event_id % 21 - 10) / 10.0::double as sen from events)"
EVT = """ev as (select b.symbol as asset_id, b.ts, 'event_driven' as signal_type, case when sen > 0 then 'long' else 'short' end as direction, 'strong' as strength,
 case when sen > 0 then least(0.9::double, conf + 0.1::double) else least(0.9::double, conf) end as confidence, case when sen > 0 then 0.08 else 0.5 end::double as position_size, null::double as stop_loss, null::double as take_profit,
 'event_driven_strategy' as model_id, event_id::varchar as trigger from bars b join evs e on e.symbol = b.symbol and abs(epoch_us(b.ts) - epoch_us(e.ts)) < 3600000000 where conf > 0.7::double and abs(sen) > 0.5::double)"""


def _all_signals(spark, folder):
    return G.generate_signals(derived.bars(spark, folder), _scored_events(spark, folder), ("momentum", "mean_reversion", "event"))


_add("f28_momentum_rule", lambda s, f: rounded(G.momentum_signals(derived.bars(s, f)).select(*_rp, *_rs)), rsql(with_sql([BARS, MOM], "select * from mo"), _rp, _rs))
_add("f29_mean_reversion_rule", lambda s, f: rounded(G.reversion_signals(derived.bars(s, f)).select(*_rp, *_rs)), rsql(with_sql([BARS, REV], "select * from re"), _rp, _rs))
_add("f30_j13_event_rule", lambda s, f: rounded(G.event_signals(derived.bars(s, f), _scored_events(s, f)).select(*_rp, *_rs)), rsql(with_sql([BARS, EVS, EVT], "select * from ev"), _rp, _rs))
_ALLSIG = "alls as (select * from mo union all select * from re union all select * from ev)"
_add(
    "u05_ud2_a39_signals_by_strategy",
    lambda s, f: rounded(_all_signals(s, f).groupBy("model_id", "direction").agg(F.count(F.lit(1)).alias("n_signals"), F.avg("confidence").alias("avg_confidence"))),
    rsql(with_sql([BARS, MOM, REV, EVS, EVT, _ALLSIG], "select model_id, direction, count(*) as n_signals, avg(confidence) as avg_confidence from alls group by 1, 2"), ["model_id", "direction", "n_signals"], ["avg_confidence"]),
)
_add(
    "t11_best_signal_per_side",
    lambda s, f: rounded(G.best_per_side(_all_signals(s, f)).select("asset_id", "ts", "direction", "model_id", "confidence")),
    rsql(with_sql([BARS, MOM, REV, EVS, EVT, _ALLSIG], "select * from alls qualify row_number() over (partition by asset_id, ts, direction order by confidence desc, model_id, trigger) = 1"), ["asset_id", "ts", "direction", "model_id"], ["confidence"]),
)

# ------------------------------------------------------------------ sizing

_add(
    "w44_recent_volatility",
    lambda s, f: rounded(G.recent_volatility(derived.bars(s, f)).select("symbol", "ts", "volatility")),
    rsql(with_sql([BARS, PRICE], "select symbol, ts, case when rn >= 19 then stddev_samp(price_change_pct) over (partition by symbol order by ts rows between 19 preceding and current row) else 0.025 end::double as volatility from p"), ["symbol", "ts"], ["volatility"]),
)


def _to_size(spark, folder):
    return _signals(spark, folder).withColumn("current_price", F.lit(20.0) + F.col("prediction_value") * 100.0)


SIZE = """sz as (select *, price * (1 - sgn * stop_pct) as stop_loss, greatest(0.01::double, least(least(position_size * greatest(0.3::double, least(coalesce(1 / nullif(1 + (vol / 0.02::double - 1) * 1.5::double, 0), 2), 2)), 0.02::double * adj / stop_pct), 0.2::double)) as wanted_size
 from (select *, 20.0::double + p * 100.0::double as price, case when direction = 'long' then 1 else -1 end::double as sgn, greatest(0.01::double, least(vol * 2 * (1.5::double - adj), 0.08::double)) as stop_pct from sg))"""
_add(
    "f31_wanted_size_and_stops",
    lambda s, f: rounded(G.wanted_size(_to_size(s, f)).select("signal_id", "model_id", "wanted_size", "stop_loss_pct", "stop_loss", "take_profit")),
    rsql(with_sql([PRED, _sig_sql(True), SIZE], "select signal_id, model_id, wanted_size, stop_pct as stop_loss_pct, stop_loss, price + sgn * abs(price - stop_loss) * greatest(1.2::double, least(2 + (adj - 0.5::double) * 2, 5)) as take_profit from sz"),
         ["signal_id", "model_id"], ["wanted_size", "stop_loss_pct", "stop_loss", "take_profit"]),
)


def q_sized(spark, folder):
    out = G.size_positions(_to_size(spark, folder), portfolio_value=1_000_000.0, order=("ts", "signal_id"))
    return rounded(out.select("run_id", "signal_id", "shares", "final_size", "dollar_amount", "expected_return", "transaction_costs"), 4)


#: The cash left by the earlier signals of a run as a recursion over the signal's number, all runs at once.
def _sized_sql(value, body):
    steps = f"""ns as (select *, price + sgn * abs(price - stop_loss) * greatest(1.2::double, least(2 + (adj - 0.5::double) * 2, 5)) as take_profit, row_number() over (partition by run_id order by ts, signal_id) as rn from sz),
sp(run_id, rn, cash, shares) as (
 select distinct run_id, 0::bigint, {value}::double * 0.95::double, 0::double from ns
 union all
 select run_id, rn, cash - shares * price, shares from (
  select run_id, rn, cash, price, floor(case when d > cash then cash * 0.95::double else d end / price) as shares from (
   select ns.run_id, ns.rn, sp.cash, ns.price, greatest(least(ns.wanted_size, sp.cash / {value}::double), 0) * {value}::double as d from sp join ns on ns.run_id = sp.run_id and ns.rn = sp.rn + 1))),
sd as (select ns.*, sp.shares, sp.shares * price as dollars, sp.shares * price / {value}::double as fs from ns join sp using (run_id, rn)),
sf as (select *, fs * case when t > 1 then 1 / t else 1 end as final_size from (select *, sum(fs) over (partition by run_id) as t from sd))"""
    return with_sql([PRED, _sig_sql(True), SIZE, steps], body).replace("with ", "with recursive ", 1)


_add(
    "ud5_f31_sized_positions",
    q_sized,
    rsql(_sized_sql(1000000, """select run_id, signal_id, shares, final_size, final_size * 1000000 as dollar_amount, abs(take_profit - price) / price * adj * final_size * 1000000 as expected_return, dollars * 0.0015::double as transaction_costs from sf"""),
         ["run_id", "signal_id"], ["shares", "final_size", "dollar_amount", "expected_return", "transaction_costs"], 4),
)
_add(
    "a21_sizing_summary",
    lambda s, f: rounded(G.sizing_summary(G.size_positions(_to_size(s, f), order=("ts", "signal_id")), ["run_id"])),
    rsql(_sized_sql(100000, """select run_id, count(*) as total_positions, avg(final_size) as avg_position_size, avg(final_size * 100000) as avg_dollar_amount, avg(vol) as avg_volatility, avg(stop_pct) as avg_stop_loss_pct, sum(final_size) as total_exposure from sf group by 1"""),
         ["run_id", "total_positions"], ["avg_position_size", "avg_dollar_amount", "avg_volatility", "avg_stop_loss_pct", "total_exposure"]),
)


def q_orders(spark, folder):
    sig = _signals(spark, folder).withColumns(
        {"dollar_amount": F.col("position_size") * 100000.0, "target_price": F.lit(20.0) + F.col("prediction_value") * 100.0,
         "order_style": F.when(F.col("urgency") == "high", "market").otherwise("limit")}
    )
    return rounded(signals_to_orders(sig).select("signal_id", "symbol", "side", "order_type", "quantity", "limit_price", "order_id"))


_add(
    "f37_signals_to_orders",
    q_orders,
    rsql(with_sql([PRED, _sig_sql(True)], """select signal_id, asset_id as symbol, case direction when 'long' then 'buy' else 'sell' end as side, case urgency when 'high' then 'market' else 'limit' end as order_type,
    abs(position_size * 100000 / (20.0::double + p * 100)) as quantity, case when urgency <> 'high' then 20.0::double + p * 100 end as limit_price, 'ord_' || substring(sha256(signal_id), 1, 12) as order_id from sg"""),
         ["signal_id", "symbol", "side", "order_type", "order_id"], ["quantity", "limit_price"]),
)

# ------------------------------------------------------------------ allocation


def _alloc_input(spark, folder):
    sig = _signals(spark, folder)
    return sig.withColumn("signal_id", F.concat_ws("|", "signal_id", F.col("prediction_value").cast("string")))


def _alloc_sql(upto, cap_clusters=False):
    steps = {
        "base": "b0 as (select *, coalesce(sector, 'Unknown') as sec, sc / sum(sc) over (partition by run_id) * 0.95::double as al from (select *, adj * case strength when 'weak' then 0.5 when 'moderate' then 1 when 'strong' then 1.5 else 2 end::double * (1 + abs(p - 0.5::double) * 2) as sc from sg))",
        "sector": "b1 as (select * replace (case when g > 0.3::double then al * (0.3::double / g) else al end as al) from (select *, sum(al) over (partition by run_id, sec) as g from b0))",
        "type": "b2 as (select * replace (case when g > 0.4::double then al * (0.4::double / g) else al end as al) from (select * exclude (g), sum(al) over (partition by run_id, signal_type) as g from b1))",
        "var": "b3 as (select * replace (al * case when t * 0.02::double * 2.33::double > 0.03::double then 0.03::double / (t * 0.02::double * 2.33::double) else 1 end as al) from (select *, sum(al) over (partition by run_id) as t from b2))",
        "opt": "b4 as (select * replace (case when t > 0.95::double then al * (0.95::double / t) else al end as al) from (select * exclude (t), sum(al) over (partition by run_id) as t from (select * replace (al * case when signal_type = 'momentum' then 1.1::double else 1 end * 0.9::double as al) from b3)))",
    }
    names = list(steps)
    return [steps[n] for n in names[: names.index(upto) + 1]]


_ak = ["run_id", "signal_id", "model_id"]


def _key_sql(src):
    return f"select run_id, signal_id || '|' || p::varchar as signal_id, model_id, al as allocation from {src}"


_add("m09_base_allocation", lambda s, f: rounded(A.base_allocation(_alloc_input(s, f)).select(*_ak, "allocation")), rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("base")], _key_sql("b0")), _ak, ["allocation"]))
_add("m10_sector_and_type_caps", lambda s, f: rounded(A.diversify(A.base_allocation(_alloc_input(s, f))).select(*_ak, "allocation")), rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("type")], _key_sql("b2")), _ak, ["allocation"]))
_add(
    "m12_m13_allocation",
    lambda s, f: rounded(A.allocate(_alloc_input(s, f)).select(*_ak, "allocation")),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt")], _key_sql("b4") + " where al >= 0.01::double"), _ak, ["allocation"]),
)
_pm = ["total_exposure", "portfolio_var", "max_drawdown_risk", "sharpe_estimate"]
PM = """pm as (select run_id, count(*) as num_signals, sum(al) as total_exposure, sum(al) * 0.03::double * (2 - avg(adj)) as portfolio_var, least(0.3::double, sum(al) * 0.15::double) as max_drawdown_risk,
 sum(adj * al * 0.1::double) / (sum(al) * 0.03::double * (2 - avg(adj)) * 16) as sharpe_estimate from b4 where al >= 0.01::double group by 1)"""
_add("a23_portfolio_metrics", lambda s, f: rounded(A.portfolio_metrics(A.allocate(_alloc_input(s, f)))), rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), PM], "select * from pm"), ["run_id", "num_signals"], _pm))
_add(
    "a21_a45_allocation_summary",
    lambda s, f: rounded(A.allocation_summary(A.portfolio_metrics(A.allocate(_alloc_input(s, f))))),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), PM], "select count(*) as total_allocations, avg(num_signals) as avg_num_signals, avg(total_exposure) as avg_exposure, avg(portfolio_var) as avg_var, avg(sharpe_estimate) as avg_sharpe from pm"),
         ["total_allocations"], ["avg_num_signals", "avg_exposure", "avg_var", "avg_sharpe"]),
)
_add(
    "a22_exposures",
    lambda s, f: rounded(A.exposures(A.allocate(_alloc_input(s, f)))),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), "k as (select * from b4 where al >= 0.01::double)"], " union all ".join(
        f"select run_id, '{d}' as dimension, {c} as member, sum(al) as exposure, count(*) as n_signals from k group by 1, 3" for d, c in (("sector", "sec"), ("direction", "direction"), ("signal_type", "signal_type"), ("urgency", "urgency")))),
         ["run_id", "dimension", "member", "n_signals"], ["exposure"]),
)


def _held(spark, folder):
    return derived.read(spark, folder, "nation").select(
        F.get(lit_array(["click", "view", "purchase", "signup", "error"]), (F.col("n_nationkey") % 5).cast("int")).alias("asset_id"), (F.col("n_nationkey") / 500.0).alias("weight"))


_HELD = "held as (select ['click', 'view', 'purchase', 'signup', 'error'][(n_nationkey % 5 + 1)::int] as asset_id, n_nationkey / 500.0::double as weight from nation)"
_add(
    "a41_position_drift",
    lambda s, f: rounded(A.drift(A.allocate(_alloc_input(s, f)), _held(s, f))),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), _HELD], "select asset_id, abs(weight - coalesce(t, 0)) as drift from held left join (select asset_id, arg_max(al, ts) as t from b4 where al >= 0.01::double group by 1) using (asset_id)"), ["asset_id"], ["drift"]),
)
_add(
    "a42_rebalance_flags",
    lambda s, f: rounded(A.rebalance_flags(A.allocate(_alloc_input(s, f)), _held(s, f))),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), _HELD], "select run_id, sum(al) as new_exposure, abs(sum(al) - (select sum(abs(weight)) from held)) > 0.05::double as rebalance_required from b4 where al >= 0.01::double group by 1"), ["run_id", "rebalance_required"], ["new_exposure"]),
)


_add(
    "m13_portfolio_record",
    lambda s, f: rounded(A.allocate_portfolio(_alloc_input(s, f), _held(s, f))[1]),
    rsql(with_sql([PRED, _sig_sql(True), *_alloc_sql("opt"), PM, _HELD, "hw as (select asset_id, sum(weight) as weight from held group by 1)", "k as (select * from b4 where al >= 0.01::double)",
                   "dr as (select r.run_id, max(abs(weight - coalesce(t, 0))) as largest_drift from (select distinct run_id from k) r, hw left join (select run_id, asset_id, sum(al) as t from k group by 1, 2) g on g.run_id = r.run_id and g.asset_id = hw.asset_id group by 1)"],
                  "select pm.*, abs(total_exposure - (select sum(abs(weight)) from hw)) > 0.05::double as rebalance_required, largest_drift, total_exposure * 100000 as cash_required from pm join dr using (run_id)"),
         ["run_id", "num_signals", "rebalance_required"], [*_pm, "largest_drift", "cash_required"]),
)


def _returns(spark, folder):
    c = row_chunks(derived.bars(spark, folder), halo=2)
    prev = F.lag("close").over(c.order)
    return c.with_columns({"ret": ratio(F.col("close") - prev, prev)}).own().filter(F.col("ret").isNotNull())


_add(
    "m11_correlation_matrix",
    lambda s, f: rounded(A.correlation_pairs(_returns(s, f))),
    rsql(with_sql([BARS, PRICE], "select x.symbol as a, y.symbol as b, covar_pop(x.price_change_pct, y.price_change_pct) / (stddev_pop(x.price_change_pct) * stddev_pop(y.price_change_pct)) as corr from p x join p y on x.ts = y.ts and x.symbol <> y.symbol where x.price_change_pct is not null and y.price_change_pct is not null group by 1, 2 having count(*) >= 10"),
         ["a", "b"], ["corr"]),
)


_TRIO = ["click", "view", "purchase"]


def _linked_returns(spark, folder):
    """Returns of which three series follow the mean of all, so that they form a cluster."""
    returns = _returns(spark, folder)
    mean = returns.groupBy("ts").agg(F.avg("ret").alias("_m"))
    return returns.join(mean, "ts").withColumn("ret", F.col("ret") + F.when(F.col("symbol").isin(_TRIO), F.col("_m") * 8.0).otherwise(0.0))


def _clusters(spark, folder):
    return A.correlation_clusters(A.correlation_pairs(_linked_returns(spark, folder)), 0.7)


_CLUSTERS = ["""m as (select ts, avg(price_change_pct) as m from p where price_change_pct is not null group by ts)""",
"""q as (select symbol, ts, price_change_pct + case when symbol in ('click', 'view', 'purchase') then 8 * m else 0 end as r from p join m using (ts) where price_change_pct is not null)""",
"""edges as (select x.symbol as a, y.symbol as b from q x join q y on x.ts = y.ts and x.symbol <> y.symbol group by 1, 2
 having count(*) >= 10 and covar_pop(x.r, y.r) / (stddev_pop(x.r) * stddev_pop(y.r)) > 0.7)""",
"""nb as (select a, list(b order by b) as bs, row_number() over (order by a) as rn from edges group by a)""",
"""g(i, taken, members) as (select 0::bigint, []::varchar[], []::varchar[][] union all
 select i + 1, case when list_contains(taken, a) or len(f) = 0 then taken else list_concat(taken, [a], f) end,
 case when list_contains(taken, a) or len(f) = 0 then members else list_concat(members, list_transform(list_concat([a], f), lambda x: [x, a])) end
 from (select g.*, nb.a, list_filter(nb.bs, lambda x: not list_contains(taken, x)) as f from g join nb on nb.rn = g.i + 1))""",
"""cl as (select u[1] as asset_id, u[2] as cluster from (select unnest(members) as u from (select members from g order by i desc limit 1)))"""]
_CAPPED = "b2c as (select * replace (case when cluster is not null and cs > 0.35::double then al * (0.35::double / cs) else al end as al) from (select b2.*, cluster, sum(al) over (partition by run_id, cluster) as cs from b2 left join cl using (asset_id)))"


def _recursive(sql):
    return sql.replace("with ", "with recursive ", 1)


_add(
    "m11_correlation_clusters",
    lambda s, f: _clusters(s, f),
    _recursive(with_sql([BARS, PRICE, *_CLUSTERS], "select * from cl")),
)
_add(
    "m11_cluster_cap",
    lambda s, f: rounded(A.cap_clusters(A.diversify(A.base_allocation(_alloc_input(s, f))), _clusters(s, f)).select(*_ak, "allocation")),
    rsql(_recursive(with_sql([BARS, PRICE, *_CLUSTERS, PRED, _sig_sql(True), *_alloc_sql("type"), _CAPPED], _key_sql("b2c"))), _ak, ["allocation"]),
)
_add(
    "m11_m12_m13_allocation_with_clusters",
    lambda s, f: rounded(A.allocate(_alloc_input(s, f), clusters=_clusters(s, f), regime=F.lit("volatile")).select(*_ak, "allocation")),
    rsql(_recursive(with_sql([BARS, PRICE, *_CLUSTERS, PRED, _sig_sql(True), *_alloc_sql("type"), _CAPPED,
        *[x.replace("from b2)", "from b2c)").replace("else 1 end as al)", "else 1 end * 0.8::double as al)") if x.startswith("b3 ") else x for x in _alloc_sql("opt")[3:]]], _key_sql("b4") + " where al >= 0.01::double")), _ak, ["allocation"]),
)
