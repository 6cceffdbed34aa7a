"""Queries over orders, fills, routing and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.operators import latency as L
from marketframe.operators import orders as O
from marketframe.operators.ranking import top_k
from marketframe.plans.sqlkit import BARS, FILLS, LATENCY, ORDER_LOG, quoted, rounded, rsql, with_sql
from marketframe.sources import derived

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _in(words):
    return "(" + ", ".join(quoted(w) for w in words) + ")"


VENDOR = ["new", "Accepted", "pending_new", "partially_filled", "FILLED", "canceled", "rejected", "expired", "replaced", "pending_cancel", "pending_replace", "odd"]


def _status_table(spark, folder):
    orders = derived.read(spark, folder, "orders")
    words = F.array(*[F.lit(v) for v in VENDOR])
    return orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"),
        F.get(words, (F.col("o_orderkey") % 12).cast("int")).alias("vendor_status"), F.col("o_totalprice").alias("order_value"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("parent_order_id"),
    ).withColumn("status", O.map_status(F.col("vendor_status")))


_vmap = "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in O.VENDOR_STATUS.items()) + "}"
STAT = f"""stat as (select *, coalesce({_vmap}[lower(vendor_status)], 'pending') as status from (select o_orderkey as order_id, o_orderdate as created_at,
 [{', '.join(quoted(v) for v in VENDOR)}][(o_orderkey % 12 + 1)::int] as vendor_status, o_totalprice as order_value,
 case when o_orderkey % 4 <> 0 then o_orderkey - o_orderkey % 4 end as parent_order_id from orders))"""

_add(
    "p22_p23_status_flags",
    lambda s, f: O.status_flags(_status_table(s, f)).select("order_id", "status", "is_active", "is_terminal", "can_be_canceled"),
    with_sql([STAT], f"select order_id, status, status in {_in(O.ACTIVE)} as is_active, status in {_in(O.TERMINAL)} as is_terminal, status in {_in(O.CANCELABLE)} as can_be_canceled from stat"),
)
_add(
    "p23_j16_bracket_status",
    lambda s, f: O.bracket_status(_status_table(s, f)),
    with_sql([STAT], f"""select p.order_id as bracket_id, p.status = 'filled' as is_complete, count(*) as n_children,
    (p.status in {_in(O.CANCELABLE)})::int + count(*) filter (c.status in {_in(O.CANCELABLE)}) as n_cancelable from stat p join stat c on c.parent_order_id = p.order_id
    where p.parent_order_id is null group by p.order_id, p.status"""),
)
_add(
    "p25_timed_out_orders",
    lambda s, f: O.timed_out(_status_table(s, f), "1996-01-01 00:00:00").select("order_id", "status"),
    with_sql([STAT], f"select order_id, status from stat where status in {_in(O.ACTIVE)} and created_at < timestamp '1995-12-31 23:00:00'"),
)
_add(
    "p25_recently_completed",
    lambda s, f: O.recently_completed(_status_table(s, f).withColumn("last_updated", F.col("created_at")), "1996-01-01 00:00:00", 24 * 30).select("order_id", "status"),
    with_sql([STAT], f"select order_id, status from stat where status in {_in(O.TERMINAL)} and created_at > timestamp '1996-01-01 00:00:00' - interval 720 hour"),
)
_add(
    "p32_active_orders_of_a_portfolio",
    lambda s, f: derived.order_log(s, f).filter((F.col("portfolio") == "7") & F.col("status").isin(O.ACTIVE)),
    with_sql([ORDER_LOG], f"select * from order_log where portfolio = '7' and status in {_in(O.ACTIVE)}"),
)
_add(
    "p33_order_json",
    lambda s, f: derived.order_log(s, f).select("order_id", F.to_json(F.struct("order_id", "portfolio", "status")).alias("json"),
                                                F.from_json(F.to_json(F.struct("order_id", "status")), "order_id long, status string")["status"].alias("status_back")),
    with_sql([ORDER_LOG], """select order_id, '{"order_id":' || order_id || ',"portfolio":"' || portfolio || '","status":"' || status || '"}' as json, status as status_back from order_log"""),
)


def _with_reference(fills):
    return fills.withColumn("reference", F.round("price", 0))


_add(
    "p24_slippage",
    lambda s, f: rounded(_with_reference(derived.fills(s, f)).select("order_id", "fill_no", O.slippage(F.col("side"), F.col("price"), F.col("reference")).alias("slippage"), (F.col("quantity") * F.col("price")).alias("market_value")), slippage=8),
    rsql(with_sql([FILLS], """select order_id, fill_no, case when round(price, 0) > 0 then case when side = 'buy' then (price - round(price, 0)) / round(price, 0) else (round(price, 0) - price) / round(price, 0) end else 0 end as slippage,
    quantity * price as market_value from fills"""), ["order_id", "fill_no"], ["slippage", "market_value"], slippage=8),
)


def _orders_for_fills(spark, folder):
    return derived.order_log(spark, folder).withColumn("quantity", F.floor(F.col("order_value") / 1500.0).cast("double"))


_of = ["filled_quantity", "average_fill_price", "total_commission", "remaining_quantity", "fill_percent"]
_OF = """ofl as (select o.order_id, o.portfolio, o.status, q as quantity, coalesce(fq, 0) as filled_quantity, coalesce(vw, 0) as average_fill_price, coalesce(cm, 0) as total_commission,
 q - coalesce(fq, 0) as remaining_quantity, case when coalesce(fq, 0) <= 0 then o.status when q - fq <= 0 then 'filled' else 'partially_filled' end as fill_status,
 case when q > 0 then coalesce(fq, 0) / q * 100 else 0 end as fill_percent from (select *, floor(order_value / 1500) as q from order_log) o
 left join (select order_id, sum(quantity) as fq, sum(price * quantity) / sum(quantity) as vw, sum(commission) as cm from fills group by 1) f using (order_id))"""
_add(
    "a24_order_fills",
    lambda s, f: rounded(O.order_fills(derived.fills(s, f), _orders_for_fills(s, f)).select("order_id", "fill_status", *_of), 4),
    rsql(with_sql([FILLS, ORDER_LOG, _OF], "select * from ofl"), ["order_id", "fill_status"], _of, 4),
)


def _signal_orders(spark, folder):
    out = O.order_fills(derived.fills(spark, folder), _orders_for_fills(spark, folder))
    return out.withColumn("signal_id", F.floor(F.col("order_id") / 5)).withColumn("reference_price", F.round("average_fill_price", 0))


_add(
    "a25_signal_completion",
    lambda s, f: rounded(O.signal_completion(_signal_orders(s, f)), 4),
    rsql(with_sql([FILLS, ORDER_LOG, _OF], f"""select (order_id // 5) as signal_id, bool_and(status in {_in(O.TERMINAL)}) as is_complete, count(*) as n_orders, sum(filled_quantity) as total_filled,
    coalesce(sum(filled_quantity * average_fill_price) / nullif(sum(filled_quantity), 0), 0) as avg_price from ofl group by 1"""), ["signal_id", "is_complete", "n_orders"], ["total_filled", "avg_price"], 4),
)
_add(
    "a26_order_summary",
    lambda s, f: rounded(O.order_summary(_signal_orders(s, f), ["portfolio"])),
    rsql(with_sql([FILLS, ORDER_LOG, _OF], f"""select portfolio, count(*) as orders_submitted, count(*) filter (status = 'filled') as orders_filled, count(*) filter (status = 'rejected') as orders_rejected,
    count(*) filter (status = 'canceled') as orders_canceled, count(*) filter (status in {_in(O.ACTIVE)}) as active_orders, count(*) filter (status = 'filled') * 100.0::double / count(*) as fill_rate_percent,
    coalesce(sum(abs(average_fill_price - round(average_fill_price, 0)) / round(average_fill_price, 0)) filter (status = 'filled' and round(average_fill_price, 0) > 0), 0) / greatest(count(*) filter (status = 'filled'), 1) as average_slippage
    from ofl group by 1"""), ["portfolio", "orders_submitted", "orders_filled", "orders_rejected", "orders_canceled", "active_orders"], ["fill_rate_percent", "average_slippage"]),
)
_add(
    "a27_net_positions",
    lambda s, f: rounded(O.net_positions(derived.fills(s, f), ["portfolio", "symbol"])),
    rsql(with_sql([FILLS], "select portfolio, symbol, sum(case when side = 'sell' then -quantity else quantity end) as position from fills group by 1, 2 having abs(sum(case when side = 'sell' then -quantity else quantity end)) >= 0.001"),
         ["portfolio", "symbol"], ["position"]),
)


def _log(spark, folder):
    """Status log of the lineitem steps: each line of an order is an update."""
    items = derived.read(spark, folder, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ts"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_linestatus") == "F", "filled").when(F.col("l_returnflag") == "N", "submitted").otherwise("accepted").alias("status"),
        F.col("l_quantity").alias("filled_qty"),
    )


LOG = """log as (select l_orderkey as order_id, l_shipdate as ts, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as seq, case when l_linestatus = 'F' then 'filled' when l_returnflag = 'N' then 'submitted' else 'accepted' end as status,
 l_quantity as filled_qty from lineitem)"""
_add(
    "a43_order_rollup",
    lambda s, f: O.order_rollup(_log(s, f)),
    with_sql([LOG], "select order_id, arg_max(status, (ts, seq)) as status, max(ts) as last_updated, min(ts) filter (status = 'submitted') as submitted_at from log group by 1"),
)
_add(
    "w45_incremental_fills",
    lambda s, f: O.incremental_fills(_log(s, f)).select("order_id", "ts", "seq", "fill_quantity"),
    with_sql([LOG], """select * from (select order_id, ts, seq, filled_qty - coalesce(max(filled_qty) over (partition by order_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as fill_quantity from log) where fill_quantity > 0"""),
)


def q_pretrade(spark, folder):
    items, orders = derived.read(spark, folder, "lineitem"), derived.read(spark, folder, "orders")
    req = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        (F.col("o_custkey") % 400).cast("string").alias("portfolio"), F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 6).cast("string")).alias("order_id"),
        (F.col("l_partkey") % 50).cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.when(F.col("l_linestatus") == "F", "market").otherwise("limit").alias("order_type"), F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linestatus") != "F", F.col("l_extendedprice") / F.col("l_quantity") / 10.0).alias("limit_price"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("target_price"), F.col("l_extendedprice").alias("position_size"),
        F.col("o_totalprice").alias("portfolio_value"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("key"),
        F.when(F.col("l_linestatus") == "F", "filled").otherwise("submitted").alias("status"),
    )
    positions = derived.fills(spark, folder).groupBy("portfolio", "symbol").agg(F.max("quantity").alias("position"))
    account = derived.read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("portfolio"), F.col("c_acctbal").alias("buying_power"))
    out = O.pretrade_checks(req, positions, account)
    return out.select("key", "line", F.array_join("failed_rules", ",").alias("failed_rules"), "accepted")


_add(
    "r1_pretrade_checks",
    q_pretrade,
    with_sql(
        [FILLS, """req as (select cast(o_custkey % 400 as varchar) as portfolio, l_orderkey || '-' || (l_linenumber % 6) as order_id, cast(l_partkey % 50 as varchar) as symbol,
        case when l_returnflag = 'R' then 'sell' else 'buy' end as side, case when l_linestatus = 'F' then 'market' else 'limit' end as order_type, l_quantity as quantity,
        case when l_linestatus <> 'F' then l_extendedprice / l_quantity / 10 end as limit_price, l_extendedprice / l_quantity as target_price, l_extendedprice as position_size, o_totalprice as portfolio_value,
        l_shipdate as created_at, l_linenumber as line, l_orderkey as key, case when l_linestatus = 'F' then 'filled' else 'submitted' end as status from lineitem join orders on l_orderkey = o_orderkey)""",
         "pos as (select portfolio, symbol, max(quantity) as position from fills group by 1, 2)",
         f"act as (select * from req where status in {_in(O.ACTIVE)})",
         "tot as (select portfolio, count(*) as n_open, count(distinct symbol) as n_sym from act group by 1)",
         "held as (select distinct portfolio, symbol, true as is_held from act)",
         "ids as (select portfolio, order_id, count(*) - 1 as copies from req group by 1, 2)",
         "x as (select r.*, quantity * coalesce(limit_price, 100) as val, position, n_open, n_sym, is_held, copies, c_acctbal as bp from req r left join pos using (portfolio, symbol) left join tot using (portfolio) left join held using (portfolio, symbol) left join ids using (portfolio, order_id) left join customer on cast(c_custkey as varchar) = r.portfolio)"],
        """select key, line, failed_rules, failed_rules = '' as accepted from (select key, line, concat_ws(',', case when abs(coalesce(position, 0)) * target_price > 50000 then 'position_value' end,
        case when position_size / portfolio_value > 0.25 then 'concentration' end, case when val < 1 then 'order_too_small' end, case when val > 10000 then 'order_too_large' end,
        case when n_open >= 50 then 'open_orders' end, case when n_sym >= 20 and is_held is null then 'max_symbols' end, case when side = 'buy' and val > bp then 'buying_power' end,
        case when copies > 0 then 'duplicate_order' end, case when order_type = 'market' and isodow(created_at) >= 6 then 'weekend_market_order' end) as failed_rules from x)""",
    ),
)

# ------------------------------------------------------------------ routing


def _routed(spark, folder):
    items, parts = derived.read(spark, folder, "lineitem"), derived.read(spark, folder, "part")
    out = items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") * F.when(F.col("l_linenumber") == 1, 60.0).otherwise(1.0)).alias("quantity"),
        F.when(F.col("l_linestatus") == "F", "market").otherwise("limit").alias("order_type"),
        F.when(F.col("l_linestatus") != "F", F.col("p_retailprice")).alias("limit_price"), F.col("p_retailprice").alias("last_price"),
        (F.col("p_retailprice") * (1.0 - F.col("l_discount") / 8)).alias("bid"), (F.col("p_retailprice") * (1.0 + F.col("l_tax") / 8)).alias("ask"),
        (F.col("p_size") * 1.0).alias("bid_size"), (F.col("p_size") * 2.0).alias("ask_size"),
        F.when(F.col("l_partkey") % 3 == 0, 0.0).otherwise(F.col("p_size") * 1000.0).alias("volume"), (F.col("l_tax") / 2).alias("volatility"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("filled").alias("status"),
    )
    return O.choose_strategy(O.quote_columns(out))


ROUTED = """q as (select l_orderkey as order_id, l_linenumber as line, l_quantity * case when l_linenumber = 1 then 60 else 1 end as quantity, case when l_linestatus = 'F' then 'market' else 'limit' end as order_type,
 case when l_linestatus <> 'F' then p_retailprice end as limit_price, p_retailprice as last_price, p_retailprice * (1.0::double - l_discount / 8) as bid, p_retailprice * (1.0::double + l_tax / 8) as ask,
 p_size * 1.0::double as bid_size, p_size * 2.0::double as ask_size, case when l_partkey % 3 = 0 then 0 else p_size * 1000.0::double end as volume, l_tax / 2 as volatility,
 case when l_returnflag = 'R' then 'rejected' else 'filled' end as status from lineitem join part on l_partkey = p_partkey),
 routed as (select *, case when val < 100 then 'aggressive' when val > 50000 then case when volume > 0 then 'vwap' else 'twap' end when spread_percent > 0.01::double then 'passive'
 when quantity > (bid_size + ask_size) * 0.5::double then 'iceberg' when order_type = 'market' then 'aggressive' else 'passive' end as strategy from (select *, quantity * coalesce(limit_price, last_price) as val,
 ask - bid as spread, case when (bid + ask) / 2 > 0 then (ask - bid) / ((bid + ask) / 2) else 0 end as spread_percent, sqrt(bid_size * ask_size) as liquidity_score from q)),
 plans as (select *, case when (bid_size + ask_size) * last_price <= 0 then 0.01::double else least(sqrt(quantity * last_price / ((bid_size + ask_size) * last_price)) * 0.01::double + spread_percent * 0.5::double
 + case when volatility > 0 then volatility * 0.1::double else 0 end, 0.05::double) end as estimated_impact, case when strategy = 'twap' then 30 when strategy = 'vwap' then 20 when strategy = 'iceberg'
 then greatest(ceil(quantity / greatest(least(quantity * 0.1::double, (bid_size + ask_size) * 0.2::double), 100)), 1) else 1 end::int as n,
 case strategy when 'twap' then 60 when 'vwap' then 90 when 'iceberg' then 30 else 0 end::double as interval_seconds,
 case strategy when 'aggressive' then 0.5 when 'twap' then 30 when 'vwap' then 30 when 'iceberg' then 120 else 60 end::double as duration_minutes from routed)"""
_add(
    "f33_f34_strategy_choice",
    lambda s, f: rounded(_routed(s, f).select("order_id", "line", "strategy", "spread", "spread_percent", "liquidity_score")),
    rsql(with_sql([ROUTED], "select * from routed"), ["order_id", "line", "strategy"], ["spread", "spread_percent", "liquidity_score"]),
)
_add(
    "f35_f38_execution_plans",
    lambda s, f: rounded(O.execution_plans(_routed(s, f)).select("order_id", "line", "strategy", "total_slices", "interval_seconds", "duration_minutes", "estimated_impact")),
    rsql(with_sql([ROUTED], "select *, n as total_slices from plans"), ["order_id", "line", "strategy", "total_slices"], ["interval_seconds", "duration_minutes", "estimated_impact"]),
)
_add(
    "f36_order_slices",
    lambda s, f: rounded(O.order_slices(_routed(s, f)).select("order_id", "line", "strategy", "slice_index", "slice_quantity")),
    rsql(with_sql([ROUTED, "sl as (select *, unnest(range(0, n))::int as slice_index from plans)",
                   "sz as (select *, case when strategy = 'vwap' then quantity / n * (1 + 0.2::double * sin(2 * pi() * slice_index / n)) else quantity / n end as sz from sl)"],
                  """select order_id, line, strategy, slice_index, case when slice_index = n - 1 then quantity - coalesce(sum(sz) over (partition by order_id, line, strategy, quantity, last_price, bid, ask order by slice_index rows between unbounded preceding and 1 preceding), 0) else sz end as slice_quantity from sz"""),
         ["order_id", "line", "strategy", "slice_index"], ["slice_quantity"]),
)
_add(
    "a28_routing_summary",
    lambda s, f: rounded(O.routing_summary(O.execution_plans(_routed(s, f)))),
    rsql(with_sql([ROUTED], "select strategy, count(*) as n_plans, avg((status = 'filled')::int) * 100 as success_percent, avg(estimated_impact) as avg_impact from plans group by 1"), ["strategy", "n_plans"], ["success_percent", "avg_impact"]),
)
_add(
    "a29_engine_rates",
    lambda s, f: rounded(O.engine_rates(derived.order_log(s, f), 60 * 24), 8),
    rsql(with_sql([ORDER_LOG], "select date_trunc('day', created_at)::timestamp as window_start, count(*) as orders_created, count(distinct signal_id) / 1440.0::double as signals_per_minute, count(*) / 1440.0::double as orders_per_minute, count(*) filter (status = 'filled') * 100.0::double / count(*) as success_percent from order_log group by 1"),
         ["window_start", "orders_created"], ["signals_per_minute", "orders_per_minute", "success_percent"], 8),
)


def q_streaks(spark, folder):
    errors = derived.read(spark, folder, "events").filter(F.col("event_type") == "error").select((F.col("user_id") % 3).cast("string").alias("source"), "ts")
    return O.error_streaks(errors, ["source"], 60)


_add(
    "st9_error_streaks",
    q_streaks,
    """select source, count(*) as streak, min(ts) as first_error, max(ts) as last_error, count(*) >= 3 as halt, count(*) >= 5 as circuit_breaker from (select *, sum(brk) over (partition by source order by ts) as isl from
    (select cast(user_id % 3 as varchar) as source, ts, case when ts - lag(ts) over (partition by user_id % 3 order by ts) < interval 60 minute then 0 else 1 end as brk from events where event_type = 'error')) group by source, isl""",
)

# ------------------------------------------------------------------ fill model


def _to_fill(spark, folder):
    fills = derived.fills(spark, folder)
    return fills.select("order_id", "fill_no", "side", "quantity", F.col("price").alias("close"), (F.col("quantity") * 90.0 + F.col("fill_no") * 10.0).alias("volume"),
                        (F.col("price") * F.col("quantity") * 8.0 + 1000.0).alias("portfolio_value"))


_TF = "tf as (select order_id, fill_no, side, quantity, price as close, quantity * 90.0::double + fill_no * 10.0::double as volume, price * quantity * 8.0::double + 1000.0::double as portfolio_value, case when side = 'buy' then 1.0::double else -1.0::double end as sg, least(quantity * price / (price * quantity * 8.0::double + 1000.0::double), 0.1::double) as sh from fills)"
_FM = {
    ("immediate", "linear"): ("close", "quantity"),
    ("realistic", "linear"): ("close * (1 + sg * (0.0005::double + 0.0005::double * (1 + sh * 10)))", "least(quantity, volume * 0.01::double)"),
    ("realistic", "sqrt"): ("close * (1 + sg * (0.0005::double + 0.0005::double * (1 + sqrt(sh * 100))))", "least(quantity, volume * 0.01::double)"),
    ("conservative", "fixed"): ("close * (1 + sg * 0.002::double)", "case when quantity * close > portfolio_value * 0.05::double then quantity * 0.8::double else quantity end"),
}
for (_m, _sm), (_pp, _qq) in _FM.items():
    _add(
        f"f32_fill_model_{_m}_{_sm}",
        lambda s, f, m=_m, sm=_sm: rounded(O.model_fills(_to_fill(s, f), m, sm).select("order_id", "fill_no", "fill_price", "fill_quantity", "commission"), 4),
        rsql(with_sql([FILLS, _TF], f"select *, greatest(1, fill_quantity * fill_price * 0.001::double) as commission from (select order_id, fill_no, {_pp} as fill_price, {_qq} as fill_quantity from tf)"), ["order_id", "fill_no"], ["fill_price", "fill_quantity", "commission"], 4),
    )

# ------------------------------------------------------------------ latency

_lat = ["mean", "median", "p95", "p99", "min_value", "max_value", "std_dev"]
_SORTED = "so as (select metric, list_sort(list(latency_ms)) as v, count(*) as n, avg(latency_ms) as mean, median(latency_ms) as median, min(latency_ms) as min_value, max(latency_ms) as max_value, coalesce(stddev_samp(latency_ms), 0) as std_dev from (select * from latency qualify row_number() over (partition by metric order by ts desc, event_id desc) <= {k}) group by 1)"


def _at(p):
    return f"v[(least(floor({p}::double * n), n - 1) + 1)::int]"


_add(
    "a30_p34_latency_stats",
    lambda s, f: rounded(L.latency_stats(derived.latency(s, f), 1500)),
    rsql(with_sql([LATENCY, _SORTED.format(k=1500)], f"select *, n as count, {_at(0.95)} as p95, {_at(0.99)} as p99 from so"), ["metric", "count"], _lat),
)
_add(
    "a31_latency_percentiles",
    lambda s, f: rounded(L.percentile_breakdown(derived.latency(s, f))),
    rsql(with_sql([LATENCY, _SORTED.format(k="9223372036854775807")], "select metric, " + ", ".join(f"{_at(p)} as {n}" for n, p in L.PERCENTILES.items()) + " from so"), ["metric"], list(L.PERCENTILES)),
)
_add(
    "a32_latency_summary",
    lambda s, f: rounded(L.latency_summary(derived.latency(s, f), 86400)),
    rsql(with_sql([LATENCY], """select count(*) filter (metric = 'end_to_end') as total_orders, sum(latency_ms) / greatest(count(*) filter (metric = 'end_to_end'), 1) as average_latency,
    count(*) filter (metric = 'end_to_end') / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) as orders_per_second, count(distinct metric) as metrics_tracked,
    count(*) filter (ts > (select max(ts) from latency) - interval 86400 second and latency_ms > case metric when 'signal_to_order' then 5 when 'order_submission' then 10 when 'broker_response' then 50 when 'end_to_end' then 100 end) as recent_alerts from latency"""),
         ["total_orders", "metrics_tracked", "recent_alerts"], ["average_latency", "orders_per_second"]),
)
_add(
    "a33_order_latency_components",
    lambda s, f: rounded(L.order_components(derived.latency(s, f), ["signal_to_order", "order_submission", "broker_response"])),
    rsql(with_sql([LATENCY, "c as (select order_id, " + ", ".join(f"arg_max(latency_ms, (ts, event_id)) filter (metric = '{m}') as {m}" for m in ("signal_to_order", "order_submission", "broker_response")) + " from latency group by 1)"],
                  "select *, coalesce(signal_to_order, 0) + coalesce(order_submission, 0) + coalesce(broker_response, 0) as total_latency from c"), ["order_id"], ["signal_to_order", "order_submission", "broker_response", "total_latency"]),
)
_AL = "al as (select *, case metric when 'signal_to_order' then 5 when 'order_submission' then 10 when 'broker_response' then 50 when 'end_to_end' then 100 end::double as threshold from latency)"
_add(
    "st5_latency_alerts_batch",
    lambda s, f: L.alerts(derived.latency(s, f)).select("event_id", "metric", "threshold", "severity"),
    with_sql([LATENCY, _AL], "select event_id, metric, threshold, case when latency_ms > 2 * threshold then 'HIGH' else 'MEDIUM' end as severity from al where latency_ms > threshold"),
)
_add(
    "t12_recent_alerts",
    lambda s, f: L.recent_alerts(derived.latency(s, f), 10).select("event_id", "metric", "severity"),
    with_sql([LATENCY, _AL], "select event_id, metric, case when latency_ms > 2 * threshold then 'HIGH' else 'MEDIUM' end as severity from al where latency_ms > threshold order by ts desc, event_id desc limit 10"),
)
_add(
    "t13_p15_last_bars_per_symbol",
    lambda s, f: top_k(derived.bars(s, f).filter(F.col("ts") <= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")), ["symbol"], [F.desc("ts")], 100),
    with_sql([BARS], "select * from bars where ts <= timestamp '2024-01-25 00:00:00' qualify row_number() over (partition by symbol order by ts desc) <= 100"),
)
