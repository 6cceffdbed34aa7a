"""Order, fill and routing tables: status flags, roll-ups, pre-trade rules, cost and slice models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import lit_map, ratio, zero
from marketframe.operators.lineage import sized

# Order states.
ACTIVE = ["pending", "submitted", "accepted", "partially_filled", "pending_cancel", "pending_replace"]
TERMINAL = ["filled", "canceled", "rejected", "expired", "replaced"]
CANCELABLE = ["pending", "submitted", "accepted", "partially_filled"]
VENDOR_STATUS = {
    "new": "submitted",
    "accepted": "accepted",
    "pending_new": "pending",
    "partially_filled": "partially_filled",
    "filled": "filled",
    "canceled": "canceled",
    "rejected": "rejected",
    "expired": "expired",
    "replaced": "replaced",
    "pending_cancel": "pending_cancel",
    "pending_replace": "pending_replace",
}
# Pre-trade limits.
LIMITS = {
    "max_order_size": 10000.0,
    "min_order_size": 1.0,
    "max_position_size": 50000.0,
    "concentration_limit": 0.25,
    "max_open_orders": 50,
    "max_symbols": 20,
    "order_timeout_minutes": 60,
}
# Routing.
MAX_ORDER_SIZE, MIN_SLICE = 10000.0, 100.0
TWAP_MINUTES, TWAP_SECONDS, ICEBERG_SECONDS, VWAP_SHARE = 30, 60, 30, 0.15
VWAP_SECONDS = min(120.0, max(30.0, TWAP_MINUTES * 60 / 20))
# Fill model.
COMMISSION_RATE, MIN_COMMISSION, SLIPPAGE_RATE, SPREAD = 0.001, 1.0, 0.0005, 0.001


def map_status(vendor: Column) -> Column:
    """Internal status of a broker status; pending when unknown."""
    return F.coalesce(F.try_element_at(lit_map(VENDOR_STATUS), F.lower(vendor)), F.lit("pending"))


def status_flags(orders: DataFrame) -> DataFrame:
    s = F.col("status")
    return orders.withColumns(
        {"is_active": s.isin(ACTIVE), "is_terminal": s.isin(TERMINAL), "can_be_canceled": s.isin(CANCELABLE)}
    )


def bracket_status(orders: DataFrame) -> DataFrame:
    """Per parent order: whether the bracket is complete and which children can still be canceled."""
    parents = orders.filter(F.col("parent_order_id").isNull()).select(
        F.col("order_id").alias("bracket_id"), (F.col("status") == "filled").alias("is_complete"),
        F.col("status").isin(CANCELABLE).cast("int").alias("_own"),
    )
    children = orders.filter(F.col("parent_order_id").isNotNull()).groupBy(F.col("parent_order_id").alias("bracket_id")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("status").isin(CANCELABLE)).alias("_kids")
    )
    out = parents.join(children, "bracket_id")
    return out.select("bracket_id", "is_complete", "n_children", (F.col("_own") + F.col("_kids")).alias("n_cancelable"))


def slippage(side: Column, executed: Column, reference: Column) -> Column:
    """Signed slippage against a reference price; 0 without a positive reference."""
    signed = F.when(side == "buy", executed - reference).otherwise(reference - executed)
    return F.when(reference > 0, ratio(signed, reference)).otherwise(0.0)


def timed_out(orders: DataFrame, as_of: str, minutes: int = LIMITS["order_timeout_minutes"]) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return orders.filter(F.col("status").isin(ACTIVE) & (F.col("created_at") < limit))


def recently_completed(orders: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return orders.filter(F.col("status").isin(TERMINAL) & (F.col("last_updated") > limit))


def order_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Filled quantity, average price, commission, remainder, status and fill share per order."""
    agg = fills.groupBy("order_id").agg(
        F.sum("quantity").alias("filled_quantity"),
        ratio(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("average_fill_price"),
        F.sum("commission").alias("total_commission"),
    )
    out = orders.join(agg, "order_id", "left").withColumns(
        {c: zero(F.col(c)) for c in ("filled_quantity", "average_fill_price", "total_commission")}
    )
    remaining = F.col("quantity") - F.col("filled_quantity")
    state = F.when(F.col("filled_quantity") <= 0, F.col("status")).when(remaining <= 0, "filled")
    return out.withColumns(
        {
            "remaining_quantity": remaining,
            "fill_status": state.otherwise("partially_filled"),
            "fill_percent": zero(F.when(F.col("quantity") > 0, ratio("filled_quantity", "quantity") * 100.0)),
        }
    )


def signal_completion(orders: DataFrame) -> DataFrame:
    """Per signal: whether all its orders are final, filled quantity and average price."""
    filled = F.sum("filled_quantity")
    return orders.groupBy("signal_id").agg(
        F.bool_and(F.col("status").isin(TERMINAL)).alias("is_complete"),
        F.count(F.lit(1)).alias("n_orders"),
        filled.alias("total_filled"),
        zero(ratio(F.sum(F.col("filled_quantity") * F.col("average_fill_price")), filled)).alias("avg_price"),
    )


def order_summary(orders: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by outcome, fill rate in percent and mean slippage of the filled orders."""
    s = F.col("status")
    n, filled = F.count(F.lit(1)), F.count_if(s == "filled")
    slip = F.when((s == "filled") & (F.col("reference_price") > 0),
                  F.abs(F.col("average_fill_price") - F.col("reference_price")) / F.col("reference_price"))
    return orders.groupBy(*keys).agg(
        n.alias("orders_submitted"), filled.alias("orders_filled"),
        F.count_if(s == "rejected").alias("orders_rejected"), F.count_if(s == "canceled").alias("orders_canceled"),
        F.count_if(s.isin(ACTIVE)).alias("active_orders"),
        (filled * 100.0 / F.greatest(n, F.lit(1))).alias("fill_rate_percent"),
        (zero(F.sum(slip)) / F.greatest(filled, F.lit(1))).alias("average_slippage"),
    )


def signed_quantity() -> Column:
    return F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))


def net_positions(fills: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Net quantity per key; closed positions (below 0.001) are left out."""
    out = fills.groupBy(*keys).agg(F.sum(signed_quantity()).alias("position"))
    return out.filter(F.abs("position") >= 0.001)


def order_rollup(log: DataFrame) -> DataFrame:
    """Latest status, last update and first submission time per order of a status log."""
    return log.groupBy("order_id").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.max("ts").alias("last_updated"),
        F.min(F.when(F.col("status") == "submitted", F.col("ts"))).alias("submitted_at"),
    )


def incremental_fills(updates: DataFrame) -> DataFrame:
    """New fills out of cumulative filled quantities: the increase over the order's best so far."""
    w = Window.partitionBy("order_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("filled_qty").over(w), F.lit(0.0))
    out = updates.withColumn("fill_quantity", F.col("filled_qty") - before)
    return out.filter(F.col("fill_quantity") > 0)


def pretrade_checks(
    orders: DataFrame, positions: DataFrame, account: DataFrame | None = None, limits: dict | None = None
) -> DataFrame:
    """Order requests with the names of the rules they break in ``failed_rules``.

    Orders carry portfolio, order_id, symbol, side, order_type, quantity, limit_price, target_price,
    position_size, portfolio_value, created_at and status. Open orders and open symbols are counted
    once per portfolio and symbol; what the orders need of this, of positions and of accounts is stored,
    so that it is broadcast where it is small. Only the broken rules are shuffled to find equal ids.
    """
    lim = {**LIMITS, **(limits or {})}
    pair, pid = ["portfolio", "symbol"], ["portfolio", "order_id"]
    pairs = sized(orders.groupBy(*pair).agg(F.count_if(F.col("status").isin(ACTIVE)).alias("_n")))
    active = pairs.filter("_n > 0")
    totals = active.groupBy("portfolio").agg(F.sum("_n").alias("_open"), F.count(F.lit(1)).alias("_symbols"))
    held_now = active.select(*pair, F.lit(True).alias("_held"))
    # a request meets each row of its positions and accounts; it counts once, with the first of them
    nth = lambda keys, by: F.row_number().over(Window.partitionBy(*keys).orderBy(by))
    wanted = positions.select(*pair, "position").join(pairs, pair, "left_semi").withColumn("_nth_position", nth(pair, "position"))
    out = orders.join(sized(wanted), pair, "left").join(sized(totals), "portfolio", "left").join(held_now, pair, "left")
    if account is not None:
        owners = account.select("portfolio", "buying_power").join(pairs.select("portfolio").distinct(), "portfolio", "left_semi")
        out = out.join(sized(owners.withColumn("_nth_account", nth(["portfolio"], "buying_power"))), "portfolio", "left")
    else:
        out = out.withColumns({"buying_power": F.lit(None).cast("double"), "_nth_account": F.lit(1)})
    value = F.col("quantity") * F.coalesce("limit_price", F.lit(100.0))
    held = F.abs(zero(F.col("position"))) * F.col("target_price")
    rules = {
        "position_value": held > lim["max_position_size"],
        "concentration": ratio("position_size", "portfolio_value") > lim["concentration_limit"],
        "order_too_small": value < lim["min_order_size"],
        "order_too_large": value > lim["max_order_size"],
        "open_orders": F.col("_open") >= lim["max_open_orders"],
        "max_symbols": (F.col("_symbols") >= lim["max_symbols"]) & F.col("_held").isNull(),
        "buying_power": (F.col("side") == "buy") & (value > F.col("buying_power")),
        "duplicate_order": F.lit(None).cast("boolean"),  # known below
        "weekend_market_order": (F.col("order_type") == "market") & (F.weekday("created_at") >= 5),
    }
    # one bit for each broken rule; orders without an id or portfolio are nobody's copy and need not meet
    broken = sum((F.when(cond, F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(rules.values())), F.lit(0))
    known = F.col("portfolio").isNotNull() & F.col("order_id").isNotNull()
    alone = F.when(~known, F.xxhash64("portfolio", "order_id", "symbol", "quantity", "created_at"))
    once = (F.coalesce("_nth_position", F.lit(1)) == 1) & (F.coalesce("_nth_account", F.lit(1)) == 1)
    rest = [c for c in orders.columns if c not in (*pid, "symbol")]
    out = out.select(*pid, "symbol", *rest, value.alias("order_value"), broken.alias("_broken"), alone.alias("_alone"), once.alias("_once"))
    out = out.withColumn("_copies", F.count_if("_once").over(Window.partitionBy(*pid, "_alone")) - 1)
    bits = {name: F.col("_broken").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(rules)}
    bits["duplicate_order"] = known & (F.col("_copies") > 0)
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in bits.items()]))
    out = out.withColumn("failed_rules", failed).withColumn("accepted", F.size("failed_rules") == 0)
    return out.drop("_broken", "_alone", "_once", "_copies")


def signals_to_orders(signals: DataFrame) -> DataFrame:
    """Order requests of sized signals: side from direction, quantity = dollars / price."""
    market = F.col("order_style") == "market"
    return signals.select(
        F.concat(F.lit("ord_"), F.sha2(F.col("signal_id"), 256).substr(1, 12)).alias("order_id"),
        "signal_id",
        F.col("asset_id").alias("symbol"),
        F.when(F.col("direction") == "long", "buy").otherwise("sell").alias("side"),
        F.when(market, "market").otherwise("limit").alias("order_type"),
        F.abs(ratio("dollar_amount", "target_price")).alias("quantity"),
        F.when(~market, F.col("target_price")).alias("limit_price"),
        F.lit("day").alias("time_in_force"),
        F.lit(0.005).alias("max_slippage"),
    )


# ---------------------------------------------------------------- routing


def quote_columns(quotes: DataFrame) -> DataFrame:
    """Spread, relative spread and liquidity of a quote."""
    mid = (F.col("bid") + F.col("ask")) / 2.0
    spread = F.col("ask") - F.col("bid")
    return quotes.withColumns(
        {
            "spread": spread,
            "spread_percent": zero(F.when(mid > 0, ratio(spread, mid))),
            "liquidity_score": F.sqrt(F.col("bid_size") * F.col("ask_size")),
        }
    )


def choose_strategy(routed: DataFrame) -> DataFrame:
    """Execution strategy of orders joined to their quotes."""
    value = F.col("quantity") * F.coalesce("limit_price", "last_price")
    visible = F.col("bid_size") + F.col("ask_size")
    rule = (
        F.when(value < MIN_SLICE, "aggressive")
        .when(value > MAX_ORDER_SIZE * 5, F.when(F.col("volume") > 0, "vwap").otherwise("twap"))
        .when(F.col("spread_percent") > 0.01, "passive")
        .when(F.col("quantity") > visible * 0.5, "iceberg")
        .when(F.col("order_type") == "market", "aggressive")
        .otherwise("passive")
    )
    return routed.withColumn("strategy", rule)


def estimate_impact(routed: DataFrame) -> DataFrame:
    """Market impact estimate, at most 5 %; 1 % where no liquidity is visible."""
    value = F.col("quantity") * F.col("last_price")
    depth = (F.col("bid_size") + F.col("ask_size")) * F.col("last_price")
    vol = F.when(F.col("volatility") > 0, F.col("volatility") * 0.1).otherwise(0.0)
    impact = F.sqrt(ratio(value, depth)) * 0.01 + F.col("spread_percent") * 0.5 + vol
    return routed.withColumn("estimated_impact", F.when(depth <= 0, 0.01).otherwise(F.least(impact, F.lit(0.05))))


def _slice_counts() -> tuple[Column, Column]:
    """Number of slices and largest iceberg slice."""
    visible = F.col("bid_size") + F.col("ask_size")
    largest = F.greatest(F.least(F.col("quantity") * 0.1, visible * 0.2), F.lit(MIN_SLICE))
    twap = max(1, int(TWAP_MINUTES * 60 / TWAP_SECONDS))
    vwap = max(1, int(TWAP_MINUTES * 60 / VWAP_SECONDS))
    iceberg = F.greatest(F.ceil(F.col("quantity") / largest), F.lit(1))
    s = F.col("strategy")
    n = F.when(s == "twap", twap).when((s == "vwap") & (F.col("volume") * VWAP_SHARE > 0), vwap)
    return n.when(s == "vwap", twap).when(s == "iceberg", iceberg).otherwise(1).cast("int"), largest


def execution_plans(routed: DataFrame) -> DataFrame:
    """Plan per order: strategy, slices, interval, duration and estimated impact."""
    s = F.col("strategy")
    minutes = F.when(s == "aggressive", 0.5).when(s.isin("twap", "vwap"), float(TWAP_MINUTES)).when(s == "iceberg", 120.0)
    interval = (
        F.when(s == "twap", float(TWAP_SECONDS)).when((s == "vwap") & (F.col("volume") > 0), VWAP_SECONDS)
        .when(s == "vwap", float(TWAP_SECONDS)).when(s == "iceberg", float(ICEBERG_SECONDS)).otherwise(0.0)
    )
    out = estimate_impact(routed)
    return out.withColumns(
        {"total_slices": _slice_counts()[0], "interval_seconds": interval, "duration_minutes": minutes.otherwise(60.0)}
    )


def order_slices(routed: DataFrame) -> DataFrame:
    """Child rows of sliced orders; the last slice takes what the others left.

    A slice's size is a closed form of its number, so slicing is an explode without any
    running state.
    """
    n = F.col("_n")
    out = routed.withColumn("_n", _slice_counts()[0])
    out = out.withColumn("slice_index", F.explode(F.sequence(F.lit(0), n - 1)))
    i = F.col("slice_index")
    even = F.col("quantity") / n
    vwap = (F.col("strategy") == "vwap") & (F.col("volume") > 0)
    angle = F.lit(2.0 * math.pi) / n
    weight = F.lit(1.0) + F.sin(angle * i) * 0.2
    # sum of sin(angle * k) for k = 0 .. n-2
    head = F.when(n > 1, F.sin(angle * (n - 2) / 2.0) * F.sin(angle * (n - 1) / 2.0) / F.sin(angle / 2.0)).otherwise(0.0)
    done = even * ((n - 1) + head * 0.2)
    size = F.when(i == n - 1, F.when(vwap, F.col("quantity") - done).otherwise(F.col("quantity") - even * i)).otherwise(
        F.when(vwap, even * weight).otherwise(even)
    )
    return out.withColumn("slice_quantity", size).filter(F.col("slice_quantity") > 0).drop("_n")


def routing_summary(plans: DataFrame) -> DataFrame:
    """Plans, success share and mean impact per strategy."""
    return plans.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_plans"),
        (F.avg((F.col("status") == "filled").cast("double")) * 100.0).alias("success_percent"),
        F.avg("estimated_impact").alias("avg_impact"),
    )


def engine_rates(log: DataFrame, minutes: int = 60 * 24 * 30, signal: str = "signal_id") -> DataFrame:
    """Per time window: signals and orders per minute and success percentage."""
    window = F.window("created_at", f"{minutes} minutes")
    n = F.count(F.lit(1))
    return (
        log.groupBy(window.alias("_w"))
        .agg(
            n.alias("orders_created"),
            (F.count_distinct(signal) / float(minutes)).alias("signals_per_minute"),
            (n / float(minutes)).alias("orders_per_minute"),
            (F.count_if(F.col("status") == "filled") * 100.0 / n).alias("success_percent"),
        )
        .select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "orders_created", "signals_per_minute",
                "orders_per_minute", "success_percent")
    )


def error_streaks(errors: DataFrame, keys: Sequence[str] = ("source",), gap_minutes: int = 5) -> DataFrame:
    """Runs of errors without a pause longer than ``gap_minutes``: length, start, end and alarm level.

    Session windows merge partial sessions before the shuffle, so no source is gathered in order.
    """
    session = F.session_window("ts", f"{gap_minutes} minutes").alias("_s")
    return (
        errors.groupBy(*keys, session)
        .agg(F.count(F.lit(1)).alias("streak"), F.min("ts").alias("first_error"), F.max("ts").alias("last_error"))
        .drop("_s")
        .withColumns({"halt": F.col("streak") >= 3, "circuit_breaker": F.col("streak") >= 5})
    )


# ---------------------------------------------------------------- fill model


def model_fills(orders: DataFrame, model: str = "realistic", slippage_model: str = "linear") -> DataFrame:
    """Fill price, quantity and commission of orders joined to their bar.

    Needs side, quantity, close, volume and portfolio_value.
    """
    price, qty = F.col("close"), F.col("quantity")
    share = F.least(ratio(qty * price, "portfolio_value"), F.lit(0.1))
    slip = {
        "linear": (F.lit(1.0) + share * 10.0) * SLIPPAGE_RATE,
        "sqrt": (F.lit(1.0) + F.sqrt(share * 100.0)) * SLIPPAGE_RATE,
        "fixed": F.lit(SLIPPAGE_RATE),
    }[slippage_model]
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    if model == "immediate":
        fill_price, fill_qty = price, qty
    elif model == "realistic":
        fill_price = price * (F.lit(1.0) + sign * (F.lit(SPREAD / 2) + slip))
        fill_qty = F.least(qty, F.coalesce("volume", F.lit(1_000_000.0)) * 0.01)
    else:
        fill_price = price * (F.lit(1.0) + sign * (SPREAD + SLIPPAGE_RATE * 2))
        fill_qty = F.when(qty * price > F.col("portfolio_value") * 0.05, qty * 0.8).otherwise(qty)
    ok = (price > 0) & (fill_qty > 0)
    out = orders.filter(ok).withColumns({"fill_price": fill_price, "fill_quantity": fill_qty})
    fee = F.col("fill_quantity") * F.col("fill_price") * COMMISSION_RATE
    return out.withColumn("commission", F.greatest(F.lit(MIN_COMMISSION), fee))
