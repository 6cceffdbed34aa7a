"""Predictions and bars to trading signals, and position sizing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import clamp, lit_map, ratio, us, zero
from marketframe.operators.folds import fold_sorted
from marketframe.operators.ordered import rolling, row_chunks
from marketframe.operators.ranking import top_k

# Evaluation thresholds.
MIN_CONFIDENCE, STRONG, EXTREME = 0.6, 0.8, 0.9
LONG_FROM, SHORT_TO = 0.55, 0.45
MAX_SIZE, MIN_SIZE, MAX_RISK = 0.20, 0.01, 0.02
MIN_EVENT_IMPACT, MAX_CORRELATION, VALID_HOURS = 0.3, 0.7, 24
REGIME_FACTORS = {"bull": 1.0, "bear": 0.7, "sideways": 0.8, "volatile": 0.6}
# Sizing.
PORTFOLIO_VALUE, CASH_RESERVE, MAX_LEVERAGE = 100000.0, 0.05, 1.0
STOP_MIN, STOP_MAX, VOL_TARGET, VOL_FACTOR = 0.01, 0.08, 0.02, 1.5
REWARD_BASE, REWARD_MIN, REWARD_MAX = 2.0, 1.2, 5.0
COMMISSION, SLIPPAGE = 0.001, 0.0005
VOL_ROWS = 20
ACTIONS = {"long": "buy", "short": "sell", "hold": "hold", "close": "close"}


def _optional(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def correlation_risk(sector: Column, has_positions: Column, has_large: Column) -> Column:
    """Risk of moving with what is already held (any position above 5 % counts as large)."""
    return (
        F.when(~has_positions, 0.0)
        .when(sector.isNull() | (sector == ""), 0.3)
        .when(has_large, F.when(sector == "Technology", 0.6).otherwise(0.3))
        .otherwise(0.1)
    )


def urgency(confidence: Column, hours: Column, impact: Column, compat: bool = False) -> Column:
    """low / normal / high from confidence, time to event and impact.

    ``compat`` keeps the alphabetical comparison of the two labels within six hours of an
    event, by which ``high`` loses to ``normal``.
    """
    base = F.when(confidence >= 0.9, "high").when(confidence >= 0.8, "normal").otherwise("low")
    near = F.lit("normal") if compat else F.when(base == "high", "high").otherwise("normal")
    return (
        F.when(hours < 2, "high").when(hours < 6, near)
        .when(impact > 0.8, F.when(base == "low", "normal").otherwise("high"))
        .otherwise(base)
    )


def signal_type(impact: Column, features: Column) -> Column:
    names = F.coalesce(F.map_keys(features), F.array().cast("array<string>"))

    def named(*words: str) -> Column:
        cond = lambda n: F.contains(n, F.lit(words[0])) if len(words) == 1 else (
            F.contains(n, F.lit(words[0])) | F.contains(n, F.lit(words[1])))
        return F.exists(names, cond)

    return (
        F.when(impact > 0.3, "event_driven").when(named("momentum"), "momentum").when(named("volatility", "vol"), "volatility")
        .when(named("breakout", "resistance"), "breakout").when(named("mean", "reversion"), "reversal").otherwise("ensemble")
    )


def evaluate_predictions(predictions: DataFrame, positions: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Predictions that pass the filters, as signals.

    Optional columns: features_used (map), event_description, event_impact_score,
    time_to_event_hours, regime, sector, volatility. ``positions`` (asset_id, weight) are reduced
    to one row before use.
    """
    p, conf = F.col("prediction_value"), F.col("confidence")
    impact = _optional(predictions, "event_impact_score")
    hours = _optional(predictions, "time_to_event_hours")
    regime, sector = _optional(predictions, "regime", "string"), _optional(predictions, "sector", "string")
    vol = F.coalesce(_optional(predictions, "volatility"), F.lit(0.02))
    features = _optional(predictions, "features_used", "map<string,double>")
    weak_event = F.coalesce((impact != 0) & (impact < MIN_EVENT_IMPACT), F.lit(False))
    out = predictions.filter((conf >= MIN_CONFIDENCE) & ~weak_event & ((p >= LONG_FROM) | (p <= SHORT_TO)))
    if positions is None:
        out = out.withColumns({"_any": F.lit(False), "_large": F.lit(False)})
    else:
        held = positions.agg(
            (F.count(F.lit(1)) > 0).alias("_any"), F.coalesce(F.max(F.col("weight") > 0.05), F.lit(False)).alias("_large")
        )
        out = out.crossJoin(F.broadcast(held))  # one row
    factor = F.coalesce(F.try_element_at(lit_map(REGIME_FACTORS), regime), F.lit(1.0))
    out = out.withColumns(
        {
            "_adj": F.when(regime.isNull(), conf).otherwise(F.least(conf * factor, F.lit(1.0))),
            "_risk": correlation_risk(sector, F.col("_any"), F.col("_large")),
        }
    ).filter(F.col("_risk") <= MAX_CORRELATION)
    adj = F.col("_adj")
    size = F.least(adj / 0.8, F.lit(1.0)) * (F.abs(p - 0.5) * 2.0) * MAX_SIZE
    return out.select(
        F.concat_ws("_", "asset_id", "model_id", F.date_format("ts", "yyyyMMdd_HHmmss")).alias("signal_id"),
        "ts", "asset_id",
        signal_type(impact, features).alias("signal_type"),
        F.when(p >= LONG_FROM, "long").otherwise("short").alias("direction"),
        F.when(adj >= EXTREME, "extreme").when(adj >= STRONG, "strong").when(adj >= 0.7, "moderate").otherwise("weak").alias("strength"),
        adj.alias("confidence"),
        F.greatest(F.least(size, F.lit(MAX_SIZE)), F.lit(MIN_SIZE)).alias("position_size"),
        F.least(F.lit(MAX_RISK), adj * MAX_RISK).alias("max_risk_pct"),
        F.when(vol < 0.01, 0.8).when(vol < 0.03, 1.0).when(vol < 0.05, 1.3).otherwise(1.6).alias("volatility_adj"),
        "model_id", "prediction_value",
        impact.alias("event_impact_score"), hours.alias("time_to_event"), regime.alias("market_regime"), sector.alias("sector"),
        F.col("_risk").alias("correlation_risk"),
        urgency(adj, hours, impact, compat).alias("urgency"),
        (F.col("ts") + F.expr(f"interval {VALID_HOURS} hours")).alias("valid_until"),
        conf.alias("original_confidence"),
        *[F.col(c) for c in ("run_id", "volatility") if c in predictions.columns],
    )


def split_valid(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with confidence and size inside [0, 1], and the rest for quarantine."""
    ok = F.coalesce(F.col("confidence").between(0.0, 1.0) & F.col("position_size").between(0.0, 1.0), F.lit(False))
    return signals.filter(ok), signals.filter(~ok)


def valid_signals(signals: DataFrame, as_of: Column, min_size: float = MIN_SIZE) -> DataFrame:
    live = F.col("valid_until").isNull() | (F.col("valid_until") >= as_of)
    return signals.filter(live & (F.col("confidence") >= 0.5) & (F.col("position_size") >= min_size))


def execution_priority() -> Column:
    """1 (lowest) to 5."""
    base = F.coalesce(F.try_element_at(lit_map({"low": 1, "normal": 2, "high": 3}), F.col("urgency")), F.lit(2))
    extra = (F.col("confidence") > 0.8).cast("int") + F.col("strength").isin("strong", "extreme").cast("int")
    return F.least(base + extra, F.lit(5))


def action() -> Column:
    return F.coalesce(F.try_element_at(lit_map(ACTIONS), F.col("direction")), F.lit("hold"))


def evaluation_summary(signals: DataFrame) -> DataFrame:
    """Counts and averages overall, by direction and by strength."""
    return (
        signals.groupingSets([(F.col("direction"),), (F.col("strength"),), ()], "direction", "strength")
        .agg(F.count(F.lit(1)).alias("n_signals"), F.avg("confidence").alias("avg_confidence"),
             F.avg("position_size").alias("avg_position_size"))
    )


# ---------------------------------------------------------------- rule generators


def _rule_signals(out: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows for the first rule that holds; a rule is (condition, values of the signal columns)."""
    cols = ["signal_type", "direction", "strength", "confidence", "position_size", "stop_loss", "take_profit", "model_id", "trigger"]
    picked = F.lit(None)
    for cond, values in reversed(rules):
        struct = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(c) for c, v in zip(cols, values)])
        picked = F.when(cond, struct).otherwise(picked)
    return out.withColumn("_s", picked).filter(F.col("_s").isNotNull()).select(
        F.col("symbol").alias("asset_id"), "ts", "close", *[F.col(f"_s.{c}").alias(c) for c in cols]
    )


def momentum_signals(bars: DataFrame, buy_size: float = 0.1, sell_size: float = 1.0, margin: float = 0.01) -> DataFrame:
    """Signals of stacked 5/10/20-bar averages with the close beyond the short one."""
    c = row_chunks(bars, halo=20)
    c = c.with_columns({f"_m{w}": rolling(c, F.col("close"), w) for w in (5, 10, 20)})
    out, close = c.own(), F.col("close")
    up = (F.col("_m5") > F.col("_m10")) & (F.col("_m10") > F.col("_m20")) & (close > F.col("_m5") * (1 + margin))
    down = (F.col("_m5") < F.col("_m10")) & (F.col("_m10") < F.col("_m20")) & (close < F.col("_m5") * (1 - margin))
    return _rule_signals(
        out,
        [
            (up, ("momentum", "long", "moderate", 0.7, buy_size, close * 0.95, close * 1.10, "momentum_strategy", "momentum_breakout")),
            (down, ("momentum", "short", "moderate", 0.6, sell_size, close * 1.05, close * 0.90, "momentum_strategy", "momentum_breakdown")),
        ],
    )


def reversion_signals(bars: DataFrame, buy_size: float = 0.05, sell_size: float = 0.5, width: float = 2.0) -> DataFrame:
    """Signals of a close more than ``width`` deviations from its 20-bar mean."""
    c = row_chunks(bars, halo=20)
    c = c.with_columns({"_mean": rolling(c, F.col("close"), 20), "_dev": rolling(c, F.col("close"), 20, F.stddev_samp)})
    out, close, mean = c.own(), F.col("close"), F.col("_mean")
    return _rule_signals(
        out,
        [
            (close < mean - F.col("_dev") * width, ("reversal", "long", "strong", 0.75, buy_size, close * 0.98, mean, "mean_reversion_strategy", "oversold_condition")),
            (close > mean + F.col("_dev") * width, ("reversal", "short", "strong", 0.75, sell_size, close * 1.02, mean, "mean_reversion_strategy", "overbought_condition")),
        ],
    )


def near_events(bars: DataFrame, events: DataFrame, hours: float = 1.0) -> DataFrame:
    """Bars paired with the events of their symbol less than ``hours`` away.

    Both sides are cut into slots of that length; an event meets only the bars of its own and
    the two neighbouring slots, by equality.
    """
    width = int(hours * 3_600_000_000)
    slot = F.floor(us("ts") / F.lit(width))
    left = bars.withColumn("_slot", slot)
    right = events.withColumnRenamed("ts", "event_ts").withColumn(
        "_slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(us("event_ts") / F.lit(width)) + d))
    )
    return left.join(right, ["symbol", "_slot"]).filter(F.abs(us("ts") - us("event_ts")) < width).drop("_slot")


def event_signals(bars: DataFrame, events: DataFrame, buy_size: float = 0.08, sell_size: float = 0.5) -> DataFrame:
    """Signals of confident events with clear sentiment within an hour of the bar."""
    out = near_events(bars, events.select("symbol", "ts", "event_id", F.col("confidence").alias("event_confidence"), "sentiment"))
    sure, conf, none = F.col("event_confidence") > 0.7, F.col("event_confidence"), F.lit(None).cast("double")
    return _rule_signals(
        out,
        [
            (sure & (F.col("sentiment") > 0.5), ("event_driven", "long", "strong", F.least(F.lit(0.9), conf + 0.1), buy_size, none, none, "event_driven_strategy", F.col("event_id").cast("string"))),
            (sure & (F.col("sentiment") < -0.5), ("event_driven", "short", "strong", F.least(F.lit(0.9), conf), sell_size, none, none, "event_driven_strategy", F.col("event_id").cast("string"))),
        ],
    )


Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {"momentum": momentum_signals, "mean_reversion": reversion_signals, "event": event_signals}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Make a callable that returns the signal columns available by name."""
    STRATEGIES[name] = strategy


def generate_signals(bars: DataFrame, events: DataFrame | None = None, names=("momentum", "mean_reversion"), **options) -> DataFrame:
    """Union of the named strategies' signals."""
    out = None
    for name in names:
        args = (bars, events) if name == "event" else (bars,)
        part = STRATEGIES[name](*args, **options.get(name, {}))
        out = part if out is None else out.unionByName(part)
    return out


def best_per_side(signals: DataFrame) -> DataFrame:
    """Most confident buy and most confident sell per asset and time."""
    return top_k(signals, ["asset_id", "ts", "direction"], [F.desc("confidence"), F.asc("model_id"), F.asc("trigger")], 1)


# ---------------------------------------------------------------- sizing


def recent_volatility(bars: DataFrame) -> DataFrame:
    """Deviation of the last 20 returns per bar; the asset class default before that."""
    c = row_chunks(bars, halo=VOL_ROWS + 2)
    prev = F.lag("close").over(c.order)
    c = c.with_columns({"_ret": ratio(F.col("close") - prev, prev)})
    frame = c.last_rows(VOL_ROWS)
    dev = F.stddev_samp("_ret").over(frame)
    default = F.when(F.endswith("symbol", F.lit("-USD")), 0.05).when(F.col("symbol").isin("SPY", "QQQ", "IWM"), 0.015).otherwise(0.025)
    return c.with_columns({"volatility": F.when(F.col("_rn") >= VOL_ROWS - 1, dev).otherwise(default)}).own().drop("_ret")


def available_cash(exposure: Column, portfolio_value: float = PORTFOLIO_VALUE) -> Column:
    """Cash for new positions given the sum of absolute weights held (NULL = nothing held)."""
    most = portfolio_value * (1 - CASH_RESERVE)
    return F.greatest(F.when(exposure.isNull(), most).otherwise(F.least(F.lit(most), (MAX_LEVERAGE - exposure) * portfolio_value)), F.lit(0.0))


def wanted_size(signals: DataFrame) -> DataFrame:
    """Stop, risk-adjusted size and targets per signal before the cash limit.

    Needs position_size, confidence, direction, current_price and volatility.
    """
    conf, price, vol = F.col("confidence"), F.col("current_price"), F.col("volatility")
    adjust = F.coalesce(clamp(F.try_divide(F.lit(1.0), (vol / VOL_TARGET - 1.0) * VOL_FACTOR + 1.0), 0.3, 2.0), F.lit(2.0))
    stop = F.greatest(F.lit(STOP_MIN), F.least(vol * 2.0 * (F.lit(1.5) - conf), F.lit(STOP_MAX)))
    out = signals.withColumns({"_adjusted": F.col("position_size") * adjust, "stop_loss_pct": stop})
    risk = F.least(F.col("_adjusted"), ratio(conf * MAX_RISK, "stop_loss_pct"))
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    reward = F.greatest(F.lit(REWARD_MIN), F.least((conf - 0.5) * 2.0 + REWARD_BASE, F.lit(REWARD_MAX)))
    stop_price = price * (F.lit(1.0) - sign * F.col("stop_loss_pct"))
    out = out.withColumns(
        {"wanted_size": F.greatest(F.lit(MIN_SIZE), F.least(risk, F.lit(MAX_SIZE))), "stop_loss": stop_price, "reward_ratio": reward}
    )
    return out.withColumn("take_profit", price + sign * F.abs(price - F.col("stop_loss")) * F.col("reward_ratio")).drop("_adjusted")


def _spend(cash: float, wanted: float, price: float, room: float, value: float) -> tuple[float, float]:
    size = max(min(wanted, cash / value, room), 0.0)
    dollars = size * value
    if dollars > cash:
        dollars = cash * 0.95
    shares = float(int(dollars // price)) if price > 0 else 0.0
    return shares, shares * price


def size_positions(
    signals: DataFrame, run: str = "run_id", exposure: str | None = None, portfolio_value: float = PORTFOLIO_VALUE,
    order: tuple[str, ...] = ("signal_id",),
) -> DataFrame:
    """Sized signals of every run: the cash left by the earlier signals limits the later ones,
    then the whole run is scaled down to the leverage limit.

    ``exposure`` names a column with the run's sum of absolute weights already held.
    """
    held = F.col(exposure) if exposure else F.lit(None).cast("double")
    ready = wanted_size(signals).withColumns(
        {"_cash": available_cash(held, portfolio_value), "_room": F.coalesce(MAX_LEVERAGE - held, F.lit(1e9))}
    )

    def start() -> dict:
        return {"cash": None}

    def step(state: dict, row: dict) -> dict:
        if state["cash"] is None:
            state["cash"] = row["_cash"]
        shares, dollars = _spend(state["cash"], row["wanted_size"], row["current_price"], row["_room"], portfolio_value)
        state["cash"] -= dollars
        return {"shares": shares, "dollars": dollars}

    sized = fold_sorted(ready, [run], list(order), start, step, "shares double, dollars double")
    sized = sized.withColumn("final_size", F.col("dollars") / portfolio_value)
    total = sized.groupBy(run).agg(F.sum("final_size").alias("_total"))
    scale = F.when(F.col("_total") > MAX_LEVERAGE, ratio(F.lit(MAX_LEVERAGE), "_total")).otherwise(1.0)
    out = sized.join(total, run)
    out = out.withColumns({"final_size": F.col("final_size") * scale, "dollar_amount": F.col("final_size") * scale * portfolio_value})
    gain = ratio(F.abs(F.col("take_profit") - F.col("current_price")), "current_price")
    return out.withColumns(
        {
            "expected_return": gain * F.col("confidence") * F.col("final_size") * portfolio_value,
            "transaction_costs": F.col("dollars") * (COMMISSION + SLIPPAGE),
        }
    ).drop("_cash", "_room", "_total", "dollars")


def sizing_summary(sized: DataFrame, keys=()) -> DataFrame:
    return sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_positions"), F.avg("final_size").alias("avg_position_size"),
        F.avg("dollar_amount").alias("avg_dollar_amount"), F.avg("volatility").alias("avg_volatility"),
        F.avg("stop_loss_pct").alias("avg_stop_loss_pct"), zero(F.sum("final_size")).alias("total_exposure"),
    )
