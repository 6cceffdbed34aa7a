"""Ledger, equity curve, performance metrics and walk-forward evaluation for all portfolios at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import MICROS_PER_DAY, day_number, ratio, us, zero
from marketframe.operators.folds import fold_sorted
from marketframe.operators.lineage import cut
from marketframe.operators.ordered import row_chunks, running_max
from marketframe.operators.orders import model_fills, signed_quantity
from marketframe.operators.ranking import exact_quantiles

YEAR = 252
RISK_FREE = 0.02
CAPITAL = 100_000.0


def cash_flow() -> Column:
    """Cash effect of a fill: buys cost price and commission, sells bring price less commission."""
    gross = F.col("quantity") * F.col("price")
    return F.when(F.col("side") == "sell", gross - F.col("commission")).otherwise(-gross - F.col("commission"))


# ---------------------------------------------------------------- average-cost ledger

LEDGER = "accepted boolean, cash_effect double, position double, avg_price double, realized_pnl double"


def _book(state: dict, row: dict) -> dict:
    qty, price, fee = row["quantity"], row["price"], row["commission"]
    held, avg = state["held"], state["avg"]
    if row["side"] != "sell":
        state["avg"] = (held * avg + qty * price) / (held + qty)
        state["held"] = held + qty
        return _entry(state, True, -(qty * price + fee), 0.0)
    if qty > held:
        return _entry(state, False, 0.0, 0.0)
    state["held"] = held - qty
    if state["held"] <= 0.001:
        state["held"] = 0.0
    return _entry(state, True, qty * price - fee, qty * (price - avg) - fee)


def _entry(state: dict, accepted: bool, cash: float, pnl: float) -> dict:
    avg = state["avg"] if state["held"] > 0 else 0.0
    return {"accepted": accepted, "cash_effect": cash, "position": state["held"], "avg_price": avg, "realized_pnl": pnl}


def trade_ledger(fills: DataFrame, keys: Sequence[str] = ("portfolio", "symbol"), order: Sequence[str] = ("ts", "order_id", "fill_no")) -> DataFrame:
    """Fills with average cost, position and realised result; sells without enough position are refused."""
    return fold_sorted(fills, keys, order, lambda: {"held": 0.0, "avg": 0.0}, _book, LEDGER, ("side", "quantity", "price", "commission"))


def positions_summary(ledger: DataFrame, prices: DataFrame, tie: Sequence[str] = ("order_id", "fill_no")) -> DataFrame:
    """Open positions marked at the latest price of their symbol; ``tie`` orders rows of one time in both tables."""
    latest_first = F.struct("ts", *tie)
    last = ledger.groupBy("portfolio", "symbol").agg(
        F.max_by(F.struct("position", "avg_price"), latest_first).alias("_p"),
        F.sum("realized_pnl").alias("realized_pnl"),
    )
    latest = prices.groupBy("symbol").agg(F.max_by("close", latest_first).alias("current_price"))
    out = last.select("portfolio", "symbol", "_p.position", "_p.avg_price", "realized_pnl").filter(F.col("position") > 0)
    out = out.join(latest, "symbol", "left")
    price = zero(F.col("current_price"))
    return out.withColumns(
        {
            "market_value": F.when(price > 0, F.col("position") * price).otherwise(0.0),
            "unrealized_pnl": F.when(price > 0, (price - F.col("avg_price")) * F.col("position")).otherwise(0.0),
        }
    )


def trade_statistics(trades: DataFrame, keys: Sequence[str] = ("portfolio",), compat: bool = False) -> DataFrame:
    """Win rate, profit factor, average win and loss over the sells.

    A trade's result is its realised pnl; with ``compat`` it is the net proceeds, by which every
    sell that brings money counts as a win.
    """
    pnl = F.col("cash_effect") if compat else F.col("realized_pnl")
    sells = trades.filter((F.col("side") == "sell") & (F.col("accepted") if "accepted" in trades.columns else F.lit(True)))
    win = pnl > 0
    wins, losses = zero(F.sum(F.when(win, pnl))), F.abs(zero(F.sum(F.when(~win, pnl))))
    n_win, n_loss, n = F.count_if(win), F.count_if(~win), F.count(F.lit(1))
    return sells.groupBy(*keys).agg(
        n.alias("total_trades"), ratio(n_win, n).alias("win_rate"),
        F.when(losses > 0, ratio(wins, losses)).when(wins > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        zero(ratio(wins, n_win)).alias("avg_win"), zero(ratio(losses, n_loss)).alias("avg_loss"),
    )


def trades_per_day(fills: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    return fills.groupBy(*keys, F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("transactions"))


# ---------------------------------------------------------------- equity


#: Length of units of a fixed length in microseconds, and of the others in months.
_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": MICROS_PER_DAY, "week": 7 * MICROS_PER_DAY}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


class Periods:
    """Consecutive periods of ``step`` from the start of the unit that holds ``first``, numbered from 0."""

    def __init__(self, first, step: str):
        number, unit = step.split()
        unit = unit.rstrip("s").lower()
        self.start = F.date_trunc(unit, F.lit(first).cast("timestamp_ntz")).cast("timestamp_ntz")
        self.months = int(number) * _MONTHS[unit] if unit in _MONTHS else 0
        self.micros = 0 if self.months else int(number) * _MICROS[unit]

    def number(self, ts: Column) -> Column:
        if self.months:
            since = (F.year(ts) - F.year(self.start)) * 12 + F.month(ts) - F.month(self.start)
            return F.floor(since / self.months).cast("int")
        return F.floor((us(ts) - us(self.start)) / self.micros).cast("int")

    def end(self, number: Column) -> Column:
        """Last microsecond of a period."""
        if self.months:
            after = F.add_months(F.to_date(self.start), (number + 1) * self.months).cast("timestamp_ntz")
            return (after - F.expr("interval 1 microsecond")).cast("timestamp_ntz")
        return F.timestamp_micros(us(self.start) + (number + 1).cast("long") * self.micros - 1).cast("timestamp_ntz")


def _until_next(df: DataFrame, keys: Sequence[str], last: Column) -> DataFrame:
    """Rows with period ``_p`` repeated for each period up to the next row of their key, or to the ``last`` one."""
    following = F.coalesce(F.lead("_p").over(Window.partitionBy(*keys).orderBy("_p")) - 1, last)
    spread = df.withColumn("_to", following).filter(F.col("_to") >= 0)
    return spread.withColumn("_p", F.explode(F.sequence(F.greatest("_p", F.lit(0)), "_to"))).drop("_to")


def equity_curve(
    fills: DataFrame,
    prices: DataFrame | None = None,
    keys: Sequence[str] = ("portfolio",),
    step: str = "1 month",
    capital: float = CAPITAL,
    tie: Sequence[str] = ("order_id", "fill_no"),
) -> DataFrame:
    """Value of every portfolio at the ends of its periods, from its first fill on: cash plus positions at their last
    price. Fills that a ledger refused (column ``accepted``) do not count.

    ``prices`` has symbol, ts, close (and may have ``tie`` columns); without it the prices of all fills count, also of
    those refused. Fills are read once: they are summed per portfolio, symbol and unit of the step (a period is a number
    of whole units) in one pre-aggregated shuffle and stored; positions and cash are running sums over these sums,
    repeated only for the periods in which a position is held.
    """
    keys = list(keys)
    counted = F.col("accepted") if "accepted" in fills.columns else F.lit(True)
    unit = F.date_trunc(step.split()[1].rstrip("s").lower(), "ts").cast("timestamp_ntz").alias("_unit")
    aggs = [F.min(F.when(counted, F.col("ts"))).alias("_first"), F.max(F.when(counted, F.col("ts"))).alias("_final"), F.count_if(counted).alias("_n")]
    aggs += [F.sum(F.when(counted, signed_quantity())).alias("_q"), F.sum(F.when(counted, cash_flow())).alias("_c")]
    if prices is None:
        latest = [c for c in tie if c in fills.columns]
        aggs.append(F.max(F.struct("ts", *latest, F.col("price").alias("_close"))).alias("_last"))
    units = cut(fills.groupBy(*keys, "symbol", unit).agg(*aggs))
    first, final = units.agg(F.min("_first"), F.max("_final")).first()
    periods = Periods(first, step)
    last = periods.number(F.lit(final).cast("timestamp_ntz"))
    number = periods.number(F.col("_unit")).alias("_p")
    sums = units.filter("_n > 0").groupBy(*keys, "symbol", number).agg(F.sum("_q").alias("_q"), F.sum("_c").alias("_c"))
    upto = lambda by: Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sums.select(*keys, "symbol", "_p", F.sum("_q").over(upto([*keys, "symbol"])).alias("_pos"))
    held = _until_next(held, [*keys, "symbol"], last).filter(F.col("_pos") != 0)
    # prices before the first period serve it, later ones than the last fill's period serve none
    of_period = lambda c: F.greatest(periods.number(F.col(c)), F.lit(-1)).alias("_p")
    if prices is None:
        closes = units.groupBy("symbol", of_period("_unit")).agg(F.max("_last")["_close"].alias("_close"))
    else:
        price_tie = [c for c in tie if c in prices.columns]
        closes = prices.groupBy("symbol", of_period("ts")).agg(F.max_by("close", F.struct("ts", *price_tie)).alias("_close"))
    closes = closes.filter(F.col("_p") <= last)
    book = held.join(_until_next(closes, ["symbol"], last), ["symbol", "_p"], "left")
    holdings = book.groupBy(*keys, "_p").agg(F.sum(F.col("_pos") * zero(F.col("_close"))).alias("holdings"))
    flows = sums.groupBy(*keys, "_p").agg(F.sum("_c").alias("_c"))
    cash = flows.select(*keys, "_p", (F.sum("_c").over(upto(keys)) + capital).alias("cash"))
    out = _until_next(cash, keys, last).join(holdings, [*keys, "_p"], "left").withColumn("holdings", zero(F.col("holdings")))
    return out.select(*keys, periods.end(F.col("_p")).alias("ts"), "holdings", "cash", (F.col("cash") + F.col("holdings")).alias("total_value"))


def equity_path(equity: DataFrame, keys: Sequence[str] = ("portfolio",), capital: float | None = CAPITAL) -> DataFrame:
    """Period result, return, drawdown and running maximum drawdown of an equity curve."""
    keys = list(keys)
    c = row_chunks(cut(equity), keys, halo=2)  # a row per period, small next to the fills
    prev = F.lag("total_value").over(c.order)
    c = c.with_columns({"_prev": prev})
    first = F.lit(capital) if capital is not None else F.col("total_value")
    out = c.with_columns(
        {
            "day_pnl": F.col("total_value") - F.coalesce("_prev", first),
            "return": ratio(F.col("total_value") - F.col("_prev"), "_prev"),
        }
    ).own().drop("_prev")
    top = F.col("total_value") if capital is None else F.greatest("total_value", F.lit(capital))
    out = running_max(cut(out), keys, {"peak": top})
    out = out.withColumn("drawdown", zero(ratio(F.col("peak") - F.col("total_value"), "peak")))
    out = running_max(cut(out), keys, {"max_drawdown": F.col("drawdown")})
    return cut(out.withColumn("total_pnl", F.col("total_value") - capital if capital is not None else F.lit(None).cast("double")))


def rolling_sharpe(path: DataFrame, keys: Sequence[str] = ("portfolio",), window: int = 60, rf: float = RISK_FREE) -> DataFrame:
    """Sharpe ratio of the ``window`` returns before the current one; 0 for a constant window."""
    c = row_chunks(path, keys, halo=window + 2)
    frame = c.order.rowsBetween(-window, -1)
    full = F.count("return").over(frame) == window
    dev = F.stddev_pop("return").over(frame)
    sharpe = zero(F.try_divide(F.avg("return").over(frame) - rf / YEAR, F.when(dev > 1e-15, dev))) * (YEAR**0.5)
    return c.with_columns({"rolling_sharpe": F.when(full & F.col("return").isNotNull(), sharpe)}).own()


def benchmark_returns(bars: DataFrame, symbol: str) -> DataFrame:
    """ts and return of one symbol."""
    c = row_chunks(bars.filter(F.col("symbol") == symbol), halo=2)
    prev = F.lag("close").over(c.order)
    out = c.with_columns({"benchmark_return": ratio(F.col("close") - prev, prev)}).own()
    return out.filter(F.col("benchmark_return").isNotNull()).select("ts", "benchmark_return")


def performance_metrics(
    path: DataFrame, keys: Sequence[str] = ("portfolio",), benchmark: DataFrame | None = None, rf: float = RISK_FREE
) -> DataFrame:
    """Return, risk and (with a benchmark of ts, benchmark_return) relative metrics per key."""
    keys = list(keys)
    r = F.col("return")
    daily = rf / YEAR
    root = YEAR**0.5
    down = F.when(r < 0, r)
    agg = path.groupBy(*keys).agg(
        F.min_by("total_value", "ts").alias("_v0"), F.max_by("total_value", "ts").alias("_v1"),
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 8.64e10).alias("_days"),
        F.count(r).alias("_n"), F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_std"),
        F.stddev_pop(down).alias("_down"), F.max("max_drawdown").alias("max_drawdown"),
    )
    tails = exact_quantiles(path, keys, "return", {"_var": 0.05})
    out = agg.join(tails, keys, "left")
    total = ratio(F.col("_v1") - F.col("_v0"), "_v0")
    years = F.greatest(F.col("_days") / 365.25, F.lit(1.0 / YEAR))
    grown = F.when(total > -1, F.pow(total + 1.0, F.lit(1.0) / years) - 1.0).otherwise(-1.0)
    enough = F.col("_n") > 1

    def annual(excess: Column, dev: Column) -> Column:
        return F.when(enough & (dev > 1e-15), ratio(excess, dev) * root).otherwise(0.0)

    out = out.withColumns({"total_return": total, "annualized_return": grown})
    out = out.withColumns(
        {
            "volatility": F.when(enough, F.col("_std") * root).otherwise(0.0),
            "sharpe_ratio": annual(F.col("_mean") - daily, F.col("_std")),
            "sortino_ratio": annual(F.col("_mean") - daily, zero(F.col("_down"))),
            "var_95": F.when(enough, F.col("_var")).otherwise(0.0),
            "calmar_ratio": zero(F.when(F.col("max_drawdown") > 0, ratio("annualized_return", "max_drawdown"))),
            "n_returns": F.col("_n"),
        }
    )
    if benchmark is not None:
        out = out.join(relative_metrics(path, keys, benchmark, rf), keys, "left")
        out = out.withColumn("information_ratio", zero(F.col("information_ratio")))
    return out.drop("_v0", "_v1", "_days", "_n", "_mean", "_std", "_down", "_var")


def relative_metrics(path: DataFrame, keys: Sequence[str], benchmark: DataFrame, rf: float = RISK_FREE) -> DataFrame:
    """Information ratio and, from 30 common returns on, yearly alpha and beta."""
    daily = rf / YEAR
    both = path.filter(F.col("return").isNotNull()).join(benchmark, "ts")
    r, b = F.col("return"), F.col("benchmark_return")
    agg = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(r - b).alias("_ex"), F.stddev_pop(r - b).alias("_te"),
        F.covar_samp(r, b).alias("_cov"), F.var_pop(b).alias("_var"), F.avg(r).alias("_mr"), F.avg(b).alias("_mb"),
    )
    beta = F.when((F.col("_n") >= 30) & (F.col("_var") > 0), ratio("_cov", "_var"))
    return agg.withColumns(
        {"information_ratio": zero(F.when(F.col("_te") > 1e-15, ratio("_ex", "_te") * (YEAR**0.5))), "beta": beta}
    ).withColumn(
        "alpha", ((F.col("_mr") - daily) - F.col("beta") * (F.col("_mb") - daily)) * float(YEAR)
    ).drop("_n", "_ex", "_te", "_cov", "_var", "_mr", "_mb")


PERIODS = {"monthly": ("month", 12.0), "quarterly": ("quarter", 4.0), "yearly": ("year", 1.0)}


def period_returns(equity: DataFrame, keys: Sequence[str] = ("portfolio",), period: str = "monthly") -> DataFrame:
    """First and last value, return and yearly rate per calendar period."""
    unit, per_year = PERIODS[period]
    out = equity.groupBy(*keys, F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period_start")).agg(
        F.min_by("total_value", "ts").alias("start_value"), F.max_by("total_value", "ts").alias("end_value"),
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"),
    )
    ret = ratio(F.col("end_value") - F.col("start_value"), "start_value")
    return out.withColumns({"period_return": ret, "annualized": ret * per_year})


def turnover(fills: DataFrame, equity: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Traded value, trades, mean equity and their ratio per key."""
    traded = fills.groupBy(*keys).agg(F.sum(F.col("quantity") * F.col("price")).alias("traded_value"), F.count(F.lit(1)).alias("total_trades"))
    mean = equity.groupBy(*keys).agg(F.avg("total_value").alias("avg_value"))
    out = traded.join(mean, list(keys))
    return out.withColumn("turnover", zero(F.when(F.col("avg_value") > 0, ratio("traded_value", "avg_value"))))


# ---------------------------------------------------------------- walk forward


def walk_forward_rows(equity: DataFrame, start: str, end: str, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """Equity rows tagged with every test window that holds them.

    The window numbers of a row follow from its day by arithmetic, so there is no join of rows
    with windows: window k tests days [start + k*step + train, ... + test].
    """
    day = day_number("ts") - F.unix_date(F.lit(start).cast("date")) - train
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    last = F.floor((span - train - test) / step)
    lo = F.greatest(F.ceil((day - test) / step), F.lit(0))
    hi = F.least(F.floor(day / step), last)
    tagged = equity.withColumns({"_lo": lo, "_hi": hi}).filter((F.col("_lo") <= F.col("_hi")))
    return tagged.withColumn("fold", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def walk_forward(equity: DataFrame, start: str, end: str, keys: Sequence[str] = ("portfolio",), **windows) -> DataFrame:
    """Performance metrics per key and test window."""
    rows = walk_forward_rows(equity, start, end, **windows)
    group = [*keys, "fold"]
    return performance_metrics(equity_path(rows, group, capital=None), group)


def walk_forward_report(folds: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    r = F.col("total_return")
    return folds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_periods"), F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("std_return"),
        F.avg("sharpe_ratio").alias("avg_sharpe"), F.stddev_pop("sharpe_ratio").alias("std_sharpe"),
        F.avg("max_drawdown").alias("avg_max_drawdown"), F.min(r).alias("worst_period_return"), F.max(r).alias("best_period_return"),
        F.count_if(r > 0).alias("positive_periods"), F.avg((r > 0).cast("double")).alias("consistency_ratio"),
    )


# ---------------------------------------------------------------- strategy evaluation


def strategy_fills(signals: DataFrame, bars: DataFrame, capital: float = CAPITAL, model: str = "realistic") -> DataFrame:
    """Signals at a bar turned into fills at that bar's close with the cost model."""
    trades = signals.select(
        F.col("model_id").alias("portfolio"), F.col("asset_id").alias("symbol"), "ts",
        F.when(F.col("direction") == "long", "buy").otherwise("sell").alias("side"),
        (F.col("position_size") * capital / F.col("close")).alias("quantity"),
        F.sha2(F.concat_ws("|", "model_id", "asset_id", F.col("ts").cast("string"), "trigger"), 256).alias("order_id"),
    ).join(bars.select("symbol", "ts", "close", "volume"), ["symbol", "ts"])
    filled = model_fills(trades.withColumn("portfolio_value", F.lit(capital)), model)
    return filled.select(
        "portfolio", "symbol", "ts", "side", "order_id", F.lit(0).alias("fill_no"),
        F.col("fill_quantity").alias("quantity"), F.col("fill_price").alias("price"), "commission",
    )


def evaluate_strategies(signals: DataFrame, bars: DataFrame, capital: float = CAPITAL, step: str = "1 day") -> DataFrame:
    """Performance of every strategy: fills, equity curve, metrics; all strategies and symbols in parallel."""
    fills = strategy_fills(signals, bars, capital)
    curve = equity_curve(fills, bars.select("symbol", "ts", "close"), step=step, capital=capital)
    return performance_metrics(equity_path(curve, capital=capital))


def timeline(bars: DataFrame, news: DataFrame, detections: DataFrame) -> DataFrame:
    """Bars, news and detections (one second after their news) in one table by time."""
    empty = F.lit(None)
    b = bars.select("ts", F.lit("market_data").alias("kind"), "symbol", F.struct("close", "volume").alias("bar"),
                    empty.cast("string").alias("title"), empty.cast("struct<event_type:string,impact_score:double>").alias("event"))
    n = news.select("ts", F.lit("news").alias("kind"), "symbol", empty.cast("struct<close:double,volume:double>").alias("bar"), "title",
                    empty.cast("struct<event_type:string,impact_score:double>").alias("event"))
    d = detections.select((F.col("ts") + F.expr("interval 1 second")).alias("ts"), F.lit("event").alias("kind"), "symbol",
                          empty.cast("struct<close:double,volume:double>").alias("bar"), empty.cast("string").alias("title"),
                          F.struct("event_type", "impact_score").alias("event"))
    return b.unionByName(n).unionByName(d)


