"""Equity curves against walking through the fills period by period."""

import datetime
import random

import pytest

from marketframe.operators import performance as P

START = datetime.datetime(2023, 11, 7, 10)


def ends(first, last, step):
    """Ends of the periods from the one that holds ``first`` to the one that holds ``last``."""
    number, unit = int(step.split()[0]), step.split()[1]
    day = first.replace(hour=0, minute=0, second=0, microsecond=0)
    start = {"day": day, "week": day - datetime.timedelta(days=day.weekday()), "month": day.replace(day=1), "quarter": day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)}[unit]
    out = []
    while not out or out[-1] < last:
        if unit in ("day", "week"):
            start = start + datetime.timedelta(days=number * {"day": 1, "week": 7}[unit])
        else:
            months = start.year * 12 + start.month - 1 + number * {"month": 1, "quarter": 3}[unit]
            start = start.replace(year=months // 12, month=months % 12 + 1)
        out.append(start - datetime.timedelta(microseconds=1))
    return out


def walked(fills, prices, step, capital):
    out = {}
    all_ends = ends(min(f["ts"] for f in fills), max(f["ts"] for f in fills), step)
    for portfolio in {f["portfolio"] for f in fills}:
        own = [f for f in fills if f["portfolio"] == portfolio]
        for end in all_ends:
            upto = [f for f in own if f["ts"] <= end]
            if not upto:
                continue
            cash, held = capital, {}
            for f in upto:
                sign = -1 if f["side"] == "sell" else 1
                cash -= sign * f["quantity"] * f["price"] + f["commission"]
                held[f["symbol"]] = held.get(f["symbol"], 0) + sign * f["quantity"]
            value = 0.0
            for symbol, quantity in held.items():
                known = [p for p in prices if p[0] == symbol and p[1] <= end]
                value += quantity * (max(known, key=lambda p: p[1])[2] if known else 0.0)
            out[portfolio, end] = (value, cash)
    return out


@pytest.mark.parametrize("step", ["1 day", "2 week", "1 month", "2 month", "1 quarter"])
def test_curve(spark, step):
    rng = random.Random(step)
    at = lambda days: START + datetime.timedelta(days=rng.random() * days)
    fills = [dict(portfolio=rng.choice("ab"), symbol=rng.choice(["x", "y", "z"]), ts=at(200), side=rng.choice(["buy", "sell"]), quantity=float(rng.randint(1, 9)),
                  price=float(rng.randint(5, 50)), commission=1.0, order_id=n, fill_no=0, accepted=rng.random() < 0.9) for n in range(60)]
    fills += [dict(fills[0], portfolio="c", ts=START + datetime.timedelta(days=150), accepted=True)]
    prices = [(rng.choice(["x", "y", "z"]), START + datetime.timedelta(days=rng.random() * 300 - 40), float(rng.randint(5, 60))) for _ in range(40)]
    schema = "portfolio string, symbol string, ts timestamp_ntz, side string, quantity double, price double, commission double, order_id long, fill_no int, accepted boolean"
    frame = spark.createDataFrame([tuple(f.values()) for f in fills], schema)
    got = P.equity_curve(frame, spark.createDataFrame(prices, "symbol string, ts timestamp_ntz, close double"), step=step, capital=1000.0)
    want = walked([f for f in fills if f["accepted"]], prices, step, 1000.0)
    rows = {(r.portfolio, r.ts): (r.holdings, r.cash, r.total_value) for r in got.collect()}
    assert set(rows) == set(want)
    for key, (value, cash) in want.items():
        assert rows[key] == pytest.approx((value, cash, value + cash))


def test_no_fills(spark):
    schema = "portfolio string, symbol string, ts timestamp_ntz, side string, quantity double, price double, commission double, order_id long, fill_no int"
    assert P.equity_curve(spark.createDataFrame([], schema), spark.createDataFrame([], "symbol string, ts timestamp_ntz, close double")).count() == 0
