"""Pre-trade checks against plain Python; they read the requests twice."""

import datetime
import itertools
import random

from watched import watched

from marketframe.operators import orders as O

DAY = datetime.datetime(2024, 1, 1)
REQUESTS = """portfolio string, order_id string, symbol string, side string, order_type string, quantity double, limit_price double, target_price double,
 position_size double, portfolio_value double, created_at timestamp_ntz, status string"""


def test_pretrade_checks_read_requests_twice(spark):
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    rows = [(pick("a", "b", None), pick(*"123456789", None), pick(*"xyzuvw", None), pick("buy", "sell"), pick("market", "limit"), pick(0.001, 5.0, 900.0), pick(None, 20.0), pick(100.0, 20000.0),
             pick(1.0, 40.0), 100.0, DAY + datetime.timedelta(days=rng.randint(0, 9)), pick("submitted", "filled", None)) for _ in range(60)]
    positions = [("a", "x", 3.0), ("a", "x", 1.0), ("b", "y", None), (None, "x", 9.0), ("z", "z", 1.0)]
    accounts = [("a", 50.0), ("b", None), ("a", 1e9), (None, 0.0)]
    limits = {"max_open_orders": 8, "max_symbols": 3}
    requests, calls = watched(spark, rows, REQUESTS, "portfolio")
    out = O.pretrade_checks(requests, spark.createDataFrame(positions, "portfolio string, symbol string, position double"), spark.createDataFrame(accounts, "portfolio string, buying_power double"), limits)
    got = sorted((str(tuple(r[c] for c in requests.columns)), tuple(r.failed_rules), r.accepted) for r in out.collect())
    assert calls.value <= 2 * len(rows)
    lim, want = {**O.LIMITS, **limits}, []
    active = [r for r in rows if r[11] in O.ACTIVE and r[0] is not None]
    for r in rows:
        own = [a for a in active if a[0] == r[0]]
        value = r[5] * (100.0 if r[6] is None else r[6])
        powers = [a[1] for a in accounts if r[0] and a[0] == r[0]] or [None]
        held = [p[2] for p in positions if r[0] and r[2] and p[:2] == (r[0], r[2])] or [None]
        for position, power in itertools.product(held, powers):
            rules = {
                "position_value": abs(position or 0.0) * r[7] > lim["max_position_size"], "concentration": r[8] / r[9] > lim["concentration_limit"],
                "order_too_small": value < lim["min_order_size"], "order_too_large": value > lim["max_order_size"], "open_orders": len(own) >= lim["max_open_orders"],
                "max_symbols": len({a[2] for a in own}) >= lim["max_symbols"] and not (r[2] and any(a[2] == r[2] for a in own)),
                "buying_power": r[3] == "buy" and power is not None and value > power,
                "duplicate_order": r[0] is not None and r[1] is not None and sum(1 for x in rows if x[:2] == r[:2]) > 1,
                "weekend_market_order": r[4] == "market" and r[10].weekday() >= 5,
            }
            failed = tuple(n for n, broken in rules.items() if broken)
            want.append((str(r), failed, not failed))
    assert got == sorted(want)
