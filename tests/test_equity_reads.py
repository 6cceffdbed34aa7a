"""An equity curve reads its fills once; a fold hands on what is read."""

import datetime
import random

from pyspark.sql import functions as F
from watched import watched

from marketframe.operators import performance as P
from marketframe.operators.folds import fold_sorted

DAY = datetime.datetime(2024, 1, 1)
FILLS = "portfolio string, symbol string, ts timestamp_ntz, side string, quantity double, price double, commission double, order_id long, fill_no int, accepted boolean"


def some_fills(n=80):
    rng = random.Random(3)
    at = lambda: DAY + datetime.timedelta(hours=rng.randint(0, 4000)) if rng.random() < 0.95 else None
    return [(rng.choice("ab"), rng.choice(["x", "y", None]), at(), rng.choice(["buy", "sell"]), float(rng.randint(1, 9)), float(rng.randint(5, 50)), 1.0, i, 0, rng.choice([True, True, False, None])) for i in range(n)]


def test_equity_reads_fills_once(spark):
    fills, calls = watched(spark, some_fills(), FILLS, "quantity")
    got = sorted(map(tuple, P.equity_curve(fills, capital=1000.0).collect()), key=str)
    assert calls.value == 80
    plain = spark.createDataFrame(some_fills(), FILLS)
    want = P.equity_curve(plain, plain.select("symbol", "ts", "order_id", "fill_no", F.col("price").alias("close")), capital=1000.0)
    assert got == sorted(map(tuple, want.collect()), key=str) and got


def test_fold_passes_what_is_read(spark):
    frame = spark.createDataFrame([("a", 1, 2.0, "p"), ("a", 2, 3.0, None), ("b", 1, None, "q")], "k string, n int, v double, other string")

    def step(state, row):
        assert set(row) == {"v"}
        state["s"] += 0.0 if row["v"] != row["v"] else row["v"]
        return {"s": state["s"]}

    rows = fold_sorted(frame, ["k"], ["n"], lambda: {"s": 0.0}, step, "s double", ("v",)).collect()
    assert sorted((r.k, r.n, r.other, r.s) for r in rows if r.other) == [("a", 1, "p", 2.0), ("b", 1, "q", 0.0)]
    assert [r.s for r in rows if r.n == 2] == [5.0]
