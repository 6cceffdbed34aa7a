"""Sums over near pairs against all pairs, in batches that come late and with missing values."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketframe.streaming import pipelines as T

START = datetime(2024, 1, 1, 10)


def rows(rng, number):
    at = lambda: START + timedelta(microseconds=rng.randrange(6 * 3_600_000_000))
    out = [(rng.choice(["a", "b", None]), at(), rng.choice([None, rng.randrange(-(1 << 50), 1 << 50)])) for _ in range(number)]
    out += [("a", START + timedelta(hours=h), h) for h in range(4)] * 2 + [("a", None, 5), ("c", START, None)]
    return out


def run(spark, folder, totals, late):
    schema = "symbol string, ts timestamp_ntz, id long"
    bars = T.landed(spark, f"{folder}/b", schema, files_per_trigger=1).select("symbol", "ts")
    events = T.landed(spark, f"{folder}/e", schema, files_per_trigger=1)
    out = f"{folder}/out{time.time()}"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    T.run_available(T.events_near_bars(bars, events, late, **totals), write, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(out)


def test_sums_are_those_of_the_pairs(spark, tmp_path):
    rng = random.Random(2)
    schema = "symbol string, ts timestamp_ntz, id long"
    want = {}
    given = {side: [rows(rng, 60) for _ in range(3)] for side in "be"}
    for side, batches in given.items():
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{side}")
    for symbol, at, _ in (r for batch in given["b"] for r in batch):
        for other, then, value in (r for batch in given["e"] for r in batch):
            if symbol and symbol == other and at and then and abs(at - then) < timedelta(hours=1):
                n, ids = want.get(symbol, (0, None))
                want[symbol] = n + 1, ids if value is None else (ids or 0) + value
    got = run(spark, tmp_path, {"totals": ["id"]}, "1 day").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("id").alias("ids"))
    assert {r.symbol: (r.n, r.ids) for r in got.collect()} == want
    pairs = run(spark, tmp_path, {}, "1 day").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    assert {r.symbol: (r.n, r.ids) for r in pairs.collect()} == want


def test_work_grows_with_the_rows(spark):
    """Sixty thousand rows of one symbol and hour are three thousand million pairs."""
    near = T._Near(["v"])
    import numpy as np

    times = np.arange(60_000, dtype=np.int64) * 60_000
    events = np.stack([times, np.ones_like(times), np.ones_like(times)])
    begin = time.time()
    assert near._meet(times, events) == [60_000 * 60_000] * 3
    assert time.time() - begin < 5
