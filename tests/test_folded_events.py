"""Events that count for the same bars are summed before the windows are worked out."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketframe.functions.numeric import whole
from marketframe.operators import timeline
from marketframe.operators.timeline import RangeTimeline

START = datetime(2024, 1, 1)
DAYS = (1, 3, 7)


def tables(spark, number):
    rng = random.Random(4)
    at = lambda: START + timedelta(seconds=rng.randrange(20 * 86_400))
    bars = [(k, START + timedelta(days=d, hours=6 * d % 24)) for k in ("a", "b", None) for d in range(2, 18, 3)] + [("a", START + timedelta(days=4)), ("c", START), ("a", None)]
    events = [(rng.choice(["a", "b", "d", None]), at(), n, rng.choice([None, rng.uniform(-1, 1)])) for n in range(number)]
    # on the limits of windows and days, several at once
    events += [(k, t + timedelta(days=-d, microseconds=m), 10_000 + 100 * n + 10 * d + m, 0.5) for n, (k, t) in enumerate(bars) if t for d in (0, *DAYS) for m in (-1, 0, 1)]
    events += [("a", None, 9_000, 0.1), ("a", START + timedelta(days=5), 9_001, None), ("a", START + timedelta(days=5), 9_002, 2.0)]
    return spark.createDataFrame(bars, "symbol string, ts timestamp_ntz"), spark.createDataFrame(events, "symbol string, ts timestamp_ntz, id long, v double")


def features(bars, events, fold, pieces=None):
    line = RangeTimeline(bars, events, ["symbol"], ["v"], ["v"], ["id"], pieces, fold=fold)
    cols = {"prev": line.previous(), "next": line.next(), "today": line.day_total(whole(F.col("v"))), "then": line.day_total(whole(F.col("v")), 3)}
    for d in DAYS:
        cols |= {f"n{d}": line.total(F.when(F.col("v") > 0, 1), d), f"s{d}": line.total(whole(F.col("v")), d), f"lo{d}": line.lowest("v", d), f"hi{d}": line.highest("v", d)}
    return line.bars(cols)


@pytest.mark.parametrize("pieces", [None, 5])
def test_folded_events_give_the_same_windows(spark, pieces):
    bars, events = tables(spark, 600)
    whole_, folded = features(bars, events, False), features(bars, events, True, pieces)
    assert folded.schema == whole_.schema
    assert sorted(map(str, folded.collect())) == sorted(map(str, whole_.collect()))
    assert whole_.where("s3 <> 0 and n1 > 0 and hi1 > 0 and then <> 0").count() > 5


def test_the_sweep_grows_with_the_bars(spark, monkeypatch):
    """Of many events only their sums between the limits of windows go on, and only they are counted for every window."""
    counts = []
    inner = timeline.by_rows
    monkeypatch.setattr(timeline, "by_rows", lambda df, *args: counts.append(df.count()) or inner(df, *args))
    bars, events = tables(spark, 4000)
    features(bars, events, None).collect()
    limits = bars.count() * (2 + len(DAYS) + 2)
    assert counts[0] <= events.count() + limits
    assert sum(counts[1:]) < 10 * limits < events.count()
