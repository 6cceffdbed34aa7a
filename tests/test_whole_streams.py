"""Streams take every row of their tables."""

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketframe.sources import derived


def test_events_near_all_bars(spark):
    events = [tuple(r) for r in derived.read(spark, SMALL, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")), "event_id").collect()]
    want = {}
    by_type = {}
    for kind, at, event in events:
        by_type.setdefault(kind, []).append((at, event))
    for kind, rows in by_type.items():
        near = [event for at, _ in rows for other, event in rows if abs(other - at) < 3_600_000_000]
        want[kind] = (len(near), sum(near))
    got = {r.symbol: (r.n, r.ids) for r in entry.queries()["st6_stream_events_near_bars"](spark, SMALL).collect()}
    assert got == want


def test_stream_of_a_table_in_parts(spark, tmp_path):
    derived.read(spark, SMALL, "documents").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda folder: {tuple(r) for r in entry.queries()["st2_stream_news_events"](spark, str(folder)).collect()}
    assert rows(tmp_path) == rows(SMALL) != set()
