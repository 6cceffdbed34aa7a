"""Fills are the same whatever orders share a bucket, over several batches and with missing ids."""

import os
import shutil
from datetime import datetime, timedelta

from marketframe.streaming import pipelines as T

SCHEMA = "order_id long, ts timestamp_ntz, seq long, status string, filled_qty double, filled_avg_price double"
START = datetime(2024, 1, 1)


def test_fills_by_bucket(spark, tmp_path):
    big = 1 << 60
    batches = []
    for n in range(3):
        rows = [((big + i) if i else None, START + timedelta(minutes=60 * n + (i * 7) % 50), i * k, "filled", float((i * 13 + k * 5 + n * 9) % 17), 1.0) for i in range(12) for k in range(4)]
        batches.append(rows)
    want, best, first = set(), {}, {}
    for rows in batches:
        for i, ts, seq, _, qty, _ in sorted(rows, key=lambda r: (r[1], r[2])):
            first.setdefault(i, ts)
            if qty > best.get(i, 0.0):
                want.add((i, ts, seq, qty - best.get(i, 0.0), int((ts - first[i]).total_seconds() * 1000)))
                best[i] = qty
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        shutil.copy(next((tmp_path / f"b{n}").glob("part-*.parquet")), folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    for buckets in (1, 5):
        out = tmp_path / f"out{buckets}"
        stream = T.landed(spark, str(folder), SCHEMA, files_per_trigger=1)
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")  # noqa: B023, E731
        T.run_available(T.order_fills(stream, idle_minutes=100_000, buckets=buckets), write, str(tmp_path / f"check{buckets}")).awaitTermination(120)
        got = spark.read.parquet(str(out)).selectExpr("order_id", "cast(ts as timestamp_ntz) ts", "seq", "fill_quantity", "latency_ms")
        assert {tuple(r) for r in got.collect()} == want
