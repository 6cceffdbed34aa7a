"""Disk and memory that the removal of repeats holds on to."""

import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from marketframe.llm import suffix_dedup
from marketframe.llm.common import shared_folder, stored


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}


def tables(spark):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()}


def gone(spark, before):
    for _ in range(100):
        if shuffles(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_stored_tables_leave_no_shuffle(spark):
    before = shuffles(spark)
    table = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert gone(spark, before)
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_removals_keep_their_result_only(spark):
    old = tables(spark)
    passage = "".join(chr(97 + n * n % 26) for n in range(240)) + "end"
    rows = [(n, f"{n} {passage} {n}") for n in range(20)] + [(30, "same " * 60), (31, "same " * 60), (32, "short")]
    got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), often=8)
    assert [name.split("-")[0] for name in tables(spark) - old] == ["repeats"]
    assert got.count() == 21 and got.where("copies = 2").count() == 1


def test_a_bucket_of_strings_is_sorted_in_ranges():
    rng = np.random.default_rng(5)
    pool = rng.integers(97, 100, (60_000, 200)).astype(np.uint8)
    pool[:, 8:60] = 97
    parts, known, want = [], [], {}
    for _ in range(6):
        some = np.unique(pool[rng.integers(0, len(pool), 20_000)], axis=0)
        flags = rng.random(len(some)) < 0.1
        parts.append(some)
        known.append(flags)
        for row, flag in zip(some, flags):
            want[row.tobytes()] = want.get(row.tobytes(), 0) + 1 + flag
    asked = pa.table(
        {
            "slice": pa.array(range(6), pa.int64()), "bucket": pa.array([0] * 6, pa.int32()),
            "strings": [zstandard.compress(p.tobytes()) for p in parts], "known": [np.packbits(k).tobytes() for k in known],
        }
    )
    raw = sum(p.nbytes for p in parts)
    tracemalloc.start()
    got = suffix_dedup._answer(200)(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for part, flags in zip(parts, got.column("twice")):
        twice = np.unpackbits(np.frombuffer(flags.as_py(), np.uint8), count=len(part))
        assert twice.tolist() == [want[row.tobytes()] > 1 for row in part]
    assert peak < 2.5 * raw
