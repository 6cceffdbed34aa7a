"""Tasks hold one piece or some chunks, whatever the session makes of its shuffles."""

from pyspark.sql import functions as F

from marketframe.operators import timeline
from marketframe.operators.ordered import row_chunks


def test_a_task_holds_one_piece(spark, monkeypatch):
    monkeypatch.setattr(timeline, "PIECE_ROWS", 300)
    table = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("_us"))
    stored = timeline.by_rows(table, ["k"])
    assert max(r["count"] for r in stored.groupBy("_piece").count().collect()) <= 600
    held = timeline._spread(stored, stored).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("_piece").alias("n")).collect()
    assert len(held) == stored.select("_piece").distinct().count() and {r.n for r in held} == {1}


def test_row_chunks_keep_their_tasks(spark):
    table = spark.range(5000).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").alias("v"))
    c = row_chunks(table, halo=2, chunk_rows=1024, tasks=9)
    out = c.with_columns({"w": F.sum("v").over(c.last_rows(3))}).own()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "_chunk" in plan
    assert {(r.v, r.w) for r in out.collect()} == {(i, sum(range(max(0, i - 2), i + 1))) for i in range(5000)}
