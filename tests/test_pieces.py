"""Pieces of a timeline keep their size when a table grows; what they give stays the same."""

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketframe.operators import timeline


def test_pieces_grow_in_number_only(spark, monkeypatch):
    names = ("w22_event_impacts", "w33_p14_news_volume", "j04_asof_previous_event")
    rows = lambda: {n: sorted(map(str, entry.queries()[n](spark, SMALL).collect())) for n in names}
    want = rows()
    monkeypatch.setattr(timeline, "PIECE_ROWS", 300)
    table = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("_us"))
    sizes = [r["count"] for r in timeline.by_rows(table, ["k"]).groupBy("_piece").count().collect()]
    assert max(sizes) <= 600 and sum(sizes) == 3000
    assert rows() == want
