"""Articles are spread over tasks and their events computed once per stored batch."""

from conftest import SMALL
from pyspark.sql import functions as F

from marketframe.functions import text as X
from marketframe.operators import event_store as S
from marketframe.sources import derived


def test_one_file_becomes_many_tasks(spark):
    news = derived.news(spark, SMALL)
    parts = derived.spread(news).withColumn("part", F.spark_partition_id())
    plan = parts._jdf.queryExecution().toString()
    assert "Repartition" in plan
    assert parts.drop("part").exceptAll(news).count() == 0 and parts.count() == news.count()


def test_events_are_computed_once_per_batch(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    news = derived.news(spark, SMALL).limit(40).coalesce(1)
    events = S.news_to_events(news)
    n = events.count()
    S.write_events(events.withColumn("title", counted("title")), str(tmp_path), 0)
    assert seen.value == n > 0


def test_spans_of_many_matches(spark):
    import re

    text = "AAPL, MSFT and $AAPL " * 50
    want = [(m.group(), m.start(), m.end()) for m in re.finditer(X.SPAN_PATTERNS[0], text)]
    rows = spark.createDataFrame([(text,), ("nothing",), (None,)], "t string").select(X.spans(F.col("t"), X.SPAN_PATTERNS[0], 0).alias("s")).collect()
    assert [(s.match, s.start, s.end) for s in rows[0].s] == want and len(want) == 150
    assert rows[1].s == [] and rows[2].s is None
