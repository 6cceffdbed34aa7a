"""Files of the feeds keep what was written, and news before a time is found over all slots."""

import datetime

from pyspark.sql import functions as F

from marketframe.sources import feeds


def test_news_files_keep_quotes_breaks_and_blanks(spark, tmp_path):
    when = datetime.datetime(2024, 1, 5)
    texts = ['say "hi", then\ngo', "  outer  ", "a,b;c", "back\\slash\\", "é 日本", 'ends with "']
    rows = [(n, when, t.replace("\n", " "), t, "s", None if n % 2 else "sym") for n, t in enumerate(texts)]
    news = spark.createDataFrame(rows, "doc_id long, ts timestamp, title string, content string, source string, symbol string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for fmt in ("csv", "json"):
        feeds.write_news_files(news, str(tmp_path / fmt), fmt)
        got = feeds.read_news_files(spark, str(tmp_path / fmt), fmt)
        assert sorted((r.doc_id, r.title, r.content, r.symbol) for r in got.collect()) == [(r[0], r[2], r[3], r[5]) for r in rows]
        assert feeds.read_news_files(spark, str(tmp_path / fmt), fmt, start="2024-01-06").count() == 0


def test_trailing_news_at_the_ends_of_slots(spark):
    def at(hours):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)

    times = spark.createDataFrame([(at(h),) for h in (0, 6, 6, 11.5, 12, 30)] + [(None,)], "ts timestamp")
    news = spark.createDataFrame([(n, at(h)) for n, h in enumerate((-6.001, -6, 0, 0.5, 5.5, 6, 11.5, 12, 24, 23.9))] + [(99, None)], "doc_id long, ts timestamp")
    got = {(r["at"].hour + r["at"].minute / 60 + 24 * (r["at"].day - 1), r.doc_id) for r in feeds.trailing_news(times, news, 6).collect()}
    assert got == {(0, 1), (0, 2), (6, 2), (6, 3), (6, 4), (6, 5), (11.5, 4), (11.5, 5), (11.5, 6), (12, 5), (12, 6), (12, 7), (30, 8)}
