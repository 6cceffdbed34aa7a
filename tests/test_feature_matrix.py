"""The combined matrix has one row per bar and one schema, whatever its tables hold."""

import pytest
from conftest import SMALL

from marketframe.operators.feature_matrix import PARTS, feature_matrix, matrix_metadata
from marketframe.plans.context_queries import _refs
from marketframe.plans.feature_queries import _sentiment
from marketframe.sources import derived


def test_schema_does_not_depend_on_rows(spark):
    bars = derived.bars(spark, SMALL).filter("ts < '2024-01-08'")
    events, news, refs = derived.detections(spark, SMALL), _sentiment(spark, SMALL), _refs(spark, SMALL)
    kwargs = {"families": ("price", "momentum"), "index": "view", "volatility": "error"}
    full = feature_matrix(bars, events, news, refs, **kwargs)
    empty = feature_matrix(bars, events.limit(0), news.limit(0), refs.limit(0), **kwargs)
    assert full.columns == empty.columns and len(set(full.columns)) == len(full.columns)
    n = bars.count()
    assert full.count() == full.select("symbol", "ts").distinct().count() == n == empty.count()
    meta = matrix_metadata(full, bars).collect()
    assert sum(r.n_rows for r in meta) == n and {r.n_features for r in meta} == {len(full.columns) - len(bars.columns)}
    assert empty.filter("event_count_7d <> 0 or news_count_7d <> 0").count() == 0


def test_parts(spark):
    bars = derived.bars(spark, SMALL).filter("ts < '2024-01-04'")
    only = feature_matrix(bars, derived.detections(spark, SMALL), parts=("events",))
    assert "event_count_7d" in only.columns and "log_return" not in only.columns
    assert feature_matrix(bars, parts=PARTS[1:]).columns == bars.columns
    with pytest.raises(ValueError):
        feature_matrix(bars, parts=("weather",))
