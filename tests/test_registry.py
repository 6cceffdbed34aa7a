"""Registered queries against their SQL on the small tables (a fast subset; compare.py runs all)."""

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as entry

FAST = ["s05_resample_1d", "w01_w03_price_features", "w11_running_volume_totals", "f01_f02_sentiment_scores", "f07_t05_article_classification",
        "w21_j03_event_counts", "a24_order_fills", "r1_pretrade_checks", "f22_f27_prediction_signals", "m12_m13_allocation", "a31_latency_percentiles",
        "l1_binary_targets", "l14_l15_combine_weighted"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    res = connect(SMALL).execute(entry.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) == ""
