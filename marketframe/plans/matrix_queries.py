"""The combined feature matrix against the statements of its parts, joined."""

from __future__ import annotations

from marketframe.operators.feature_matrix import feature_matrix, matrix_metadata
from marketframe.plans import bar_queries, context_queries, feature_queries
from marketframe.plans.sqlkit import BARS, rounded, with_sql
from marketframe.sources import derived, sinks

QUERIES: dict = {}
SQL: dict = {}


def _matrix(spark, folder):
    return feature_matrix(
        derived.bars(spark, folder), derived.detections(spark, folder), feature_queries._sentiment(spark, folder), context_queries._refs(spark, folder),
        index="view", volatility="error",
    )


def q_matrix(spark, folder):
    """Columns of every part of the whole matrix of all symbols."""
    wanted = [*bar_queries.PRICE_COLS, *feature_queries._cnt, *feature_queries._imp, *feature_queries._roll, "market_regime", "market_trend_20d", "market_trend_50d", "market_above_ma200"]
    return rounded(_matrix(spark, folder).select("symbol", "ts", *wanted), 6, **dict.fromkeys(feature_queries._roll, 5))


def _columns(names):
    return ", ".join(f'"{c}"' for c in names)


_SQL = f"""select symbol, ts, {_columns(bar_queries.PRICE_COLS)}, {_columns(feature_queries._cnt)}, {_columns(feature_queries._imp)}, {_columns(feature_queries._roll)}, market_regime, market_trend_20d, market_trend_50d, market_above_ma200
from ({bar_queries.SQL['w01_w03_price_features']}) join ({feature_queries.SQL['w21_j03_event_counts']}) using (symbol, ts) join ({feature_queries.SQL['w22_event_impacts']}) using (symbol, ts)
join ({feature_queries.SQL['w29_rolling_sentiment']}) using (symbol, ts) join ({context_queries.SQL['w35_j09_market_regime']}) using (symbol, ts)"""
QUERIES["l07_feature_matrix"] = q_matrix
SQL["l07_feature_matrix"] = _SQL


def q_cached(spark, folder):
    """The technical part through the feature cache: its metadata per symbol after reading it back."""
    from marketframe.plans.file_queries import _folder

    bars = derived.bars(spark, folder)
    matrix = feature_matrix(bars, parts=("technical",), families=("price", "momentum"))
    path = _folder(spark, "matrix")
    sinks.write_features(matrix, path)
    meta = matrix_metadata(sinks.read_features(spark, path).select(matrix.columns), bars)
    return meta.select("symbol", "n_rows", "first_ts", "last_ts")


QUERIES["s15_cached_matrix"] = q_cached
SQL["s15_cached_matrix"] = with_sql([BARS], "select symbol, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from bars group by 1")
