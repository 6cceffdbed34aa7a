"""The combined feature matrix: technical, event, sentiment and market-context features of all symbols in one table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators import context as C
from marketframe.operators.event_features import event_features
from marketframe.operators.lineage import cut
from marketframe.operators.sentiment_features import sentiment_features

KEYS = ["symbol", "ts"]
PARTS = ("technical", "events", "sentiment", "context")


def context_features(
    bars: DataFrame, refs: DataFrame, index: str = "SPY", volatility: str = "VIX", sectors: Sequence[str] = (),
    macro: dict[str, str] | None = None, indexes: dict[str, str] | None = None, crypto: tuple[str, str] | None = None,
) -> DataFrame:
    """Bars with regime, sector, macro, volatility, crypto, correlation and calendar features of the reference series."""
    out = C.market_regime(bars, refs, index)
    if sectors:
        out = C.sector_performance(out, refs, sectors)
    if macro:
        out = C.macro_indicators(out, refs, macro)
    out = C.volatility_regime(out, refs, volatility)
    if crypto:
        out = C.crypto_market(out, refs, *crypto)
    if indexes:
        out = C.index_correlation(out, refs, indexes)
    return C.calendar_context(out)


def feature_matrix(
    bars: DataFrame,
    events: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    refs: DataFrame | None = None,
    parts: Sequence[str] = PARTS,
    families: Sequence[str] | None = None,
    **context,
) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume; unique per symbol and ts) with the features of the chosen parts.

    ``events`` are detections, ``sentiment`` scored news, ``refs`` reference series (name, ts, close); ``context`` goes to
    :func:`context_features`. A part whose table is missing is left out; one whose table is empty has its columns all the
    same, so the schema depends on the arguments alone. Every part is worked out on the narrow bars and stored, then the
    parts are joined by symbol and time. A feature that two parts have counts as the later part has it.
    """
    unknown = set(parts) - set(PARTS)
    if unknown:
        raise ValueError(f"no part named {', '.join(sorted(unknown))}")
    narrow = cut(bars.select(*KEYS, "close"))
    makers: dict[str, Callable[[], DataFrame] | None] = {
        "technical": lambda: B.bar_features(bars, **({"families": families} if families else {})),
        "events": None if events is None else lambda: event_features(narrow.select(*KEYS), events),
        "sentiment": None if sentiment is None else lambda: sentiment_features(narrow.select(*KEYS), sentiment),
        "context": None if refs is None else lambda: context_features(narrow, refs, **context).drop("close"),
    }
    out = bars
    for part in PARTS:
        if part in parts and makers[part] is not None:
            made = cut(makers[part]())
            new = [c for c in made.columns if c not in bars.columns]
            out = out.drop(*[c for c in new if c in out.columns]).join(made.select(*KEYS, *[F.col(f"`{c}`") for c in new]), KEYS, "left")
    return out


def matrix_metadata(matrix: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol: rows, first and last time, number of features, and missing values in them."""
    features = [c for c in matrix.columns if c not in bars.columns]
    missing = sum((F.col(f"`{c}`").isNull().cast("long") for c in features), F.lit(0).cast("long"))
    return matrix.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.lit(len(features)).cast("long").alias("n_features"), F.sum(missing).alias("n_missing"),
    )
