"""Forward-looking targets. Rows ahead come from the chunk overlap, not from whole-symbol windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import MICROS_PER_HOUR, clamp, flag, ratio, us, zero
from marketframe.operators.ordered import CHUNK_ROWS, Chunks, rolling, row_chunks
from marketframe.operators.ranking import exact_quantiles
from marketframe.operators.timeline import asof_join

HORIZONS = (3, 5, 10)
CLASSES = ("strong_down", "down", "neutral", "up", "strong_up")
CUTS = (-0.02, -0.01, 0.01, 0.02)


def target_chunks(bars: DataFrame, ahead: int = 16, chunk_rows: int = CHUNK_ROWS) -> Chunks:
    return row_chunks(bars, halo=32, ahead=ahead, chunk_rows=chunk_rows)


def forward_return(c: Chunks, n: int) -> Column:
    """close[t+n] / close[t] - 1."""
    return ratio(F.lead("close", n).over(c.order) - F.col("close"), "close")


def binary_targets(c: Chunks, n: int = 1, threshold: float = 0.01, more: Sequence[float] = (0.005, 0.02, 0.05)) -> Chunks:
    """Flags of the forward return above thresholds; a missing future is 0."""
    c = c.with_columns({"_f": forward_return(c, n)})
    f = F.col("_f")
    cols = {"target_binary_return": flag(f > threshold)}
    for t in more:
        cols[f"target_binary_return_{int(t * 1000):03d}bp"] = flag(f > t)
    cols["target_binary_strong"] = F.when(f > threshold, 1).when(f < -threshold, -1).otherwise(0)
    return c.with_columns(cols)


def regression_targets(c: Chunks, n: int = 1, horizons: Sequence[int] = HORIZONS, clip: float | None = 0.1) -> Chunks:
    limit = lambda x: clamp(x, -clip, clip) if clip is not None else x
    c = c.with_columns({"target_return": limit(forward_return(c, n))})
    return c.with_columns(
        {"target_log_return": F.log1p("target_return"), **{f"target_return_{h}p": limit(forward_return(c, h)) for h in horizons}}
    )


def volatility_targets(c: Chunks, n: int = 1, window: int = 5) -> Chunks:
    prev = F.lag("close").over(c.order)
    c = c.with_columns({"_r": ratio(F.col("close") - prev, prev), "_i": ratio(F.col("high") - F.col("low"), "close")})
    c = c.with_columns({"_rv": rolling(c, F.col("_r"), window, F.stddev_samp), "_iv": rolling(c, F.col("_i"), window)})
    c = c.with_columns(
        {"target_volatility": F.lead("_rv", n).over(c.order), "target_intraday_volatility": F.lead("_iv", n).over(c.order)}
    )
    return c.with_columns({"target_volatility_annualized": F.col("target_volatility") * (252.0**0.5)})


def with_high_volatility(df: DataFrame, keys: Sequence[str] = ("symbol",), q: float = 0.7) -> DataFrame:
    """Flag of target_volatility above its own series' quantile."""
    cut = exact_quantiles(df, keys, "target_volatility", {"_cut": q})
    out = df.join(cut, list(keys), "left")
    return out.withColumn("target_high_volatility", flag(F.col("target_volatility") > F.col("_cut"))).drop("_cut")


def breakout_targets(c: Chunks, n: int = 1, window: int = 20, threshold: float = 0.02, strong: float = 0.05) -> Chunks:
    top, bottom = rolling(c, F.col("high"), window, F.max), rolling(c, F.col("low"), window, F.min)
    c = c.with_columns({"_top": top, "_bottom": bottom})
    high, low = F.lead("high", n).over(c.order), F.lead("low", n).over(c.order)
    up = lambda t: F.coalesce(high > F.col("_top") * (1 + t), F.lit(False))
    down = lambda t: F.coalesce(low < F.col("_bottom") * (1 - t), F.lit(False))
    return c.with_columns(
        {
            "target_upward_breakout": flag(up(threshold)),
            "target_downward_breakout": flag(down(threshold)),
            "target_any_breakout": flag(up(threshold) | down(threshold)),
            "target_strong_breakout": flag(up(strong) | down(strong)),
        }
    )


def multiclass_targets(c: Chunks, n: int = 1) -> Chunks:
    """Five right-closed return classes, their code (-1 when missing) and one-hot columns."""
    c = c.with_columns({"_f5": forward_return(c, n)})
    f = F.col("_f5")
    label, code = F.when(f.isNull(), F.lit(None).cast("string")), F.when(f.isNull(), -1)
    for i, cut in enumerate(CUTS):
        label, code = label.when(f <= cut, CLASSES[i]), code.when(f <= cut, i)
    c = c.with_columns({"target_return_class": label.otherwise(CLASSES[-1]), "target_return_class_numeric": code.otherwise(4)})
    return c.with_columns({f"target_class_{k}": flag(F.col("target_return_class") == k) for k in CLASSES})


def all_targets(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    c = target_chunks(bars, chunk_rows=chunk_rows)
    for family in (binary_targets, regression_targets, volatility_targets, breakout_targets, multiclass_targets):
        c = family(c)
    out = with_high_volatility(c.own())
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def event_targets(bars: DataFrame, events: DataFrame, pre_hours: int = 24, post_hours: int = 24, threshold: float = 0.01) -> DataFrame:
    """Returns of the windows before and after events, written to the bars inside them.

    Where windows overlap the later event counts. Every step is an as-of lookup: an event finds
    the first and last bar of its windows, a bar finds the latest event whose window holds it.
    """
    pre, post = pre_hours * MICROS_PER_HOUR, post_hours * MICROS_PER_HOUR
    close = bars.select("symbol", "ts", "close")
    look = lambda left, name, direction, shift: asof_join(
        left, close, ["symbol"], ["close"], name, direction=direction, offset_us=shift)
    e = events.select("symbol", "ts", "event_id")
    e = look(e, "_a", "forward", -pre - 1)  # first bar at or after e - pre
    e = look(e, "_b", "backward", 1)  # last bar before e
    e = look(e, "_c", "forward", 0)  # first bar after e
    e = look(e, "_d", "backward", -post)  # last bar up to e + post
    at = us("ts")
    has_pre = (F.col("_a.us") < at) & (F.col("_b.us") >= at - pre)
    has_post = (F.col("_c.us") <= at + post) & (F.col("_d.us") > at)
    e = e.withColumns(
        {
            "pre": F.when(has_pre, ratio(F.col("_b.close") - F.col("_a.close"), F.col("_a.close"))),
            "post": F.when(has_post, ratio(F.col("_d.close") - F.col("_c.close"), F.col("_c.close"))),
        }
    ).select("symbol", "ts", "event_id", "pre", "post")
    out = asof_join(bars, e, ["symbol"], ["pre"], "_n", tie=["event_id"], offset_us=-pre)
    out = asof_join(out, e, ["symbol"], ["post"], "_l", tie=["event_id"], offset_us=1)
    out = asof_join(out, e.filter(F.abs("post") > threshold), ["symbol"], ["event_id"], "_h", offset_us=1)
    t = us("ts")
    soon, after = F.col("_n.us") > t, F.col("_l.us") >= t - post
    return out.withColumns(
        {
            "target_pre_event_return": zero(F.when(soon, F.col("_n.pre"))),
            "target_post_event_return": zero(F.when(after, F.col("_l.post"))),
            "target_event_impact": flag(F.col("_h.us") >= t - post),
            "target_has_event_soon": flag(soon),
        }
    ).drop("_n", "_l", "_h")


# ---------------------------------------------------------------- summaries


def target_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, deviation, range and missing count per numeric target, long format, one pass."""
    kinds = dict(df.dtypes)
    cols = [c for c in (columns or [c for c in df.columns if c.startswith("target_")]) if kinds[c] != "string"]
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("v")) for c in cols]))
    return (
        df.select(parts.alias("_t"))
        .groupBy(F.col("_t.target").alias("target"))
        .agg(F.avg("_t.v").alias("mean"), F.stddev_samp("_t.v").alias("std"), F.min("_t.v").alias("min"),
             F.max("_t.v").alias("max"), F.count_if(F.col("_t.v").isNull()).alias("null_count"))
    )


def class_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of categorical targets (long table)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(parts.alias("_t")).groupBy(F.col("_t.target").alias("target"), F.col("_t.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def volatility_quartiles(df: DataFrame, keys: Sequence[str] = ("symbol",), column: str = "target_volatility") -> DataFrame:
    return exact_quantiles(df, keys, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
