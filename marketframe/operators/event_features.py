"""Per-bar features of the detected events around it; one shuffle of the bars feeds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.functions.lexicons import EVENT_TYPES
from marketframe.functions.numeric import MICROS_PER_DAY, MICROS_PER_HOUR, PARTS, centred, flag, millis, ratio, us, whole
from marketframe.operators.lineage import cut
from marketframe.operators.ordered import row_chunks
from marketframe.operators.timeline import RangeTimeline, pieces_of

LOOKBACKS = (1, 3, 7, 14, 30)
TYPE_DAYS = (7, 14, 30)
CLUSTER_DAYS = (3, 7, 14)
MOMENTUM_DAYS = (7, 14)
THRESHOLDS = (0.3, 0.5, 0.7)
INF = float("inf")


def event_history(events: DataFrame) -> DataFrame:
    """Events with what is known as of each one: running count, decayed impact of the last five
    and mean spacing of the last ten.

    A recency weight exp(-(t - u)/7d) is the same for every event up to the factor exp(-t/7d),
    so the weighted mean can be taken relative to the event itself and carried to any later bar.
    """
    c = row_chunks(events, ("symbol",), tie=("event_id",), halo=9, bucket_us=MICROS_PER_HOUR, tasks=pieces_of(events.count()))
    c = c.with_columns({"_u": F.unix_micros(F.col("ts").cast("timestamp"))})
    last5, last10 = c.last_rows(5), c.last_rows(10)
    c = c.with_columns(
        {
            "_recent": F.collect_list(F.struct("_u", "impact_score")).over(last5),
            "_n10": F.count(F.lit(1)).over(last10),
            "_first10": F.min("_u").over(last10),
        }
    )
    weight = lambda e: F.exp((e["_u"] - F.col("_u")) / float(7 * MICROS_PER_DAY))
    total = F.aggregate("_recent", F.lit(0.0), lambda a, e: a + weight(e) * e["impact_score"])
    weights = F.aggregate("_recent", F.lit(0.0), lambda a, e: a + weight(e))
    spacing = ratio((F.col("_u") - F.col("_first10")) / float(MICROS_PER_DAY), F.col("_n10") - 1)
    return c.with_columns(
        {
            "event_count_total": F.col("_rn") + 1,
            "recent_event_impact": ratio(total, weights),
            "avg_event_spacing": F.when(F.col("_n10") >= 2, spacing),
        }
    ).own().drop("_u", "_recent", "_n10", "_first10")


def event_features(
    bars: DataFrame,
    events: DataFrame,
    lookbacks: Sequence[int] = LOOKBACKS,
    thresholds: Sequence[float] = THRESHOLDS,
    event_types: Sequence[str] = tuple(EVENT_TYPES),
    pieces: int | None = None,
) -> DataFrame:
    """Bars with time-to-event, count, impact, type, clustering and momentum features.

    The column set does not depend on the data: without events counts are 0 and times infinite.
    """
    values = ["event_type", "event_count_total", "recent_event_impact", "avg_event_spacing"]
    # stored: it is counted, sampled for its ranges and read
    history = cut(event_history(events).select("symbol", "ts", "event_id", "impact_score", *values))
    # windows needed by the later features even when not asked for by name
    days = sorted({*lookbacks, 7, 14, 30})
    history = history.withColumn("_t", us("ts"))
    line = RangeTimeline(bars, history, ["symbol"], ["impact_score", "event_type", "_t"], values, ["event_id"], pieces)
    impact, kind = F.col("impact_score"), F.col("event_type")
    cols = {"_prev": line.previous(), "_next": line.next(), "_now": F.col("_us")}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = F.lit(1)
    seen = F.when(kind.isNotNull(), one)
    for d in days:
        n = f"event_count_{d}d"
        cols[n] = line.total(seen, d)
        if d not in lookbacks:
            continue
        cols[f"high_impact_count_{d}d"] = line.total(F.when(impact >= 0.6, one), d)
        cols[f"max_impact_{d}d"] = zero(line.highest("impact_score", d))
        cols[f"_sum_{d}"] = line.total(whole(impact), d) / F.lit(PARTS)
        for t in thresholds:
            cols[f"impact_above_{t}_{d}d"] = line.total(F.when(impact >= t, one), d)
    for d in TYPE_DAYS:
        for name in event_types:
            cols[f"{name}_count_{d}d"] = line.total(F.when(kind == name, one), d)
    for d in CLUSTER_DAYS:
        cols[f"event_cluster_{d}d"] = flag(line.total(seen, d) >= 3)
    t, y = millis(F.col("_t")), whole(impact)
    both = kind.isNotNull() & impact.isNotNull()
    for d in MOMENTUM_DAYS:
        for tag, term in (("n", F.lit(1)), ("t", t), ("y", y), ("tt", t * t), ("yy", y * y), ("ty", t * y)):
            cols[f"_{tag}_{d}"] = line.total(F.when(both, term), d)
    out = line.bars(cols)
    means = {}
    for d in lookbacks:
        some = F.col(f"event_count_{d}d") > 0
        means[f"sum_impact_{d}d"] = F.when(some, F.col(f"_sum_{d}")).otherwise(0.0)
        means[f"avg_impact_{d}d"] = F.when(some, ratio(f"_sum_{d}", f"event_count_{d}d")).otherwise(0.0)
    for d in MOMENTUM_DAYS:
        n, st, sy = (F.col(f"_{x}_{d}") for x in ("n", "t", "y"))
        vt, vy, cov = centred(n, st, st, F.col(f"_tt_{d}")), centred(n, sy, sy, F.col(f"_yy_{d}")), centred(n, st, sy, F.col(f"_ty_{d}"))
        # deviations in seconds and in units of impact: less is a constant series
        spread = F.sqrt(vt * vy) / n / F.lit(1000 * PARTS)
        means[f"impact_momentum_{d}d"] = zero(F.when((F.col(f"event_count_{d}d") >= 3) & (spread > 1e-12), cov / F.sqrt(vt * vy)))
    drop = [f"_sum_{d}" for d in lookbacks] + [f"_{x}_{d}" for d in MOMENTUM_DAYS for x in ("n", "t", "y", "tt", "yy", "ty")]
    return _finish(out.withColumns(means).drop(*drop), event_types)


def _finish(out: DataFrame, event_types: Sequence[str]) -> DataFrame:
    since = F.col("_now") - F.col("_prev.us")
    until = F.col("_next.us") - F.col("_now")
    inf = F.lit(INF)
    day, hour = float(MICROS_PER_DAY), float(MICROS_PER_DAY / 24)
    out = out.withColumns(
        {
            "days_since_last_event": F.coalesce(since / day, inf),
            "hours_since_last_event": F.coalesce(since / hour, inf),
            "days_to_next_event": F.coalesce(until / day, inf),
            "hours_to_next_event": F.coalesce(until / hour, inf),
            "event_count_total": F.coalesce("_prev.event_count_total", F.lit(0)),
            "event_frequency": F.col("event_count_30d") / 30.0,
            "recent_event_impact": F.coalesce("_prev.recent_event_impact", F.lit(0.0)),
            "avg_event_spacing": F.coalesce("_prev.avg_event_spacing", inf),
            "last_event_type": F.coalesce("_prev.event_type", F.lit("none")),
        }
    )
    recent = F.col("event_count_7d") / 7.0
    older = (F.col("event_count_14d") - F.col("event_count_7d")) / 7.0
    cols = {
        "has_recent_event_1d": flag(F.col("days_since_last_event") <= 1),
        "has_recent_event_3d": flag(F.col("days_since_last_event") <= 3),
        "has_upcoming_event_1d": flag(F.col("days_to_next_event") <= 1),
        "has_upcoming_event_3d": flag(F.col("days_to_next_event") <= 3),
        "event_acceleration": F.coalesce(F.when(older > 0, ratio(recent - older, older)), F.lit(0.0)),
    }
    for name in [*event_types, "none"]:
        cols[f"last_event_{name}"] = flag(F.col("last_event_type") == name)
    return out.withColumns(cols).drop("_prev", "_next", "_now")
