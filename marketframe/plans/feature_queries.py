"""Queries for event and sentiment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketframe.functions import lexicons as lex
from marketframe.functions import text as X
from marketframe.operators import event_features as E
from marketframe.operators import sentiment_features as N
from marketframe.operators.timeline import asof_join
from marketframe.plans.sqlkit import BARS, DETECTIONS, NEWS, rounded, rsql, with_sql
from marketframe.plans.text_queries import SENT
from marketframe.sources import derived

QUERIES: dict = {}
SQL: dict = {}
ID = ["symbol", "ts"]


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _events(keep, digits=6):
    def run(spark, folder):
        out = E.event_features(derived.bars(spark, folder), derived.detections(spark, folder))
        return rounded(out.select(*ID, *[F.col(f"`{c}`") for c in keep]), digits)

    return run


def _win(d, inner):
    """Aggregates of the events in [t - d, t] per bar."""
    return f"""(select b.symbol, b.ts, {inner} from bars b left join detections e on e.symbol = b.symbol
 and e.ts >= b.ts - interval {d} day and e.ts <= b.ts group by 1, 2)"""


HIST = """hist as (select b.symbol, b.ts, e.event_id, e.ts as ets, e.event_type, e.impact_score,
 row_number() over (partition by b.symbol, b.ts order by e.ts desc, e.event_id desc) as back from bars b join detections e on e.symbol = b.symbol and e.ts <= b.ts)"""
_time_cols = ["days_since_last_event", "hours_since_last_event", "days_to_next_event", "hours_to_next_event"]
_time_flags = ["has_recent_event_1d", "has_recent_event_3d", "has_upcoming_event_1d", "has_upcoming_event_3d"]
_add(
    "w20_j01_j02_event_times",
    _events([*_time_cols, *_time_flags]),
    rsql(
        with_sql(
            [BARS, DETECTIONS, """t as (select b.symbol, b.ts, (epoch_us(b.ts) - epoch_us(max(e.ts) filter (e.ts <= b.ts))) / 8.64e10 as s,
            (epoch_us(min(e.ts) filter (e.ts > b.ts)) - epoch_us(b.ts)) / 8.64e10 as n from bars b left join detections e using (symbol) group by b.symbol, b.ts)""".replace("e using (symbol)", "e on e.symbol = b.symbol")],
            """select symbol, ts, coalesce(s, 'inf'::double) as days_since_last_event, coalesce(s * 24, 'inf'::double) as hours_since_last_event,
            coalesce(n, 'inf'::double) as days_to_next_event, coalesce(n * 24, 'inf'::double) as hours_to_next_event, coalesce(s <= 1, false)::int as has_recent_event_1d,
            coalesce(s <= 3, false)::int as has_recent_event_3d, coalesce(n <= 1, false)::int as has_upcoming_event_1d, coalesce(n <= 3, false)::int as has_upcoming_event_3d from t""",
        ),
        [*ID, *_time_flags],
        _time_cols,
    ),
)
_cnt = [f"{p}_{d}d" for d in E.LOOKBACKS for p in ("event_count", "high_impact_count")]
_join = " ".join(f"join w{d} using (symbol, ts)" for d in E.LOOKBACKS[1:])
_cw = [f"w{d} as {_win(d, f'count(e.ts) as event_count_{d}d, count(*) filter (e.impact_score >= 0.6) as high_impact_count_{d}d')}" for d in E.LOOKBACKS]
_add(
    "w21_j03_event_counts",
    _events([*_cnt, "event_count_total", "event_frequency"]),
    rsql(
        with_sql([BARS, DETECTIONS, *_cw, f"tot as {_win(3650, 'count(e.ts) as event_count_total')}"],
                 f"select *, event_count_30d / 30.0::double as event_frequency from w1 {_join} join tot using (symbol, ts)"),
        [*ID, *_cnt, "event_count_total"],
        ["event_frequency"],
    ),
)
_imp = [f"{p}_impact_{d}d" for d in E.LOOKBACKS for p in ("max", "avg", "sum")]
_thr = [f"impact_above_{t}_{d}d" for d in E.LOOKBACKS for t in E.THRESHOLDS]
_iw = [
    "w%d as %s" % (d, _win(d, f"coalesce(max(impact_score), 0) as max_impact_{d}d, coalesce(avg(impact_score), 0) as avg_impact_{d}d, coalesce(sum(impact_score), 0) as sum_impact_{d}d, "
    + ", ".join(f'count(*) filter (impact_score >= {t}) as "impact_above_{t}_{d}d"' for t in E.THRESHOLDS)))
    for d in E.LOOKBACKS
]
_add(
    "w22_event_impacts",
    _events([*_imp, *_thr]),
    rsql(with_sql([BARS, DETECTIONS, *_iw], f"select * from w1 {_join}"), [*ID, *[f'"{t}"' for t in _thr]], _imp),
)
_add(
    "w23_w25_j05_recent_impact_and_spacing",
    _events(["recent_event_impact", "avg_event_spacing", *[f"event_cluster_{d}d" for d in E.CLUSTER_DAYS]]),
    rsql(
        with_sql(
            [BARS, DETECTIONS, HIST,
             *[f"c{d} as {_win(d, f'(count(e.ts) >= 3)::int as event_cluster_{d}d')}" for d in E.CLUSTER_DAYS],
             """r as (select symbol, ts, sum(impact_score * exp(-(epoch_us(ts) - epoch_us(ets)) / 8.64e10 / 7)) filter (back <= 5)
             / sum(exp(-(epoch_us(ts) - epoch_us(ets)) / 8.64e10 / 7)) filter (back <= 5) as ri,
             case when count(*) filter (back <= 10) >= 2 then (max(epoch_us(ets)) filter (back <= 10) - min(epoch_us(ets)) filter (back <= 10)) / 8.64e10 / (count(*) filter (back <= 10) - 1) end as sp
             from hist group by 1, 2)"""],
            """select symbol, ts, coalesce(ri, 0) as recent_event_impact, coalesce(sp, 'inf'::double) as avg_event_spacing, event_cluster_3d, event_cluster_7d, event_cluster_14d
            from c3 join c7 using (symbol, ts) join c14 using (symbol, ts) left join r using (symbol, ts)""",
        ),
        [*ID, *[f"event_cluster_{d}d" for d in E.CLUSTER_DAYS]],
        ["recent_event_impact", "avg_event_spacing"],
    ),
)
_types = [f"{t}_count_{d}d" for d in E.TYPE_DAYS for t in lex.EVENT_TYPES]
_hot = [f"last_event_{t}" for t in [*lex.EVENT_TYPES, "none"]]
_tw = ["w%d as %s" % (d, _win(d, ", ".join(f"count(*) filter (event_type = '{t}') as {t}_count_{d}d" for t in lex.EVENT_TYPES))) for d in E.TYPE_DAYS]
_add(
    "w24_j04_event_types",
    _events([*_types, "last_event_type", *_hot]),
    with_sql(
        [BARS, DETECTIONS, HIST, *_tw],
        f"select w7.symbol, w7.ts, {', '.join(_types)}, coalesce(event_type, 'none') as last_event_type, "
        + ", ".join(f"(coalesce(event_type, 'none') = '{t}')::int as last_event_{t}" for t in [*lex.EVENT_TYPES, "none"])
        + " from w7 join w14 using (symbol, ts) join w30 using (symbol, ts) left join (select * from hist where back = 1) h using (symbol, ts)",
    ),
)
_mw = [
    f"m{d} as {_win(d, '''case when count(e.ts) >= 3 and stddev_pop(impact_score) * stddev_pop(epoch_us(e.ts) / 1e6 - 1704067200) > 1e-12 then coalesce(covar_pop(impact_score, epoch_us(e.ts) / 1e6 - 1704067200)
    / (stddev_pop(impact_score) * stddev_pop(epoch_us(e.ts) / 1e6 - 1704067200)), 0) else 0 end as m, count(e.ts) as n''')}"
    for d in E.MOMENTUM_DAYS
]
_add(
    "w26_impact_momentum",
    _events(["impact_momentum_7d", "impact_momentum_14d", "event_acceleration"], 5),
    rsql(
        with_sql([BARS, DETECTIONS, *_mw], """select m7.symbol, m7.ts, m7.m as impact_momentum_7d, m14.m as impact_momentum_14d,
        case when m14.n - m7.n > 0 then (m7.n / 7.0::double - (m14.n - m7.n) / 7.0::double) / ((m14.n - m7.n) / 7.0::double) else 0 end as event_acceleration
        from m7 join m14 on m7.symbol = m14.symbol and m7.ts = m14.ts"""),
        ID,
        ["impact_momentum_7d", "impact_momentum_14d", "event_acceleration"],
        5,
    ),
)


def q_no_events(spark, folder):
    """Bars of symbols that have no event get the same columns."""
    bars = derived.bars(spark, folder).withColumn("symbol", F.concat(F.lit("x-"), "symbol"))
    out = E.event_features(bars, derived.detections(spark, folder))
    return out.select(*ID, "event_count_total", "days_since_last_event", "max_impact_30d", "last_event_type", "event_count_7d")


_add(
    "w27_features_without_events",
    q_no_events,
    with_sql([BARS], "select 'x-' || symbol as symbol, ts, 0::bigint as event_count_total, 'inf'::double as days_since_last_event, 0::double as max_impact_30d, 'none' as last_event_type, 0::bigint as event_count_7d from bars"),
)

# ------------------------------------------------------------------ sentiment


def _sentiment(spark, folder):
    return X.score_sentiment(derived.news(spark, folder).drop("source"))


def _sent(keep, digits=6):
    def run(spark, folder):
        out = N.sentiment_features(derived.bars(spark, folder), _sentiment(spark, folder))
        return rounded(out.select(*ID, *keep), digits)

    return run


ART = "arts as (select doc_id, ts, symbol, ks / 3 as s from sent)"
SEEN = "seen as (select b.symbol, b.ts, a.doc_id, a.ts as ats, a.s from bars b join arts a on (a.symbol = b.symbol or a.symbol is null) and a.ts <= b.ts)"
DAYS = "days as (select b.symbol, b.ts, avg(a.s) as m, count(a.s) as n from bars b left join arts a on (a.symbol = b.symbol or a.symbol is null) and a.ts::date = b.ts::date - {k} group by 1, 2)"
_base = [BARS, NEWS, SENT, ART]
_basic = list(N.DAILY_COLUMNS)
_add(
    "w28_j06_j07_daily_sentiment",
    _sent([*_basic, "last_sentiment"]),
    rsql(
        with_sql([*_base, SEEN, DAYS.format(k=0), "lst as (select symbol, ts, arg_max(s, (ats, doc_id)) as l from seen group by 1, 2)"],
                 """select symbol, ts, coalesce(m, 0) as sentiment_score, case when n > 0 then 0.33 else 0 end::double as sentiment_positive, case when n > 0 then 0.33 else 0 end::double as sentiment_negative,
                 case when n > 0 then 0.34 else 0 end::double as sentiment_neutral, 0::double as sentiment_compound, 0.5::double as sentiment_subjectivity, coalesce(l, 0) as last_sentiment
                 from days left join lst using (symbol, ts)"""),
        ID,
        [*_basic, "last_sentiment"],
    ),
)


def _swin(d, inner):
    return f"""(select b.symbol, b.ts, {inner} from bars b left join arts a on (a.symbol = b.symbol or a.symbol is null) and a.ts >= b.ts - interval {d} day and a.ts <= b.ts group by 1, 2)"""


_roll = [f"sentiment_{p}_{d}d" for d in N.WINDOWS for p in ("avg", "std", "min", "max", "trend")]
_sec = "(epoch_us(a.ts) / 1e6 - 1704067200)"
_rw = [
    f"w{d} as " + _swin(d, f"coalesce(avg(s), 0) as sentiment_avg_{d}d, case when count(s) = 0 then 0 else stddev_samp(s) end as sentiment_std_{d}d, coalesce(min(s), 0) as sentiment_min_{d}d, coalesce(max(s), 0) as sentiment_max_{d}d, "
    f"case when count(s) >= 3 and var_pop(s) > 1e-20 and var_pop({_sec}) > 1e-6 then covar_pop(s, {_sec}) / (stddev_pop(s) * stddev_pop({_sec})) else 0 end as sentiment_trend_{d}d")
    for d in N.WINDOWS
]
_add("w29_rolling_sentiment", _sent(_roll, 5), rsql(with_sql([*_base, *_rw], f"select * from w1 {_join}"), ID, _roll, 5))
_decay = [f"sentiment_decay_{h}d" for h in N.HALF_LIVES]
_add(
    "w30_decayed_sentiment",
    _sent(_decay),
    rsql(
        with_sql([*_base, SEEN, "lt as (select *, (epoch_us(ts) - epoch_us(ats)) / 8.64e10 as age from seen qualify row_number() over (partition by symbol, ts order by ats desc, doc_id desc) <= 100)",
                  "dc as (select symbol, ts, " + ", ".join(f"sum(s * power(2, -age / {h})) / sum(power(2, -age / {h})) as sentiment_decay_{h}d" for h in N.HALF_LIVES) + " from lt group by 1, 2)"],
                 "select symbol, ts, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _decay) + " from bars left join dc using (symbol, ts)"),
        ID,
        _decay,
    ),
)
_chg = ["sentiment_change_1d", "sentiment_change_3d", "sentiment_acceleration", "sentiment_momentum_5d"]
_add(
    "w31_j08_sentiment_momentum",
    _sent(_chg),
    rsql(
        with_sql([*_base, *[DAYS.format(k=k).replace("days as", f"d{k} as") for k in (0, 1, 3)],
                  "ch as (select d0.symbol, d0.ts, coalesce(d0.m - d1.m, 0) as c1, coalesce(d0.m - d3.m, 0) as c3 from d0 join d1 using (symbol, ts) join d3 using (symbol, ts))"],
                 """select symbol, ts, c1 as sentiment_change_1d, c3 as sentiment_change_3d, c1 - lag(c1) over w as sentiment_acceleration,
                 case when count(c1) over v = 5 then avg(c1) over v end as sentiment_momentum_5d from ch window w as (partition by symbol order by ts),
                 v as (partition by symbol order by ts rows between 4 preceding and current row)"""),
        ID,
        _chg,
    ),
)
_volc = [f"sentiment_volatility_{d}d" for d in N.VOLATILITY_DAYS]
_vw = [
    f"v{d} as (select symbol, ts, case when sum(n) >= 3 then coalesce(stddev_samp(m), 0) else 0 end as sentiment_volatility_{d}d from (select b.symbol, b.ts, a.ts::date as day, avg(s) as m, count(s) as n "
    f"from bars b join arts a on (a.symbol = b.symbol or a.symbol is null) and a.ts >= b.ts - interval {d} day and a.ts <= b.ts group by 1, 2, 3) group by 1, 2)"
    for d in N.VOLATILITY_DAYS
]
_add(
    "w32_a05_sentiment_volatility",
    _sent(_volc),
    rsql(with_sql([*_base, *_vw], "select symbol, ts, " + ", ".join(f"coalesce({c}, 0) as {c}" for c in _volc) + " from bars left join v7 using (symbol, ts) left join v14 using (symbol, ts) left join v30 using (symbol, ts)"), ID, _volc),
)
_newc = [f"{p}news_count_{d}d" for d in N.WINDOWS for p in ("", "positive_", "negative_")]
_nw = [f"w{d} as " + _swin(d, f"count(s) as news_count_{d}d, count(*) filter (s > 0.1) as positive_news_count_{d}d, count(*) filter (s < -0.1) as negative_news_count_{d}d") for d in N.WINDOWS]
_rat = ["news_frequency", "positive_news_ratio", "negative_news_ratio"]
_add(
    "w33_p14_news_volume",
    _sent([*_newc, *_rat]),
    rsql(
        with_sql([*_base, *_nw], f"select *, news_count_7d / 7.0::double as news_frequency, positive_news_count_7d / (news_count_7d + 1)::double as positive_news_ratio, negative_news_count_7d / (news_count_7d + 1)::double as negative_news_ratio from w1 {_join}"),
        [*ID, *_newc],
        _rat,
    ),
)


def q_no_news(spark, folder):
    """Features of bars that see no news at all: the same columns with their defaults."""
    bars = derived.bars(spark, folder).withColumn("symbol", F.concat(F.lit("x-"), "symbol"))
    out = N.sentiment_features(bars, _sentiment(spark, folder).filter(F.col("symbol").isNotNull()))
    return out.select(*ID, "sentiment_score", "sentiment_subjectivity", "news_count_7d", "sentiment_avg_7d", "sentiment_decay_3d", "sentiment_volatility_7d")


_add(
    "w34_features_without_news",
    q_no_news,
    with_sql([BARS], "select 'x-' || symbol as symbol, ts, 0::double as sentiment_score, 0.5::double as sentiment_subjectivity, 0::bigint as news_count_7d, 0::double as sentiment_avg_7d, 0::double as sentiment_decay_3d, 0::double as sentiment_volatility_7d from bars"),
)


def q_asof(direction, offset):
    def run(spark, folder):
        out = asof_join(derived.bars(spark, folder).select(*ID), derived.detections(spark, folder), ["symbol"],
                        ["event_type"], "e", tie=["event_id"], direction=direction, offset_days=offset)
        return out.select(*ID, F.col("e.event_id").alias("event_id"), F.col("e.event_type").alias("event_type"))

    return run


def sql_asof(cond, order):
    return with_sql([BARS, DETECTIONS], f"""select b.symbol, b.ts, event_id, event_type from bars b left join (select b.symbol, b.ts, e.event_id, e.event_type from bars b join detections e on e.symbol = b.symbol and {cond}
    qualify row_number() over (partition by b.symbol, b.ts order by {order}) = 1) h using (symbol, ts)""".replace("using (symbol, ts)", "on h.symbol = b.symbol and h.ts = b.ts"))


_add("j04_asof_previous_event", q_asof("backward", 0.0), sql_asof("e.ts <= b.ts", "e.ts desc, e.event_id desc"))
_add("j02_asof_next_event", q_asof("forward", 0.0), sql_asof("e.ts > b.ts", "e.ts, e.event_id"))
_add("j10_asof_two_days_before", q_asof("backward", 2.0), sql_asof("e.ts <= b.ts - interval 2 day", "e.ts desc, e.event_id desc"))
