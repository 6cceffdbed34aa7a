"""Queries over news text, detected events and the scheduled-event calendar."""

from __future__ import annotations

import uuid


from pyspark.sql import functions as F

from marketframe.functions import lexicons as lex
from marketframe.functions import text as X
from marketframe.operators import event_store as S
from marketframe.operators.lineage import cut
from marketframe.operators.ranking import top_k
from marketframe.plans.sqlkit import NEWS, quoted, rounded, rsql, with_sql
from marketframe.session import checkpoint_folder
from marketframe.sources import derived, feeds

QUERIES: dict = {}
SQL: dict = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    SQL[name] = sql


def _has(text, word):
    return f"contains({text}, {quoted(word)})"


def _count(text, words):
    return "(" + " + ".join(f"{_has(text, w)}::int" for w in words) + ")"


def _any(text, words):
    return "(" + " or ".join(_has(text, w) for w in words) + ")"


def _list(words):
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def _map(mapping):
    return f"map {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in mapping.items())}}}"


# ------------------------------------------------------------------ sentiment

SENT = f"""sent as (select doc_id, ts, symbol, title, lang, p, n, case when p + n = 0 then 0.0::double else (p - n)::double / (p + n) end as ks,
 length(t) as text_length, length(title) as title_length from
 (select *, {_count('lt', lex.POSITIVE_WORDS)} as p, {_count('lt', lex.NEGATIVE_WORDS)} as n from
 (select *, lower(t) as lt from (select *, title || ' ' || content as t from news))))"""


def q_keyword_sentiment(spark, folder):
    out = X.score_sentiment(derived.news(spark, folder))
    return rounded(out.select("doc_id", "keyword_sentiment", "composite_sentiment", "text_length", "title_length"))


_add(
    "f01_f02_sentiment_scores",
    q_keyword_sentiment,
    rsql(
        with_sql([NEWS, SENT], "select doc_id, ks as keyword_sentiment, ks / 3 as composite_sentiment, text_length::int as text_length, title_length::int as title_length from sent"),
        ["doc_id", "text_length", "title_length"],
        ["keyword_sentiment", "composite_sentiment"],
    ),
)
UD1 = f"""ud as (select doc_id, lang, case when s > 0 then 'POSITIVE' when s < 0 then 'NEGATIVE' else 'NEUTRAL' end as sentiment_label,
 abs(s) as sentiment_score, s as sentiment_numeric from (select doc_id, lang, case when p + n = 0 then 0.0::double
 else (p - n)::double / (p + n) end as s from (select doc_id, lang, {_count('lower(content)', lex.POSITIVE_WORDS)} as p,
 {_count('lower(content)', lex.NEGATIVE_WORDS)} as n from news)))"""


def _scored(spark, folder):
    return X.analyze_text_column(derived.news(spark, folder), "content")


_add(
    "ud1_f03_scored_text",
    lambda s, f: rounded(_scored(s, f).select("doc_id", "sentiment_label", "sentiment_score", "sentiment_numeric")),
    rsql(with_sql([NEWS, UD1], "select doc_id, sentiment_label, sentiment_score, case when sentiment_label = 'POSITIVE' then sentiment_score else -sentiment_score end as sentiment_numeric from ud"),
         ["doc_id", "sentiment_label"], ["sentiment_score", "sentiment_numeric"]),
)
_add(
    "a01_sentiment_by_language",
    lambda s, f: rounded(X.aggregate_sentiment(_scored(s, f), ["lang"])),
    rsql(
        with_sql([NEWS, UD1], """select lang, coalesce(avg(sentiment_numeric), 0) as mean_sentiment, coalesce(stddev_samp(sentiment_numeric), 0) as std_sentiment,
        avg((sentiment_label = 'POSITIVE')::int) as positive_ratio, avg((sentiment_label = 'NEGATIVE')::int) as negative_ratio from ud group by 1"""),
        ["lang"],
        ["mean_sentiment", "std_sentiment", "positive_ratio", "negative_ratio"],
    ),
)

# ------------------------------------------------------------------ event detection

_branches = []
for _i, (_name, (_words, _weight, _req)) in enumerate(lex.EVENT_PATTERNS.items()):
    _branches.append(
        f"select *, {_i} as ord, '{_name}' as event_type, list_filter({_list(_words)}, lambda w: contains(low, w)) as kws, "
        f"{len(_words)}::double as total, {_weight}::double as weight, {_count('low', _req)}::double as found, {len(_req)}::double as req from art"
    )
ART = "art as (select *, lower(full_text) as low from (select *, title || ' ' || content as full_text from news))"
# RE2 word boundaries are ASCII only, so upper-case words are cut by Unicode classes instead
ENT = f"""ent as (select doc_id, list_concat(list_filter(string_split_regex(full_text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,5}}')),
 regexp_extract_all(full_text, {quoted(lex.COMPANY_WORDS)}, 1)) as cand from art)"""
DET = """det as (select *, row_number() over (partition by doc_id order by confidence desc, ord) as event_rank,
 count(*) over (partition by doc_id) as n_det from (select *, least(1.0::double, len(kws)::double / total * weight + found / req * 0.3::double
 - least(0.1::double, length(low) / 10000.0::double)) as confidence from (""" + " union all ".join(_branches) + """)) where len(kws) > 0 and confidence > 0.3::double)"""
DESC = "case when length(content) > 200 then substring(content, 1, 200) || '...' else content end"
_ents = "coalesce(cand[1], 'Unknown')"


def q_detect(spark, folder):
    out = X.detected_events(derived.news(spark, folder))
    return rounded(
        out.select("doc_id", "event_rank", "event_type", "confidence", "entity", "description", "text_length",
                   F.array_join("keywords_matched", ", ").alias("keywords"))
    )


_add(
    "f04_f05_event_detection",
    q_detect,
    rsql(
        with_sql([NEWS, ART, ENT, DET], f"select doc_id, event_rank::int as event_rank, event_type, confidence, {_ents} as entity, {DESC} as description, length(low)::int as text_length, array_to_string(kws, ', ') as keywords from det join ent using (doc_id)"),
        ["doc_id", "event_rank", "event_type", "entity", "description", "text_length", "keywords"],
        ["confidence"],
    ),
)


def q_candidates(spark, folder):
    out = X.detect(derived.news(spark, folder))
    return out.select("doc_id", "entity", F.array_join(F.array_sort("all_entities"), "|").alias("all_entities"))


_add(
    "f06_u07_candidate_entities",
    q_candidates,
    with_sql([NEWS, ART, ENT], f"select doc_id, {_ents} as entity, array_to_string(list_sort(list_distinct(cand)), '|') as all_entities from ent"),
)


def q_articles(spark, folder):
    out = X.classify_articles(derived.news(spark, folder))
    return rounded(out.select("doc_id", "event_type", "event_confidence", "event_entity", "keywords_matched", "num_events_detected"))


_add(
    "f07_t05_article_classification",
    q_articles,
    rsql(
        with_sql([NEWS, ART, ENT, DET], f"""select n.doc_id, coalesce(event_type, 'unknown') as event_type, coalesce(confidence, 0) as event_confidence,
        case when event_type is null then '' else {_ents} end as event_entity, coalesce(array_to_string(kws, ', '), '') as keywords_matched,
        coalesce(n_det, 0)::int as num_events_detected from news n join ent using (doc_id) left join (select * from det where event_rank = 1) d using (doc_id)"""),
        ["doc_id", "event_type", "event_entity", "keywords_matched", "num_events_detected"],
        ["event_confidence"],
    ),
)

# ------------------------------------------------------------------ impact

DETE = f"dete as (select d.doc_id, d.ts, source, event_rank, event_type, confidence, {_ents} as entity, title, content, {DESC} as description from det d join ent using (doc_id))"
MET = f"""met as (select *, {_has('low', 'beat')} and {_has('low', 'estimate')} as beat,
 {_any('low', ['guidance', 'outlook', 'forecast'])} as talk, {_any('low', ['raise', 'increase', 'upgrade'])} as up,
 {_any('low', ['lower', 'cut', 'reduce'])} as dn, regexp_extract_all(low, {quoted(lex.PERCENTAGE)}, 1) as pct,
 regexp_extract_all(low, {quoted(lex.DOLLARS)}, 1) as amt, regexp_extract_all(low, {quoted(lex.DOLLARS)}, 2) as unit
 from (select *, lower(title || ' ' || content) as low from dete))"""


def q_metrics(spark, folder):
    out = X.financial_metrics(X.detected_events(derived.news(spark, folder)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(
        out.select(
            "doc_id", "event_rank", F.size("percentages").alias("n_percentages"), total("percentages").alias("sum_percentages"),
            F.size("dollar_amounts").alias("n_dollars"), total("dollar_amounts").alias("sum_dollars"),
            "earnings_beat", "earnings_miss", "guidance_raised", "guidance_lowered",
        )
    )


_add(
    "f08_financial_metrics",
    q_metrics,
    rsql(
        with_sql([NEWS, ART, ENT, DET, DETE, MET], f"""select doc_id, event_rank::int as event_rank, len(pct)::int as n_percentages,
        coalesce(list_sum(list_transform(pct, lambda x: x::double)), 0) as sum_percentages, len(amt)::int as n_dollars,
        coalesce(list_sum(list_transform(range(1, len(amt) + 1), lambda i: amt[i]::double * case when unit[i] in ('million', 'm') then 1e6 else 1e9 end)), 0) as sum_dollars,
        beat as earnings_beat, (not beat and {_has('low', 'miss')} and {_has('low', 'estimate')}) as earnings_miss,
        talk and up as guidance_raised, talk and not up and dn as guidance_lowered from met"""),
        ["doc_id", "event_rank", "n_percentages", "n_dollars", "earnings_beat", "earnings_miss", "guidance_raised", "guidance_lowered"],
        ["sum_percentages", "sum_dollars"],
    ),
)


def _impact_cte(conditions=()):
    market = 1.0
    for c in conditions:
        market *= lex.MARKET_FACTORS.get(c, 1.0)
    base = "case event_type " + " ".join(f"when '{k}' then {v}::double" for k, v in lex.BASE_IMPACT.items()) + " else 0.5::double end"
    return f"""imp as (select *, least(final, 1.0::double) as impact_score, case when final < 0.2 then 'minimal' when final < 0.4 then 'low'
 when final < 0.6 then 'medium' when final < 0.8 then 'high' else 'extreme' end as impact_level,
 case when final < 0.2 then 0.5 when final < 0.4 then 2 when final < 0.6 then 5 when final < 0.8 then 10 else 20 end::double as price_target_change,
 final * 50 as volatility_increase, least(confidence * 0.8::double, 0.9::double) as impact_confidence
 from (select *, least(base * factor * (confidence * 0.5::double + 0.5::double), 1.0::double)
 * case when upper(entity) in ({', '.join(quoted(x) for x in lex.MEGA_CAPS)}) then 0.7::double when upper(entity) in ({', '.join(quoted(x) for x in lex.LARGE_CAPS)}) then 0.8::double else 1.0::double end
 * case when upper(entity) in ({', '.join(quoted(x) for x in lex.HIGH_PROFILE)}) then 1.2::double else 1.0::double end * {market!r}::double as final
 from (select *, {base} as base, case when event_type = 'earnings' then
 (case when beat then 1.5::double when {_has('low', 'miss')} and {_has('low', 'estimate')} then 1.8::double else 1.0::double end)
 * (case when talk and (up or dn) then 1.3::double else 1.0::double end)
 when event_type = 'regulatory' then case when {_has('low', 'fda')} and {_has('low', 'approval')} then 1.8::double
 when {_has('low', 'sec')} and {_has('low', 'investigation')} then 1.6::double else 1.0::double end
 when event_type = 'leadership_change' and {_has('low', 'ceo')} then 1.8::double else 1.0::double end as factor from met)))"""


_imp_cols = ["impact_score", "price_target_change", "volatility_increase", "impact_confidence"]


def _impact_query(conditions=None):
    def run(spark, folder):
        out = X.score_impact(X.detected_events(derived.news(spark, folder)), conditions)
        return rounded(out.select("doc_id", "event_rank", "impact_level", *_imp_cols))

    return run


def _impact_sql(conditions=()):
    return rsql(
        with_sql([NEWS, ART, ENT, DET, DETE, MET, _impact_cte(conditions)], f"select doc_id, event_rank::int as event_rank, impact_level, {', '.join(_imp_cols)} from imp"),
        ["doc_id", "event_rank", "impact_level"],
        _imp_cols,
    )


_add("f09_f12_impact_scores", _impact_query(), _impact_sql())
_COND = ["high_volatility", "earnings_season", "not_a_condition"]
_add("f11_impact_under_conditions", _impact_query(_COND), _impact_sql(_COND))


def q_high_impact(spark, folder):
    out = X.score_impact(X.detected_events(derived.news(spark, folder)))
    out = out.filter(F.col("impact_score") >= 0.6)
    return rounded(X.impact_report(out, ["doc_id", "event_rank"]))


_add(
    "p08_p09_high_impact_report",
    q_high_impact,
    rsql(
        with_sql([NEWS, ART, ENT, DET, DETE, MET, _impact_cte()], """select doc_id, event_rank::int as event_rank, entity, event_type, confidence as event_confidence, impact_level, impact_score,
        price_target_change, volatility_increase, impact_confidence as assessment_confidence,
        case when length(title) > 100 then substring(title, 1, 100) || '...' else title end as title from imp where impact_score >= 0.6"""),
        ["doc_id", "event_rank", "entity", "event_type", "impact_level", "title"],
        ["event_confidence", "impact_score", "price_target_change", "volatility_increase", "assessment_confidence"],
    ),
)
_add(
    "a40_average_impact_by_type",
    lambda s, f: rounded(
        X.score_impact(X.detected_events(derived.news(s, f))).groupBy("event_type").agg(
            F.avg("impact_score").alias("avg_impact"), F.count(F.lit(1)).alias("n_events"))
    ),
    rsql(with_sql([NEWS, ART, ENT, DET, DETE, MET, _impact_cte()], "select event_type, avg(impact_score) as avg_impact, count(*) as n_events from imp group by 1"),
         ["event_type", "n_events"], ["avg_impact"]),
)
_add(
    "t04_top3_by_impact_per_type",
    lambda s, f: rounded(
        top_k(X.score_impact(X.detected_events(derived.news(s, f))).select("doc_id", "event_rank", "event_type", "impact_score"),
              ["event_type"], [F.desc(F.round("impact_score", 9)), F.asc("doc_id")], 3, rank="rank")
    ),
    rsql(with_sql([NEWS, ART, ENT, DET, DETE, MET, _impact_cte()], """select doc_id, event_rank::int as event_rank, event_type, impact_score,
    row_number() over (partition by event_type order by round(impact_score, 9) desc, doc_id)::int as rank from imp qualify rank <= 3"""),
         ["doc_id", "event_rank", "event_type", "rank"], ["impact_score"]),
)

# ------------------------------------------------------------------ entities


def _span_cte(i, pattern):
    return f"""select doc_id, full_text, {i} as kind, hits[j] as match,
 (coalesce(list_sum(list_transform(gaps[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0))::int as s
 from (select doc_id, full_text, hits, gaps, unnest(range(1, len(hits) + 1)) as j from (select doc_id, full_text,
 regexp_extract_all(full_text, {quoted(pattern)}) as hits, string_split_regex(full_text, {quoted(pattern)}) as gaps from art))"""


_alias_low = {a.lower(): c for a, c in lex.ALIASES.items()}
_alias_ord = "map {" + ", ".join(f"{quoted(a.lower())}: {i}" for i, a in enumerate(lex.ALIASES)) + "}"
_sector_counts = {s: _count("slow", [w.lower() for w in ws]) for s, ws in lex.SECTORS.items()}
_best = "greatest(" + ", ".join(f"c{i}" for i in range(len(lex.SECTORS))) + ")"
_sector_pick = "case when " + _best + " = 0 then null " + " ".join(
    f"when c{i} = {_best} then {quoted(s)}" for i, s in enumerate(lex.SECTORS)
) + " end"
SPANS = "spans as (" + " union all ".join(_span_cte(i, p) for i, p in enumerate(X.SPAN_PATTERNS)) + ")"
LINK = f"""link as (select doc_id, row_number() over (partition by doc_id order by confidence desc, kind, ord, s) as entity_rank, text,
 case when kind <= 2 then 'ticker' else 'company' end as entity_type, confidence,
 case when kind <= 2 then text else {_map(lex.COMPANY_TICKER)}[text] end as ticker,
 case when kind <= 2 then {_map(lex.TICKERS)}[text] else text end as canonical_name, s as start_char, e as end_char, context,
 case when kind > 2 then {_sector_pick} end as sector
 from (select *, {', '.join(f'{c} as c{i}' for i, c in enumerate(_sector_counts.values()))} from (select *, lower(text || ' ' || context) as slow from (
 select *, substring(full_text, greatest(s - 100, 0) + 1, e + 100 - greatest(s - 100, 0)) as context from (
 select *, s + length(match) as e, case when kind <= 2 then 0.9::double else 0.7::double end as confidence,
 case when kind <= 2 then replace(match, '$', '') when kind = 3 then {_map(_alias_low)}[lower(match)] else match end as text,
 case when kind = 3 then {_alias_ord}[lower(match)] else 0 end as ord from spans)
 qualify row_number() over (partition by doc_id, s, e order by confidence desc, kind, ord) = 1))))"""


def _linked(spark, folder):
    news = X._article_text(derived.news(spark, folder))
    return X.link_entities(news, F.col("_full"))


_ent_cols = ["doc_id", "entity_rank", "text", "entity_type", "ticker", "canonical_name", "start_char", "end_char", "context"]
_add(
    "f13_f18_linked_entities",
    lambda s, f: rounded(X.explode_entities(_linked(s, f), ["doc_id"]).select(*_ent_cols, "sector", "confidence")),
    rsql(with_sql([NEWS, ART, SPANS, LINK], "select * exclude (entity_rank), entity_rank::int as entity_rank from link"), [*_ent_cols, "sector"], ["confidence"]),
)
_add(
    "p10_p11_entity_report",
    lambda s, f: X.entity_report(X.financial_entities(X.explode_entities(_linked(s, f), ["doc_id"]))).select(
        "doc_id", "entity_rank", "text", "context", "aliases"),
    with_sql([NEWS, ART, SPANS, LINK], """select doc_id, entity_rank::int as entity_rank, text,
    case when length(context) > 100 then substring(context, 1, 100) || '...' else context end as context, 'sector:' || sector as aliases from link"""),
)
PRIM = """prim as (select doc_id, coalesce(min_by(ticker, entity_rank) filter (entity_type = 'ticker' and ticker is not null),
 min_by(ticker, entity_rank) filter (ticker is not null)) as ticker, min_by(ticker, entity_rank) filter (ticker is not null) as any_ticker,
 min_by(sector, entity_rank) filter (sector is not null) as sector from link group by 1)"""
_add(
    "t06_t07_primary_ticker_and_sector",
    lambda s, f: _linked(s, f).select(
        "doc_id", X.primary_ticker(F.col("entities")).alias("ticker"), X.primary_ticker(F.col("entities"), True).alias("any_ticker"),
        X.primary_sector(F.col("entities")).alias("sector")),
    with_sql([NEWS, ART, SPANS, LINK, PRIM], "select doc_id, ticker, any_ticker, sector from news left join prim using (doc_id)"),
)


def q_mentions(spark, folder):
    gazetteer = spark.createDataFrame(list(lex.TICKERS.items()), "ticker string, company string")
    return X.ticker_mentions(derived.news(spark, folder), gazetteer)


_add(
    "j14_gazetteer_join",
    q_mentions,
    with_sql([NEWS, ART], f"""select distinct doc_id, ticker, g[ticker] as company from (select doc_id, {_map(lex.TICKERS)} as g,
    unnest(regexp_extract_all(full_text, '\\b[A-Z]{{1,5}}(?:-USD)?\\b')) as ticker from art) where g[ticker] is not null"""),
)


def q_dictionary(spark, folder):
    """Every article against a dictionary drawn from the benchmark texts' words and the keyword lists."""
    words = derived.read(spark, folder, "part").select(F.lower(F.regexp_extract("p_name", r"^(\w+)", 1)).alias("keyword"))
    extra = spark.createDataFrame([(w,) for p in lex.EVENT_PATTERNS.values() for w in p[0]], "keyword string")
    return X.match_dictionary(derived.news(spark, folder), words.union(extra).distinct()).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n_articles"))


_all_words = sorted({w for p in lex.EVENT_PATTERNS.values() for w in p[0]})
_add(
    "j15_dictionary_match",
    q_dictionary,
    with_sql([NEWS, ART], f"""select keyword, count(*) as n_articles from art join (select distinct lower(regexp_extract(p_name, '^(\\w+)', 1)) as keyword from part
    union select unnest({_list(_all_words)})) k on contains(low, keyword) and keyword <> '' group by 1"""),
)

# ------------------------------------------------------------------ event store


def _events(spark, folder):
    return S.news_to_events(derived.spread(derived.news(spark, folder)))


STORE = """store as (select sha256(concat_ws('|', i.title, i.event_type, i.ts::varchar, i.source, i.doc_id::varchar)) as event_id, i.doc_id, i.ts, i.title, i.description, i.entity, i.event_type,
 i.confidence as classification_confidence, i.impact_level, i.impact_score, i.price_target_change, i.volatility_increase, '1-5 days' as time_horizon,
 i.impact_confidence, i.source as source_name, p.ticker, p.sector from imp i left join prim p using (doc_id) where i.impact_score >= 0.3)"""
STORE_CTES = [NEWS, ART, ENT, DET, DETE, MET, _impact_cte(), SPANS, LINK, PRIM, STORE]
_store_doubles = ["classification_confidence", "impact_score", "price_target_change", "volatility_increase", "impact_confidence"]
_store_plain = [c for c in S.EVENT_COLUMNS if c not in _store_doubles]


def _store_sql(body, plain=_store_plain, doubles=_store_doubles):
    return rsql(with_sql(STORE_CTES, body), plain, doubles)


_add("s13_st02_news_to_events", lambda s, f: rounded(_events(s, f).drop("entities")), _store_sql("select * from store"))


def _stored(spark, folder):
    """The events written in two batches that share their dates, one of them twice, read back from the store."""
    events = cut(_events(spark, folder))
    path = f"{checkpoint_folder(spark)}/events-{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))
    for batch in (0, 1, 1):
        S.write_events(events.where(half == batch), path, batch)
    return path


_add("s13_store_read_back", lambda s, f: rounded(S.read_events(s, _stored(s, f))), _store_sql("select * from store"))
_add(
    "s14_store_entities",
    lambda s, f: S.read_entities(s, _stored(s, f)).select("event_id", "entity_rank", "text", "ticker", "start_char"),
    with_sql(STORE_CTES, "select distinct event_id, entity_rank::int as entity_rank, text, link.ticker, start_char from store join link using (doc_id)"),
)
_add(
    "s13_j16_event_entities",
    lambda s, f: S.event_entities(_events(s, f)).select("event_id", "entity_rank", "text", "ticker", "start_char"),
    with_sql(STORE_CTES, "select event_id, entity_rank::int as entity_rank, text, link.ticker, start_char from store join link using (doc_id)"),
)
_add(
    "p01_t01_event_query",
    lambda s, f: rounded(S.query_events(_events(s, f).drop("entities"), ticker="AAPL", min_impact=0.5, start="2024-01-05", end="2024-01-25", limit=20)),
    _store_sql("""select * from store where ticker = 'AAPL' and impact_score >= 0.5 and ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'
    order by ts desc, event_id limit 20"""),
)
_add(
    "p31_events_for_features",
    lambda s, f: S.events_for_features(_events(s, f), "2024-03-10 00:00:00", "2024-03-12 00:00:00").select("event_id", "ts"),
    with_sql(STORE_CTES, "select event_id, ts from store where ts >= timestamp '2024-03-10 00:00:00' - interval 60 day and ts <= timestamp '2024-03-12 00:00:00' + interval 30 day"),
)
_add(
    "a02_a03_event_statistics",
    lambda s, f: rounded(S.statistics(_events(s, f))),
    rsql(
        with_sql(STORE_CTES, " union all ".join(
            f"select '{d}' as dimension, {m} as member, count(*) as n_events, avg(impact_score) as avg_impact, max(impact_score) as max_impact, min(impact_score) as min_impact, count(*) filter (impact_score >= 0.6) as high_impact from store"
            + (f" where {m} is not null group by 2" if d != "all" else "")
            for d, m in (("event_type", "event_type"), ("impact_level", "impact_level"), ("ticker", "ticker"), ("sector", "sector"), ("all", "null::varchar"))
        )),
        ["dimension", "member", "n_events", "high_impact"],
        ["avg_impact", "max_impact", "min_impact"],
    ),
)
_add(
    "t02_ticker_distribution_top20",
    lambda s, f: S.distribution(_events(s, f), "ticker", 20),
    with_sql(STORE_CTES, "select ticker, count(*) as n_events from store where ticker is not null group by 1 order by 2 desc, 1 limit 20"),
)
_add(
    "p12_ticker_timeline",
    lambda s, f: rounded(S.ticker_timeline(_events(s, f), "AAPL", "2024-01-31 00:00:00").select("event_id", "ts", "impact_score", "date", "hour", "day_of_week")),
    rsql(with_sql(STORE_CTES, """select event_id, ts, impact_score, ts::date as date, hour(ts)::int as hour, dayname(ts) as day_of_week from store where ticker = 'AAPL' and impact_score >= 0.4
    and ts >= timestamp '2024-01-01 00:00:00' and ts <= timestamp '2024-01-31 00:00:00'"""), ["event_id", "ts", "date", "hour", "day_of_week"], ["impact_score"]),
)
_add(
    "p13_backtest_dataset",
    lambda s, f: rounded(S.backtest_dataset(_events(s, f), "2024-01-02", "2024-01-28", ["AAPL", "TSLA", "INTC"]).select(
        "event_id", "ts", "ticker", "impact_score", "date", "time", "is_market_hours", "is_weekend")),
    rsql(with_sql(STORE_CTES, """select event_id, ts, ticker, impact_score, ts::date as date, strftime(ts, '%H:%M:%S') as time, hour(ts) between 9 and 16 as is_market_hours,
    isodow(ts) >= 6 as is_weekend from store where ticker in ('AAPL', 'TSLA', 'INTC') and impact_score >= 0.4 and ts >= timestamp '2024-01-02 00:00:00' and ts <= timestamp '2024-01-28 00:00:00'"""),
         ["event_id", "ts", "ticker", "date", "time", "is_market_hours", "is_weekend"], ["impact_score"]),
)
_add(
    "t03_market_moving_events",
    lambda s, f: rounded(S.market_moving(_events(s, f), "2024-01-30 00:00:00", limit=50).select("event_id", "ts", "impact_score")),
    rsql(with_sql(STORE_CTES, """select event_id, ts, impact_score from (select * from store where impact_score >= 0.7 and ts >= timestamp '2024-01-23 00:00:00'
    and ts <= timestamp '2024-01-30 00:00:00' order by ts desc, event_id limit 50) order by impact_score desc, event_id"""), ["event_id", "ts"], ["impact_score"]),
)


def q_counters(spark, folder):
    """Article and event counts per day: the counters of a run as a table."""
    news = derived.news(spark, folder)
    per_day = news.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("articles_processed"))
    found = _events(spark, folder).groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("events_detected"), F.count_if(F.col("impact_score") >= 0.6).alias("high_impact_events"))
    return per_day.join(found, "date", "left").na.fill(0, ["events_detected", "high_impact_events"])


_add(
    "a04_throughput_counters",
    q_counters,
    with_sql(STORE_CTES, """select date, articles_processed, coalesce(events_detected, 0) as events_detected, coalesce(high_impact_events, 0) as high_impact_events
    from (select ts::date as date, count(*) as articles_processed from news group by 1) left join (select ts::date as date, count(*) as events_detected,
    count(*) filter (impact_score >= 0.6) as high_impact_events from store group by 1) using (date)"""),
)

# ------------------------------------------------------------------ news sources

NEWS_COLS = ["doc_id", "ts", "symbol", "lang"]
_add(
    "s02_p07_news_in_range",
    lambda s, f: feeds.between(derived.news(s, f), "ts", "2024-01-10 00:00:00", "2024-01-12 12:00:00").select(*NEWS_COLS),
    with_sql([NEWS], "select doc_id, ts, symbol, lang from news where ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-12 12:00:00'"),
)
_add(
    "s06_news_search",
    lambda s, f: feeds.search_news(derived.news(s, f), "earnings", "2024-01-02", "2024-01-29", "en", 50).select(*NEWS_COLS),
    with_sql([NEWS], """select doc_id, ts, symbol, lang from news where lang = 'en' and contains(lower(title || ' ' || content), 'earnings')
    and ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-29 00:00:00' order by ts desc, doc_id limit 50"""),
)
_add(
    "s08_market_news",
    lambda s, f: feeds.market_news(derived.news(s, f), language=None, page_size=None).select(*NEWS_COLS),
    with_sql([NEWS], f"select doc_id, ts, symbol, lang from news where {_any('lower(title || chr(32) || content)', ['stock market', 'trading', 'finance'])}"),
)


def q_company_news(spark, folder):
    companies = spark.createDataFrame([(a,) for a in lex.ALIASES], "company string")
    return feeds.company_news(derived.news(spark, folder), companies, start="2024-01-03").select("doc_id", "ts", "company")


_add(
    "s07_company_news",
    q_company_news,
    with_sql([NEWS, ART], f"select doc_id, ts, company from art join (select unnest({_list(lex.ALIASES)}) as company) c on contains(low, lower(company)) where ts >= timestamp '2024-01-03 00:00:00'"),
)


def q_union_news(spark, folder):
    news = derived.news(spark, folder)
    market = feeds.market_news(news, language=None, page_size=None)
    return feeds.tag_and_union(market, news.filter(F.col("symbol").isNotNull())).select("doc_id", "symbol")


_add(
    "u04_market_and_company_news",
    q_union_news,
    with_sql([NEWS], f"select doc_id, null::varchar as symbol from news where {_any('lower(title || chr(32) || content)', ['stock market', 'trading', 'finance'])} union all select doc_id, symbol from news where symbol is not null"),
)


def q_coverage(spark, folder):
    universe = derived.read(spark, folder, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("symbol"))
    universe = universe.union(derived.bars(spark, folder).select("symbol")).distinct()
    return feeds.symbol_coverage(universe, derived.bars(spark, folder), "2024-01-30 23:00:00")


def q_uncovered(spark, folder):
    universe = derived.read(spark, folder, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("symbol"))
    universe = universe.union(derived.bars(spark, folder).select("symbol")).distinct()
    return feeds.uncovered(universe, derived.bars(spark, folder))


_UNI = "uni as (select 'S' || p_partkey as symbol from part union select distinct event_type from events)"
_CB = "cb as (select event_type as symbol, date_trunc('hour', ts) as ts from events group by 1, 2)"
_add(
    "s11_s12_symbol_coverage",
    q_coverage,
    with_sql([_UNI, _CB], """select symbol, n10 as bars_10d, n1 as bars_1d, n10 > 0 as has_daily, n1 > 0 as has_minute from (select symbol,
    count(*) filter (ts > timestamp '2024-01-20 23:00:00' and ts <= timestamp '2024-01-30 23:00:00') as n10,
    count(*) filter (ts > timestamp '2024-01-29 23:00:00' and ts <= timestamp '2024-01-30 23:00:00') as n1 from uni left join cb using (symbol) group by 1)"""),
)
_add("s12_uncovered_symbols", q_uncovered, with_sql([_UNI, _CB], "select symbol from uni where symbol not in (select symbol from cb)"))

# ------------------------------------------------------------------ calendar


def _feeds(spark, folder):
    orders = derived.read(spark, folder, "orders")
    base = orders.select(
        F.concat(F.get(F.array(*[F.lit(x) for x in ("AAPL", "tsla", "ETHUSD", "BTCUSD", "USD")]), (F.col("o_custkey") % 5).cast("int"))).alias("symbol"),
        F.col("o_orderdate").alias("event_time"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"),
        F.when(F.col("o_totalprice") > 250000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low").alias("impact_level"),
        (F.col("o_orderkey") % 3).alias("_feed"),
    )
    kind = {0: "earnings", 1: "macro", 2: "token_unlock"}
    return [base.filter(F.col("_feed") == i).drop("_feed").withColumn("event_type", F.lit(k)) for i, k in kind.items()]


CAL = """cal as (select ['AAPL', 'tsla', 'ETHUSD', 'BTCUSD', 'USD'][(o_custkey % 5 + 1)::int] as symbol, o_orderdate as event_time, 'order ' || o_orderkey as description,
 case when o_totalprice > 250000 then 'high' when o_totalprice > 100000 then 'medium' else 'low' end as impact_level,
 case o_orderkey % 3 when 0 then 'earnings' when 1 then 'macro' else 'token_unlock' end as event_type from orders)"""
_AS_OF = "1996-06-15 00:00:00"


def _calendar(spark, folder):
    return S.combine_calendar(*_feeds(spark, folder))


_cal_plain = ["symbol", "event_type", "event_time", "description", "impact_level"]
_add("s09_u01_calendar_union", lambda s, f: _calendar(s, f).select(*_cal_plain), with_sql([CAL], f"select {', '.join(_cal_plain)} from cal"))
_add(
    "p02_p05_p06_upcoming_calendar",
    lambda s, f: rounded(S.calendar_report(S.upcoming(S.current_calendar(_calendar(s, f), _AS_OF), _AS_OF, 72), _AS_OF).select(*_cal_plain, "hours_until", "is_crypto")),
    rsql(with_sql([CAL], f"""select *, (epoch_us(event_time) - epoch_us(timestamp '{_AS_OF}')) / 3.6e9 as hours_until, regexp_matches(upper(symbol), 'BTC|ETH|SOL|ADA|DOT')::int as is_crypto
    from cal where event_time > timestamp '{_AS_OF}' - interval 1 hour and event_time <= timestamp '{_AS_OF}' + interval 72 hour"""), [*_cal_plain, "is_crypto"], ["hours_until"]),
)
_add(
    "p03_p04_calendar_by_symbol_high_impact",
    lambda s, f: S.high_impact_calendar(S.calendar_for_symbol(_calendar(s, f), "TSLA")).select(*_cal_plain),
    with_sql([CAL], f"select {', '.join(_cal_plain)} from cal where upper(symbol) = 'TSLA' and impact_level = 'high'"),
)
