"""Helpers that pair a Spark query with its plain SQL statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.sources.derived import HEADLINES, TYPE_CODES

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison between engines.

    The shift moves values that lie exactly between two roundings off the tie, and adding 0
    turns -0 into 0.
    """
    cols = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "double":
            n = special.get(field.name, digits)
            col = (F.round(col + F.lit(_shift(n)), n) + F.lit(0.0)).alias(field.name)
        cols.append(col)
    return df.select(*cols)


def _shift(digits: int) -> float:
    return 0.7310585 * 10.0 ** -(digits + 3)


def rsql(body: str, plain: Sequence[str], doubles: Sequence[str], digits: int = 6, **special: int) -> str:
    """SQL that rounds the given double columns of ``body`` the same way."""
    cols = list(plain)
    for d in doubles:
        n = special.get(d, digits)
        cols.append(f'round("{d}"::double + {_shift(n)!r}::double, {n}) + 0.0::double as "{d}"')
    return f"select {', '.join(cols)} from ({body}) _r"


def with_sql(ctes: Sequence[str], body: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + body


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BARS = """bars as (select event_type as symbol, cast(date_trunc('hour', ts) as timestamp) as ts, min_by(value, (ts, event_id)) as open,
 max(value) as high, min(value) as low, max_by(value, (ts, event_id)) as close, cast(count(*) as double) as volume
 from events group by 1, 2)"""

_TYPES = " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPE_CODES))
DETECTIONS = f"""detections as (select event_id, event_type as symbol, ts,
 case user_id % 9 {_TYPES} end as event_type, least(value / cast(100 as double), cast(1 as double)) as impact_score
 from events)"""

_STEMS = " ".join(f"when {i} then {quoted(h)}" for i, h in enumerate(HEADLINES))
NEWS = f"""news as (select doc_id, timestamp '2024-01-01 00:00:00' + (doc_id % 720) * interval '1' hour as ts,
 (case doc_id % 10 {_STEMS} end) || ' ' || string_split(text, chr(10))[1] as title, text as content, source, lang,
 case doc_id % 6 when 0 then 'click' when 1 then 'view' when 2 then 'purchase' when 3 then 'signup'
 when 4 then 'error' else null end as symbol from documents)"""

FILLS = """fills as (select l_orderkey as order_id, l_linenumber as fill_no, cast(o_custkey % 20 as varchar) as portfolio,
 o_orderdate as ts, cast(l_partkey % 50 as varchar) as symbol,
 case when l_returnflag = 'R' then 'sell' else 'buy' end as side, l_quantity as quantity,
 l_extendedprice / l_quantity as price, l_extendedprice * cast(0.001 as double) as commission
 from lineitem join orders on l_orderkey = o_orderkey)"""

ORDER_LOG = """order_log as (select o_orderkey as order_id, cast(o_custkey % 20 as varchar) as portfolio,
 o_orderdate as created_at, case o_orderstatus when 'F' then 'filled' when 'P' then 'partially_filled'
 else 'submitted' end as status, o_totalprice as order_value, o_custkey as signal_id from orders)"""

LATENCY = """latency as (select event_id, user_id as order_id, case event_type when 'click' then 'signal_to_order'
 when 'view' then 'order_submission' when 'purchase' then 'broker_response' when 'signup' then 'end_to_end'
 else 'network_rtt' end as metric, ts, value as latency_ms from events)"""

PREDICTIONS = """predictions as (select event_id as pred_id, event_type as asset_id, ts,
 'm' || cast(user_id % 3 as varchar) as model_id, cast(event_id % 1000 as double) / cast(1000 as double) as prediction_value,
 cast(0.5 as double) + cast(user_id % 50 as double) / cast(100 as double) as confidence, value from events)"""
