"""Null-safe arithmetic shared by all operators.

Missing values are NULL throughout (never NaN: Spark sorts NaN above every number), a
comparison with a missing value is a 0 flag, and division by zero is NULL instead of an
ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def us(ts: Column | str) -> Column:
    """Microseconds since the epoch of a UTC timestamp (zoned or not)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def day_number(ts: Column | str) -> Column:
    """Days since the epoch."""
    return F.unix_date((F.col(ts) if isinstance(ts, str) else ts).cast("date"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den, NULL when den is 0 or either side is missing."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def flag(cond: Column) -> Column:
    """0/1 integer; a missing condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clamp(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lit_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def corr_agg(x: Column, y: Column) -> Column:
    """Aggregate (or window-less) correlation over rows where both sides are present."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(den > 1e-300, den))


def truncated(text: Column, limit: int) -> Column:
    """First ``limit`` characters followed by ``...`` when the text is longer."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


#: Parts of one in which values are summed exactly.
PARTS = 1e12


def whole(value: Column) -> Column:
    """A value in parts of 1e-12 as a whole number: sums of such numbers are exact in any order."""
    return F.round(value * PARTS).cast("decimal(38,0)")


def millis(micros: Column) -> Column:
    """Time in milliseconds since 2000 as a whole number."""
    return (F.floor(micros / 1000) - 946_684_800_000).cast("decimal(38,0)")


def centred(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Sum of (x - mean)(y - mean) from whole sums, as a double. The means' whole parts are taken off before anything is
    rounded, so a constant series gives exactly 0; NULL without rows."""
    some = F.when(n > 0, n).cast("decimal(38,0)")
    mx, my = (F.floor(F.try_divide(s.cast("double"), some.cast("double"))).cast("decimal(38,0)") for s in (sx, sy))
    about = sxy - mx * sy - my * sx + some * mx * my
    return about.cast("double") - (sx - some * mx).cast("double") * (sy - some * my).cast("double") / some.cast("double")
