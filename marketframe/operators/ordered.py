"""Ordered per-key computation that survives one key holding most of the rows.

``Window.partitionBy("symbol")`` puts a whole symbol into one task. Here the rows of a key
are numbered with two balanced shuffles and cut into chunks of a fixed number of rows; each
chunk starts with a copy of the last ``halo`` rows of the chunk before it (and, for forward
looking windows, ends with the first ``ahead`` rows of the next). Any frame that reaches at
most ``halo`` rows back is then exact inside the chunk, and no task ever holds more than
``chunk_rows + halo + ahead`` rows whatever the key distribution. Running totals use the
chunk totals, a table with one row per chunk, as carry-in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketframe.functions.numeric import MICROS_PER_DAY, us

BLOCK = 1024
CHUNK_ROWS = 64 * BLOCK


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie: Sequence[str] = (),
    bucket_us: int = MICROS_PER_DAY,
    tasks: int | None = None,
) -> DataFrame:
    """Add ``_rn``: the 0-based position of the row within its key in (ts, tie) order.

    Rows are ordered inside (key, time bucket) groups; the offset of a bucket is the running
    total of the bucket counts, which is a table of keys x buckets. With ``tasks`` the rows are
    ordered by so many tasks, whatever the session makes of small shuffles.
    """
    df = df.withColumn("_bucket", F.floor(us(ts) / F.lit(bucket_us)))
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tie)
    df = df.repartition(tasks, *keys, "_bucket") if tasks else df
    return (
        df.join(offsets, [*keys, "_bucket"])
        .withColumn("_rn", F.col("_base") + F.row_number().over(inside) - F.lit(1))
        .drop("_bucket", "_base")
    )


@dataclass(frozen=True)
class Chunks:
    """Rows cut into overlapping chunks. ``df`` carries _rn, _chunk, _block, _j and _own."""

    df: DataFrame
    keys: tuple[str, ...]

    def with_columns(self, columns: dict[str, Column]) -> Chunks:
        return Chunks(self.df.withColumns(columns), self.keys)

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_chunk").orderBy("_block", "_rn")

    def last_rows(self, width: int) -> WindowSpec:
        """Frame of the current row and the width-1 rows before it."""
        return self.order.rowsBetween(-(width - 1), 0)

    def own(self) -> DataFrame:
        """The chunk's own rows: overlap rows and helper columns removed."""
        return self.df.filter("_own").drop("_rn", "_chunk", "_block", "_j", "_own")


def row_chunks(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    tie: Sequence[str] = (),
    halo: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    bucket_us: int = MICROS_PER_DAY,
    tasks: int | None = None,
) -> Chunks:
    """Cut the ordered rows of every key into chunks of ``chunk_rows`` with overlap; ``tasks`` as for ``number_rows``."""
    chunk_rows = max(chunk_rows, BLOCK * math.ceil(max(halo, ahead, 1) / BLOCK))
    numbered = number_rows(df, keys, ts, tie, bucket_us, tasks)
    home = F.floor(F.col("_rn") / F.lit(chunk_rows))
    pos = F.col("_rn") % F.lit(chunk_rows)
    targets = [home]
    if halo:
        targets.append(F.when(pos >= chunk_rows - halo, home + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (home > 0), home - 1))
    placed = numbered.withColumn("_home", home)
    if len(targets) == 1:
        placed = placed.withColumn("_chunk", F.col("_home"))
    else:
        placed = placed.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
    placed = placed.withColumns(
        {
            "_own": F.col("_chunk") == F.col("_home"),
            "_block": F.floor(F.col("_rn") / F.lit(BLOCK)),
            "_j": (F.col("_rn") % F.lit(BLOCK)).cast("double"),
        }
    ).drop("_home")
    placed = placed.repartition(tasks, *keys, "_chunk") if tasks else placed
    return Chunks(placed, tuple(keys))


def rolling(chunks: Chunks, value: Column, width: int, agg=F.avg) -> Column:
    """Aggregate of the last ``width`` rows; NULL unless all of them are present."""
    frame = chunks.last_rows(width)
    return F.when(F.count(value).over(frame) == width, agg(value).over(frame))


def ewm_halo(span: int) -> int:
    """Rows of history after which the weight of an exponential mean is below double precision."""
    return BLOCK * _blocks_back(1.0 - 2.0 / (span + 1.0))


def decayed_sum(chunks: Chunks, value: Column, decay: float, hold: int = 0) -> Column:
    """Sum over the rows i up to the current row t of value_i * decay^(t - i).

    Inside a block the sum is decay^j times the running sum of value * decay^-j'; preceding
    blocks contribute their totals decayed by whole blocks. Each row costs constant work:
    there is no per-row history array and no Python. With ``hold`` the rows before position
    ``hold`` of the key count as if they sat at that position (a smoothing started by a plain
    sum of its first rows).
    """
    if decay <= 0:
        return F.coalesce(value.cast("double"), F.lit(0.0))
    blocks_back = _blocks_back(decay)
    size = _block_rows(decay)
    block = F.col("_block") if size == BLOCK else F.floor(F.col("_rn") / F.lit(size))
    inside = (
        Window.partitionBy(*chunks.keys, "_chunk", block)
        .orderBy("_rn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = Window.partitionBy(*chunks.keys, "_chunk").orderBy(block)
    j = F.col("_j") if size == BLOCK else (F.col("_rn") % F.lit(size)).cast("double")
    at = F.when(F.col("_rn") < hold, F.lit(float(hold))).otherwise(j) if hold else j
    term = value.cast("double") * F.pow(F.lit(1.0 / decay), at)
    total = F.pow(F.lit(decay), j) * F.coalesce(F.sum(term).over(inside), F.lit(0.0))
    for back in range(1, blocks_back + 1):
        earlier = F.sum(term).over(across.rangeBetween(-back, -back))
        total = total + F.pow(F.lit(decay), j + F.lit(float(back * size))) * F.coalesce(earlier, F.lit(0.0))
    return total


def _block_rows(decay: float) -> int:
    """Rows of a block: as many as keep decay^-rows far below the largest double."""
    return min(BLOCK, max(1, int(600.0 / -math.log(decay))))


def _blocks_back(decay: float) -> int:
    if decay <= 0:
        return 1
    return max(1, math.ceil(math.log(1e-17) / math.log(decay) / _block_rows(decay)))


def ewm(chunks: Chunks, value: Column, span: int) -> Column:
    """Exponential mean with normalised weights (1-a)^i, a = 2/(span+1)."""
    decay = 1.0 - 2.0 / (span + 1.0)
    weight = F.when(value.isNotNull(), F.lit(1.0))
    return F.try_divide(decayed_sum(chunks, value, decay), decayed_sum(chunks, weight, decay))


def wilder(chunks: Chunks, value: Column, period: int, first: int) -> Column:
    """Wilder mean: plain mean of the ``period`` values up to row ``first``, then (prev*(n-1)+x)/n."""
    mean = decayed_sum(chunks, value, 1.0 - 1.0 / period, hold=first) / period
    return F.when(F.col("_rn") >= first, mean)


def running_sums(chunks: Chunks, columns: dict[str, Column]) -> DataFrame:
    """Own rows plus a running total per key for each column (NULL terms leave NULL rows)."""
    terms = {f"_term_{name}": col for name, col in columns.items()}
    df = chunks.df.filter("_own").withColumns(terms)
    group = [*chunks.keys, "_chunk"]
    totals = df.groupBy(*group).agg(*[F.sum(f"_term_{n}").alias(f"_sum_{n}") for n in columns])
    before = Window.partitionBy(*chunks.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*group, *[F.sum(f"_sum_{n}").over(before).alias(f"_carry_{n}") for n in columns])
    inside = chunks.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({f"_part_{n}": F.sum(f"_term_{n}").over(inside) for n in columns}).join(carry, group)
    out = out.withColumns(
        {
            n: F.when(
                F.col(f"_term_{n}").isNotNull(), F.col(f"_part_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
            )
            for n in columns
        }
    )
    helpers = [f"{p}{n}" for p in ("_term_", "_part_", "_carry_") for n in columns]
    return out.drop(*helpers, "_rn", "_chunk", "_block", "_j", "_own")


def running_max(df: DataFrame, keys: Sequence[str], columns: dict[str, Column], ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Running maximum per key of each column, with chunk maxima as carry-in."""
    c = row_chunks(df, keys, ts, tie)
    terms = c.df.withColumns({f"_term_{n}": col for n, col in columns.items()})
    group = [*keys, "_chunk"]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = terms.groupBy(*group).agg(*[F.max(f"_term_{n}").alias(f"_top_{n}") for n in columns])
    carry = tops.select(*group, *[F.max(f"_top_{n}").over(before).alias(f"_carry_{n}") for n in columns])
    inside = c.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = terms.withColumns({f"_part_{n}": F.max(f"_term_{n}").over(inside) for n in columns}).join(carry, group)
    out = out.withColumns({n: F.greatest(f"_part_{n}", f"_carry_{n}") for n in columns})
    helpers = [f"{p}{n}" for p in ("_term_", "_part_", "_carry_") for n in columns]
    return out.drop(*helpers, "_rn", "_chunk", "_block", "_j", "_own")


def running_last(chunks: Chunks, columns: Sequence[str], forward: bool = True) -> DataFrame:
    """Own rows with missing values filled from the previous (or, backwards, the next) present value."""
    df = chunks.df.filter("_own")
    group = [*chunks.keys, "_chunk"]
    if forward:
        step = Window.partitionBy(*chunks.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        inside = chunks.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = F.max_by
    else:
        step = Window.partitionBy(*chunks.keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        inside = (
            Window.partitionBy(*chunks.keys, "_chunk")
            .orderBy(F.desc("_rn"))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        edge = F.min_by
    edges = df.groupBy(*group).agg(
        *[edge(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_edge_{c}") for c in columns]
    )
    carry = edges.select(
        *group, *[F.last(f"_edge_{c}", ignorenulls=True).over(step).alias(f"_carry_{c}") for c in columns]
    )
    filled = df.withColumns({f"_fill_{c}": F.last(c, ignorenulls=True).over(inside) for c in columns})
    out = filled.join(carry, group)
    out = out.withColumns({c: F.coalesce(f"_fill_{c}", f"_carry_{c}") for c in columns})
    helpers = [f"{p}{c}" for p in ("_fill_", "_carry_") for c in columns]
    return out.drop(*helpers, "_rn", "_chunk", "_block", "_j", "_own")
