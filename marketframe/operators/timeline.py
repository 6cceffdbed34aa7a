"""Range windows and as-of lookups over two time-ordered tables, whatever key or time holds most of the rows.

Rows of both tables are range-partitioned together by (key, time), so that pieces have about the same number of rows: a
hot key or a hot day falls into many pieces. What a piece needs of the pieces before or after it are a few carried
rows: running sums, the last event before it, the first event after it.

Window sums over [t - d, t] are a sweep: an event adds its value at its own time u and takes it off again after u + d, so
a window sum is one running sum over growing frames, and a bar costs the same for a day as for a month. Extremes divide
time into blocks as long as the window, which then spans two of them at most: the running extreme of the bar's block, and
the extreme from t - d to the end of the block before, which the first event that leaves after t knows.

Where events are many times the bars, those between two times at which a bar's windows begin or end count for the same
bars. They are folded to one event (sums, extremes, first and last of them) before the sweep, which then grows with the
bars; the events themselves move and are sorted once, in narrow rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from marketframe.functions.numeric import MICROS_PER_DAY, us
from marketframe.operators.lineage import cut

#: Rows of a piece: a task holds one piece, so its memory does not grow with the table.
PIECE_ROWS = 100_000
#: With so many events for a bar, events that count for the same bars are summed first.
FOLD_FROM = 16
#: Before and after all times.
_FIRST, _LAST = -(1 << 62), 1 << 62


def by_rows(df: DataFrame, keys: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` (with a time ``_us``) with ``_piece``: consecutive ranges of (keys, _us) of about equal numbers of rows.

    Rows of one key and instant share a piece. Unless given, the number of pieces follows from the rows: one that the
    session is free to choose would be cut down to a few pieces that grow with the table. The table is stored, because a
    range belongs to the sample it was drawn from.
    """
    order = [*keys, "_us"]
    pieces = pieces or pieces_of(df.select(*order).count())
    return cut(df.repartitionByRange(pieces, *order).withColumn("_piece", F.spark_partition_id()))


def pieces_of(rows: int) -> int:
    """Number of pieces, or of tasks that sort, for so many rows."""
    return max(1, -(-rows // PIECE_ROWS))


def _spread(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows with a task for each piece of ``stored``, so that windows over pieces sort one at a time."""
    return rows.repartitionById(max(1, stored.rdd.getNumPartitions()), "_piece")


def _over_pieces(keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """All pieces of the key before, and all after; there is one row per piece."""
    order = Window.partitionBy(*keys).orderBy("_piece")
    return order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)


class RangeTimeline:
    """Bars and events in one order. Ask for window sums (:meth:`total`), extremes (:meth:`lowest`, :meth:`highest`) and
    neighbours (:meth:`previous`, :meth:`next`) first, then evaluate them with :meth:`bars`.

    ``payload`` are event columns that sums and extremes may use; ``values`` (with ``tie`` as order among equal times)
    come with the neighbours. Windows are closed; events at the bar's own time count. An event whose values are wide (an
    array) takes the place of ``weight`` rows of a piece. Unless given, ``fold`` follows from the numbers of rows.
    """

    def __init__(
        self,
        bars: DataFrame,
        events: DataFrame,
        keys: Sequence[str],
        payload: Sequence[str],
        values: Sequence[str] = (),
        tie: Sequence[str] = (),
        pieces: int | None = None,
        weight: int = 1,
        fold: bool | None = None,
    ):
        self.keys, self.payload, self.pieces, self.weight = list(keys), list(payload), pieces, weight
        self._bars = bars
        timed = events.withColumn("_us", us("ts")).filter(F.col("_us").isNotNull())
        near = [F.struct(F.col("_us").alias("us"), *[F.col(c) for c in [*tie, *values]]).alias("_e")] if values else []
        self._events = timed.select(*self.keys, "_us", *payload, *near)
        self._near = bool(values)
        self._sums: dict[tuple[str, int, int], tuple[str, Column, DataType | None]] = {}
        self._extremes: dict[int, list[str]] = {}
        self._next = False
        self._counts = None if pieces else (self._events.count(), bars.count())
        self._fold = fold if fold is not None else bool(self._counts) and self._counts[0] > FOLD_FROM * self._counts[1]
        #: of folded events: the columns that have the sums of values, and the first event
        self._folded: dict[str, tuple[str, Column, DataType]] = {}
        self._first = "_f" if self._fold else "_e"

    def _upto(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_piece").orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def _later(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_piece").orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, -1)

    def total(self, value: Column, days: float) -> Column:
        """Sum of ``value`` in [t - days, t], 0 without any. Exact for whole and decimal numbers."""
        width = int(days * MICROS_PER_DAY)
        return self._sum(value, 0, width)

    def day_total(self, value: Column, days: int = 0) -> Column:
        """Sum of ``value`` over the events of one calendar day: that of t up to t, or with ``days`` that of t - days before
        t - days. Here an event is taken off at the midnight after it."""
        width = int(days * MICROS_PER_DAY)
        return self._sum(value, width, -width - 1)

    def _sum(self, value: Column, enter: int, leave: int) -> Column:
        known = str(value._jc.toString()), enter, leave
        if known not in self._sums:
            value, kind = self._once(value) if self._fold else (value, None)
            moved = F.when(F.col("_off") == enter, value).when(F.col("_off") == leave, -value)
            self._sums[known] = f"_c{len(self._sums)}", moved, kind
        name, moved, kind = self._sums[known]
        total = F.sum(F.coalesce(F.col(name), moved)).over(self._upto())
        return F.coalesce(total.cast(kind) if kind else total, F.lit(0))

    def _once(self, value: Column) -> tuple[Column, DataType]:
        """The folded sums of a value, and the type that its sum has."""
        name, _, kind = self._folded.setdefault(
            str(value._jc.toString()), (f"_v{len(self._folded)}", value, self._events.select(F.sum(value)).schema[0].dataType)
        )
        return F.col(name), kind

    def _extreme(self, column: str, days: float, side: str) -> Column:
        width = int(days * MICROS_PER_DAY)
        wanted = self._extremes.setdefault(width, [])
        if column not in wanted:
            wanted.append(column)
        block = F.floor(F.col("_us") / F.lit(width))
        tail, head = F.col("_tail"), F.col(f"_head{width}")
        own = F.when(tail[f"b{width}"] == block, tail[f"{side}_{column}_{width}"])
        before = F.when(head["b"] == block - 1, head[f"{side}_{column}"])
        return (F.least if side == "lo" else F.greatest)(own, before)

    def lowest(self, column: str, days: float) -> Column:
        """Smallest value of a payload column in [t - days, t], NULL without any."""
        return self._extreme(column, days, "lo")

    def highest(self, column: str, days: float) -> Column:
        return self._extreme(column, days, "hi")

    def previous(self) -> Column:
        """Struct of the last event at or before the row's time."""
        return F.col("_before")

    def next(self) -> Column:
        """Struct of the first event strictly after the row's time."""
        self._next = True
        return F.col("_after")

    def _with_extremes(self, events: DataFrame, pieces: int) -> DataFrame:
        """Events with the extremes of their block up to them (struct _p of all windows) and from them on (one struct
        _s... for each window)."""
        blocks = {w: F.floor(F.col("_us") / F.lit(w)) for w in self._extremes}
        stored = by_rows(events, self.keys, pieces)
        rows = stored.withColumns({f"_b{w}": b for w, b in blocks.items()})
        # the last block of a piece with its extremes there, and the first: what neighbouring pieces have to know
        ends = {}
        for w, columns in self._extremes.items():
            for c in columns:
                for side, value in (("hi", F.col(self._side(c, "hi"))), ("lo", -F.col(self._side(c, "lo")))):
                    present = F.when(value.isNotNull(), F.struct(F.col(f"_b{w}").alias("b"), value.alias("v")))
                    absent = F.when(value.isNotNull(), F.struct(F.col(f"_b{w}").alias("b"), (-value).alias("v")))
                    ends[f"_p_{side}_{c}_{w}"] = F.max(present), F.max, 0
                    ends[f"_s_{side}_{c}_{w}"] = F.min(absent), F.min, 1
        sides = _over_pieces(self.keys)
        carried = rows.groupBy(*self.keys, "_piece").agg(*[agg.alias(n) for n, (agg, _, _) in ends.items()])
        carried = carried.withColumns({n: pick(n).over(sides[which]) for n, (_, pick, which) in ends.items()})
        names = {k: f"_k{i}" for i, k in enumerate([*self.keys, "_piece"])}
        carried = carried.withColumnsRenamed(names)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        # no sort of the rows for this join: the other side has one row for each piece of a key
        rows = _spread(rows.join(carried.hint("shuffle_hash"), same, "left").drop(*names.values()), stored)
        out = {}
        prefix, suffix = [F.col("_us").alias("us")], {}
        for w, columns in self._extremes.items():
            segment = Window.partitionBy(*self.keys, "_piece", f"_b{w}")
            growing = segment.orderBy("_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            falling = segment.orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            prefix.append(F.col(f"_b{w}").alias(f"b{w}"))
            suffix[w] = [(F.col("_us") + w + 1).alias("us"), F.col(f"_b{w}").alias("b")]
            for c in columns:
                for side, pick, most in (("hi", F.max, F.greatest), ("lo", F.min, F.least)):
                    sign = 1 if side == "hi" else -1
                    for tag, frame, flip in (("_p", growing, sign), ("_s", falling, -sign)):
                        carry = F.col(f"{tag}_{side}_{c}_{w}")
                        known = F.when(carry["b"] == F.col(f"_b{w}"), carry["v"] * flip)
                        out[f"{tag}{side}_{c}_{w}"] = most(pick(self._side(c, side)).over(frame), known)
                    prefix.append(F.col(f"_p{side}_{c}_{w}").alias(f"{side}_{c}_{w}"))
                    suffix[w].append(F.col(f"_s{side}_{c}_{w}").alias(f"{side}_{c}"))
        rows = rows.withColumns(out)
        return rows.select(*events.columns, F.struct(*prefix).alias("_p"), *[F.struct(*s).alias(f"_s{w}") for w, s in suffix.items()])

    def _side(self, column: str, side: str) -> str:
        return f"_{side}_{column}" if self._fold else column

    def _together(self, offsets: Sequence[int]) -> DataFrame:
        """Events folded over the times between which no window of a bar begins or ends: the sums of the values, extremes,
        last and first event, at the time of the last. A piece folds its own."""
        at, day = us("ts"), F.lit(MICROS_PER_DAY)
        # the last time from which an event's row of this offset comes at or before the bar
        last = [at if w == 0 else at - w - 1 if w > 0 else F.floor((at + w + 1) / day) * day - 1 for w in offsets]
        limits = self._bars.select(*self.keys, F.explode(F.array(*[x.cast("long") for x in last])).alias("_us")).filter(F.col("_us").isNotNull()).distinct()
        both = self._events.withColumn("_limit", F.lit(False)).unionByName(limits.withColumn("_limit", F.lit(True)), allowMissingColumns=True)
        stored = by_rows(both, self.keys, self.pieces or pieces_of(self._counts[0] * self.weight))
        behind = Window.partitionBy(*self.keys, "_piece").orderBy(F.col("_us").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        rows = _spread(stored, stored).withColumn("_cell", F.min(F.when(F.col("_limit"), F.col("_us"))).over(behind)).filter(~F.col("_limit"))
        folds = [F.max("_us").alias("_us"), *[F.sum(value).alias(name) for name, value, _ in self._folded.values()]]
        for column in dict.fromkeys(c for asked in self._extremes.values() for c in asked):
            folds += [F.max(column).alias(self._side(column, "hi")), F.min(column).alias(self._side(column, "lo"))]
        folds += [F.max("_e").alias("_e")] if self._near else []
        folds += [F.min("_e").alias("_f")] if self._next else []
        return cut(rows.groupBy(*self.keys, "_piece", "_cell").agg(*folds).drop("_piece", "_cell"))

    def bars(self, columns: dict[str, Column]) -> DataFrame:
        """Bar rows with the asked-for expressions evaluated."""
        # a row for each time at which an event counts: its own, those at which it leaves a window, and midnights
        offsets = {0} | {w for known in self._sums for w in known[1:]} | set(self._extremes)
        pieces, most = self.pieces, self.pieces
        near = ["_e"] * self._near + ["_f"] * (self._fold and self._next)
        payload = [name for name, _, _ in self._folded.values()] if self._fold else self.payload
        events = self._together(sorted(offsets)) if self._fold else self._events
        if not pieces:
            count = events.count() if self._fold else self._counts[0]
            pieces, most = pieces_of(count * self.weight), pieces_of(count * (self.weight + len(offsets)) + self._counts[1])
        events = self._with_extremes(events, pieces) if self._extremes else events
        events = events.select("*", F.explode(F.array(*[F.lit(w).cast("long") for w in sorted(offsets)])).alias("_off"))
        enters = F.col("_off") == 0
        keep = [F.when(enters, F.col(c)).alias(c) for c in near + (["_p"] if self._extremes else [])]
        keep += [F.when(F.col("_off") == w, F.col(f"_s{w}")).alias(f"_s{w}") for w in self._extremes]
        midnight = (F.floor(F.col("_us") / F.lit(MICROS_PER_DAY)) + 1) * MICROS_PER_DAY
        at = F.when(enters, F.col("_us")).when(F.col("_off") > 0, F.col("_us") + F.col("_off") + 1).otherwise(midnight - F.col("_off") - 1)
        events = events.select(*self.keys, at.alias("_us"), "_off", *payload, *keep)
        bars = self._bars.withColumn("_us", us("ts")).withColumn("_bar", F.lit(True))
        stored = rows = by_rows(bars.unionByName(events.withColumn("_bar", F.lit(False)), allowMissingColumns=True), self.keys, most)

        sums = list(self._sums.values())
        aggs = [F.sum(moved).alias(name) for name, moved, _ in sums]
        aggs += [F.max("_e").alias("_e")] if self._near else []
        aggs += [F.min(self._first).alias("_f")] if self._next else []
        aggs += [F.max("_p").alias("_p")] if self._extremes else []
        aggs += [F.min(f"_s{w}").alias(f"_s{w}") for w in self._extremes]
        aggs = aggs or [F.lit(0).alias("_none")]
        before, after = _over_pieces(self.keys)
        edge = rows.groupBy(*self.keys, "_piece").agg(*aggs)
        start = [F.sum(name).over(before).alias(name) for name, _, _ in sums]
        start += [F.max("_e").over(before).alias("_e")] if self._near else []
        start += [F.max("_p").over(before).alias("_p")] if self._extremes else []
        end = [F.min("_f").over(after).alias(self._first)] if self._next else []
        end += [F.min(f"_s{w}").over(after).alias(f"_s{w}") for w in self._extremes]
        for time, carried in ((_FIRST, start), (_LAST, end)):
            if carried:
                carried = edge.select(*self.keys, "_piece", F.lit(time).cast("long").alias("_us"), F.lit(False).alias("_bar"), *carried)
                rows = rows.unionByName(carried, allowMissingColumns=True)
        rows = _spread(rows, stored)
        upto, later = {}, {}
        if self._near:
            upto["_before"] = F.max("_e").over(self._upto())
        if self._next:
            later["_after"] = F.min(self._first).over(self._later())
        if self._extremes:
            upto["_tail"] = F.max("_p").over(self._upto())
            later |= {f"_head{w}": F.min(f"_s{w}").over(self._later()) for w in self._extremes}
        # what comes later first, so that rows are sorted again before the many sums and not with them; what is asked for
        # may combine neighbours and sums
        asked = {f"_x{i}": column for i, column in enumerate(columns.values())}
        for found in (later, upto):
            rows = rows.withColumns(found) if found else rows
        out = rows.withColumns(asked).filter("_bar")
        return out.select(*self._bars.columns, *[F.col(x).alias(name) for x, name in zip(asked, columns)])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    name: str,
    tie: Sequence[str] = (),
    offset_days: float = 0.0,
    offset_us: int = 0,
    direction: str = "backward",
    pieces: int | None = None,
) -> DataFrame:
    """Left rows plus struct ``name`` (us, tie..., values...) of the matching right row, or NULL.

    backward: last right row at or before ``ts - offset``; forward: first right row strictly
    after ``ts + offset``. Rows with equal times are decided by ``tie`` (the highest wins).
    """
    keys = list(keys)
    shift = int(offset_days * MICROS_PER_DAY) + offset_us
    back = direction == "backward"
    pick = F.max if back else F.min
    packed = F.struct(F.col("_us").alias("us"), *[F.col(c) for c in [*tie, *values]])
    probe = left.withColumn("_us", us("ts") + F.lit(-shift if back else shift)).withColumn("_probe", F.lit(True))
    events = right.withColumn("_us", us("ts")).filter(F.col("_us").isNotNull()).select(*keys, "_us", packed.alias("_e"))
    stored = rows = by_rows(probe.unionByName(events.withColumn("_probe", F.lit(False)), allowMissingColumns=True), keys, pieces)
    before, after = _over_pieces(keys)
    edge = rows.groupBy(*keys, "_piece").agg(pick("_e").alias("_e"))
    time = F.lit(_FIRST if back else _LAST).cast("long")
    carried = edge.select(*keys, "_piece", time.alias("_us"), F.lit(False).alias("_probe"), pick("_e").over(before if back else after).alias("_e"))
    rows = _spread(rows.unionByName(carried, allowMissingColumns=True), stored)
    order = Window.partitionBy(*keys, "_piece").orderBy(F.col("_us") if back else F.col("_us").desc())
    frame = order.rangeBetween(Window.unboundedPreceding, Window.currentRow if back else -1)
    return rows.withColumn(name, pick("_e").over(frame)).filter("_probe").select(*left.columns, name)
