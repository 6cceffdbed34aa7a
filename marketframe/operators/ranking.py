"""Top-k and exact quantiles without collecting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.operators.lineage import cut


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of every key in the given total order.

    Rows compete inside (key, salt) first, so the last step sees at most salts * k rows of a
    key. With no keys Spark's own top-k (ordered limit) is used.
    """
    if not keys:
        out = df.orderBy(*order).limit(k)
        return out.withColumn(rank, F.row_number().over(Window.orderBy(*order))) if rank else out
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in _hashable(df)]), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    second = Window.partitionBy(*keys).orderBy(*order)
    out = kept.drop("_salt", "_rank").withColumn("_rank", F.row_number().over(second)).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


#: Bits of a value that one round of the selection fixes.
DIGIT = 16


def ordered_bits(value: Column) -> Column:
    """A double as a long in the same order: exponent and fraction in one number, negative for negative values. Both
    zeros are 0, NaN is above infinity."""
    size = F.abs(value)
    # floor(log2) may be off by one next to a power of two
    guess = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    scaled = size * F.pow(F.lit(2.0), -guess)
    exponent = F.greatest(guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0), F.lit(-1022))
    fraction = (size * F.pow(F.lit(2.0), -exponent) - 1) * float(1 << 52)
    bits = (exponent + 1023) * (1 << 52) + fraction.cast("long")
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits).cast("long")
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -bits).otherwise(bits)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = 10_000,
    interpolate: bool = True,
) -> DataFrame:
    """One row per key with exact quantiles, named by ``probs``; missing values do not count.

    A radix selection for all keys and ranks at once: values become ordered 64-bit numbers; each round counts the rows
    by the next 16 bits, within the leading bits that a wanted rank was found to have, and so finds 16 bits more. Rows
    meet one leading part at most and are neither repeated nor sorted; histograms have 65,536 rows for each part. Parts
    of at most ``accuracy`` rows are looked up directly. With ``interpolate`` the value lies linearly between the two
    closest ranks, otherwise it is the value at rank floor(p * n), limited to the last one.
    """
    keys = list(keys)
    group = F.struct(*keys) if keys else F.lit(0)
    data = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    data = cut(data.withColumn("k", ordered_bits(F.col("v"))))
    places = [
        (F.col("n") - 1) * F.lit(p) if interpolate else F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1).cast("double")
        for p in probs.values()
    ]
    places = [F.when(F.abs(h - F.round(h)) < 1e-9, F.round(h)).otherwise(h) for h in places]
    ranks = [F.struct(F.lit(2 * i + side).alias("id"), (F.floor, F.ceil)[side](h).alias("rank")) for i, h in enumerate(places) for side in (0, 1)]

    def parts(histogram: DataFrame, within: list[str], wanted: Column) -> DataFrame:
        """The parts of a histogram (within..., p, c, v) that hold wanted ranks, with the ranks inside them."""
        upto = Window.partitionBy(*within).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        before = F.sum("c").over(upto) - F.col("c")
        placed = histogram.withColumn("before", before)
        inside = F.filter(wanted, lambda w: (w["rank"] >= F.col("before")) & (w["rank"] < F.col("before") + F.col("c")))
        inside = F.transform(inside, lambda w: F.struct(w["id"].alias("id"), (w["rank"] - F.col("before")).alias("rank")))
        return cut(placed.select("g", "n", "p", "c", "v", inside.alias("w")).filter(F.size("w") > 0))

    shift = 64 - DIGIT
    counted = data.groupBy("g", F.shiftright("k", shift).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
    counted = counted.withColumn("n", F.sum("c").over(Window.partitionBy("g")))
    found = parts(counted, ["g"], F.array(*ranks))
    while shift and (found.agg(F.max("c")).first()[0] or 0) > accuracy:
        open_ = found.select("g", F.col("p").alias("outer"), F.col("n"), "w")
        inner = data.withColumn("outer", F.shiftright("k", shift)).join(open_.select("g", "outer"), ["g", "outer"])
        shift -= DIGIT
        counted = inner.groupBy("g", "outer", F.shiftright("k", shift).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("v"))
        found = parts(counted.join(open_, ["g", "outer"]), ["g", "outer"], F.col("w"))
    if shift:
        rows = data.withColumn("p", F.shiftright("k", shift)).join(found.select("g", "p"), ["g", "p"])
        listed = rows.groupBy("g", "p").agg(F.sort_array(F.collect_list("v")).alias("values"))  # accuracy rows at most
        found = found.join(listed, ["g", "p"]).withColumn("x", F.expr("transform(w, e -> struct(e.id as id, get(values, int(e.rank)) as v))"))
    else:
        found = found.withColumn("x", F.expr("transform(w, e -> struct(e.id as id, v as v))"))
    # one row per key: at most two values for each wanted quantile
    per_key = found.groupBy("g").agg(F.first("n").alias("n"), F.map_from_entries(F.flatten(F.collect_list("x"))).alias("values"))
    out = {}
    for i, (name, h) in enumerate(zip(probs, places)):
        low, high, f = F.col("values")[2 * i], F.col("values")[2 * i + 1], h - F.floor(h)
        between = F.when(f < 0.5, low + (high - low) * f).otherwise(high - (high - low) * (1 - f))
        out[name] = F.when(low == high, low).otherwise(between)
    return per_key.select(*([F.col("g")[k].alias(k) for k in keys]), *[c.alias(name) for name, c in out.items()])
