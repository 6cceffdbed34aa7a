"""Feature matrix tools: missing values, importance, summaries, selection and the ML dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.functions.numeric import corr_agg, ratio
from marketframe.operators.ordered import row_chunks, running_last
from marketframe.operators.ranking import exact_quantiles

NOT_FEATURES = {"symbol", "ts", "open", "high", "low", "close", "volume", "target"}
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC and c not in NOT_FEATURES and c not in exclude]


def fill_missing(df: DataFrame, columns: Sequence[str], method: str = "fill", lookahead: bool = False) -> DataFrame:
    """Missing values per symbol: ``fill`` (forward, optionally backward, then 0), ``drop`` or ``interpolate``.

    Backward filling takes values from the future, so it is off unless asked for.
    """
    columns = list(columns)
    if method == "drop":
        return df.dropna(subset=columns)
    if method == "fill":
        out = running_last(row_chunks(df), columns)
        if lookahead:
            out = running_last(row_chunks(out), columns, forward=False)
        return out.na.fill(0.0, columns)
    return interpolate(df, columns).na.fill(0.0, columns)


def interpolate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation over row positions between present values; the last value is held to the end."""
    c = row_chunks(df)
    pos = {f"_at_{x}": F.when(F.col(x).isNotNull(), F.struct(F.col("_rn").alias("r"), F.col(x).alias("v"))) for x in columns}
    placed = c.df.withColumns({**{f"_p_{x}": v for x, v in zip(columns, pos.values())},
                               **{f"_n_{x}": v for x, v in zip(columns, pos.values())}, "_row": F.col("_rn")})
    base = placed.drop("_rn", "_chunk", "_block", "_j", "_own")
    out = running_last(row_chunks(base), [f"_p_{x}" for x in columns])
    out = running_last(row_chunks(out), [f"_n_{x}" for x in columns], forward=False)
    cols = {}
    for x in columns:
        p, n = F.col(f"_p_{x}"), F.col(f"_n_{x}")
        slope = ratio((n["v"] - p["v"]) * (F.col("_row") - p["r"]), n["r"] - p["r"])
        cols[x] = F.coalesce(F.col(x), F.when(n.isNull(), p["v"]).otherwise(p["v"] + slope))
    return out.withColumns(cols).drop("_row", *[f"_p_{x}" for x in columns], *[f"_n_{x}" for x in columns])


def importance(df: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of each feature with the next row's target (long table: feature, corr).

    One aggregation computes every correlation; constant features give 0.
    """
    c = row_chunks(df.select("symbol", "ts", target, *[x for x in columns if x != target]), ahead=2)
    c = c.with_columns({"_y": F.lead(target).over(c.order)})
    sums = c.own().groupBy(*keys).agg(
        *[F.coalesce(corr_agg(F.col(x), F.col("_y")), F.lit(0.0)).alias(f"c_{i}") for i, x in enumerate(columns)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"c_{i}").alias("corr")) for i, x in enumerate(columns)]))
    return sums.select(*keys, rows.alias("_r")).select(*keys, "_r.*")


def top_features(df: DataFrame, columns: Sequence[str], target: str, n: int) -> list[str]:
    """Names of the ``n`` features with the largest absolute correlation (a driver-side list of names)."""
    rows = importance(df, columns, target).orderBy(F.desc(F.abs("corr")), F.asc("feature")).limit(n).collect()
    return [r["feature"] for r in rows]


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and share, min, max and mean per column (long table), one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    n = F.count(F.lit(1))
    return (
        df.select(parts.alias("_t")).groupBy(F.col("_t.feature").alias("feature")).agg(
            n.alias("n_rows"), F.count_if(F.col("_t.v").isNull()).alias("missing"),
            (F.count_if(F.col("_t.v").isNull()) * 100.0 / n).alias("missing_percent"),
            F.min("_t.v").alias("min"), F.max("_t.v").alias("max"), F.avg("_t.v").alias("mean"),
        )
    )


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features with at most one distinct present value."""
    s = summary(df, columns)
    return s.filter(F.col("min").isNull() | (F.col("min") == F.col("max"))).select("feature")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median of every column over the whole table (long table)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(parts.alias("_t")).select("_t.*")
    return exact_quantiles(long, ["feature"], "v", {"median": 0.5})


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace missing values by the column median (one row of medians is attached to the table)."""
    long = medians(df, columns)
    wide = long.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(wide))  # one row
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{i}")) for i, c in enumerate(columns)})
    return out.drop(*[f"_m_{i}" for i in range(len(columns))])


def with_enough_rows(df: DataFrame, minimum: int = 100) -> DataFrame:
    """Rows of symbols that have at least ``minimum`` rows (counted, then joined back)."""
    enough = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum)
    return df.join(enough.select("symbol"), "symbol", "left_semi")


def choose_columns(df: DataFrame, wanted: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """Usable feature columns and the wanted ones that are missing."""
    if wanted is None:
        return numeric_columns(df), []
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """The model's columns in its order: absent ones 0.0, missing values 0.0."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]
    return df.select(*keep, *cols)


def ml_dataset(
    df: DataFrame, target: str = "price_change_pct", horizon: int = 1, features: Sequence[str] | None = None, min_samples: int = 100
) -> DataFrame:
    """symbol, ts, features and the target of ``horizon`` rows later. Missing features stay missing: a fitted pipeline
    fills them with what it saw in training."""
    enough = with_enough_rows(df, min_samples)
    c = row_chunks(enough, ahead=horizon + 1)
    out = c.with_columns({"_target": F.lead(target, horizon).over(c.order)}).own().filter(F.col("_target").isNotNull())
    columns, _ = choose_columns(out.drop("_target"), features)
    return out.select("symbol", "ts", *columns, F.col("_target").alias("target"))


def correlated_features(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Pairs of features with an absolute correlation above the limit (long table a, b, corr).

    The number of pairs is features squared, not rows; all are computed in one aggregation.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(*[corr_agg(F.col(a), F.col(b)).alias(f"c_{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]
    return sums.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*").filter(F.abs("corr") > limit)


def time_split(df: DataFrame, fractions: Sequence[float] = (0.6, 0.8)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows by cut times (lazy: the cuts are a one-row table)."""
    seconds = df.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    cuts = exact_quantiles(seconds, [], "_s", {"_a": fractions[0], "_b": fractions[1]})
    out = seconds.crossJoin(F.broadcast(cuts))  # one row
    part: list[Column] = [F.col("_s") <= F.col("_a"), (F.col("_s") > F.col("_a")) & (F.col("_s") <= F.col("_b")), F.col("_s") > F.col("_b")]
    train, val, test = (out.filter(p).drop("_s", "_a", "_b") for p in part)
    return train, val, test


def stratified_split(df: DataFrame, label: str, key: Sequence[str], fractions: Sequence[float] = (0.6, 0.8)) -> DataFrame:
    """Tag rows train / val / test with the same shares in every label.

    Rows are ordered by 40 bits of the MD5 of their key; the label's exact quantiles of these are the cuts.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 10), 16, 10).cast("double")
    hashed = df.withColumn("_u", u)
    cuts = exact_quantiles(hashed, [label], "_u", {"_a": fractions[0], "_b": fractions[1]})
    out = hashed.join(cuts, label)
    return out.withColumn(
        "split", F.when(F.col("_u") <= F.col("_a"), "train").when(F.col("_u") <= F.col("_b"), "val").otherwise("test")
    ).drop("_u", "_a", "_b")
