"""Portfolio allocation of signals, for all runs at once.

Every cap is a group total joined back to its signals, so a run of any size is summed with
partial aggregation and never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.functions.numeric import corr_agg, lit_map, ratio, zero
from marketframe.operators.lineage import cut

# Allocation limits.
MAX_EXPOSURE, SECTOR_CAP, TYPE_CAP, CLUSTER_CAP = 0.95, 0.30, 0.40, 0.35
MAX_VAR, DAILY_VOL, VAR_FACTOR = 0.03, 0.02, 2.33
MIN_SIZE, REBALANCE, MOMENTUM_BIAS, VOL_SCALE = 0.01, 0.05, 0.1, 0.9
STRENGTH = {"weak": 0.5, "moderate": 1.0, "strong": 1.5, "extreme": 2.0}
REGIME = {"bear": 0.7, "volatile": 0.8}


def _with_total(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.sum(column).alias(name)), list(keys), "left")


def _capped(df: DataFrame, keys: Sequence[str], cap: float) -> DataFrame:
    """Scale ``allocation`` so that no group of ``keys`` exceeds ``cap``."""
    out = _with_total(df, keys, "allocation", "_group")
    scale = F.when(F.col("_group") > cap, F.col("allocation") * ratio(F.lit(cap), "_group")).otherwise(F.col("allocation"))
    return out.withColumn("allocation", scale).drop("_group")


def _score() -> Column:
    strength = F.coalesce(F.try_element_at(lit_map(STRENGTH), F.col("strength")), F.lit(1.0))
    return F.col("confidence") * strength * (F.abs(F.col("prediction_value") - 0.5) * 2.0 + 1.0)


def base_allocation(signals: DataFrame, run: str = "run_id", max_exposure: float = MAX_EXPOSURE) -> DataFrame:
    """Share of the exposure proportional to confidence x strength x (1 + |2p - 1|)."""
    out = _with_total(signals.withColumn("_score", _score()), [run], "_score", "_total")
    share = F.when(F.col("_total") > 0, ratio("_score", "_total") * min(max_exposure, 1.0)).otherwise(F.col("_score"))
    return out.withColumn("allocation", share).drop("_score", "_total")


def diversify(allocated: DataFrame, run: str = "run_id") -> DataFrame:
    """Sector cap on the base allocations, then signal-type cap on the result."""
    out = allocated.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return _capped(_capped(out, [run, "sector"], SECTOR_CAP), [run, "signal_type"], TYPE_CAP)


def correlation_pairs(returns: DataFrame, min_obs: int = 10) -> DataFrame:
    """Correlation of every two symbols with at least ``min_obs`` common times (long table a, b, corr).

    The returns meet by equality of their time; each time contributes its symbols' pairs and the
    sums are pre-aggregated before the shuffle, so the output is symbols squared, not rows squared.
    """
    a = returns.select("ts", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    b = returns.select("ts", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    half = a.join(b, "ts").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(
        corr_agg(F.col("x"), F.col("y")).alias("corr"), F.count(F.lit(1)).alias("n_obs")
    )
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.filter(F.col("n_obs") >= min_obs).select(sides.alias("_p"), "corr").select("_p.*", "corr")


def correlation_clusters(pairs: DataFrame, threshold: float = 0.7, group: str | None = None) -> DataFrame:
    """Greedy clusters: in symbol order, each free symbol takes its free neighbours; symbols left alone have no cluster.

    With ``group`` there are clusters per value of that column, without it one set for all runs. The heads are found in
    parallel rounds: an undecided symbol without a smaller undecided neighbour becomes a head and its neighbours are
    taken; a symbol belongs to the smallest head beside it. Each round is stored; symbols chained in their own order
    need a round for every other one.
    """
    near = pairs.filter((F.col("corr") > threshold) & (F.col("a") != F.col("b")))
    g = F.struct(group) if group else F.lit(0)
    edges = cut(near.select(g.alias("g"), F.col("a").alias("v"), F.col("b").alias("w")).distinct())
    open_edges, nodes, heads = edges, edges.select("g", "v").distinct(), None
    while not nodes.isEmpty():
        waiting = open_edges.filter("w < v").select("g", "v")
        found = cut(nodes.join(waiting, ["g", "v"], "left_anti"))
        heads = found if heads is None else heads.unionByName(found)
        taken = open_edges.join(found, ["g", "v"]).select("g", F.col("w").alias("v")).unionByName(found).distinct()
        nodes = cut(nodes.join(taken, ["g", "v"], "left_anti"))
        left = open_edges.join(nodes, ["g", "v"], "left_semi")
        open_edges = cut(left.join(nodes.withColumnRenamed("v", "w"), ["g", "w"], "left_semi"))
    if heads is None:
        heads = edges.select("g", "v")
    members = edges.join(heads, ["g", "v"]).groupBy("g", F.col("w").alias("asset_id")).agg(F.min("v").alias("cluster"))
    members = cut(members.join(heads.withColumnRenamed("v", "asset_id"), ["g", "asset_id"], "left_anti"))
    own = members.select("g", F.col("cluster").alias("asset_id"), "cluster").distinct()
    out = members.select("g", "asset_id", "cluster").unionByName(own)
    return out.select(*([F.col("g")[group].alias(group)] if group else []), "asset_id", "cluster")


def cap_clusters(allocated: DataFrame, clusters: DataFrame, run: str = "run_id") -> DataFrame:
    """Scale the allocations of correlated assets to the cluster cap."""
    keys = [run, "asset_id"] if run in clusters.columns else ["asset_id"]
    out = allocated.join(clusters, keys, "left")
    lone = F.coalesce("cluster", F.concat(F.lit("#"), F.col("signal_id")))
    out = _with_total(out.withColumn("_cluster", lone), [run, "_cluster"], "allocation", "_group")
    over = F.col("cluster").isNotNull() & (F.col("_group") > CLUSTER_CAP)
    scaled = F.when(over, F.col("allocation") * ratio(F.lit(CLUSTER_CAP), "_group")).otherwise(F.col("allocation"))
    return out.withColumn("allocation", scaled).drop("_group", "_cluster", "cluster")


def risk_limits(allocated: DataFrame, run: str = "run_id", regime: Column | None = None) -> DataFrame:
    """VaR limit per run, then the regime factor."""
    out = _with_total(allocated, [run], "allocation", "_total")
    var = F.col("_total") * DAILY_VOL * VAR_FACTOR
    scale = F.when(var > MAX_VAR, ratio(F.lit(MAX_VAR), var)).otherwise(1.0)
    factor = F.lit(1.0) if regime is None else F.coalesce(F.try_element_at(lit_map(REGIME), regime), F.lit(1.0))
    return out.withColumn("allocation", F.col("allocation") * scale * factor).drop("_total")


def optimise(allocated: DataFrame, run: str = "run_id", max_exposure: float = MAX_EXPOSURE) -> DataFrame:
    """Momentum bias, volatility scaling, total cap; too small positions are dropped."""
    boost = F.when(F.col("signal_type") == "momentum", 1.0 + MOMENTUM_BIAS).otherwise(1.0)
    out = allocated.withColumn("allocation", F.col("allocation") * boost * VOL_SCALE)
    out = _with_total(out, [run], "allocation", "_total")
    scale = F.when(F.col("_total") > max_exposure, ratio(F.lit(max_exposure), "_total")).otherwise(1.0)
    return out.withColumn("allocation", F.col("allocation") * scale).drop("_total").filter(F.col("allocation") >= MIN_SIZE)


def allocate(
    signals: DataFrame, run: str = "run_id", clusters: DataFrame | None = None, regime: Column | None = None,
    max_exposure: float = MAX_EXPOSURE,
) -> DataFrame:
    """Valid signals of every run with their final ``allocation``.

    Every step scales all signals of a cell (run, sector, type, cluster, regime) alike. So the scores are summed per
    cell once, all caps are worked out on that small table, and each signal gets its cell's factor: two scans of the
    signals, whatever the number of caps. A run's cells are bounded by its sectors, types and clusters.
    """
    score = _score().alias("_score")
    factor = F.lit(1.0) if regime is None else F.coalesce(F.try_element_at(lit_map(REGIME), regime), F.lit(1.0))
    scored = signals.withColumns({"_score": score, "sector": F.coalesce("sector", F.lit("Unknown")), "_regime": factor})
    if clusters is None:
        scored = scored.withColumn("cluster", F.lit(None).cast("string"))
    else:
        scored = scored.join(clusters, [run, "asset_id"] if run in clusters.columns else ["asset_id"], "left")
    keys = [run, "sector", "signal_type", "cluster", "_regime"]
    cells = scored.groupBy(*keys).agg(F.sum("_score").alias("_sum"))

    def total(*by: str) -> Column:
        return F.sum("_al").over(Window.partitionBy(run, *by))

    def capped(cells: DataFrame, group: Column, cap: float, where: Column | None = None) -> DataFrame:
        over = F.col("_group") > cap if where is None else where & (F.col("_group") > cap)
        scaled = F.when(over, F.col("_al") * ratio(F.lit(cap), "_group")).otherwise(F.col("_al"))
        return cells.withColumn("_group", group).withColumn("_al", scaled)

    cells = cells.withColumn("_al", F.col("_sum")).withColumn("_group", total())
    share = F.when(F.col("_group") > 0, ratio("_al", "_group") * min(max_exposure, 1.0)).otherwise(F.col("_al"))
    cells = cells.withColumn("_al", share)
    cells = capped(cells, total("sector"), SECTOR_CAP)
    cells = capped(cells, total("signal_type"), TYPE_CAP)
    cells = capped(cells, total("cluster"), CLUSTER_CAP, F.col("cluster").isNotNull())
    var = F.col("_group") * DAILY_VOL * VAR_FACTOR
    cells = cells.withColumn("_group", total())
    cells = cells.withColumn("_al", F.col("_al") * F.when(var > MAX_VAR, ratio(F.lit(MAX_VAR), var)).otherwise(1.0) * F.col("_regime"))
    boost = F.when(F.col("signal_type") == "momentum", 1.0 + MOMENTUM_BIAS).otherwise(1.0)
    cells = capped(cells.withColumn("_al", F.col("_al") * boost * VOL_SCALE), total(), max_exposure)
    factors = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(ratio("_al", "_sum"), F.lit(0.0)).alias("_factor"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = scored.join(factors, same).withColumn("allocation", F.col("_score") * F.col("_factor"))
    return out.select(*signals.columns, "allocation").filter(F.col("allocation") >= MIN_SIZE)


def portfolio_metrics(allocated: DataFrame, run: str = "run_id") -> DataFrame:
    """Exposure, VaR, drawdown risk and Sharpe estimate per run."""
    total, conf = F.sum("allocation"), F.avg("confidence")
    expected = F.sum(F.col("confidence") * F.col("allocation") * 0.1)
    var = total * 0.03 * (F.lit(2.0) - conf)
    return allocated.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_signals"), total.alias("total_exposure"), var.alias("portfolio_var"),
        F.least(F.lit(0.3), total * 0.15).alias("max_drawdown_risk"),
        zero(ratio(expected, F.when(var * 16.0 > 0, var * 16.0))).alias("sharpe_estimate"),
    )


def exposures(allocated: DataFrame, run: str = "run_id") -> DataFrame:
    """Exposure per run by sector, direction, type and urgency (long table)."""
    parts = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("Unknown")).alias("member"))
            for d in ("sector", "direction", "signal_type", "urgency")
        ]
    )
    return (
        allocated.select(run, "allocation", F.explode(parts).alias("_p"))
        .groupBy(run, F.col("_p.dimension").alias("dimension"), F.col("_p.member").alias("member"))
        .agg(F.sum("allocation").alias("exposure"), F.count(F.lit(1)).alias("n_signals"))
    )


def drift(targets: DataFrame, positions: DataFrame) -> DataFrame:
    """Distance of every held asset from its target allocation (0 without a target)."""
    goal = targets.groupBy("asset_id").agg(F.max_by("allocation", "ts").alias("target"))
    return positions.join(goal, "asset_id", "left").select(
        "asset_id", F.abs(F.col("weight") - zero(F.col("target"))).alias("drift")
    )


def rebalance_flags(allocated: DataFrame, positions: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: whether the exposure moves by more than the threshold (any signal counts without positions)."""
    held = positions.agg(F.sum(F.abs("weight")).alias("_held"))
    new = allocated.groupBy(run).agg(F.sum("allocation").alias("new_exposure"))
    out = new.crossJoin(F.broadcast(held))  # one row
    moved = F.abs(F.col("new_exposure") - F.col("_held")) > REBALANCE
    return out.select(run, "new_exposure", F.coalesce(moved, F.lit(True)).alias("rebalance_required"))


def allocate_portfolio(
    signals: DataFrame, positions: DataFrame, portfolio_value: float = 100_000.0, run: str = "run_id",
    clusters: DataFrame | None = None, regime: Column | None = None, max_exposure: float = MAX_EXPOSURE,
) -> tuple[DataFrame, DataFrame]:
    """The allocated signals and one record per run: metrics, exposure, cash required, whether it has to be rebalanced
    given the held ``positions`` (asset_id, weight), and the largest drift of a held asset from its new allocation."""
    allocated = cut(allocate(signals, run, clusters, regime, max_exposure))
    held = cut(positions.groupBy("asset_id").agg(F.sum("weight").alias("weight")))
    goal = allocated.groupBy(run, "asset_id").agg(F.sum("allocation").alias("target"))
    assets = allocated.select(run).distinct().crossJoin(held)  # runs times held assets, both small next to the signals
    drifts = assets.join(goal, [run, "asset_id"], "left").groupBy(run).agg(F.max(F.abs(F.col("weight") - zero(F.col("target")))).alias("largest_drift"))
    flags = rebalance_flags(allocated, held, run).withColumnRenamed("new_exposure", "_new")
    record = portfolio_metrics(allocated, run).join(flags.drop("_new"), run).join(drifts, run, "left")
    return allocated, record.withColumn("cash_required", F.col("total_exposure") * portfolio_value)


def allocation_summary(metrics: DataFrame) -> DataFrame:
    """Averages over the recorded runs."""
    return metrics.agg(
        F.count(F.lit(1)).alias("total_allocations"), F.avg("num_signals").alias("avg_num_signals"),
        F.avg("total_exposure").alias("avg_exposure"), F.avg("portfolio_var").alias("avg_var"),
        F.avg("sharpe_estimate").alias("avg_sharpe"),
    )
