"""Chunked kernels against plain pandas, with chunks small enough to be crossed many times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.operators import bars as B
from marketframe.operators.ordered import BLOCK, ewm, rolling, row_chunks, running_last, running_max, running_sums, wilder
from marketframe.operators.ranking import exact_quantiles, ordered_bits, top_k
from marketframe.functions.numeric import whole
from marketframe.operators.timeline import RangeTimeline, asof_join, by_rows


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    frames = []
    for symbol, n in (("hot", 11_000), ("cold", 40)):
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.choice(30 * 86400, n, replace=False)), unit="s")
        x = 100 + np.cumsum(rng.normal(0, 1, n))
        y = np.where(rng.random(n) < 0.3, np.nan, x)
        frames.append(pd.DataFrame({"symbol": symbol, "ts": ts, "x": x, "y": y}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, series):
    df = spark.createDataFrame(series.sample(frac=1, random_state=3)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.withColumn("y", F.when(~F.isnan("y"), F.col("y"))).cache()


def by_key(df, columns):
    pdf = df.select("symbol", "ts", *columns).toPandas()
    return pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)


def expected(series, fn):
    s = series.sort_values(["symbol", "ts"])
    return s.groupby("symbol", group_keys=False)["x"].apply(fn).reset_index(drop=True)


def test_rolling_and_lag_cross_chunks(table, series):
    c = row_chunks(table, halo=64, chunk_rows=BLOCK)
    c = c.with_columns({"m": rolling(c, F.col("x"), 50), "d": rolling(c, F.col("x"), 20, F.stddev_samp)})
    got = by_key(c.own(), ["m", "d"])
    np.testing.assert_allclose(got["m"].astype(float), expected(series, lambda s: s.rolling(50).mean()), rtol=1e-9)
    np.testing.assert_allclose(got["d"].astype(float), expected(series, lambda s: s.rolling(20).std()), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("span", [2, 3, 5, 26, 200])
def test_exponential_mean(table, series, span):
    c = row_chunks(table, halo=5 * BLOCK, chunk_rows=5 * BLOCK)
    c = c.with_columns({"e": ewm(c, F.col("x"), span)})
    got = by_key(c.own(), ["e"])
    np.testing.assert_allclose(got["e"], expected(series, lambda s: s.ewm(span=span).mean()), rtol=1e-10)


def test_wilder_mean_starts_with_plain_mean(table, series):
    c = row_chunks(table, halo=2 * BLOCK, chunk_rows=2 * BLOCK)
    got = by_key(c.with_columns({"w": wilder(c, F.col("x"), 14, 13)}).own(), ["w"])

    def brute(s):
        out, prev = [], None
        for i, v in enumerate(s.to_numpy()):
            prev = None if i < 13 else (s.to_numpy()[:14].mean() if i == 13 else (prev * 13 + v) / 14)
            out.append(np.nan if prev is None else prev)
        return pd.Series(out, index=s.index)

    np.testing.assert_allclose(got["w"].astype(float), expected(series, brute), rtol=1e-10)


def test_running_totals_and_fills(table, series):
    s = series.sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = by_key(running_sums(row_chunks(table, chunk_rows=BLOCK), {"t": F.col("y")}), ["t"])
    np.testing.assert_allclose(got["t"].astype(float), s.groupby("symbol")["y"].cumsum(), rtol=1e-9)
    got = by_key(running_last(row_chunks(table, chunk_rows=BLOCK), ["y"]), ["y"])
    np.testing.assert_allclose(got["y"].astype(float), s.groupby("symbol")["y"].ffill())
    got = by_key(running_last(row_chunks(table, chunk_rows=BLOCK), ["y"], forward=False), ["y"])
    np.testing.assert_allclose(got["y"].astype(float), s.groupby("symbol")["y"].bfill())
    got = by_key(running_max(table, ["symbol"], {"top": F.col("x")}), ["top"])
    np.testing.assert_allclose(got["top"], s.groupby("symbol")["x"].cummax())


def test_chunk_size_bounds_every_group(table):
    c = row_chunks(table, halo=100, ahead=10, chunk_rows=BLOCK)
    biggest = c.df.groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    assert biggest <= BLOCK + 110
    assert c.own().count() == 11_040


def test_quantiles_are_exact_when_bracketed(table, series):
    probs = {"a": 0.05, "b": 0.33, "c": 0.5, "d": 0.999}
    got = exact_quantiles(table, ["symbol"], "x", probs, accuracy=500).toPandas().set_index("symbol")
    for symbol, part in series.groupby("symbol"):
        for name, p in probs.items():
            assert got.loc[symbol, name] == pytest.approx(np.quantile(part["x"], p), rel=1e-12)
    got = exact_quantiles(table, ["symbol"], "x", {"p95": 0.95}, accuracy=500, interpolate=False).toPandas().set_index("symbol")
    for symbol, part in series.groupby("symbol"):
        v = np.sort(part["x"].to_numpy())
        assert got.loc[symbol, "p95"] == v[min(int(0.95 * len(v)), len(v) - 1)]


def test_ordered_bits_order_doubles(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64).view(np.float64)
    powers = np.concatenate([2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1073, 1024), 0)])
    values = np.concatenate([bits[~np.isnan(bits)], powers, -powers, [0.0, -0.0, np.inf, -np.inf, 1.0, 1.0]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("k", ordered_bits(F.col("v"))).collect()
    rows = sorted(rows, key=lambda r: r.k)
    got = np.array([r.v for r in rows])
    assert (np.diff(got) >= 0)[~np.isinf(got[1:])].all() and got[0] == -np.inf and got[-1] == np.inf
    assert len({r.k for r in rows}) == len(np.unique(values))


def test_quantiles_of_one_large_key(spark):
    """A key of a million different values: rounds of counts narrow every rank down; what is sorted at last stays small."""
    n = 1_000_000
    value = (F.col("id") * 7_919_317 % n).cast("double") / 3 + 1e6
    df = spark.range(n, numPartitions=8).select(F.lit("a").alias("k"), value.alias("x"))
    df = df.unionByName(spark.range(2500).select(F.lit("b").alias("k"), F.lit(5.5).alias("x")))
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), ("c", float("inf")), ("c", float("-inf")), ("c", 0.0), ("d", None)], "k string, x double"))
    probs = {"a": 0.001, "b": 0.5, "c": 0.75, "d": 0.999999, "e": 1.0}
    x = np.sort((np.arange(n) * 7_919_317 % n) / 3 + 1e6)
    for accuracy in (100, 1000):
        got = {r.k: r.asDict() for r in exact_quantiles(df, ["k"], "x", probs, accuracy=accuracy).collect()}
        assert set(got) == {"a", "b", "c", None}
        for name, p in probs.items():
            assert got["a"][name] == pytest.approx(np.quantile(x, p), rel=1e-13)
            assert got["b"][name] == 5.5
        assert got[None]["b"] == 1.5 and got["c"]["b"] == 0.0 and got["c"]["e"] == float("inf")
    assert exact_quantiles(df, [], "x", {"m": 0.5}, interpolate=False).collect()[0].m == sorted([*x, *[5.5] * 2500, 1.0, 2.0, float("inf"), float("-inf"), 0.0])[(n + 2505) // 2]
    assert exact_quantiles(df.limit(0), ["k"], "x", probs).count() == 0


def test_top_k_with_salts(table, series):
    got = top_k(table, ["symbol"], [F.desc("x")], 7).toPandas()
    want = series.sort_values("x", ascending=False).groupby("symbol").head(7)
    assert sorted(got["x"]) == sorted(want["x"])


def test_asof_lookups_cross_chunks(spark, table, series):
    rng = np.random.default_rng(5)
    right = pd.DataFrame({"symbol": rng.choice(["hot", "cold"], 40), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30 * 86400, 40), unit="s"), "v": np.arange(40.0)})
    events = spark.createDataFrame(right).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    left = series.sort_values("ts")[["symbol", "ts"]].astype({"ts": "datetime64[us]"})
    right = right.sort_values("ts").astype({"ts": "datetime64[us]"})
    for direction, kwargs in (("backward", {}), ("forward", {"allow_exact_matches": False})):
        out = asof_join(table.select("symbol", "ts"), events, ["symbol"], ["v"], "e", direction=direction, pieces=7)
        got = by_key(out.withColumn("v", F.col("e.v")), ["v"])
        want = pd.merge_asof(left, right, on="ts", by="symbol", direction=direction, **kwargs).sort_values(["symbol", "ts"])
        np.testing.assert_array_equal(got["v"].astype(float).to_numpy(), want["v"].to_numpy())


def test_range_totals_equal_brute_force(spark, table, series):
    rng = np.random.default_rng(6)
    ev = pd.DataFrame({"symbol": "cold", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 30 * 86400, 200), unit="s"), "v": rng.random(200)})
    events = spark.createDataFrame(ev).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    line = RangeTimeline(table.filter("symbol = 'cold'").select("symbol", "ts"), events, ["symbol"], ["v"], pieces=7)
    got = by_key(line.bars({"s": line.total(F.col("v"), 5), "m": line.highest("v", 5)}), ["s", "m"])
    for row in got.itertuples():
        inside = ev[(ev.ts >= row.ts - pd.Timedelta(days=5)) & (ev.ts <= row.ts)]
        assert row.s == pytest.approx(inside.v.sum(), abs=1e-9)
        assert (np.isnan(row.m) and inside.empty) or row.m == inside.v.max()


def test_bar_features_do_not_look_ahead_and_ignore_other_symbols(table):
    bars = table.select("symbol", "ts", *[(F.col("x") + i).alias(n) for i, n in enumerate(("open", "high", "low", "close"))], F.lit(1.0).alias("volume"))
    families = ("price", "volatility", "momentum", "patterns")
    full = B.bar_features(bars, families, regime=False, calendar=False)
    cut = B.bar_features(bars.filter("ts <= '2024-01-12'"), families, regime=False, calendar=False)
    alone = B.bar_features(bars.filter("symbol = 'cold'"), families, regime=False, calendar=False)
    assert cut.exceptAll(full).count() == 0
    assert alone.exceptAll(full).count() == 0


@pytest.fixture(scope="module")
def hot(spark):
    """Bars and events of three keys; 95 % of both on one key and one day, many at equal times."""
    rng = np.random.default_rng(11)

    def rows(n, name):
        key = np.where(rng.random(n) < 0.95, "hot", rng.choice(["a", "b"], n))
        day = np.where((key == "hot") & (rng.random(n) < 0.98), 20, rng.integers(0, 40, n))
        second = rng.integers(0, 86_400, n) // 7 * 7
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(day * 86_400 + second, unit="s")
        return pd.DataFrame({"symbol": key, "ts": ts.astype("datetime64[us]"), "id": np.arange(n), name: np.round(rng.normal(size=n), 3)})

    bars, events = rows(3000, "close"), rows(4000, "v")
    make = lambda df: spark.createDataFrame(df).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return bars, events, make(bars), make(events)


def test_a_hot_key_and_day_fall_into_many_pieces(hot):
    bars, events, b, e = hot
    both = b.select("symbol", "ts").unionByName(e.select("symbol", "ts")).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    sizes = [r[0] for r in by_rows(both, ["symbol"], 25).groupBy("symbol", "_piece").count().select("count").collect()]
    assert len(sizes) >= 25 and max(sizes) <= 2.5 * sum(sizes) / 25


@pytest.mark.parametrize("pieces", [1, 25])
def test_windows_of_a_hot_key_equal_brute_force(hot, pieces):
    bars, events, b, e = hot
    days = (1, 3, 30)
    line = RangeTimeline(b, e, ["symbol"], ["v"], ["v"], ["id"], pieces)
    cols = {"prev": line.previous()["id"], "next": line.next()["us"]}
    for d in days:
        cols |= {f"n{d}": line.total(F.when(F.col("v").isNotNull(), 1), d), f"s{d}": line.total(whole(F.col("v")), d), f"lo{d}": line.lowest("v", d), f"hi{d}": line.highest("v", d)}
    cols |= {"today": line.day_total(whole(F.col("v"))), "then": line.day_total(whole(F.col("v")), 3)}
    got = {r.id: r for r in line.bars(cols).collect()}
    assert len(got) == len(bars)
    day = np.timedelta64(1, "D")
    for symbol, part in bars.groupby("symbol"):
        own = events[events.symbol == symbol].sort_values(["ts", "id"])
        at, v, ids = own.ts.to_numpy(), own.v.to_numpy(), own.id.to_numpy()
        for t, i in zip(part.ts.to_numpy(), part.id):
            r, end = got[i], np.searchsorted(at, t, "right")
            assert r.prev == (ids[end - 1] if end else None)
            assert r.next == (at[end].astype("datetime64[us]").astype(int) if end < len(at) else None)
            for d in days:
                inside = v[np.searchsorted(at, t - d * day, "left") : end]
                assert r[f"n{d}"] == len(inside) and float(r[f"s{d}"]) == pytest.approx(inside.sum() * 1e12, abs=1)
                assert (r[f"lo{d}"], r[f"hi{d}"]) == ((inside.min(), inside.max()) if len(inside) else (None, None))
            midnight = t.astype("datetime64[D]").astype(at.dtype)
            assert float(r.today) == pytest.approx(v[np.searchsorted(at, midnight, "left") : end].sum() * 1e12, abs=1)
            assert float(r.then) == pytest.approx(v[np.searchsorted(at, midnight - 3 * day, "left") : np.searchsorted(at, t - 3 * day, "left")].sum() * 1e12, abs=1)


def test_asof_join_of_a_hot_key(hot):
    bars, events, b, e = hot
    for pieces in (1, 25):
        out = asof_join(b, e.withColumnRenamed("id", "eid"), ["symbol"], ["v"], "e", tie=["eid"], pieces=pieces)
        got = {r.id: r.e.eid if r.e else None for r in out.collect()}
        for symbol, part in bars.groupby("symbol"):
            own = events[events.symbol == symbol].sort_values(["ts", "id"])
            place = np.searchsorted(own.ts.to_numpy(), part.ts.to_numpy(), "right")
            assert [got[i] for i in part.id] == [int(own.id.iloc[p - 1]) if p else None for p in place]
