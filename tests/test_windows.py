"""Window operators against pandas and numpy, and block size against results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import indicators as I, lookback as L, rolling as R
from candlewick.operators.ewm import ewm_means, ewm_stds, geometric_sums

KEY = ["series_id"]


def by_series(df, col):
    p = df.toPandas().sort_values(["series_id", "ds"])
    return {k: g[col].astype(float).to_numpy() for k, g in p.groupby("series_id")}


@pytest.mark.parametrize("n,fn", [(14, "sum"), (20, "stddev_samp"), (72, "avg"), (1, "stddev_samp")])
@pytest.mark.parametrize("block", [64, 100, 4096])
def test_rolling_equals_pandas_for_any_block(series, n, fn, block):
    pdf, df = series
    w = R.Blocked(df, KEY, "ds", back=n - 1, block=block)
    got = by_series(w.add(r=R.rolling(w, "y", n, fn)).done(), "r")
    for k, g in pdf.groupby("series_id"):
        roll = g["y"].rolling(n)
        want = {"sum": roll.sum, "avg": roll.mean, "stddev_samp": roll.std}[fn]().to_numpy()
        np.testing.assert_allclose(got[k], want, atol=1e-9)


@pytest.mark.parametrize("alpha,need", [(1 / 14, 14), (2 / 27, 26), (2 / 241, 1), (0.5, 3)])
@pytest.mark.parametrize("sub", [16, 128])
def test_recursive_average(series, alpha, need, sub, monkeypatch):
    monkeypatch.setattr(geometric_sums, "__defaults__", (3600, sub))
    pdf, df = series
    got = by_series(ewm_means(df, KEY, "ds", {"m": ("y", alpha, need)}), "m")
    for k, g in pdf.groupby("series_id"):
        want = g["y"].ewm(alpha=alpha, adjust=False, min_periods=need).mean().to_numpy()
        np.testing.assert_allclose(got[k], want, rtol=1e-11)


@pytest.mark.parametrize("span", [1, 6, 24, 240])
def test_weighted_deviation(series, span):
    pdf, df = series
    got = by_series(ewm_stds(df, KEY, "ds", "y", {"s": span}), "s")
    for k, g in pdf.groupby("series_id"):
        np.testing.assert_allclose(got[k], g["y"].ewm(span=span).std().to_numpy(), rtol=1e-6)


@pytest.mark.parametrize("block", [200, 4096])
def test_kernel_is_the_convolution_with_smallest_weight_on_the_newest(series, block):
    pdf, df = series
    got = by_series(R.time_weighted(df, KEY, "ds", {"t": "volume"}, block=block), "t")
    weights = np.array([0.5 ** ((120 - i) / 120) for i in range(120)])
    for k, g in pdf.groupby("series_id"):
        want = np.concatenate([np.full(119, np.nan), np.convolve(g["volume"], weights, mode="valid") / weights.sum()])
        np.testing.assert_allclose(got[k], want, rtol=1e-12)


def test_kernel_impulse_orientation(spark):
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=240, freq="h"), "y": 0.0})
    pdf.loc[119, "y"] = 1.0
    out = R.time_weighted(spark.createDataFrame(pdf), KEY, "ds", {"ref": "y"}).orderBy("ds").toPandas()["ref"]
    late = out[119:239].to_numpy()
    assert (np.diff(late) > 0).all() and late[0] == pytest.approx(0.5 / 86.5, rel=0.02)


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_fill_and_interpolate_across_blocks(spark, block):
    v = [np.nan, np.nan, 1.0, np.nan, np.nan, 4.0, np.nan, 8.0, np.nan, np.nan]
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=10, freq="h"), "y": v})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    line = by_series(R.interpolate(df, KEY, "ds", ["y"], block), "y")["a"]
    want = pdf.set_index("ds")["y"].interpolate(method="time").to_numpy()
    np.testing.assert_allclose(line, want)
    both = by_series(R.fill(df, KEY, "ds", ["y"], "both", block), "y")["a"]
    np.testing.assert_allclose(both, pdf["y"].ffill().bfill())
    fwd = by_series(R.fill(df, KEY, "ds", ["y"], "forward", block), "y")["a"]
    np.testing.assert_allclose(fwd, pdf["y"].ffill())


def test_positions_skip_when_series_is_short(spark):
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=12, freq="h"), "y": range(12)})
    got = R.sample_positions(spark.createDataFrame(pdf), KEY, "ds", [-1, -6, -12, 0, 11, 23]).toPandas()
    assert dict(zip(got["position"], got["y"])) == {-1: 11, -6: 6, 0: 0, 11: 11}


def _flat(spark, prices):
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=len(prices), freq="h"), "y": prices,
                        "y_upper": prices, "y_lower": prices, "volume": 1.0})
    return spark.createDataFrame(pdf)


def test_rsi_without_losses_is_100(spark):
    out = I.rsi(_flat(spark, [float(i) for i in range(30)]), KEY).orderBy("ds").toPandas()["RSI"]
    assert out[:13].isna().all() and (out[13:] == 100).all()


def test_money_flow_divisions(spark):
    flat = I.money_flow(_flat(spark, [5.0] * 20), KEY).toPandas()["MFI"]
    assert flat.isna().all()
    up = I.money_flow(_flat(spark, [float(i) for i in range(20)]), KEY).orderBy("ds").toPandas()["MFI"]
    assert up[:13].isna().all() and (up[13:] == 100).all()


def test_gradient_matches_numpy(series):
    pdf, df = series
    got = by_series(R.gradient(df, KEY, "ds", {"g": "volume"}, block=50), "g")
    for k, g in pdf.groupby("series_id"):
        np.testing.assert_allclose(got[k], np.gradient(g["volume"].to_numpy()))


@pytest.mark.parametrize("block", [40, 4096])
def test_lookback_panel_equals_the_range_join(spark, block):
    rng = np.random.default_rng(3)
    posts = pd.DataFrame({"created_at": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 200 * 3600, 400), "s"),
                          "s": rng.uniform(size=400), "w": rng.uniform(size=400)})
    bars = pd.DataFrame({"ds": pd.date_range("2024-01-01", periods=220, freq="h")})
    out = L.lookback_panel(spark.createDataFrame(bars), spark.createDataFrame(posts), ["s"], (24, 48), weight=F.col("w"), block=block)
    got = out.toPandas().set_index("ds").sort_index()
    for end, row in got.iterrows():
        for k in (24, 48):
            win = posts[(posts.created_at >= end - pd.Timedelta(hours=k)) & (posts.created_at < end)]
            d = 0.5 ** ((end - win.created_at).dt.total_seconds() / 3600 / 24)
            want = [len(win) / k, win.s.mean(), (win.s * win.w).sum() / win.w.sum() if len(win) else np.nan,
                    (win.s * d).sum() / len(win) if len(win) else np.nan, (win.s * win.w * d).sum() / win.w.sum() if len(win) else np.nan]
            have = [row[f"senti_sub_freq_w{k}"], row[f"s_rolling_w{k}"], row[f"s_rolling_wgt_w{k}"],
                    row[f"s_rolling_timeDecay_w{k}"], row[f"s_rolling_wgt_timeDecay_w{k}"]]
            np.testing.assert_allclose(np.array(have, float), want, rtol=1e-10)
