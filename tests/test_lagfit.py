"""Lag regression without samples against the dense normal equations."""

import resource
import time

import numpy as np
import pandas as pd
import pytest

from candlewick.operators import forecast as P, lagfit as L

KEY = ["series_id"]


def frame(n, m, seed, gaps=()):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, m)).cumsum(axis=0) * 0.1 + rng.normal(size=(n, m))
    pdf = pd.DataFrame(z, columns=[f"c{i}" for i in range(m)])
    pdf["y"] = 0.5 * pdf["c0"].shift(3).fillna(0) + 5 + rng.normal(size=n) * 0.1
    pdf.insert(0, "ds", pd.date_range("2024-01-01 07:00", periods=n, freq="h"))
    pdf.insert(0, "series_id", "a")
    return pdf.drop(index=list(gaps)).reset_index(drop=True)


def samples(pdf, cols, n_past, horizon):
    """Plain samples of every gap-free run: ts, x, y."""
    out = []
    run = (pdf["ds"].diff() != pd.Timedelta(hours=1)).cumsum()
    for _, part in pdf.groupby(run):
        z, y, ts = part[cols].to_numpy(), part["y"].to_numpy(), part["ds"].to_numpy()
        out += [(ts[i + horizon - 1], z[i - n_past:i].ravel(), y[i + horizon - 1]) for i in range(n_past, len(part) - horizon + 1)]
    return out


def dense(s, penalty):
    x, y = np.stack([r[1] for r in s]), np.array([r[2] for r in s])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + penalty * np.eye(x.shape[1]), xc.T @ yc)
    return np.append(y.mean() - x.mean(axis=0) @ w, w)


def test_levinson_and_inverse_products():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(200, 3)).cumsum(axis=0)
    n = 7
    c = np.stack([z[:len(z) - k].T @ z[k:] for k in range(n)])
    c[0] += np.eye(3)
    full = np.block([[c[b - a] if b >= a else c[a - b].T for b in range(n)] for a in range(n)])
    inverse = np.linalg.inv(full)
    x, y = L.first_and_last(c)
    np.testing.assert_allclose(x.reshape(-1, 3), inverse[:, :3], rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(y.reshape(-1, 3), inverse[:, -3:], rtol=1e-6, atol=1e-9)
    v = rng.normal(size=n * 3)
    t = L.Toeplitz(c)
    np.testing.assert_allclose(t.times(v), full @ v, rtol=1e-9)
    np.testing.assert_allclose(t.solve(full @ v), v, rtol=1e-5, atol=1e-8)


@pytest.mark.parametrize("n_past,horizon,gaps,block", [(1, 1, (), 50), (6, 1, (), 64), (6, 5, (100, 101, 233), 64), (12, 24, (40,), 4096), (6, 1, (3, 8, 400), 30)])
def test_same_coefficients_as_dense(spark, n_past, horizon, gaps, block):
    pdf, cols = frame(420, 3, 1, gaps), ["c0", "c1", "y"]
    s = samples(pdf, cols, n_past, horizon)
    df = spark.createDataFrame(pdf).repartition(3)
    fit = L.fit_lagged(df, KEY, "ds", cols, "y", n_past, horizon, 0.7, block)
    want = dense(s, 0.7)
    np.testing.assert_allclose(np.array(fit.first()["beta"]), want, rtol=1e-7, atol=1e-9)
    got = L.predict_lagged(df, fit, KEY, "ds", cols, "y", n_past, horizon, block).toPandas().sort_values("ds")
    assert got["ds"].tolist() == [pd.Timestamp(t) for t, _, _ in s]
    np.testing.assert_allclose(got["yhat"], [want[0] + x @ want[1:] for _, x, _ in s], rtol=1e-7)
    np.testing.assert_allclose(got["y"], [y for _, _, y in s])


def test_every_way_to_solve_agrees():
    pdf, cols = frame(300, 3, 7), ["c0", "c1", "y"]
    n, h = 20, 4
    z, y = pdf[cols].to_numpy(), pdf["y"].to_numpy()
    cc = np.stack([z[:len(z) - k].T @ z[k:] for k in range(n)])
    s = samples(pdf, cols, n, h)
    want = dense(s, 2.0)
    rows = np.column_stack([np.zeros(len(z)), np.arange(len(z)), np.full(len(z), len(z)), y, z]).ravel()
    e = L.Edges(rows, n, 3, h)
    x, t = np.stack([r[1] for r in s]), np.array([r[2] for r in s])
    mean, b = x.mean(axis=0), (x - x.mean(axis=0)).T @ (t - t.mean())
    cc[0] += 2.0 * np.eye(3)
    for got in (L.by_gradients(cc, e, mean, b), L.written_out(cc, e, mean, b), L.in_samples(e, mean, t.mean(), n + h, 2.0)):
        np.testing.assert_allclose(got, want[1:], rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("n", [70, 90, 140])
def test_few_samples_and_columns_of_very_different_size(spark, n):
    pdf, cols = frame(n, 3, 11), ["c0", "c1", "y"]
    pdf["c0"], pdf["c1"] = pdf["c0"] * 1e-4, pdf["c1"] * 1e5
    df = spark.createDataFrame(pdf)
    s = samples(pdf, cols, 24, 1)
    want = dense(s, 1.0)
    got = L.predict_lagged(df, L.fit_lagged(df, KEY, "ds", cols, "y", 24), KEY, "ds", cols, "y", 24).toPandas().sort_values("ds")
    np.testing.assert_allclose(got["yhat"], [want[0] + x @ want[1:] for _, x, _ in s], rtol=1e-4)


def test_nulls_short_series_and_empty_tables(spark):
    pdf = frame(60, 1, 2)
    pdf.loc[30, "c0"] = np.nan
    short = frame(4, 1, 3).assign(series_id="b")
    df = spark.createDataFrame(pd.concat([pdf, short]))
    fit = L.fit_lagged(df, KEY, "ds", ["c0"], "y", 5, 2)
    assert [r["series_id"] for r in fit.collect()] == ["a"]
    np.testing.assert_allclose(fit.first()["beta"], dense(samples(pdf.drop(index=30), ["c0"], 5, 2), 1.0), rtol=1e-7)
    assert L.fit_lagged(df.limit(0), KEY, "ds", ["c0"], "y", 5, 2).count() == 0


def test_reference_size(spark):
    """360 hours of 20 columns: 7 200 coefficients from moments of a few megabytes."""
    pdf = frame(6000, 19, 4)
    cols = [f"c{i}" for i in range(19)] + ["y"]
    z, y = pdf[cols].to_numpy(), pdf["y"].to_numpy()
    n, h = 360, 120
    cc = np.stack([z[:len(z) - k].T @ z[k:] for k in range(n)])
    cy = np.stack([z[:len(z) - (n + h - 1 - a)].T @ y[n + h - 1 - a:] for a in range(n)])
    at = np.flatnonzero((np.arange(len(z)) < n + h) | (np.arange(len(z)) >= len(z) - n - h))
    edges = np.column_stack([np.zeros(len(at)), at, np.full(len(at), len(z)), y[at], z[at]]).ravel()
    began = time.time()
    beta = L.solve_lagged(cc.ravel(), cy.ravel(), np.append(z.sum(axis=0), y.sum()), edges, n, 20, h, 50.0)
    assert time.time() - began < 240 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 16e6
    windows = np.lib.stride_tricks.sliding_window_view(z.ravel(), n * 20)[::20][:len(z) - n - h + 1]
    e = y[n + h - 1:] - beta[0] - windows @ beta[1:]
    slope = windows.T @ e - 50.0 * beta[1:]  # zero at the minimum
    assert np.abs(slope).max() < 1e-5 * np.abs(windows.T @ (y[n + h - 1:] - y.mean())).max()


def test_lagged_forecast_at_reference_length(spark):
    t = np.arange(24 * 70)
    y = 100 + 10 * np.sin(2 * np.pi * t / 24) + 4 * np.cos(2 * np.pi * t / 168)
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=len(t), freq="h"), "u": np.sin(t), "y": y})
    out = P.lagged_forecast(spark.createDataFrame(pdf[:-120]), KEY, cols=("u", "y"), n_past=360).orderBy("ds").toPandas()
    assert len(out) == 120 and np.abs(out.yhat.to_numpy() - y[-120:]).max() < 1.0
