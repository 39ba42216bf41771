"""Quantiles, rank correlation, least squares and selection against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from candlewick.operators import leastsq as LS, selection as SE, stats as ST


def test_quantiles_with_one_value_holding_most_rows(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(4000, 7.0), rng.normal(7, 3, 2000), [1e9, -1e9]])
    g = np.where(np.arange(len(v)) % 10 == 0, "small", "big")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    probs = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)
    got = ST.exact_quantiles(df, ["g"], "v", probs, [f"p{i}" for i in range(len(probs))]).toPandas().set_index("g")
    for k in ("small", "big"):
        np.testing.assert_allclose(got.loc[k].astype(float), np.quantile(v[g == k], probs), rtol=1e-12)


@pytest.mark.parametrize("limit", [1, 40, 500])
def test_large_ranges_are_cut_again(spark, monkeypatch, limit):
    monkeypatch.setattr(ST, "RANGES", 8)
    monkeypatch.setattr(ST, "RANGE_ROWS", limit)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(v)) % 2, "v": v}))
    probs = (0.1, 0.5, 0.77)
    got = ST.exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for k in (0, 1):
        np.testing.assert_allclose(got.loc[k].astype(float), np.quantile(v[np.arange(len(v)) % 2 == k], probs), rtol=1e-12)
    got = ST.exact_quantiles(df, [], "v", probs).toPandas().iloc[0]
    np.testing.assert_allclose(got.astype(float), np.quantile(v, probs), rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=2, max_size=60))
def test_median_property(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert ST.exact_quantiles(df, [], "v", (0.5,), ("m",)).first()["m"] == np.quantile(values, 0.5)


def test_group_table_above_the_limit_is_not_broadcast(spark, monkeypatch):
    from candlewick.operators import single
    df = spark.createDataFrame([(i % 7, float(i)) for i in range(200)], "g int, v double")
    want = ST.exact_quantiles(df, ["g"], "v", (0.3,), ("q",)).orderBy("g").collect()
    monkeypatch.setattr(single.small_side, "__defaults__", (3,))
    monkeypatch.setattr(single.small_rows, "__defaults__", (3,))
    assert ST.exact_quantiles(df, ["g"], "v", (0.3,), ("q",)).orderBy("g").collect() == want


def tau_b(x, y):
    s = sx = sy = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, sx, sy = s + a * b, sx + abs(a), sy + abs(b)
    return s / np.sqrt(sx * sy)


@pytest.mark.parametrize("high", [3, 8, 10 ** 6])
def test_kendall_with_ties(spark, high):
    rng = np.random.default_rng(high)
    x, y = rng.integers(0, high, 60), rng.integers(0, high, 60)
    days = pd.date_range("2024-01-01", periods=60)
    a = spark.createDataFrame(pd.DataFrame({"k": "s", "ds": days, "x": x.astype(float)}))
    b = spark.createDataFrame(pd.DataFrame({"ds": days, "y": y.astype(float)}))
    got = {r["lag"]: r["r"] for r in ST.cross_corr(a, b, ["k"], "ds", "x", "y", (-2, 0, 3), "kendall").collect()}
    for lag in (-2, 0, 3):
        p = pd.DataFrame({"x": x, "y": pd.Series(y).shift(lag)}).dropna()
        assert got[lag] == pytest.approx(tau_b(p.x.to_numpy(), p.y.to_numpy()), abs=1e-12)
    for method in ("pearson", "spearman"):
        got = {r["lag"]: r["r"] for r in ST.cross_corr(a, b, ["k"], "ds", "x", "y", (-2, 3), method).collect()}
        for lag in (-2, 3):
            p = pd.DataFrame({"x": x, "y": pd.Series(y).shift(lag)}).dropna()
            p = p.rank() if method == "spearman" else p
            assert got[lag] == pytest.approx(p.x.corr(p.y), abs=1e-9)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 5))
    x[:, 4] = x[:, 0] + 0.1 * x[:, 4]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.01 * x[:, 2] + rng.normal(scale=0.1, size=500)
    pdf = pd.DataFrame(x, columns=list("abcde")).assign(y=y)
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_inflation_factors(frame):
    pdf, df = frame
    got = {r["feature"]: r["vif"] for r in SE.vif(df, list("abcde")).collect()}
    want = np.diag(np.linalg.inv(pdf[list("abcde")].corr().to_numpy()))
    np.testing.assert_allclose([got[c] for c in "abcde"], want, rtol=1e-8)


def test_determined_column_has_no_factor(frame):
    _, df = frame
    got = {r["feature"] for r in SE.vif(df.withColumn("f", F.col("a") + F.col("b")), list("abcf")).collect()}
    assert got == {"c"}


def test_elimination_keeps_the_strong_coefficients(frame):
    pdf, df = frame
    out = {r["feature"]: r["ranking"] for r in SE.rfe(df, list("abcd"), "y", 2).collect()}
    assert {c for c, r in out.items() if r == 1} == {"a", "b"} and sorted(out.values()) == [1, 1, 2, 3]


def test_p_values(frame):
    _, df = frame
    p = {r["feature"]: r["p_value"] for r in SE.ols_pvalues(df, list("abcd"), "y").collect()}
    assert p["a"] < 1e-6 and p["b"] < 1e-6 and p["d"] > 0.01


@pytest.mark.parametrize("combiners", [1, 32])
def test_ridge_per_group_over_many_partitions(frame, spark, monkeypatch, combiners):
    monkeypatch.setattr(LS, "COMBINERS", combiners)
    pdf, _ = frame
    pdf = pdf.assign(g=np.arange(500) % 3)
    df = spark.createDataFrame(pdf).repartition(9).withColumn("x", F.array(*"abc"))
    pen = [0.5, 1.0, 2.0]
    fits = LS.ridge(df, ["g"], "x", "y", [("all", pen), ("first", pen)], [[0, 1, 2], [0]]).collect()
    assert len(fits) == 6
    for f in fits:
        rows = pdf[pdf.g == f["g"]]
        at = [0, 1, 2] if f["fit"] == "all" else [0]
        m = rows[list("abc")].to_numpy()[:, at]
        beta = np.linalg.solve(m.T @ m + np.diag(np.array(pen)[at]), m.T @ rows.y.to_numpy())
        np.testing.assert_allclose(np.array(f["beta"])[at], beta, rtol=1e-9)
        assert f["n"] == len(rows) and f["sigma"] == pytest.approx(np.sqrt(np.mean((rows.y - m @ beta) ** 2)), rel=1e-6)


def test_moments(frame):
    pdf, df = frame
    n, mean, cov = LS.moments(df, list("abc"))
    np.testing.assert_allclose(cov, pdf[list("abc")].cov().to_numpy(), rtol=1e-9)
    assert n == 500
