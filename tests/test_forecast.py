"""Forecasters on series whose answer is known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewick.operators import backtest as B, forecast as P, origins as N

KEY = ["series_id"]


@pytest.fixture(scope="module")
def seasonal(spark):
    t = np.arange(24 * 60)
    y = (100 + 0.05 * t) * (1 + 0.1 * np.sin(2 * np.pi * t / 24) + 0.05 * np.cos(2 * np.pi * t / 168))
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=len(t), freq="h"), "y": y})
    return pdf, spark.createDataFrame(pdf)


def test_baseline_recovers_trend_times_season(seasonal, spark):
    pdf, df = seasonal
    train = df.where("ds < '2024-02-20'")
    out = P.baseline_forecast(train, KEY, season_prior=10.0).join(df, [*KEY, "ds"]).toPandas()
    assert len(out) == 120
    assert (abs(out.yhat - out.y) / out.y).mean() < 0.02
    assert ((out.yhat_lower <= out.yhat) & (out.yhat <= out.yhat_upper)).all()
    np.testing.assert_allclose(out.yhat, out.trend * (1 + out.weekly + out.daily))


def slots(*days):
    return [int(pd.Timestamp(d).timestamp()) // 3600 for d in days]


def origins(spark, base, step, count):
    return spark.createDataFrame([("a", base, step, count)], "series_id string, _base long, _step long, _count long")


def test_backtest_equals_a_fit_per_origin(seasonal, spark):
    pdf, df = seasonal
    noisy = df.withColumn("y", F.col("y") + 3 * F.rand(5)).where("hour(ds) <> 5 OR day(ds) <> 9")  # some hours are missing
    base, = slots("2024-02-10 07:00")
    for group in (1, 3, None):
        rows = P.backtest_rows(noisy, KEY, "ds", "y", origins(spark, base, 29, 4), train_days=30, season_prior=10.0, group=group)
        got = rows.toPandas()
        assert sorted(got.cutoff.unique()) == [np.datetime64("1970-01-01") + np.timedelta64(base + 29 * k, "h") for k in range(4)]
        for cutoff, own in list(got.groupby("cutoff"))[:: 1 if group is None else 3]:
            train = noisy.where((F.col("ds") <= F.lit(cutoff)) & (F.col("ds") > F.lit(cutoff - pd.Timedelta(days=30)))).withColumns(
                {"training_start": F.lit(cutoff - pd.Timedelta(hours=719)), "training_end": F.lit(cutoff)})
            fit = P.fit_baseline(train, KEY, season_prior=10.0)
            test = noisy.where((F.col("ds") > F.lit(cutoff)) & (F.col("ds") <= F.lit(cutoff + pd.Timedelta(hours=120)))).withColumns(
                {"training_start": F.lit(cutoff - pd.Timedelta(hours=719)), "training_end": F.lit(cutoff)})
            want = P.predict_baseline(test, fit, KEY).toPandas().sort_values("ds")
            own = own.sort_values("ds")
            assert own.ds.tolist() == want.ds.tolist()
            for c in ("y", "yhat", "yhat_lower", "yhat_upper"):
                np.testing.assert_allclose(own[c], want[c], rtol=1e-6)


def test_backtest_at_the_end_and_without_enough_hours(seasonal, spark):
    _, df = seasonal
    last, = slots("2024-02-29 23:00")
    runs = P.backtest_baseline(df, KEY, origins(spark, last - 121, 1, 3), train_days=20).orderBy("cutoff").collect()
    assert [r["n_test"] for r in runs] == [120, 120, 119] and [r["short_horizon"] for r in runs] == [False, False, True]
    assert N.origins_by_step(df.limit(50), KEY, "ds").count() == 0 and N.origins_by_period(df.limit(50), KEY, "ds").count() == 0
    assert P.backtest_baseline(df, KEY, N.origins_by_step(df.limit(0), KEY, "ds")).count() == 0


def test_origins_follow_the_series(seasonal, spark):
    _, df = seasonal
    n = 24 * 60
    step = N.origins_by_step(df, KEY, "ds").first()
    first, = slots("2024-01-01")
    assert (step["_base"], step["_count"]) == (first + round(0.7 * n) - 1, n - 120 - round(0.7 * n) + 1)
    cuts = N.splits(df, KEY, "ds", N.origins_by_period(df, KEY, "ds", period_h=100), train_days=10).orderBy("cutoff").collect()
    want = [c for c in range(first + n - 1 - 120, 0, -100) if c >= first + round(0.7 * n)][::-1]
    assert [int(r["cutoff"].timestamp()) // 3600 for r in cuts] == want and {r["n_train"] for r in cuts} == {240}


def test_tuning_prefers_a_weak_season_penalty(seasonal, spark):
    _, df = seasonal
    base, = slots("2024-02-15")
    tuned = P.tune_baseline(df, KEY, origins(spark, base, 24, 2), priors=(0.1, 0.6), season_priors=(0.001, 10.0), reaches=(0.7, 0.8))
    assert tuned.count() == 8
    best = P.best_parameters(tuned).first()
    assert best["season_prior"] == 10.0
    rows = P.backtest_rows(df, KEY, "ds", "y", origins(spark, base, 24, 2), None, prior=best["prior"], season_prior=10.0, reach=best["reach"])
    assert best["rmse"] == pytest.approx(rows.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("yhat"), 2)))).first()[0], rel=1e-9)


def test_fit_does_not_depend_on_the_unit(seasonal):
    _, df = seasonal
    got = {}
    for f in (0.001, 1.0, 1000.0):
        fit = P.baseline_forecast(df.withColumn("y", F.col("y") * f), KEY).orderBy("ds").toPandas()
        got[f] = fit[["yhat", "yhat_lower", "yhat_upper"]].to_numpy() / f
    np.testing.assert_allclose(got[0.001], got[1.0], rtol=1e-9)
    np.testing.assert_allclose(got[1000.0], got[1.0], rtol=1e-9)


def test_bounds_widen_with_the_horizon(seasonal):
    _, df = seasonal
    out = P.baseline_forecast(df, KEY).orderBy("ds").toPandas()
    wide = (out.yhat_upper - out.yhat_lower).to_numpy()
    assert wide[-1] > wide[0] and (wide >= wide[0] * 0.99).all()


def test_regressor_subsets_are_all_scored(seasonal):
    _, df = seasonal
    with_r = df.withColumns({"r1": F.rand(1), "r2": F.rand(2)})
    out = {r["regressors"] for r in P.evaluate_regressors(with_r, KEY, "ds", "y", ["r1", "r2"]).collect()}
    assert out == {"none", "r1", "r2", "r1+r2"}


def test_roll_forward_equals_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=10, freq="h"), "u": rng.normal(size=10), "y": rng.normal(size=10)})
    beta = rng.normal(size=7) * 0.3
    fit = spark.createDataFrame([("a", beta.tolist())], "series_id string, beta array<double>")
    got = [r["yhat"] for r in P.roll_forward(spark.createDataFrame(pdf), fit, KEY, "ds", ["u", "y"], 3, 5).orderBy("ds").collect()]
    window = pdf[["u", "y"]].to_numpy()[-3:].copy()
    want = []
    for _ in range(5):
        pred = beta[0] + window.ravel() @ beta[1:]
        want.append(pred)
        window = np.roll(window, -1, axis=0)
        window[-1, -1] = pred
    np.testing.assert_allclose(got, want)


def test_lag_regression_follows_a_linear_recurrence(spark):
    y = [1.0, 0.5]
    for _ in range(300):
        y.append(1.6 * y[-1] - 0.95 * y[-2])
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=len(y), freq="h"), "y": y})
    out = P.lagged_forecast(spark.createDataFrame(pdf[:120]), KEY, n_past=4, horizon=20, penalty=1e-9).orderBy("ds").toPandas()
    np.testing.assert_allclose(out.yhat, y[120:140], atol=1e-4)


def test_direction_model_learns_a_separable_label(spark):
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=240, freq="h")})
    pdf["label"] = np.arange(240) % 3 - 1
    pdf["f"] = pdf["label"] + 0.01 * np.sin(np.arange(240))
    out = P.direction_model(spark.createDataFrame(pdf), KEY, "ds", ["f"], "label", 2).toPandas()
    assert (out.label == out.predicted).mean() > 0.95


def test_holdout_does_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    tag = lambda d: {r["id"] for r in P.random_holdout(d, ["id"]).where("part = 'test'").collect()}
    assert tag(df.repartition(3)) == tag(df.repartition(17)) and 300 < len(tag(df)) < 500


def test_naive_rows_use_the_value_one_horizon_back(seasonal, spark):
    pdf, df = seasonal
    base, = slots("2024-02-10")
    rows = B.naive_rows(df, KEY, "ds", "y", origins(spark, base, 6, 1), 30, 120).toPandas()
    back = pdf.set_index("ds")["y"]
    assert len(rows) == 120
    np.testing.assert_allclose(rows.yhat, back.loc[rows.ds - pd.Timedelta(hours=120)].to_numpy())


def test_regressors_multiply_the_trend(spark):
    t = np.arange(24 * 40)
    r = np.sin(t * 0.37) + (t % 5)
    pdf = pd.DataFrame({"series_id": "a", "ds": pd.date_range("2024-01-01", periods=len(t), freq="h"), "r": r, "y": (100 + t) * (1 + 0.2 * (r - r.mean()) / r.std())})
    both = {x["regressors"]: x["rmse"] for x in P.evaluate_regressors(spark.createDataFrame(pdf), KEY, "ds", "y", ["r"]).collect()}
    assert set(both) == {"none", "r"}
