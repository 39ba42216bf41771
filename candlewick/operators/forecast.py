"""Forecasters: decomposable baseline, lag regression, direction classifier, tuning."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import timefns as D
from ..functions.scalars import bind
from ..session import staged
from . import backtest as B, origins as N, rolling as R, stats as S
from .lagfit import fit_lagged, predict_lagged
from .leastsq import dot, ridge
from .metrics import regression_metrics

# Tuned parameters of the baseline.
CHANGEPOINT_PRIOR = 0.6
SEASONALITY_PRIOR = 0.01
CHANGEPOINT_RANGE = 0.76
INTERVAL_Z = 1.959963984540054
# The tuning grid.
PRIOR_GRID = (0.001, 0.01, 0.1, 0.5, 0.6)
SEASON_GRID = (0.01, 0.1, 1.0, 10.0)
RANGE_GRID = tuple(0.7 + 0.01 * i for i in range(11))

CHANGEPOINTS = 25
WEEKLY_ORDER, DAILY_ORDER, YEARLY_ORDER = 3, 4, 10
NOISE = 0.05
PAST = 360  # hours of a lag window


def trend_features(u: Column, reach: Column | float, n: int = CHANGEPOINTS) -> Column:
    """1, u and n hinges spread over the first ``reach`` share of the training span."""
    r = F.lit(reach) if isinstance(reach, float) else reach
    return F.array(F.lit(1.0), u, *[F.greatest(u - r * F.lit(k / (n + 1)), F.lit(0.0)) for k in range(1, n + 1)])


def season_features(ts: str, yearly: bool = False) -> Column:
    """Fourier pairs: weekly, daily and (long histories) yearly."""
    days = F.unix_seconds(F.col(ts)) / F.lit(86400.0)
    waves = [(7.0, WEEKLY_ORDER), (1.0, DAILY_ORDER)] + ([(365.25, YEARLY_ORDER)] if yearly else [])
    out = []
    for period, order in waves:
        for k in range(1, order + 1):
            angle = days * F.lit(2 * math.pi * k / period)
            out += [F.sin(angle), F.cos(angle)]
    return F.array(*out)


def trend_penalty(prior: float, n: int = CHANGEPOINTS) -> list[float]:
    return [1e-9, 1e-9] + [NOISE ** 2 / prior ** 2] * n


def season_penalty(prior: float, yearly: bool = False) -> list[float]:
    n = 2 * (WEEKLY_ORDER + DAILY_ORDER + (YEARLY_ORDER if yearly else 0))
    return [NOISE ** 2 / prior ** 2] * n


def fit_baseline(train: DataFrame, key: Sequence[str], ts: str = "ds", y: str = "y",
                 start: str = "training_start", end: str = "training_end",
                 prior: float = CHANGEPOINT_PRIOR, season_prior: float = SEASONALITY_PRIOR,
                 reach: float = CHANGEPOINT_RANGE, yearly: bool = False) -> DataFrame:
    """Coefficients per key of ``trend * (1 + weekly + daily)``.

    ``start`` and ``end`` are columns with the bounds of each key's training span. A first fit of
    the piecewise trend gives the level that stands in for the trend as factor of the seasonality;
    the second fits trend and seasonality together, so that neither takes up the other's movement.
    """
    keep = [*key, start, end]
    x = _design(train.withColumn("_y", F.col(y).cast("double")).where(F.col("_y").isNotNull()), ts, start, end, reach, yearly)
    level = ridge(x, keep, "_t", "_y", [("level", trend_penalty(prior))]).select(*keep, F.col("beta").alias("level_beta"))
    both = x.join(level, keep).withColumn("_x", _joint(dot("_t", "level_beta")))
    penalty = trend_penalty(prior) + season_penalty(season_prior, yearly)
    full = ridge(both, keep, "_x", "_y", [("both", penalty)], shares=range(CHANGEPOINTS + 2, len(penalty)))
    return full.select(*keep, "beta", "sigma")


def _design(df: DataFrame, ts: str, start: str, end: str, reach: Column | float, yearly: bool) -> DataFrame:
    return df.withColumns({"_t": trend_features(_progress(ts, start, end), reach), "_f": season_features(ts, yearly)})


def _joint(level: Column) -> Column:
    return F.concat(F.col("_t"), bind(level, lambda v: F.transform("_f", lambda f: f * v)))


def _progress(ts: str, start: str, end: str) -> Column:
    span = F.greatest(D.slot(end) - D.slot(start), F.lit(1)).cast("double")
    return (D.slot(ts) - D.slot(start)).cast("double") / span


def predict_baseline(rows: DataFrame, fit: DataFrame, key: Sequence[str], ts: str = "ds",
                     start: str = "training_start", end: str = "training_end",
                     reach: float = CHANGEPOINT_RANGE, yearly: bool = False) -> DataFrame:
    """Add trend, weekly, daily (as shares of the trend), yhat and the 95 % bounds.

    Behind the training span the bounds widen: the trend may go on changing as often, and with the
    mean size, as it did inside, so its variance grows with the third power of the time ahead.
    """
    n_t = CHANGEPOINTS + 2
    parts = {"weekly": (0, 2 * WEEKLY_ORDER), "daily": (2 * WEEKLY_ORDER, 2 * DAILY_ORDER)}
    if yearly:
        parts["yearly"] = (2 * (WEEKLY_ORDER + DAILY_ORDER), 2 * YEARLY_ORDER)
    out = _design(rows.join(fit, [*key, start, end]), ts, start, end, reach, yearly)
    out = out.withColumn("trend", dot("_t", F.slice("beta", 1, n_t))).withColumns({
        name: dot(F.slice("_f", lo + 1, n), F.slice("beta", n_t + lo + 1, n)) for name, (lo, n) in parts.items()})
    factor = F.lit(1.0)
    for name in parts:
        factor = factor + F.col(name)
    out = out.withColumn("yhat", F.col("trend") * factor)
    change = F.aggregate(F.slice("beta", 3, CHANGEPOINTS), F.lit(0.0), lambda s, v: s + F.abs(v)) / CHANGEPOINTS
    ahead = F.greatest(_progress(ts, start, end) - 1.0, F.lit(0.0))
    drift = F.lit(2.0 * CHANGEPOINTS / 3.0 / reach) * F.pow(change * factor, 2.0) * F.pow(ahead, 3.0)
    half = F.lit(INTERVAL_Z) * F.sqrt(F.pow("sigma", F.lit(2.0)) + drift)
    return out.withColumns({"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half}).drop(
        "_t", "_f", "beta", "sigma")


def training_span(df: DataFrame, key: Sequence[str], ts: str = "ds") -> DataFrame:
    return df.groupBy(*key).agg(F.min(ts).alias("training_start"), F.max(ts).alias("training_end"))


def future_frame(df: DataFrame, key: Sequence[str], ts: str = "ds", horizon: int = 120,
                 regressors: Sequence[str] = (), history: bool = False) -> DataFrame:
    """The next ``horizon`` hours per key; regressors hold their training mean."""
    span = df.groupBy(*key).agg(F.min(ts).alias("training_start"), F.max(ts).alias("training_end"),
                                *[F.avg(c).alias(c) for c in regressors])
    hour = F.expr("INTERVAL 1 HOUR")
    begin = F.col("training_start") if history else F.col("training_end") + hour
    stop = F.col("training_end") + F.make_dt_interval(hours=F.lit(horizon))
    return span.select(*key, "training_start", "training_end", *regressors, F.explode(F.sequence(begin, stop, hour)).alias(ts))


def baseline_forecast(df: DataFrame, key: Sequence[str], ts: str = "ds", y: str = "y", horizon: int = 120,
                      prefix: str = "", **params) -> DataFrame:
    """Fit on all of ``df`` and forecast the next hours of every series."""
    train = df.join(training_span(df, key, ts), list(key))
    fit = fit_baseline(train, key, ts, y, **params)
    shared = {k: v for k, v in params.items() if k in ("reach", "yearly")}
    out = predict_baseline(future_frame(df, key, ts, horizon), fit, key, ts, **shared).drop("training_start", "training_end")
    return out.withColumnsRenamed({c: prefix + c for c in out.columns if c not in (*key, ts)}) if prefix else out


def attach_baseline(df: DataFrame, key: Sequence[str], ts: str = "ds", y: str = "y", prefix: str = "baseline_",
                    **params) -> DataFrame:
    """The training rows with the baseline's own fitted columns as further features."""
    train = df.join(training_span(df, key, ts), list(key))
    fit = fit_baseline(train, key, ts, y, **params)
    shared = {k: v for k, v in params.items() if k in ("reach", "yearly")}
    out = predict_baseline(train, fit, key, ts, **shared).drop("training_start", "training_end")
    return out.withColumnsRenamed({c: prefix + c for c in out.columns if c not in df.columns})


def _seasons(yearly: bool) -> N.Waves:
    return N.Waves([(7.0, WEEKLY_ORDER), (1.0, DAILY_ORDER)] + ([(365.25, YEARLY_ORDER)] if yearly else []))


def _fits(m: N.Moments, start: int, end: int, reach: float, priors: Sequence[float], season_priors: Sequence[float], yearly: bool):
    """``(prior, season_prior, origin, beta, sigma)`` of one origin; its sums serve all priors."""
    o = N.Origin(m, start, end, reach, CHANGEPOINTS)
    if not o.rows:
        return
    n_t = CHANGEPOINTS + 2
    for prior in priors:
        trend = np.array(trend_penalty(prior))
        xx, xy = o.joint(N.solved(o.tt, o.ty, trend))
        for season_prior in season_priors:
            penalty = np.concatenate([trend, np.array(season_penalty(season_prior, yearly)) * o.top ** 2])
            beta = N.solved(xx, xy, penalty)
            sse = max(o.yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
            yield prior, season_prior, o, (beta[:n_t], beta[n_t:]), math.sqrt(sse / o.rows)


def backtest_rows(df: DataFrame, key: Sequence[str], ts: str, y: str, origins: DataFrame, train_days: int | None = 180, horizon: int = 120,
                  prior: float = CHANGEPOINT_PRIOR, season_prior: float = SEASONALITY_PRIOR, reach: float = CHANGEPOINT_RANGE, yearly: bool = False,
                  group: int | None = None) -> DataFrame:
    """Forecasts of the ``horizon`` hours behind every origin by a baseline fitted on the days before it:
    key, cutoff, training_start, training_end, short_horizon, ds, y, yhat, yhat_lower, yhat_upper.

    An hour without a value is no test row; ``short_horizon`` tells that the series ends early.
    """
    fields = [T.StructField("_at", T.LongType()), T.StructField("short_horizon", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in (y, "yhat", "yhat_lower", "yhat_upper")]]

    def each(m: N.Moments, start: int, end: int, tests: np.ndarray):
        short = len(tests) < horizon
        tests = tests[~np.isnan(m.y[tests])]
        for *_, o, (trend, seasons), sigma in _fits(m, start, end, reach, [prior], [season_prior], yearly):
            u, t, f = o.features(tests)
            factor = 1.0 + f @ seasons
            yhat = t @ trend * factor
            change = np.abs(trend[2:]).sum() / CHANGEPOINTS
            drift = 2.0 * CHANGEPOINTS / 3.0 / reach * (change * factor) ** 2 * np.maximum(u - 1.0, 0.0) ** 3
            half = INTERVAL_Z * np.sqrt(sigma ** 2 + drift)
            yield from zip((tests + m.first).tolist(), [short] * len(tests), m.y[tests].tolist(), yhat.tolist(), (yhat - half).tolist(), (yhat + half).tolist())
    out = N.by_origin(df, key, ts, y, origins, train_days, horizon, _seasons(yearly), each, fields, group)
    return out.select(*key, "cutoff", "training_start", F.col("cutoff").alias("training_end"), "short_horizon", D.slot_start("_at").alias(ts), y, "yhat", "yhat_lower", "yhat_upper")


def backtest_baseline(df: DataFrame, key: Sequence[str], origins: DataFrame, train_days: int | None = 180, horizon: int = 120, ts: str = "ds", y: str = "y", **params) -> DataFrame:
    """Baseline refitted at every origin; one summary row per run."""
    return B.summarise_runs(backtest_rows(df, key, ts, y, origins, train_days, horizon, **params), key, ts, y)


def tune_baseline(df: DataFrame, key: Sequence[str], origins: DataFrame, train_days: int | None = None, horizon: int = 120,
                  priors: Sequence[float] = PRIOR_GRID, season_priors: Sequence[float] = SEASON_GRID, reaches: Sequence[float] = RANGE_GRID,
                  ts: str = "ds", y: str = "y", yearly: bool = False) -> DataFrame:
    """RMSE of every parameter combination over all origins and series.

    The sums of an origin are made once per range; priors only change penalties and the level that
    the seasons are multiplied with.
    """
    fields = [T.StructField(c, T.DoubleType()) for c in ("prior", "season_prior", "reach", "sse")] + [T.StructField("n", T.LongType())]

    def each(m: N.Moments, start: int, end: int, tests: np.ndarray):
        tests = tests[~np.isnan(m.y[tests])]
        for reach in reaches:
            for prior, season_prior, o, (trend, seasons), _ in _fits(m, start, end, float(reach), priors, season_priors, yearly):
                _, t, f = o.features(tests)
                e = m.y[tests] - t @ trend * (1.0 + f @ seasons)
                yield float(prior), float(season_prior), float(reach), float(e @ e), len(tests)
    found = N.by_origin(df, key, ts, y, origins, train_days, horizon, _seasons(yearly), each, fields)
    return found.groupBy("prior", "season_prior", "reach").agg(F.sqrt(F.try_divide(F.sum("sse"), F.sum("n"))).alias("rmse"))


def best_parameters(tuned: DataFrame) -> DataFrame:
    return tuned.orderBy("rmse", "prior", "season_prior", "reach").limit(1)


def evaluate_regressors(df: DataFrame, key: Sequence[str], ts: str, y: str, regressors: Sequence[str],
                        horizon: int = 120) -> DataFrame:
    """Metrics of every subset of regressors on the last ``horizon`` hours.

    Regressors multiply the trend, as the seasons do. As in the reference procedure the future holds
    each at its training mean. All subsets are solved from one set of summed equations.
    """
    train, test = R.split_last(df, key, ts, horizon)
    span = train.groupBy(*key).agg(F.min(ts).alias("training_start"), F.max(ts).alias("training_end"),
                                   *[F.avg(c).alias(f"_m_{c}") for c in regressors],
                                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in regressors])
    n_t, n_f = CHANGEPOINTS + 2, 2 * (WEEKLY_ORDER + DAILY_ORDER)
    scaled = F.array(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in regressors])

    def design(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.join(span, list(key)).withColumns({
            "_y": F.col(y).cast("double"), "_t": trend_features(_progress(ts, "training_start", "training_end"), CHANGEPOINT_RANGE),
            "_f": F.concat(season_features(ts), extra)})

    names, subsets = [], []
    for k in range(len(regressors) + 1):
        for combo in itertools.combinations(range(len(regressors)), k):
            names.append("+".join(regressors[i] for i in combo) or "none")
            subsets.append([*range(n_t + n_f), *[n_t + n_f + i for i in combo]])
    rows = design(train.dropna(subset=[*regressors, y]), scaled)
    level = ridge(rows, key, "_t", "_y", [("level", trend_penalty(CHANGEPOINT_PRIOR))]).select(*key, F.col("beta").alias("level_beta"))
    both = rows.join(level, list(key)).withColumn("_x", _joint(dot("_t", "level_beta")))
    penalty = [*trend_penalty(CHANGEPOINT_PRIOR), *season_penalty(SEASONALITY_PRIOR), *([1e-6] * len(regressors))]
    fits = ridge(both, key, "_x", "_y", [(n, penalty) for n in names], subsets, shares=range(n_t, len(penalty)))
    zeros = F.array(*[F.lit(0.0) for _ in regressors])
    tests = design(test, zeros).join(fits.select(*key, "fit", "beta"), list(key)).withColumn(
        "yhat", dot("_t", F.slice("beta", 1, n_t)) * (F.lit(1.0) + dot("_f", F.slice("beta", n_t + 1, n_f + len(regressors)))))
    return regression_metrics(tests, y, "yhat", [*key, "fit"]).withColumnRenamed("fit", "regressors")


# -- lag regression ------------------------------------------------------------------------------------

def roll_forward(df: DataFrame, fit: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], n_past: int,
                 steps: int) -> DataFrame:
    """Recursive forecast from the newest ``n_past`` rows.

    Each step predicts, moves the window on by one row and writes the prediction into the target
    slot (the last column) of its new last row; the other slots of that row are taken from the
    row that left, as the reference does.
    """
    m = len(cols)
    row = F.struct(F.col(ts).alias("t"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    newest = R.last_rows(df, key, ts, n_past).groupBy(*key).agg(
        F.max(ts).alias("_end"), F.sort_array(F.collect_list(row)).alias("_rows"))
    newest = newest.where(F.size("_rows") == n_past).withColumn("_w", F.flatten(F.transform("_rows", lambda r: r["v"])))
    state = newest.join(fit, list(key))

    def advance(acc: Column, _: Column) -> Column:
        pred = dot(F.concat(F.array(F.lit(1.0)), acc["w"]), F.col("beta"))
        left = F.slice(acc["w"], 1, m - 1) if m > 1 else F.array().cast("array<double>")
        moved = F.concat(F.slice(acc["w"], m + 1, n_past * m - m), left, F.array(pred))
        return F.struct(moved.alias("w"), F.concat(acc["p"], F.array(pred)).alias("p"))

    begin = F.struct(F.col("_w").alias("w"), F.array().cast("array<double>").alias("p"))
    preds = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, advance, lambda a: a["p"])
    return state.select(*key, "_end", F.posexplode(preds).alias("_i", "yhat")).select(
        *key, (F.col("_end") + F.make_dt_interval(hours=F.col("_i") + 1)).alias(ts), "yhat")


def lagged_forecast(df: DataFrame, key: Sequence[str], ts: str = "ds", cols: Sequence[str] = ("y",), n_past: int = PAST,
                    horizon: int = 120, penalty: float = 1.0) -> DataFrame:
    """Scale, fit on lag windows, roll forward and scale back; the target is the last column."""
    target = cols[-1]
    stats = df.groupBy(*key).agg(*[e for c in cols for e in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = df.join(stats, list(key)).select(*key, ts, *[
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c) for c in cols])
    fit = fit_lagged(z, key, ts, cols, target, n_past, 1, penalty)
    out = roll_forward(z, fit, key, ts, cols, n_past, horizon)
    return out.join(stats, list(key)).select(
        *key, ts, (F.col("yhat") * F.col(f"_s_{target}") + F.col(f"_m_{target}")).alias("yhat"))


def direct_forecast_error(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str, n_past: int,
                          horizon: int, train_share: float = 0.8, penalty: float = 1.0) -> DataFrame:
    """Train and test RMSE of a direct ``horizon``-step lag regression fitted on the first ``train_share`` of the hours.

    A sample belongs to the part of the hour it predicts, so a test sample may look back on training hours."""
    span = df.groupBy(*key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    n = D.slot("_b") - D.slot("_a") + 1
    cut = D.slot("_a") + F.floor(n * F.lit(train_share)).cast("long")
    tagged = df.join(span, list(key)).withColumn("part", F.when(D.slot(ts) < cut, "train").otherwise("test")).drop("_a", "_b")
    fit = fit_lagged(tagged.where("part = 'train'"), key, ts, cols, target, n_past, horizon, penalty)
    scored = predict_lagged(df, fit, key, ts, cols, target, n_past, horizon).join(tagged.select(*key, ts, "part"), [*key, ts])
    e = F.col("y") - F.col("yhat")
    return scored.groupBy(*key).agg(
        F.sqrt(F.avg(F.when(F.col("part") == "train", e * e))).alias("rmse_train"),
        F.sqrt(F.avg(F.when(F.col("part") == "test", e * e))).alias("rmse_test"))


# -- direction classifier ---------------------------------------------------------------------------------

def direction_predictions(df: DataFrame, features: Sequence[str], label: str, part: str = "part") -> DataFrame:
    """Fit a multinomial logistic model on the train rows, predict the test rows (labels -1, 0, 1)."""
    rows = df.dropna(subset=[*features, label]).withColumn("_y", (F.col(label) + 1).cast("double"))
    vec = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(rows)
    train, test = vec.where(F.col(part) == "train"), vec.where(F.col(part) == "test")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(train)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=100).fit(scaler.transform(train))
    out = model.transform(scaler.transform(test))
    return out.withColumn("predicted", (F.col("prediction") - 1).cast("int")).drop(
        "_raw", "_x", "_y", "rawPrediction", "probability", "prediction")


def direction_model(df: DataFrame, key: Sequence[str], ts: str, features: Sequence[str], label: str,
                    n_splits: int = 5) -> DataFrame:
    """Predictions of the expanding-window splits, one fit per split."""
    split = B.time_splits(staged(df.select(*key, ts, *features, label), "direction"), key, ts, n_splits)
    out = None
    for i in range(n_splits):
        one = direction_predictions(split.where(F.col("split") == i), features, label)
        out = one if out is None else out.unionByName(one)
    return out


def random_holdout(df: DataFrame, on: Sequence[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Random train/test tag that does not depend on how rows are partitioned."""
    h = F.pmod(F.xxhash64(F.lit(seed), *on), F.lit(10_000))
    return df.withColumn("part", F.when(h < int(share * 10_000), "test").otherwise("train"))


# -- naive forecasts and ablation ---------------------------------------------------------------------------

def naive_errors(df: DataFrame, key: Sequence[str], ts: str, close: str, horizon: int = 120) -> DataFrame:
    """RMSE of two naive forecasts of the forward return, and their ratio in percent.

    The first takes the past return over the same horizon, the second the target ``horizon``
    hours earlier.
    """
    w = R.Blocked(df, key, ts, back=horizon, ahead=horizon)
    w.add(fwd=R.forward_return(w, close, horizon), past=R.past_return(w, close, horizon))
    # The target `horizon` hours earlier is the past return now.
    e1, e2 = F.col("fwd") - F.col("past"), F.col("fwd")
    rows = w.done()
    both = F.col("fwd").isNotNull() & F.col("past").isNotNull()
    out = rows.where(both).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e1 * e1)).alias("rmse_past"), F.sqrt(F.avg(e2 * e2)).alias("rmse_zero"))
    return out.withColumn("ratio_pct", (F.try_divide(F.col("rmse_past"), F.col("rmse_zero")) - 1) * 100)


def ablation(df: DataFrame, key: Sequence[str], ts: str, target: str,
             configs: Sequence[tuple[str, Sequence[str]]], n_past: int = PAST, corr_threshold: float = 0.0) -> DataFrame:
    """Test errors of one model per feature family, each family cut by correlation to the target."""
    df = staged(df, "ablation")
    candidates = [c for c in S.numeric_columns(df) if c not in (ts, target) and "ret_fwd_" not in c]
    correl = {r["field"]: r["correl"] for r in S.corr_to(df, target, candidates).collect()}
    strong = [c for c, v in correl.items() if v is not None and abs(v) > corr_threshold]
    out = None
    for name, contains in configs:
        cols = S.select_family(df.select(*candidates, target, ts), contains, ts, target, strong)[2:]
        used = [*cols, target]
        rows = df.select(*key, ts, *used).dropna()
        err = direct_forecast_error(rows, key, ts, used, target, n_past, 1).withColumns(
            {"config": F.lit(name), "n_features": F.lit(len(cols))})
        out = err if out is None else out.unionByName(err)
    return out
