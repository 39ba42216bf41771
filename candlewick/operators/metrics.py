"""Forecast and classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timefns as D
from .single import with_row
from .stats import exact_quantiles

EPS = 2.220446049250313e-16


def _ape(y: Column, yhat: Column) -> Column:
    return F.abs(y - yhat) / F.greatest(F.abs(y), F.lit(EPS))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), median: bool = False) -> DataFrame:
    """MAPE, MSE, RMSE, MAE, R2, explained variance, RMSPE (%), deviation of the absolute error.

    ``rmse_ref`` repeats the MSE: the figure published under the name RMSE is the squared one.
    """
    a, b = F.col(y), F.col(yhat)
    e = a - b
    rows = df.where(a.isNotNull() & b.isNotNull())
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(_ape(a, b)).alias("mape"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"), F.stddev_pop(F.abs(e)).alias("std_error"),
        (F.sqrt(F.avg(F.pow(F.try_divide(e, a), F.lit(2.0)))) * 100).alias("rmspe"),
        F.var_pop(a).alias("_vy"), F.var_pop(e).alias("_ve"))
    out = out.withColumns({
        "rmse": F.sqrt("mse"), "rmse_ref": F.col("mse"),
        "r2": F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_vy")),
        "explained_variance": F.lit(1.0) - F.try_divide(F.col("_ve"), F.col("_vy"))}).drop("_vy", "_ve")
    if median:
        q = exact_quantiles(rows.select(*by, F.abs(e).alias("_e")), by, "_e", (0.5,), ("median_ae",))
        out = out.join(q, list(by)) if by else with_row(out, q)
    return out


def hit_rate(df: DataFrame, key: Sequence[str], ts: str, y: str, yhat: str) -> DataFrame:
    """Share of steps where forecast and truth move the same way."""
    w = Window.partitionBy(*key).orderBy(ts)
    dy, dh = F.col(y) - F.lag(y).over(w), F.col(yhat) - F.lag(yhat).over(w)
    moves = df.select(*key, dy.alias("dy"), dh.alias("dh"))
    return moves.groupBy(*key).agg(
        F.try_divide(F.count_if(F.col("dy") * F.col("dh") > 0), F.count("dy")).alias("pcg_same_dir"))


def mape_by_horizon(df: DataFrame, key: Sequence[str], ts: str, y: str, yhat: str, horizon: int) -> DataFrame:
    """Mean and population deviation of the MAPE per position modulo ``horizon`` (dense series)."""
    start = df.groupBy(*key).agg(F.min(ts).alias("_start"))
    rows = df.join(start, list(key)).withColumn(
        "hour", F.pmod(D.slot(ts) - D.slot("_start"), F.lit(horizon)).cast("int"))
    ape = _ape(F.col(y), F.col(yhat))
    return rows.groupBy(*key, "hour").agg(F.avg(ape).alias("avg_mape"), F.stddev_pop(ape).alias("std_mape"))


def horizon_extremes(by_hour: DataFrame, key: Sequence[str]) -> DataFrame:
    return by_hour.groupBy(*key).agg(
        F.min_by("hour", F.struct("avg_mape", "hour")).alias("best_hour"), F.min("avg_mape").alias("best_mape"),
        F.min_by("hour", F.struct(-F.col("avg_mape"), F.col("hour"))).alias("worst_hour"),
        F.max("avg_mape").alias("worst_mape"), F.avg("avg_mape").alias("mean_mape"))


def mape_per_step(runs: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error per array position over many runs."""
    cells = F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(yhat).alias("yhat")))
    flat = runs.select(*by, cells.alias("hour", "c"))
    e = F.abs(F.try_divide(F.col("c.y") - F.col("c.yhat"), F.col("c.y"))) * 100
    return flat.groupBy(*by, "hour").agg(F.avg(e).alias("mean_mape"))


def residual_percent(y: str | Column, yhat: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (y, yhat))
    return F.try_divide(a - b, a) * 100


def class_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """Accuracy, precision, recall and F1 of a binary label; undefined ones are 0."""
    a, p = F.col(actual) == positive, F.col(predicted) == positive
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(actual) == F.col(predicted)).alias("_ok"),
                            F.count_if(a & p).alias("_tp"), F.count_if(p).alias("_pp"), F.count_if(a).alias("_ap"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    s = s.withColumns({"accuracy": F.try_divide(F.col("_ok"), F.col("n")),
                       "precision": z(F.try_divide(F.col("_tp"), F.col("_pp"))),
                       "recall": z(F.try_divide(F.col("_tp"), F.col("_ap"))),
                       "f1_score": z(F.try_divide(F.col("_tp") * 2, F.col("_pp") + F.col("_ap")))})
    return s.drop("_ok", "_tp", "_pp", "_ap")


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    """Counts per actual and predicted class with a total row and column."""
    return df.rollup(actual).agg(
        *[F.count_if(F.col(predicted) == l).alias(f"predicted_{l}".replace("-", "m")) for l in labels],
        F.count(F.lit(1)).alias("total")).select(
            F.coalesce(F.col(actual).cast("string"), F.lit("Total")).alias("actual"),
            *[f"predicted_{l}".replace("-", "m") for l in labels], "total")


def constant_class(df: DataFrame, actual: str, key: Sequence[str]) -> DataFrame:
    """The class that is most frequent (the smaller of equals), and how often it is right."""
    counts = df.groupBy(*key, F.col(actual).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.max(F.struct("_n", (-F.col("label")).alias("_minus")))
    out = counts.groupBy(*key).agg(best.alias("_b"), F.sum("_n").alias("n"))
    return out.select(*key, (-F.col("_b._minus")).cast("int").alias("label"), "n", (F.col("_b._n") / F.col("n")).alias("accuracy"))


def accuracy_by(df: DataFrame, actual: str, predicted: str, key: Sequence[str]) -> DataFrame:
    """Rows and share of right answers per key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def mean_confusion(df: DataFrame, actual: str, predicted: str, split: str, labels: Sequence[int]) -> DataFrame:
    """Confusion matrix averaged over splits: mean count per actual and predicted class (0 where a split has none)."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("_n"))
    n = df.agg(F.count_distinct(split).alias("_s"))
    cells = df.sparkSession.createDataFrame([(a, p) for a in labels for p in labels], "actual int, predicted int")
    return cells.join(counts, ["actual", "predicted"], "left").withColumn("_s", n.scalar()).select(
        "actual", "predicted", F.try_divide(F.coalesce("_n", F.lit(0)), F.col("_s")).alias("mean_count"))
