"""Feature selection. Data is read in a few aggregations; d x d algebra runs on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged
from .leastsq import moments
from .stats import corr_to, drop_constant


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population variance per column."""
    return df.agg(*[F.var_pop(c).alias(c) for c in cols]).unpivot([], list(cols), "feature", "variance")


def select_by_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.1) -> DataFrame:
    return variances(df, cols).where(F.col("variance") > threshold)


def compared_sets(one: DataFrame, two: DataFrame) -> DataFrame:
    """``part, <columns>``: distinct rows of either table, of both, of the first alone, of the second alone."""
    parts = {"either": one.union(two).distinct(), "both": one.intersect(two), "first only": one.subtract(two), "second only": two.subtract(one)}
    tagged = [df.select(F.lit(name).alias("part"), "*") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def assemble(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(target).cast("double").alias("_label"))
    return VectorAssembler(inputCols=list(cols), outputCol="_features", handleInvalid="skip").transform(
        rows.dropna()).select("_features", "_label")


def select_by_forest(df: DataFrame, cols: Sequence[str], target: str, top_n: int = 20, trees: int = 100,
                     depth: int = 8, seed: int = 42) -> DataFrame:
    """Features by random-forest importance, the best ``top_n``."""
    model = RandomForestRegressor(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth,
                                  seed=seed).fit(assemble(df, cols, target))
    ranked = sorted(zip(cols, model.featureImportances.toArray()), key=lambda p: (-p[1], p[0]))
    return _table(df.sparkSession, [(c, float(v)) for c, v in ranked[:top_n]], "feature string, importance double")


def rfe(df: DataFrame, cols: Sequence[str], target: str, n_features: int = 20) -> DataFrame:
    """Recursive elimination with a linear model: drop the smallest coefficient each round.

    One covariance pass over the data serves every round.
    """
    kept = [c for c in drop_constant(df.select(*cols), cols).columns]
    order = list(kept)
    _, _, cov = moments(df, [*order, target])
    at = {c: i for i, c in enumerate(order)}
    t = len(order)
    dropped: list[tuple[str, int]] = []
    while len(kept) > min(n_features, len(order)):
        idx = [at[c] for c in kept]
        beta = np.linalg.lstsq(cov[np.ix_(idx, idx)], cov[idx, t], rcond=None)[0]
        weakest = kept[int(np.argmin(beta ** 2))]
        kept.remove(weakest)
        dropped.append((weakest, len(kept) + 1))
    rows = [(c, 1, True) for c in kept] + [
        (c, r - len(kept) + 1, False) for c, r in dropped]
    return _table(df.sparkSession, rows, "feature string, ranking int, selected boolean")


def ols_pvalues(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Two-sided p-values of an ordinary least squares fit with intercept."""
    fit = LinearRegression(featuresCol="_features", labelCol="_label", solver="normal", standardization=False
                           ).fit(assemble(df, cols, target))
    p = fit.summary.pValues
    return _table(df.sparkSession, [(c, float(fit.coefficients[i]), float(p[i])) for i, c in enumerate(cols)],
                  "feature string, coefficient double, p_value double")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix."""
    _, _, cov = moments(df, cols)
    sd = np.sqrt(np.diag(cov))
    live = [i for i, s in enumerate(sd) if s > 0]
    r = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
    # A column that others determine has no finite factor and is left out.
    if np.linalg.cond(r) < 1e12:
        values = np.diag(np.linalg.inv(r))
    else:
        values = np.array([_vif_of(r, i) for i in range(len(live))])
    rows = [(cols[j], float(v)) for j, v in zip(live, values) if np.isfinite(v)]
    return _table(df.sparkSession, rows, "feature string, vif double")


def _vif_of(r: np.ndarray, i: int) -> float:
    rest = [j for j in range(len(r)) if j != i]
    beta = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=None)[0]
    left = 1.0 - float(r[i, rest] @ beta)
    return 1.0 / left if left > 1e-10 else float("inf")


def select_features(df: DataFrame, cols: Sequence[str], target: str, corr_threshold: float = 0.1,
                    variance_threshold: float = 0.1, n_features: int = 20, trees: int = 100,
                    check_multicollinearity: bool = True) -> DataFrame:
    """(method, feature) rows of four selectors; their distinct features are the selection."""
    spark = df.sparkSession
    df = staged(df.select(*cols, target), "selection")
    by_corr = corr_to(df, target, cols, corr_threshold).select(F.lit("correlation").alias("method"), F.col("field").alias("feature"))
    by_var = select_by_variance(df, cols, variance_threshold).select(F.lit("variance").alias("method"), "feature")
    by_forest = select_by_forest(df, cols, target, n_features, trees).select(F.lit("forest").alias("method"), "feature")
    chosen = [r["feature"] for r in rfe(df, cols, target, n_features).where("selected").collect()]
    if check_multicollinearity:
        chosen = [r["feature"] for r in vif(df, chosen).where("vif < 10").collect()]
    by_rfe = _table(spark, [("elimination", c) for c in chosen], "method string, feature string")
    return by_corr.unionByName(by_var).unionByName(by_forest).unionByName(by_rfe)
