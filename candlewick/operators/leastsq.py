"""Ridge regression for many groups from summed normal equations.

Each task adds up ``x x'`` and ``x y`` of its own rows; only those small matrices are shuffled.
A group may be spread over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 512
COMBINERS = 32


def normal_equations(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """Partial sums per group: ``n``, flattened ``xx``, ``xy``, ``yy`` and the largest ``|y|``; may repeat a group."""
    rows = df.select(*key, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("n", T.LongType()),
                           T.StructField("xx", arr), T.StructField("xy", arr), T.StructField("yy", T.DoubleType()),
                           T.StructField("top", T.DoubleType())])
    names = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([[*k, n, xx.ravel(), xy, yy, top] for k, (n, xx, xy, yy, top) in held.items()],
                               columns=[*names, "n", "xx", "xy", "yy", "top"])
            held.clear()
            return out

        for b in batches:
            if not len(b):
                continue
            for k, part in (b.groupby(names, sort=False) if names else [((), b)]):
                m = np.stack(part["_x"].to_numpy())
                v = part["_y"].to_numpy()
                add = [len(part), m.T @ m, m.T @ v, float(v @ v), float(np.abs(v).max())]
                k = k if isinstance(k, tuple) else (k,)
                held[k] = [*(p + q for p, q in zip(held[k][:4], add)), max(held[k][4], add[4])] if k in held else add
            if len(held) >= HELD_GROUPS:
                yield flush()
        if held:
            yield flush()

    return rows.mapInPandas(run, schema)


def _combined(parts: DataFrame, names: list[str]) -> DataFrame:
    """Sum a group's partial rows in ``COMBINERS`` places before the solver."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in names], pdf["n"].sum(), np.sum(np.stack(pdf["xx"]), axis=0),
                              np.sum(np.stack(pdf["xy"]), axis=0), pdf["yy"].sum(), pdf["top"].max()]],
                            columns=[*names, "n", "xx", "xy", "yy", "top"])

    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(COMBINERS)))
    return salted.groupBy(*names, "_salt").applyInPandas(add, parts.schema)


def ridge(df: DataFrame, key: Sequence[str], x: str, y: str,
          penalties: Sequence[tuple[str, Sequence[float]]], subsets: Sequence[Sequence[int]] | None = None,
          match: str | None = None, shares: Sequence[int] = ()) -> DataFrame:
    """``key, fit, beta, sigma, n``: one solution per group and penalty vector.

    ``subsets`` (parallel to ``penalties``) restricts a fit to some feature positions; the other
    coefficients are zero. All fits of a group share its one pass over the data. With ``match``
    a group only runs the fits whose name up to ``|`` equals its value in that key column.

    ``shares`` are the positions whose features carry the unit of ``y``, so that their coefficients
    are plain numbers: their penalties count in squares of the largest ``|y|`` of the group. The
    solution for ``1000 y`` is then 1000 times (for shares: equal to) the one for ``y``.
    """
    names = list(key)
    schema = T.StructType([*[df.schema[k] for k in key], T.StructField("fit", T.StringType()),
                           T.StructField("beta", T.ArrayType(T.DoubleType())),
                           T.StructField("sigma", T.DoubleType()), T.StructField("n", T.LongType())])
    plan = [(name, np.asarray(pen, float), None if subsets is None else list(subsets[i]))
            for i, (name, pen) in enumerate(penalties)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, xy, yy = int(pdf["n"].sum()), np.sum(np.stack(pdf["xy"]), axis=0), float(pdf["yy"].sum())
        d = len(xy)
        xx = np.sum(np.stack(pdf["xx"]), axis=0).reshape(d, d)
        unit = np.ones(d)
        unit[list(shares)] = float(pdf["top"].max()) ** 2
        out = []
        for name, pen, keep in plan:
            if match and name.split("|")[0] != str(pdf[match].iloc[0]):
                continue
            at = np.arange(d) if keep is None else np.asarray(keep)
            a = xx[np.ix_(at, at)] + np.diag((pen * unit)[at])
            # Columns of equal length: features may differ by many powers of ten.
            size = np.sqrt(np.diag(a))
            size[size == 0] = 1.0
            beta = np.zeros(d)
            beta[at] = np.linalg.lstsq(a / np.outer(size, size), xy[at] / size, rcond=None)[0] / size
            sse = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
            out.append([*[pdf[k].iloc[0] for k in names], name, beta, float(np.sqrt(sse / max(n, 1))), n])
        return pd.DataFrame(out, columns=[*names, "fit", "beta", "sigma", "n"])

    parts = _combined(normal_equations(df, key, x, y), names)
    return parts.groupBy(*key).applyInPandas(solve, schema)


def dot(x: str | Column, beta: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, beta))
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and sample covariance of the complete rows (d x d, on the driver)."""
    rows = df.select([F.col(c).cast("double").alias(c) for c in cols]).dropna()
    m = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = np.array([m[c] for c in cols], float)
    centred = rows.select(F.array(*[F.col(c) - F.lit(float(v)) for c, v in zip(cols, means)]).alias("x"),
                          F.lit(0.0).alias("y"))
    parts = normal_equations(centred, [], "x", "y")
    total = parts.select("n", F.posexplode("xx").alias("p", "v")).groupBy("p").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    d = len(cols)
    cov = np.zeros(d * d)
    for r in total:
        cov[r["p"]] = r["v"]
    n = int(total[0]["n"])
    return n, means, cov.reshape(d, d) / max(n - 1, 1)
