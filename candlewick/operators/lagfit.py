"""Lag regression at full length: block-Toeplitz equations from lagged cross-products.

A sample is ``n_past`` consecutive hours of ``m`` columns and a target some hours later. Samples
overlap, so their normal equations hold few numbers: entry (a, b) is a sum of products that lie
``b - a`` hours apart, up to the hours at the edges. Tasks add up the ``n_past`` lagged
cross-products of their own blocks (``m x m`` each) and hand on the hours near the edges of a run;
no sample and no ``d x d`` matrix (``d = n_past * m``) is ever made.

The solver takes the Toeplitz part through the block Levinson recursion, whose first and last
columns of the inverse give its products with any vector (Gohberg and Semencul), and meets the edges
with conjugate gradients around it. Memory is that of ``n_past * m * m`` numbers and the edges. Where the
edges outweigh the rest, so that the gradients don't settle, the equations are written out and solved
as they are; a series with no more samples than coefficients is solved in its samples (its rows are
then fewer numbers than the cross-products).

A run is a stretch of hours without a gap; a sample lies in one run. Rows with a null or NaN in any
column are left out and end a run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import timefns as D

BLOCK_STEPS = 4096
COMBINERS = 32
TOLERANCE = 1e-12
STEPS = 300  # of the conjugate gradients
GOOD = 1e-9  # a residual, relative to the right-hand side, that is taken after these steps


# -- runs and blocks

def _runs(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str) -> DataFrame:
    """``key, ts, _slot, _run, _pos, _len, _z, _y``: complete rows, their run, place in it and its length."""
    z = F.array(*[F.col(c).cast("double") for c in cols])
    rows = df.select(*key, ts, D.slot(ts).alias("_slot"), z.alias("_z"), F.col(target).cast("double").alias("_y"))
    rows = rows.where(~F.exists("_z", lambda v: v.isNull() | F.isnan(v)) & F.col("_y").isNotNull() & ~F.isnan("_y"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_slot"))
    runs = rows.withColumn("_run", F.col("_slot") - nth)
    ends = runs.groupBy(*key, "_run").agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_len"))
    return runs.join(ends, [*key, "_run"]).withColumn("_pos", F.col("_slot") - F.col("_first")).drop("_first")


def _blocks(runs: DataFrame, back: int, block: int) -> DataFrame:
    """Rows once per block that needs them: their own, and those whose next ``back`` rows reach into it."""
    home = F.floor(F.col("_slot") / block).cast("long")
    last = F.least(F.floor((F.col("_slot") + back) / block), F.floor((F.col("_slot") - F.col("_pos") + F.col("_len") - 1) / block)).cast("long")
    return runs.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(F.col("_home"), F.greatest(F.col("_home"), last))))


class Run:
    """The rows of one run in a block: ``z`` and ``y`` with the first ``halo`` rows from before it."""

    def __init__(self, part: pd.DataFrame, block: int):
        part = part.sort_values("_slot")
        self.z, self.y = np.stack(part["_z"].to_numpy()), part["_y"].to_numpy()
        self.halo = int((part["_home"] < block).sum())
        self.pos, self.length = part["_pos"].to_numpy(), int(part["_len"].iloc[0])
        self.ts = part


def lag_moments(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str, n_past: int, horizon: int,
                block: int = BLOCK_STEPS) -> DataFrame:
    """Partial sums per key: ``cc`` (n_past, m, m), ``cy`` (n_past, m), sums of z and y, and the edge rows of runs."""
    m, reach = len(cols), n_past + horizon
    arr = T.ArrayType(T.DoubleType())
    names = list(key)
    schema = T.StructType([*[df.schema[k] for k in names], *[T.StructField(c, arr) for c in ("cc", "cy", "sums", "edges")]])

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        cc, cy, sums, edges = np.zeros((n_past, m, m)), np.zeros((n_past, m)), np.zeros(m + 1), []
        for run, part in pdf.groupby("_run", sort=False):
            r = Run(part, int(pdf["_block"].iloc[0]))
            n, own = len(r.z), r.halo
            if r.length < reach or own == n:
                continue  # too short for a sample, or only there as halo
            for k in range(min(n_past, n)):
                to = max(own, k)
                cc[k] += r.z[to - k:n - k].T @ r.z[to:]
            for a in range(n_past):
                lag = reach - 1 - a
                to = max(own, lag)
                if to < n:
                    cy[a] += r.z[to - lag:n - lag].T @ r.y[to:]
            sums += np.append(r.z[own:].sum(axis=0), r.y[own:].sum())
            short = r.length - reach + 1 <= n_past * m  # then all rows, no more than cc holds
            at = own + np.flatnonzero((r.pos[own:] < reach) | (r.pos[own:] >= r.length - reach) | short)
            edges.append(np.column_stack([np.full(len(at), run), r.pos[at], np.full(len(at), r.length), r.y[at], r.z[at]]).ravel())
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in names], cc.ravel(), cy.ravel(), sums, np.concatenate([np.zeros(0), *edges])]], columns=schema.names)

    rows = _blocks(_runs(df, key, ts, cols, target), reach - 1, block)
    return rows.groupBy(*names, "_block").applyInPandas(partial, schema)


def _add(pdf: pd.DataFrame, names: list[str], columns: list[str]) -> pd.DataFrame:
    total = [np.sum(np.stack(pdf[c]), axis=0) for c in ("cc", "cy", "sums")]
    return pd.DataFrame([[*[pdf[k].iloc[0] for k in names], *total, np.concatenate(pdf["edges"].tolist())]], columns=columns)


# -- the solver

def first_and_last(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last block column of the inverse of the symmetric block-Toeplitz matrix whose block
    (a, b) is ``c[b - a]`` (its transpose below the diagonal): the Levinson recursion."""
    n, m = c.shape[:2]
    x = y = np.linalg.inv(c[0])[None]
    one = np.eye(m)
    for k in range(1, n):
        low = np.tensordot(c[k:0:-1], x, axes=([0, 1], [0, 1]))  # sum of c[k - b]' x[b]
        high = np.einsum("kij,kjl->il", c[1:k + 1], y)
        zero = np.zeros((1, m, m))
        x0, y0 = np.concatenate([x, zero]), np.concatenate([zero, y])
        x, y = (x0 - y0 @ low) @ np.linalg.inv(one - high @ low), (y0 - x0 @ high) @ np.linalg.inv(one - low @ high)
    return x, y


class Toeplitz:
    """Products with a symmetric block-Toeplitz matrix and with its inverse, by Fourier transforms."""

    def __init__(self, c: np.ndarray):
        self.n, self.m = c.shape[:2]
        self.size = 1 << (2 * self.n - 1).bit_length()
        self.forward = self._transform(c.transpose(0, 2, 1)) + self._transform(np.concatenate([np.zeros_like(c[:1]), c[1:]]), True)
        x, y = first_and_last(c)
        shifted = np.concatenate([np.zeros_like(y[:1]), y[:-1]])
        self.parts = [(self._transform(x), np.linalg.inv(x[0]), 1.0), (self._transform(shifted), np.linalg.inv(y[-1]), -1.0)]

    def _transform(self, blocks: np.ndarray, mirrored: bool = False) -> np.ndarray:
        padded = np.zeros((self.size, self.m, self.m))
        if mirrored:
            padded[-np.arange(len(blocks))] = blocks
        else:
            padded[:len(blocks)] = blocks
        return np.fft.rfft(padded, axis=0)

    def _through(self, kernel: np.ndarray, v: np.ndarray, adjoint: bool = False) -> np.ndarray:
        f = np.fft.rfft(v, n=self.size, axis=0)[:, :, None]
        g = (kernel.conj().transpose(0, 2, 1) if adjoint else kernel) @ f
        return np.fft.irfft(g[:, :, 0], n=self.size, axis=0)[:self.n]

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._through(self.forward, v.reshape(self.n, self.m)).ravel()

    def solve(self, v: np.ndarray) -> np.ndarray:
        v = v.reshape(self.n, self.m)
        return sum(sign * self._through(k, self._through(k, v, True) @ middle.T) for k, middle, sign in self.parts).ravel()


class Edges:
    """Products with the samples that a run's ends cut: they are in the lagged sums but are no samples."""

    def __init__(self, edges: np.ndarray, n_past: int, m: int, horizon: int):
        self.n, self.m, reach = n_past, m, n_past + horizon
        rows = edges.reshape(-1, 4 + m)
        self.heads, self.tails, self.samples, self.whole = [], [], 0, []
        self.head_z, self.head_y, self.tail_z = [], [], []
        for run in np.unique(rows[:, 0]):
            own = rows[rows[:, 0] == run]
            own = own[np.argsort(own[:, 1])]
            length = int(own[0, 2])
            head, tail = own[own[:, 1] < reach], own[own[:, 1] >= length - reach]
            self.samples += length - reach + 1
            self.whole.append((own[:, 4:], own[:, 3]) if len(own) == length else None)
            z0, z1 = head[:n_past - 1, 4:], tail[len(tail) - (reach - 1):, 4:]
            self.heads.append(np.concatenate([np.zeros((n_past - 1, m)), z0]))
            self.tails.append(np.concatenate([z1, np.zeros((n_past - 1, m))]))
            self.head_z.append(head[:, 4:])
            self.head_y.append(head[:, 3])
            self.tail_z.append(z1)

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(rows).ravel()
        return np.lib.stride_tricks.sliding_window_view(flat, self.n * self.m)[::self.m] if len(rows) >= self.n else np.zeros((0, self.n * self.m))

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for rows in (*self.heads, *self.tails):
            w = self._windows(rows)
            out += (w @ v) @ w
        return out


def solve_lagged(cc: np.ndarray, cy: np.ndarray, sums: np.ndarray, edges: np.ndarray, n_past: int, m: int, horizon: int, penalty: float) -> np.ndarray | None:
    """Intercept and coefficients (oldest hour first); None without samples. The intercept bears no penalty."""
    if not len(edges):
        return None
    cc, cy = cc.reshape(n_past, m, m), cy.reshape(n_past, m)
    e = Edges(edges, n_past, m, horizon)
    reach = n_past + horizon
    total, total_y = sums[:m], sums[m]
    mean, b = np.zeros((n_past, m)), cy.copy()
    for a in range(n_past):
        lag = reach - 1 - a
        mean[a] = total
        for z, y, tail in zip(e.head_z, e.head_y, e.tail_z):
            mean[a] -= z[:a].sum(axis=0) + tail[a:].sum(axis=0)
            b[a] -= z[:a].T @ y[lag:lag + a]
    mean = (mean / e.samples).ravel()
    mean_y = (total_y - sum(y[:reach - 1].sum() for y in e.head_y)) / e.samples
    b = b.ravel() - e.samples * mean * mean_y
    if e.samples <= n_past * m and None not in e.whole:
        w = in_samples(e, mean, mean_y, reach, penalty)
    else:
        ridge = cc.copy()
        ridge[0] += penalty * np.eye(m)
        w = by_gradients(ridge, e, mean, b)
        if w is None:
            w = written_out(ridge, e, mean, b)
    return np.append(mean_y - mean @ w, w)


def in_samples(e: Edges, mean: np.ndarray, mean_y: float, reach: int, penalty: float) -> np.ndarray:
    """The dual equations: one unknown per sample."""
    x = np.concatenate([e._windows(z)[:len(z) - reach + 1] for z, _ in e.whole]) - mean
    y = np.concatenate([y[reach - 1:] for _, y in e.whole]) - mean_y
    return x.T @ np.linalg.solve(x @ x.T + penalty * np.eye(len(x)), y)


def by_gradients(ridge: np.ndarray, e: Edges, mean: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Conjugate gradients, the Toeplitz part's inverse before them; None when they don't settle."""
    try:
        t = Toeplitz(ridge)
    except np.linalg.LinAlgError:
        return None

    def times(v: np.ndarray) -> np.ndarray:
        return t.times(v) - e.times(v) - e.samples * mean * (mean @ v)
    x, r = np.zeros_like(b), b.copy()
    size = np.linalg.norm(b)
    z = t.solve(r)
    p, rz = z.copy(), r @ z
    for _ in range(STEPS):
        if np.linalg.norm(r) <= TOLERANCE * size:
            break
        q = times(p)
        step = rz / (p @ q)
        x += step * p
        r -= step * q
        z = t.solve(r)
        p, rz = z + (r @ z) / rz * p, r @ z
        if not np.isfinite(rz) or rz <= 0:
            break
    good = np.isfinite(x).all() and np.linalg.norm(b - times(x)) <= GOOD * size
    return x if good else None


def written_out(ridge: np.ndarray, e: Edges, mean: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The equations themselves, ``d x d``, from the same moments."""
    n, m = ridge.shape[:2]
    full = np.empty((n, m, n, m))
    for i in range(n):
        for j in range(i, n):
            full[i, :, j], full[j, :, i] = ridge[j - i], ridge[j - i].T
    full = full.reshape(n * m, n * m)
    for rows in (*e.heads, *e.tails):
        w = np.ascontiguousarray(e._windows(rows))
        full -= w.T @ w
    full -= e.samples * np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(full), np.finfo(float).tiny))
    return np.linalg.lstsq(full / np.outer(size, size), b / size, rcond=None)[0] / size if n * m <= 2000 else np.linalg.solve(full / np.outer(size, size), b / size) / size


# -- fit and predict

def fit_lagged(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str, n_past: int, horizon: int = 1,
               penalty: float = 1.0, block: int = BLOCK_STEPS) -> DataFrame:
    """``key, beta``: ridge regression of the target ``horizon`` hours ahead on the last ``n_past`` hours of ``cols``."""
    names = list(key)
    parts = lag_moments(df, names, ts, cols, target, n_past, horizon, block)
    columns = parts.columns
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(COMBINERS)))
    few = salted.groupBy(*names, "_salt").applyInPandas(lambda pdf: _add(pdf, names, columns), parts.schema)
    schema = T.StructType([*[df.schema[k] for k in names], T.StructField("beta", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _add(pdf, names, columns).iloc[0]
        beta = solve_lagged(r["cc"], r["cy"], r["sums"], r["edges"], n_past, len(cols), horizon, penalty)
        return pd.DataFrame([] if beta is None else [[*[r[k] for k in names], beta]], columns=schema.names)
    return few.groupBy(*names).applyInPandas(solve, schema)


def predict_lagged(df: DataFrame, fit: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str, n_past: int, horizon: int = 1,
                   block: int = BLOCK_STEPS) -> DataFrame:
    """``key, ts, y, yhat`` of every sample, ``ts`` being the hour that is predicted. Samples are not made: each
    lag's coefficients meet a whole block of hours at once."""
    names, m, reach = list(key), len(cols), n_past + horizon
    schema = T.StructType([*[df.schema[k] for k in names], T.StructField(ts, df.schema[ts].dataType), T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            beta = np.asarray(right["beta"].iloc[0])
            w = beta[1:].reshape(n_past, m)
            for _, part in left.groupby("_run", sort=False):
                r = Run(part, int(left["_block"].iloc[0]))
                to = max(r.halo, reach - 1)
                if to >= len(r.z):
                    continue
                yhat = np.full(len(r.z) - to, beta[0])
                for a in range(n_past):
                    lag = reach - 1 - a
                    yhat += r.z[to - lag:len(r.z) - lag] @ w[a]
                out.append(pd.DataFrame({**{k: r.ts[k].iloc[0] for k in names}, ts: r.ts[ts].to_numpy()[to:], "y": r.y[to:], "yhat": yhat}))
        return pd.concat(out)[schema.names] if out else pd.DataFrame(columns=schema.names)

    rows = _blocks(_runs(df, key, ts, cols, target), reach - 1, block)
    # A series' coefficients go to each of its blocks.
    spread = rows.select(*names, "_block").distinct().join(fit, names).withColumnsRenamed({c: f"_of_{c}" for c in [*names, "_block"]})
    return rows.groupBy(*names, "_block").cogroup(spread.groupBy(*[f"_of_{c}" for c in [*names, "_block"]])).applyInPandas(run, schema)
