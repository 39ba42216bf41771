"""Baseline fits from many origins of one series, from running sums of moments.

The baseline's features depend on the origin: hinges lie at shares of its training span, and the
seasons are multiplied with the level of its first fit. But between two hinges every feature is a
line in time, times a wave that depends on the hour alone. So the equations of any origin follow from
sums of ``time^p``, ``time^p * waves``, ``time^p * waves * waves`` and the same with ``y`` between
its hinges, and those are differences of running sums over the hours. Each hour is met once per
group of neighbouring origins, however many origins, priors and ranges there are; no row is copied
per origin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import timefns as D

LONG = 1 << 40  # hours of a training span without a limit


# -- origins

def origins_by_step(df: DataFrame, key: Sequence[str], ts: str, initial: float = 0.7, step_h: int = 1, horizon: int = 120) -> DataFrame:
    """``key, _base, _step, _count``: an origin every ``step_h`` hours, from ``initial`` of the series'
    hours on, as long as ``horizon`` hours follow."""
    span = _span(df, key, ts)
    base = F.col("_first") + F.round(initial * F.col("_n")).cast("long") - 1
    count = F.expr(f"(_last - {horizon} - _base) div {step_h}") + 1
    return span.withColumn("_base", base).withColumn("_step", F.lit(step_h).cast("long")).withColumn("_count", count).where("_count > 0").select(*key, "_base", "_step", "_count")


def origins_by_period(df: DataFrame, key: Sequence[str], ts: str, initial: float = 0.7, period_h: int = 1440, horizon: int = 120) -> DataFrame:
    """The same for origins that step back from ``horizon`` hours before the end by ``period_h`` hours,
    not before ``initial`` of the series' hours behind its start."""
    span = _span(df, key, ts)
    least = F.col("_first") + F.round(initial * F.col("_n")).cast("long")
    count = F.expr(f"(_last - {horizon} - _least) div {period_h}") + 1
    rows = span.withColumn("_least", least).where(F.col("_last") - horizon >= F.col("_least")).withColumn("_count", count)
    return rows.select(*key, (F.col("_last") - horizon - (F.col("_count") - 1) * period_h).alias("_base"), F.lit(period_h).cast("long").alias("_step"), "_count")


def _span(df: DataFrame, key: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*key).agg(D.slot(F.min(ts)).alias("_first"), D.slot(F.max(ts)).alias("_last")).withColumn("_n", F.col("_last") - F.col("_first") + 1)


def splits(df: DataFrame, key: Sequence[str], ts: str, origins: DataFrame, train_days: int | None = None, horizon: int = 120) -> DataFrame:
    """One row per origin: cutoff, training_start, training_end, test_start, test_end, n_train."""
    train_h = LONG if train_days is None else 24 * train_days
    rows = origins.join(_span(df, key, ts).select(*key, "_first"), list(key)).withColumn("_c", F.explode(F.expr("transform(sequence(0L, _count - 1), k -> _base + k * _step)")))
    start = F.greatest(F.col("_first"), F.col("_c") - F.lit(train_h - 1))
    return rows.select(*key, D.slot_start("_c").alias("cutoff"), D.slot_start(start).alias("training_start"), D.slot_start("_c").alias("training_end"),
                       D.slot_start(F.col("_c") + 1).alias("test_start"), D.slot_start(F.col("_c") + horizon).alias("test_end"), (F.col("_c") - start + 1).alias("n_train"))


# -- moments

class Waves:
    """Weekly, daily and (with ``yearly``) yearly Fourier pairs of absolute hours."""

    def __init__(self, periods: Sequence[tuple[float, int]]):
        self.rates = [2 * math.pi * k / period for period, order in periods for k in range(1, order + 1)]

    def at(self, hours: np.ndarray) -> np.ndarray:
        angle = hours[:, None] / 24.0 * np.array(self.rates)
        return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(hours), -1)


class Moments:
    """Running sums over consecutive hours from ``first`` on; ``y`` is NaN where an hour has no value."""

    def __init__(self, first: int, y: np.ndarray, waves: Waves):
        self.first, self.y, self.n = first, y, len(y)
        hours = first + np.arange(self.n)
        self.f = waves.at(hours)
        d = self.f.shape[1]
        self.upper = np.triu_indices(d)
        known = ~np.isnan(y)
        v = np.where(known, y, 0.0)
        # Time in the middle of the stretch is 0, and its ends are half a unit away: sums stay small.
        self.mid, self.size = (self.n - 1) / 2, float(max(self.n, 1))
        x = (np.arange(self.n) - self.mid) / self.size
        q = np.concatenate([np.ones((self.n, 1)), self.f, self.f[:, self.upper[0]] * self.f[:, self.upper[1]], v[:, None], v[:, None] * self.f], axis=1) * known[:, None]
        powers = np.stack([q, q * x[:, None], q * (x * x)[:, None]], axis=1)
        self.run = np.concatenate([np.zeros((1, *powers.shape[1:])), np.cumsum(powers, axis=0)])
        self.squares = np.append(0.0, np.cumsum(v * v))
        self.d = d

    def between(self, cuts: np.ndarray, start: int, span: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of 1, u and u^2 (u: progress since ``start`` in units of ``span``) times every quantity,
        between neighbouring ``cuts``."""
        s0, s1, s2 = np.moveaxis(np.diff(self.run[cuts], axis=0), 1, 0)
        b, a = self.size / span, (self.mid - start) / span
        return s0, a * s0 + b * s1, a * a * s0 + 2 * a * b * s1 + b * b * s2


class Origin:
    """The equations of one origin and range of changepoints: training hours ``start`` to ``end`` of the stretch."""

    def __init__(self, moments: Moments, start: int, end: int, reach: float, changepoints: int):
        self.m, self.start = moments, start
        self.span = float(max(end - start, 1))
        self.knots = np.append(0.0, reach * np.arange(1, changepoints + 1) / (changepoints + 1))  # of time itself, then of the hinges
        cuts = np.minimum(start + np.ceil(self.knots * self.span - 1e-9).astype(int), end + 1)
        self.u = moments.between(np.append(cuts, end + 1), start, self.span)
        d, n = moments.d, moments.d * (moments.d + 1) // 2
        self.at_f, self.at_ff, self.at_y, self.at_yf = slice(1, 1 + d), slice(1 + d, 1 + d + n), 1 + d + n, slice(2 + d + n, 2 + 2 * d + n)
        self.rows = int(round(self.u[0][:, 0].sum()))
        self.yy = moments.squares[end + 1] - moments.squares[start]
        own = moments.y[start:end + 1]
        self.top = float(np.nanmax(np.abs(own))) if self.rows else 0.0
        r0, r1, r2 = (self._after(s[:, 0]) for s in self.u)
        k = self.knots
        most = np.maximum.outer(np.arange(len(k)), np.arange(len(k)))
        self.tt = np.empty((len(k) + 1, len(k) + 1))
        self.tt[0, 0] = r0[0]
        self.tt[0, 1:] = self.tt[1:, 0] = r1 - k * r0
        self.tt[1:, 1:] = r2[most] - np.add.outer(k, k) * r1[most] + np.multiply.outer(k, k) * r0[most]
        self.ty = self._hinged(self.u[0][:, self.at_y], self.u[1][:, self.at_y])

    @staticmethod
    def _after(s: np.ndarray) -> np.ndarray:
        return np.cumsum(s[::-1], axis=0)[::-1]

    def _hinged(self, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
        """Sums of each trend feature times a quantity with sums ``s0``, and ``s1`` times u."""
        a0, a1 = self._after(s0), self._after(s1)
        k = self.knots.reshape(-1, *[1] * (s0.ndim - 1))
        return np.concatenate([a0[:1], a1 - k * a0])

    def joint(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equations of the trend and of the seasons times the ``level`` of a trend fit."""
        # Between two knots the level is alpha + gamma * u.
        gamma = np.cumsum(level[1:])
        alpha = level[0] - np.cumsum(level[1:] * self.knots)
        a, g = alpha[:, None], gamma[:, None]
        f = [s[:, self.at_f] for s in self.u]
        ff = [s[:, self.at_ff] for s in self.u]
        tf = self._hinged(a * f[0] + g * f[1], a * f[1] + g * f[2])
        square = (a * a * ff[0] + 2 * a * g * ff[1] + g * g * ff[2]).sum(axis=0)
        d, t = self.m.d, len(self.tt)
        xx = np.empty((t + d, t + d))
        xx[:t, :t], xx[:t, t:], xx[t:, :t] = self.tt, tf, tf.T
        seasons = np.zeros((d, d))
        seasons[self.m.upper] = square
        xx[t:, t:] = seasons + np.triu(seasons, 1).T
        fy = (a * self.u[0][:, self.at_yf] + g * self.u[1][:, self.at_yf]).sum(axis=0)
        return xx, np.append(self.ty, fy)

    def features(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Progress, trend features and waves of hours of the stretch."""
        u = (places - self.start) / self.span
        return u, np.column_stack([np.ones(len(u)), np.maximum(u[:, None] - self.knots, 0.0) if len(u) else np.zeros((0, len(self.knots)))]), self.m.f[places]


def solved(xx: np.ndarray, xy: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    a = xx + np.diag(penalty)
    size = np.sqrt(np.diag(a))
    size[size == 0] = 1.0
    return np.linalg.lstsq(a / np.outer(size, size), xy / size, rcond=None)[0] / size


# -- origins over Spark

def by_origin(df: DataFrame, key: Sequence[str], ts: str, y: str, origins: DataFrame, train_days: int | None, horizon: int, waves: Waves, each, fields: list[T.StructField],
              group: int | None = None) -> DataFrame:
    """``each(moments, start, end, tests)`` for every origin: rows (tuples) of ``fields``, behind key and cutoff.

    ``tests`` are the places of the ``horizon`` hours behind the origin. Neighbouring origins form
    groups; an hour goes once to every group that uses it.
    """
    names = list(key)
    train_h = LONG if train_days is None else 24 * train_days
    rows = df.select(*names, D.slot(ts).alias("_s"), F.col(y).cast("double").alias("_y")).join(origins, names)
    # About four groups meet an hour, and a group holds some dozens of origins at least.
    size = F.lit(group).cast("long") if group else F.greatest(F.lit(24).cast("long"), F.expr(f"{min(train_h, 1 << 20) + horizon} div (4 * _step)"))
    rows = rows.withColumn("_size", size)
    last = F.col("_base") + (F.col("_count") - 1) * F.col("_step")
    stretch = F.col("_size") * F.col("_step")
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_s") - horizon - F.col("_base") - (F.col("_size") - 1) * F.col("_step")) / stretch).cast("long"))
    hi = F.floor((F.least(F.col("_s") + F.lit(train_h - 1), last) - F.col("_base")) / stretch).cast("long")
    dealt = rows.where(F.col("_s") <= last + horizon).withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_group", F.explode(F.sequence("_lo", "_hi")))
    schema = T.StructType([*[df.schema[k] for k in names], T.StructField("_cutoff", T.LongType()), T.StructField("_start", T.LongType()), *fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        base, step, count, size, g = (int(head[c]) for c in ("_base", "_step", "_count", "_size", "_group"))
        first, top = int(pdf["_s"].min()), int(pdf["_s"].max())
        values = np.full(top - first + 1, np.nan)
        values[pdf["_s"].to_numpy() - first] = pdf["_y"].to_numpy()
        m, out = Moments(first, values, waves), []
        for k in range(g * size, min((g + 1) * size, count)):
            end = base + k * step - first
            start = max(0, end - train_h + 1)
            if end < start:
                continue
            tests = np.arange(end + 1, min(end + horizon, m.n - 1) + 1)
            out += [(*[head[c] for c in names], first + end, first + start, *r) for r in each(m, start, end, tests)]
        return pd.DataFrame(out, columns=schema.names)
    return dealt.groupBy(*names, "_group").applyInPandas(run, schema).withColumns({"cutoff": D.slot_start("_cutoff"), "training_start": D.slot_start("_start")}).drop("_cutoff", "_start")
