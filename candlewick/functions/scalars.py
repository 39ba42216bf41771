"""Small numeric expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def floor_zero(c: str | Column) -> Column:
    """Null becomes 0, negative values become 0."""
    return F.greatest(F.coalesce(_c(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def signal_label(c: str | Column, threshold: float = 0.005) -> Column:
    """+1 / -1 beyond the threshold, else 0; a missing return is 0."""
    x = _c(c)
    return (F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)).cast("int")


def score_band(c: str | Column, neutral_from: int = 34, positive_from: int = 67) -> Column:
    """negative / neutral / positive band; the gauge uses ``neutral_from=33``."""
    x = _c(c)
    return (F.when(x < neutral_from, "negative").when(x < positive_from, "neutral")
            .when(x >= positive_from, "positive"))


def composite_score(negative: str | Column, neutral: str | Column, positive: str | Column) -> Column:
    """0 * negative + 50 * neutral + 100 * positive, truncated to an integer."""
    return (F.lit(0.0) * _c(negative) + F.lit(50.0) * _c(neutral)
            + F.lit(100.0) * _c(positive)).cast("int")


def decay(hours: str | Column, half_life: float = 24.0) -> Column:
    return F.pow(F.lit(0.5), _c(hours) / F.lit(half_life))


def post_weight(quantile: str | Column, relevance: str | Column | None = None,
                comments: str | Column | None = None) -> Column:
    """quantile^2, times relevance and ln(comments + 1) where given."""
    w = F.pow(_c(quantile), F.lit(2.0))
    if relevance is not None:
        w = w * _c(relevance)
    if comments is not None:
        w = w * F.log1p(_c(comments))
    return w


def dominant(labels: Sequence[tuple[str, Column]]) -> Column:
    """Label with the largest score; the first listed wins a tie, nulls never win."""
    best = F.greatest(*[c for _, c in labels]) if len(labels) > 1 else labels[0][1]
    out = None
    for name, c in labels:
        out = F.when(c == best, name) if out is None else out.when(c == best, name)
    return out


def direction(positive: Column, negative: Column, neutral: Column) -> Column:
    """+1 / -1 when positive / negative beats both others strictly, else 0."""
    return (F.when((positive > negative) & (positive > neutral), 1)
            .when((negative > positive) & (negative > neutral), -1)
            .otherwise(0)).cast("int")
