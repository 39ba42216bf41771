"""Exponential averages without an unbounded window.

``G_t = sum over i <= t of q^(t-i) x_i`` is linear, so it splits by sub-blocks of consecutive
hours: sums inside each sub-block run in parallel, one small row per sub-block carries the rest.
Weights of sub-blocks further back than double precision can see are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .single import with_row

SUB_BLOCK = 128


def geometric_sums(df: DataFrame, key: Sequence[str], ts: str, specs: Mapping[str, tuple[str, float]],
                   step: int = 3600, sub_block: int = SUB_BLOCK) -> DataFrame:
    """Add one column per spec ``name: (x, q)`` with the geometric running sum of the expression x.

    A null x adds nothing but time still passes, so the series may hold leading nulls.
    """
    n = sub_block
    slot = f"CAST(floor(unix_seconds(`{ts}`) / {step}) AS BIGINT)"
    base = (df.selectExpr("*", f"{slot} AS _slot", *[
        f"coalesce(CAST({x} AS DOUBLE), 0D) AS `_x_{k}`" for k, (x, _) in specs.items()])
        .selectExpr("*", f"CAST(floor(_slot / {n}) AS BIGINT) AS _g", f"CAST(pmod(_slot, {n}) AS DOUBLE) AS _p"))
    by = ", ".join(f"`{k}`" for k in key)

    totals = base.groupBy(*key, "_g").agg(*[
        F.expr(f"sum(`_x_{k}` * pow({q!r}D, {n - 1}D - _p)) AS `{k}`") for k, (_, q) in specs.items()])
    carry = []
    for k, (_, q) in specs.items():
        # A total from m sub-blocks back has shrunk m - 1 times since; beyond `far` it is below 1e-18.
        far = max(1, math.ceil(42.0 / (-math.log(q) * n))) if q > 0 else 1
        near = f"OVER (PARTITION BY {by or '1'} ORDER BY _g RANGE BETWEEN {far} PRECEDING AND 1 PRECEDING)"
        carry.append(f"aggregate(collect_list(struct(_g, `{k}` AS t)) {near}, 0D, "
                     f"(a, e) -> a + e.t * pow({q ** n!r}D, CAST(_g - e._g - 1 AS DOUBLE))) AS `_c_{k}`")
    carried = totals.selectExpr(*key, "_g", *carry)

    inside = f"OVER (PARTITION BY {by + ', ' if key else ''}_g ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = base.selectExpr("*", *[f"sum(`_x_{k}` * pow({q!r}D, -_p)) {inside} AS `_l_{k}`" for k, (_, q) in specs.items()])
    return local.join(carried, [*key, "_g"]).selectExpr(*[f"`{c}`" for c in df.columns], *[
        f"pow({q!r}D, _p) * (`_l_{k}` + {q!r}D * `_c_{k}`) AS `{k}`" for k, (_, q) in specs.items()])


def ewm_means(df: DataFrame, key: Sequence[str], ts: str,
              specs: Mapping[str, tuple[str, float, int]], step: int = 3600) -> DataFrame:
    """Recursive averages ``out: (column, alpha, min_periods)``.

    ``m_0 = x_0`` and ``m_t = (1 - alpha) m_(t-1) + alpha x_t`` from the first value on; the
    column must be dense after it. Null until ``min_periods`` values were seen.
    """
    cols = sorted({c for c, _, _ in specs.values()})
    slot = f"CAST(floor(unix_seconds(`{ts}`) / {step}) AS BIGINT)"
    seen = {c: f"CASE WHEN `{c}` IS NOT NULL THEN {slot} END" for c in cols}
    start = df.groupBy(*key).agg(*[F.expr(e) for c in cols for e in (
        f"min({seen[c]}) AS `_t0_{c}`", f"min_by(`{c}`, {seen[c]}) AS `_x0_{c}`")])
    sums = geometric_sums(df, key, ts, {f"_s_{o}": (f"`{c}`", 1.0 - a) for o, (c, a, _) in specs.items()}, step)
    flat = sums.join(start, list(key)) if key else with_row(sums, start)
    new = []
    for o, (c, a, need) in specs.items():
        age = f"CAST({slot} - `_t0_{c}` AS DOUBLE)"
        new.append(f"CASE WHEN `{c}` IS NOT NULL AND {age} + 1 >= {need} THEN "
                   f"{a!r}D * `_s_{o}` + pow({1.0 - a!r}D, {age} + 1) * `_x0_{c}` END AS `{o}`")
    return flat.selectExpr(*[f"`{c}`" for c in df.columns], *new)


def ewm_stds(df: DataFrame, key: Sequence[str], ts: str, col: str, spans: Mapping[str, int],
             step: int = 3600) -> DataFrame:
    """Bias-corrected standard deviation with weights ``(1 - 2/(span+1))^age``; span 1 is null."""
    x = f"`{col}`"
    one = f"CASE WHEN {x} IS NOT NULL THEN 1D END"
    specs: dict[str, tuple[str, float]] = {}
    for o, span in spans.items():
        q = 1.0 - 2.0 / (span + 1.0)
        if q > 0:
            specs |= {f"_w_{o}": (one, q), f"_ww_{o}": (one, q * q), f"_wx_{o}": (x, q), f"_wxx_{o}": (f"{x} * {x}", q)}
    sums = geometric_sums(df, key, ts, specs, step) if specs else df
    new = []
    for o in spans:
        if f"_w_{o}" not in specs:
            new.append(f"CAST(NULL AS DOUBLE) AS `{o}`")
            continue
        w, ww, wx, wxx = (f"`_{p}_{o}`" for p in ("w", "ww", "wx", "wxx"))
        biased = f"greatest({wxx} / {w} - ({wx} / {w}) * ({wx} / {w}), 0D)"
        new.append(f"CASE WHEN {x} IS NOT NULL AND {w} * {w} - {ww} > 1e-12D THEN "
                   f"sqrt({biased} * {w} * {w} / ({w} * {w} - {ww})) END AS `{o}`")
    return sums.selectExpr(*[f"`{c}`" for c in df.columns], *new)
