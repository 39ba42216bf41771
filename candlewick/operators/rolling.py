"""Window operators over dense hourly series.

Frames of bounded length run inside blocks of consecutive hours: each block also receives the
rows its frames reach outside it (the halo), so one long series spreads over many tasks and
gives the same numbers as one unbroken window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import timefns as D

BLOCK_STEPS = 4096


class Blocked:
    """A frame cut in blocks with halo rows; add window columns, then call ``done``."""

    def __init__(self, df: DataFrame, key: Sequence[str], ts: str, back: int = 0, ahead: int = 0,
                 block: int = BLOCK_STEPS, step: int = 3600):
        s = D.slot(ts, step)
        first = F.floor((s - F.lit(ahead)) / F.lit(block)).cast("long")
        last = F.floor((s + F.lit(back)) / F.lit(block)).cast("long")
        self.df = (df.withColumn("_home", F.floor(s / F.lit(block)).cast("long"))
                   .withColumn("_block", F.explode(F.sequence(first, last))))
        self.window = Window.partitionBy(*key, "_block").orderBy(ts)
        self._spec = f"PARTITION BY {', '.join(f'`{k}`' for k in [*key, '_block'])} ORDER BY `{ts}`"

    def over(self, first: int | None = None, last: int | None = None) -> str:
        """The window as SQL text, with rows ``first .. last`` around the current one as frame."""
        if first is None:
            return f"OVER ({self._spec})"
        edge = lambda n: "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
        return f"OVER ({self._spec} ROWS BETWEEN {edge(first)} AND {edge(last)})"

    def frame(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-(n - 1), 0)

    def add(self, **cols: Column) -> "Blocked":
        self.df = self.df.withColumns(cols)
        return self

    def done(self) -> DataFrame:
        return self.df.where(F.col("_block") == F.col("_home")).drop("_block", "_home")


def rolling(w: Blocked, col: str, n: int, fn: str = "sum", min_periods: int | None = None) -> Column:
    """``fn`` over the last n rows; null unless enough of them hold a value (default all)."""
    f = w.over(1 - n, 0)
    need = n if min_periods is None else min_periods
    return F.expr(f"CASE WHEN count(`{col}`) {f} >= {need} THEN {fn}(`{col}`) {f} END")


def lags(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], ks: Sequence[int],
         name: str = "{col}_lag_{k}hr", block: int = BLOCK_STEPS) -> DataFrame:
    w = Blocked(df, key, ts, back=max(max(ks), 0), ahead=max(-min(ks), 0), block=block)
    w.add(**{name.format(col=c, k=k): F.expr(f"lag(`{c}`, {k}) {w.over()}") for c in cols for k in ks})
    return w.done()


def diff(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str],
         name: str = "{col}_momentum", block: int = BLOCK_STEPS) -> DataFrame:
    w = Blocked(df, key, ts, back=1, block=block)
    w.add(**{name.format(col=c): F.col(c) - F.lag(c, 1).over(w.window) for c in cols})
    return w.done()


def past_return(w: Blocked, col: str, k: int) -> Column:
    return F.expr(f"try_divide(`{col}`, lag(`{col}`, {k}) {w.over()}) - 1")


def forward_return(w: Blocked, col: str, k: int) -> Column:
    return F.expr(f"try_divide(lead(`{col}`, {k}) {w.over()}, `{col}`) - 1")


def returns(df: DataFrame, key: Sequence[str], ts: str, col: str, ks: Sequence[int],
            direction: str = "past", block: int = BLOCK_STEPS) -> DataFrame:
    """``ret_past_{k}_h`` or ``ret_fwd_{k}_h`` for every k."""
    past = direction == "past"
    w = Blocked(df, key, ts, back=max(ks) if past else 0, ahead=0 if past else max(ks), block=block)
    fn, tag = (past_return, "past") if past else (forward_return, "fwd")
    w.add(**{f"ret_{tag}_{k}_h": fn(w, col, k) for k in ks})
    return w.done()


def kernel_average(w: Blocked, ts: str, col: str, n: int = 120, rate: float = 0.5,
                   kernel: str = "ref", block: int = BLOCK_STEPS) -> Column:
    """Average over n rows with geometric weights; null while any of the n is missing.

    ``ref`` weighs the row l steps back with ``rate ** ((n - l) / n)``, so the newest row weighs
    least; ``recent`` mirrors the weights. A geometric weight splits into a factor of the row and
    one of the frame end, which leaves a plain framed sum.
    """
    sign = 1.0 if kernel == "ref" else -1.0
    # Position inside the block keeps the exponents small.
    at = f"({sign}D * (floor(unix_seconds(`{ts}`) / 3600) - _block * {block}) / {n}.0D)"
    top = 1.0 if kernel == "ref" else 1.0 / n
    total = sum(rate ** ((n - l) / n if kernel == "ref" else (l + 1) / n) for l in range(n))
    f = w.over(1 - n, 0)
    return F.expr(f"CASE WHEN count(`{col}`) {f} = {n} THEN sum(`{col}` * pow({rate!r}D, {at})) {f} "
                  f"* pow({rate!r}D, {top!r}D - {at}) / {total!r}D END")


def time_weighted(df: DataFrame, key: Sequence[str], ts: str, cols: dict[str, str], n: int = 120,
                  rate: float = 0.5, kernel: str = "ref", block: int = BLOCK_STEPS) -> DataFrame:
    """Add ``cols[out] = in`` kernel averages."""
    w = Blocked(df, key, ts, back=n - 1, block=block)
    w.add(**{o: kernel_average(w, ts, c, n, rate, kernel, block) for o, c in cols.items()})
    return w.done()


def fill(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], how: str = "both",
         block: int = BLOCK_STEPS) -> DataFrame:
    """Forward fill, then (``both``) backward fill.

    Unbounded reach is carried between blocks by a small table of each block's first and last
    value: one row per block.
    """
    flat = _with_neighbours(df, key, ts, cols, block, times=False)
    later = ", `_next_{c}`" if how == "both" else ""
    return flat.selectExpr(*[
        f"coalesce(`{c}`, `_prev_{c}`{later.format(c=c)}) AS `{c}`" if c in cols else f"`{c}`" for c in df.columns])


def interpolate(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str],
                block: int = BLOCK_STEPS) -> DataFrame:
    """Linear in time between neighbours; the end holds the last value, the start stays null."""
    flat = _with_neighbours(df, key, ts, cols, block, times=True)
    line = ("CASE WHEN `{c}` IS NOT NULL THEN `{c}` WHEN `_prev_{c}` IS NOT NULL AND `_next_{c}` IS NOT NULL THEN "
            "`_prev_{c}` + (`_next_{c}` - `_prev_{c}`) * (unix_micros(`{ts}`) - `_prevt_{c}`) / (`_nextt_{c}` - `_prevt_{c}`) "
            "ELSE `_prev_{c}` END AS `{c}`")
    return flat.selectExpr(*[line.format(c=c, ts=ts) if c in cols else f"`{c}`" for c in df.columns])


def _with_neighbours(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], block: int,
                     times: bool) -> DataFrame:
    """Add the nearest non-null value before and after each row (and its time) per column."""
    base = df.withColumn("_block", F.floor(D.slot(ts) / F.lit(block)).cast("long"))
    by = ", ".join(f"`{k}`" for k in key)
    part = f"PARTITION BY {by} " if key else ""
    value = {c: f"CAST(`{c}` AS DOUBLE)" for c in cols}
    at = {c: f"CASE WHEN `{c}` IS NOT NULL THEN unix_micros(`{ts}`) END" for c in cols}

    edge = [F.expr(e) for c in cols for e in (
        f"max_by({value[c]}, {at[c]}) AS `_lv_{c}`", f"max({at[c]}) AS `_lt_{c}`",
        f"min_by({value[c]}, {at[c]}) AS `_fv_{c}`", f"min({at[c]}) AS `_ft_{c}`")]
    before = f"OVER ({part}ORDER BY _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = f"OVER ({part}ORDER BY _block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    blocks = base.groupBy(*key, "_block").agg(*edge).selectExpr(*key, "_block", *[e for c in cols for e in (
        f"last(`_lv_{c}`, true) {before} AS `_bv_{c}`", f"last(`_lt_{c}`, true) {before} AS `_bt_{c}`",
        f"first(`_fv_{c}`, true) {after} AS `_av_{c}`", f"first(`_ft_{c}`, true) {after} AS `_at_{c}`")])

    own = f"OVER (PARTITION BY {by + ', ' if key else ''}_block ORDER BY `{ts}` ROWS BETWEEN "
    upto, onward = own + "UNBOUNDED PRECEDING AND CURRENT ROW)", own + "CURRENT ROW AND UNBOUNDED FOLLOWING)"
    near, merged = [], []
    for c in cols:
        near += [f"last({value[c]}, true) {upto} AS `_p_{c}`", f"first({value[c]}, true) {onward} AS `_n_{c}`"]
        merged += [f"coalesce(`_p_{c}`, `_bv_{c}`) AS `_prev_{c}`", f"coalesce(`_n_{c}`, `_av_{c}`) AS `_next_{c}`"]
        if times:
            near += [f"last({at[c]}, true) {upto} AS `_pt_{c}`", f"first({at[c]}, true) {onward} AS `_nt_{c}`"]
            merged += [f"coalesce(`_pt_{c}`, `_bt_{c}`) AS `_prevt_{c}`", f"coalesce(`_nt_{c}`, `_at_{c}`) AS `_nextt_{c}`"]
    flat = base.selectExpr("*", *near).join(blocks, [*key, "_block"])
    return flat.selectExpr(*[f"`{c}`" for c in df.columns], *merged)


def gradient(df: DataFrame, key: Sequence[str], ts: str, cols: dict[str, str],
             block: int = BLOCK_STEPS) -> DataFrame:
    """Central differences between neighbouring rows, one-sided at both ends of a series.

    Neighbours may be any time apart: what lies outside a row's block comes from the last row of the
    block before and the first of the block after, one summary row per block.
    """
    names, inner = list(key), list(dict.fromkeys(cols.values()))
    base = df.withColumn("_block", F.floor(D.slot(ts) / F.lit(block)).cast("long"))
    w, across = Window.partitionBy(*names, "_block").orderBy(ts), Window.partitionBy(*names).orderBy("_block")
    row = F.struct(*[F.col(c).cast("double").alias(c) for c in inner])
    ends = base.groupBy(*names, "_block").agg(F.min_by(row, ts).alias("_first"), F.max_by(row, ts).alias("_last"))
    ends = ends.select(*names, "_block", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    rows = base.withColumns({"_p": F.lag(row).over(w), "_n": F.lead(row).over(w)}).join(ends, [*names, "_block"])
    p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    new = {out: F.when(p.isNotNull() & n.isNotNull(), (n[c] - p[c]) / 2).when(n.isNotNull(), n[c] - F.col(c)).when(p.isNotNull(), F.col(c) - p[c]) for out, c in cols.items()}
    return rows.withColumns(new).select(*df.columns, *[c for c in new if c not in df.columns])


def first_cross(flag: Column, w: WindowSpec) -> Column:
    """Flag is set and was not set on the row before; the first row counts when set."""
    on = F.coalesce(flag, F.lit(False))
    return on & ~F.coalesce(F.lag(on).over(w), F.lit(False))


def drop_warmup(df: DataFrame, key: Sequence[str], ts: str, n: int) -> DataFrame:
    """Drop the first n steps of each dense series."""
    start = df.groupBy(*key).agg(F.min(ts).alias("_start"))
    return (df.join(start, list(key))
            .where(F.col(ts) >= F.col("_start") + F.make_dt_interval(hours=F.lit(n)))
            .drop("_start"))


def sample_positions(df: DataFrame, key: Sequence[str], ts: str, ks: Sequence[int]) -> DataFrame:
    """Rows at positions ``ks`` of the time order; negative ones count from the end.

    A position is left out when ``abs(k)`` is not below the series length. Only the few rows
    nearest each end are ranked, so the ranking prunes before its shuffle.
    """
    size = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for picked, order in (([k for k in ks if k >= 0], F.col(ts).asc()),
                          ([k for k in ks if k < 0], F.col(ts).desc())):
        if not picked:
            continue
        deepest = max(k + 1 if k >= 0 else -k for k in picked)
        ranked = (df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
                  .where(F.col("_rn") <= deepest))
        pos = F.col("_rn") - 1 if picked[0] >= 0 else -F.col("_rn")
        parts.append(ranked.withColumn("position", pos.cast("int")).where(
            F.col("position").isin(picked)).drop("_rn"))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.join(size, list(key)).where(F.abs("position") < F.col("_n")).drop("_n")


def last_rows(df: DataFrame, key: Sequence[str], ts: str, n: int) -> DataFrame:
    """The newest n rows per series (partial top-n before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def split_last(df: DataFrame, key: Sequence[str], ts: str, n: int = 120) -> tuple[DataFrame, DataFrame]:
    """(train, test): the newest n rows of each series are the test part."""
    edge = last_rows(df, key, ts, n).groupBy(*key).agg(F.min(ts).alias("_from"))
    tagged = df.join(edge, list(key))
    return (tagged.where(F.col(ts) < F.col("_from")).drop("_from"),
            tagged.where(F.col(ts) >= F.col("_from")).drop("_from"))


def supervised(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], n_in: int,
               n_out: int = 1, block: int = BLOCK_STEPS) -> DataFrame:
    """Columns t-n_in .. t+n_out-1 side by side; incomplete rows are dropped."""
    w = Blocked(df, key, ts, back=n_in, ahead=max(n_out - 1, 0), block=block)
    new: dict[str, Column] = {}
    for i in range(n_in, 0, -1):
        new.update({f"{c}_t_minus_{i}": F.lag(c, i).over(w.window) for c in cols})
    for i in range(n_out):
        new.update({f"{c}_t_plus_{i}": F.lead(c, i).over(w.window) for c in cols})
    return w.add(**new).done().select(*key, ts, *new).dropna()


def sequences(df: DataFrame, key: Sequence[str], ts: str, cols: Sequence[str], target: str,
              n_past: int, horizon: int, block: int = BLOCK_STEPS) -> DataFrame:
    """Samples: ``x`` = n_past rows ending one before ``ts``, ``target_y`` = target horizon-1 later."""
    w = Blocked(df, key, ts, back=n_past, ahead=horizon - 1, block=block)
    f = w.window.rowsBetween(-n_past, -1)
    row = F.array(*[F.col(c).cast("double") for c in cols])
    w.add(x=F.flatten(F.collect_list(row).over(f)), target_y=F.lead(target, horizon - 1).over(w.window))
    return (w.done().where((F.size("x") == n_past * len(cols)) & F.col("target_y").isNotNull())
            .select(*key, ts, "x", "target_y"))
