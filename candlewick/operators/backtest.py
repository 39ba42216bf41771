"""Rolling-origin backtests as one job: cut-offs are rows, not loop turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import timefns as D
from . import grid as G, metrics as M, rolling as R
from .single import with_row


def expand_cutoffs(df: DataFrame, key: Sequence[str], ts: str, start: str, end: str, step_h: int,
                   train_days: int, horizon: int, part: str = "both") -> DataFrame:
    """Each row once per cut-off c that uses it: ``c - train_days < ds <= c + horizon``.

    The cut-offs of a row are an arithmetic run, so they are generated, not joined. As in the
    reference procedure the last ``horizon`` rows of each trimmed set are its test part; when
    data ends before ``c + horizon`` (``short_horizon``) they reach back before the cut-off.
    """
    first, last = D.slot(F.to_timestamp(F.lit(start))), D.slot(F.to_timestamp(F.lit(end)))
    ends = df.groupBy(*key).agg(D.slot(F.max(ts)).alias("_last"), D.slot(F.min(ts)).alias("_first"))
    rows = df.join(ends, list(key)).withColumn("_s", D.slot(ts))
    train_h = train_days * 24
    # Index of the first and last cut-off that sees this hour.
    lo = F.greatest(F.ceil((F.col("_s") - F.lit(horizon) - first) / F.lit(step_h)), F.lit(0)).cast("long")
    hi = F.floor((F.least(F.col("_s") + F.lit(train_h - 1), last) - first) / F.lit(step_h)).cast("long")
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where(F.col("_lo") <= F.col("_hi"))
    rows = rows.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("_c", first + F.col("_k") * F.lit(step_h))
    stop = F.least(F.col("_c") + F.lit(horizon), F.col("_last"))
    rows = rows.withColumns({
        "cutoff": D.slot_start("_c"), "is_test": F.col("_s") > stop - F.lit(horizon),
        "short_horizon": F.col("_last") < F.col("_c") + F.lit(horizon),
        "training_start": D.slot_start(F.greatest(F.col("_first"), F.col("_c") - F.lit(train_h - 1))),
        "training_end": D.slot_start(stop - F.lit(horizon))})
    # A trimmed set no longer than the horizon leaves nothing to train on.
    rows = rows.where(F.col("training_end") >= F.col("training_start"))
    if part != "both":
        rows = rows.where(F.col("is_test") == F.lit(part == "test"))
    return rows.drop("_s", "_c", "_k", "_lo", "_hi", "_last", "_first")


def naive_rows(df: DataFrame, key: Sequence[str], ts: str, y: str, origins: DataFrame, train_days: int | None = 180, horizon: int = 120) -> DataFrame:
    """Test rows of every origin (see ``origins``) with the value ``horizon`` hours earlier as forecast.

    The origins that test an hour are an arithmetic run, so they are generated, not joined.
    """
    w = R.Blocked(df.select(*key, ts, y), key, ts, back=horizon)
    shifted = w.add(yhat=F.lag(y, horizon).over(w.window)).done()
    ends = df.groupBy(*key).agg(D.slot(F.max(ts)).alias("_last"), D.slot(F.min(ts)).alias("_first"))
    rows = shifted.join(ends.join(origins, list(key)), list(key)).withColumn("_s", D.slot(ts))
    lo = F.greatest(F.ceil((F.col("_s") - horizon - F.col("_base")) / F.col("_step")), F.lit(0)).cast("long")
    hi = F.least(F.floor((F.col("_s") - 1 - F.col("_base")) / F.col("_step")), F.col("_count") - 1).cast("long")
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    rows = rows.withColumn("_c", F.col("_base") + F.col("_k") * F.col("_step"))
    start = F.col("_first") if train_days is None else F.greatest(F.col("_first"), F.col("_c") - F.lit(train_days * 24 - 1))
    return rows.select(*key, D.slot_start("_c").alias("cutoff"), D.slot_start(start).alias("training_start"), D.slot_start("_c").alias("training_end"),
                       (F.col("_last") < F.col("_c") + horizon).alias("short_horizon"), ts, y, "yhat")


def summarise_runs(tests: DataFrame, key: Sequence[str], ts: str, y: str, yhat: str = "yhat",
                   split: float = 0.2) -> DataFrame:
    """One row per run: bounds, metrics and the y / yhat arrays in time order."""
    a, b = F.col(y), F.col(yhat)
    e = a - b
    runs = tests.groupBy(*key, "cutoff", "training_start", "training_end", "short_horizon").agg(
        F.min(ts).alias("mystery_start"), F.max(ts).alias("mystery_end"), F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(M.EPS))).alias("mape"),
        F.stddev_pop(F.abs(e)).alias("std_error"),
        (F.sqrt(F.avg(F.pow(F.try_divide(e, a), F.lit(2.0)))) * 100).alias("rmspe"),
        # A run has at most `horizon` rows.
        F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), a.alias("y"), b.alias("yhat")))).alias("_rows"))
    n_train = D.slot("training_end") - D.slot("training_start") + 1
    moves = F.zip_with(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))),
                       F.slice("_rows", 1, F.greatest(F.size("_rows") - 1, F.lit(0))),
                       lambda p, q: (p["y"] - q["y"]) * (p["yhat"] - q["yhat"]))
    same = F.size(F.filter(moves, lambda m: m > 0))
    return runs.withColumns({
        "rmse": F.sqrt("mse"), "validation_size": n_train * F.lit(split),
        "pcg_same_dir": F.try_divide(same.cast("double"), F.size(moves)),
        "y": F.transform("_rows", lambda s: s["y"]), "yhat": F.transform("_rows", lambda s: s["yhat"]),
    }).drop("_rows")


def ranked_runs(runs: DataFrame) -> DataFrame:
    """Newest run end first, then best MAPE."""
    return runs.orderBy(F.col("mystery_end").desc(), F.col("mape").asc())


def side_by_side(left: DataFrame, right: DataFrame, key: Sequence[str], names: tuple[str, str],
                 cols: Sequence[str] = ("mae", "rmse", "mape")) -> DataFrame:
    """Metrics of two forecasters per run."""
    on = [*key, "cutoff"]
    a = left.select(*on, *[F.col(c).alias(f"{c}_{names[0]}") for c in cols])
    b = right.select(*on, *[F.col(c).alias(f"{c}_{names[1]}") for c in cols])
    return a.join(b, on)


def time_splits(df: DataFrame, key: Sequence[str], ts: str, n_splits: int = 5, gap: int = 0) -> DataFrame:
    """Expanding-window splits of a dense series: each row once per split that uses it.

    Split i tests block i + 1 of n // (n_splits + 1) rows at the end and trains on everything
    up to ``gap`` rows before it.
    """
    spans = G.span(df, key, ts).select(*key, D.slot("lo").alias("_a"), (D.slot("hi") - D.slot("lo") + 1).alias("_n"))
    rows = df.join(spans, list(key)) if key else with_row(df, spans)
    size = F.floor(F.col("_n") / F.lit(n_splits + 1)).cast("long")
    rows = rows.withColumns({"_i": D.slot(ts) - F.col("_a"), "_size": size,
                             "split": F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))})
    begin = F.col("_n") - F.lit(n_splits) * F.col("_size") + F.col("split") * F.col("_size")
    part = (F.when(F.col("_i") < begin - F.lit(gap), "train")
            .when((F.col("_i") >= begin) & (F.col("_i") < begin + F.col("_size")), "test"))
    return rows.withColumn("part", part).where(F.col("part").isNotNull()).drop("_a", "_n", "_i", "_size")
