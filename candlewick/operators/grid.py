"""Candles, calendars, gaps and resampling.

A series is one key. After aggregation to a step (one hour) a series has as many rows as its
span has steps - about 8 800 per year - however many raw rows fed it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import DataQualityError
from ..functions import timefns as D

Keys = Sequence[str]


def candles(df: DataFrame, key: Keys, hour: Column, order: Column, value: str,
            buy: Column) -> DataFrame:
    """Hourly open/high/low/close, volumes and trade counts.

    ``order`` ranks rows inside the hour; keep it a primitive (long or decimal) so that the
    aggregation stays a hash aggregation with map-side combine.
    """
    v = F.col(value)
    bought = F.when(buy, v).otherwise(F.lit(0.0))
    return df.groupBy(*key, hour.alias("ds")).agg(
        F.min_by(v, order).alias("open_price"),
        F.max(v).alias("y_upper"),
        F.min(v).alias("y_lower"),
        F.max_by(v, order).alias("y"),
        F.sum(v).alias("volume"),
        F.count(F.lit(1)).alias("num_of_trades"),
        F.sum(bought).alias("taker_buy_base_asset_volume"),
    )


def fill_bar_gaps(bars: DataFrame, key: Keys, ts: str = "ds",
                  zero: Sequence[str] = ("volume", "num_of_trades", "taker_buy_base_asset_volume"),
                  ) -> DataFrame:
    """Dense hourly candles: an hour without trades keeps the last close and has no volume.

    Every bar is repeated up to the hour before the next bar, so neither a calendar table nor a
    join is needed.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    hour = F.expr("INTERVAL 1 HOUR")
    upto = F.coalesce(F.lead(ts).over(w) - hour, F.col(ts))
    rows = bars.withColumn("_upto", upto).withColumn(
        "_slot", F.explode(F.sequence(F.col(ts), F.col("_upto"), hour)))
    own = F.col("_slot") == F.col(ts)
    cols = []
    for c in bars.columns:
        if c == ts:
            cols.append(F.col("_slot").alias(ts))
        elif c in zero:
            cols.append(F.when(own, F.col(c)).otherwise(F.lit(0).cast(bars.schema[c].dataType)).alias(c))
        elif c in ("open_price", "y_upper", "y_lower"):
            cols.append(F.when(own, F.col(c)).otherwise(F.col("y")).alias(c))
        else:
            cols.append(F.col(c))
    return rows.select(*cols)


def span(df: DataFrame, key: Keys, ts: str = "ds") -> DataFrame:
    """First and last instant per series as ``lo`` and ``hi``."""
    return df.groupBy(*key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))


def densify(df: DataFrame, key: Keys, ts: str = "ds", step: str = "1 hour",
            bounds: DataFrame | None = None) -> DataFrame:
    """Reindex to every step between ``lo`` and ``hi`` (own span, or ``bounds`` with both)."""
    edges = span(df, key, ts) if bounds is None else bounds
    grid = edges.select(*key, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias(ts))
    return grid.join(df, [*key, ts], "left")


def find_gaps(df: DataFrame, key: Keys, ts: str = "ds", step: str = "1 hour") -> DataFrame:
    """Rows that follow their predecessor by more than one step."""
    w = Window.partitionBy(*key).orderBy(ts)
    prev = F.lag(ts).over(w)
    return (df.select(*key, ts, prev.alias("previous"))
            .where(F.col(ts) > F.col("previous") + F.expr(f"INTERVAL {step}")))


def require_no_gaps(df: DataFrame, key: Keys, ts: str = "ds", step: str = "1 hour") -> DataFrame:
    bad = find_gaps(df, key, ts, step).take(5)
    if bad:
        raise DataQualityError(f"gaps larger than {step}: {bad}")
    return df


def check_row_count(df: DataFrame, days: int, per_day: int = 24) -> DataFrame:
    """Raise unless the table holds ``days`` full days."""
    n = df.count()
    if n != days * per_day:
        raise DataQualityError(f"expected {days * per_day} rows, found {n}")
    return df


def resample(df: DataFrame, key: Keys, label: Column, aggs: Mapping[str, Column],
             out: str = "ds") -> DataFrame:
    """Aggregate per time label; one shuffle after map-side combine."""
    return df.groupBy(*key, label.alias(out)).agg(*[c.alias(n) for n, c in aggs.items()])


def means(cols: Sequence[str]) -> dict[str, Column]:
    return {c: F.avg(c) for c in cols}


def latest_hours(df: DataFrame, key: Keys, ts: str, n: int) -> DataFrame:
    """Rows of the last ``n`` hours of each series, counted from its newest row."""
    if not key:
        newest = df.agg(F.max(ts).alias("m")).scalar()
        return df.where(F.col(ts) >= D.floor_hour(newest - F.make_dt_interval(hours=F.lit(n - 1))))
    newest = df.groupBy(*key).agg(F.max(ts).alias("_newest"))
    cut = D.floor_hour(F.col("_newest") - F.make_dt_interval(hours=F.lit(n - 1)))
    return df.join(newest, list(key)).where(F.col(ts) >= cut).drop("_newest")


def coverage(df: DataFrame, key: Keys, ts: str, cols: Sequence[str]) -> DataFrame:
    """Row count, date span and missing values per column."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ds"), F.max(ts).alias("last_ds"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols])
