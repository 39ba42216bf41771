"""Small result tables behind the dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import DataQualityError
from ..functions import timefns as D
from . import rolling as R
from .single import row_of


def join_model_frame(bars: DataFrame, senti: DataFrame, key: Sequence[str] = (), ts: str = "ds",
                     strict: bool = True) -> DataFrame:
    """Bars with hourly sentiment; both must end on the same day and have equally many hours."""
    if strict:
        a = bars.agg(F.to_date(F.max(ts)).alias("d"), F.count_distinct(*key, ts).alias("n"),
                     F.count_distinct(*key).alias("k") if key else F.lit(1).alias("k")).first()
        b = senti.agg(F.to_date(F.max(ts)).alias("d"), F.count(F.lit(1)).alias("n")).first()
        if a["d"] != b["d"]:
            raise DataQualityError(f"bars end on {a['d']}, sentiment on {b['d']}")
        if a["n"] != b["n"] * a["k"]:
            raise DataQualityError(f"{a['n']} bars against {b['n']} sentiment hours for {a['k']} series")
    return bars.join(senti, ts, "left")


def guarded_model_frame(bars: DataFrame, senti: DataFrame, key: Sequence[str] = (), ts: str = "ds") -> DataFrame:
    """The strict ``join_model_frame`` with its guards in the plan: nothing runs before the result is read,
    and it can't be read when a guard fails. Their counts are two aggregates that run once."""
    a = row_of(bars.agg(F.to_date(F.max(ts)).alias("d"), F.count_distinct(*key, ts).alias("n"),
                        (F.count_distinct(*key) if key else F.lit(1)).alias("k")))
    b = row_of(senti.agg(F.to_date(F.max(ts)).alias("d"), F.count(F.lit(1)).alias("n")))
    day = F.assert_true(a["d"].eqNullSafe(b["d"]), F.concat(F.lit("bars end on "), a["d"].cast("string"), F.lit(", sentiment on "), b["d"].cast("string")))
    hours = F.assert_true(a["n"] == b["n"] * a["k"], F.concat(a["n"].cast("string"), F.lit(" bars against "), b["n"].cast("string"),
                                                              F.lit(" sentiment hours for "), a["k"].cast("string"), F.lit(" series")))
    return bars.join(senti, ts, "left").where(day.isNull() & hours.isNull())


def history_and_forecast(hist: DataFrame, pred: DataFrame, key: Sequence[str], as_of: str, ts: str = "ds",
                         price: str = "close_price", limit: int = 120, days: int = 10) -> DataFrame:
    """History before ``as_of`` and at most ``limit`` forecast hours from it on, price at 2 decimals."""
    now = F.to_timestamp(F.lit(as_of))
    since = F.date_trunc("day", now - F.make_dt_interval(days=F.lit(days)))
    past = hist.where((F.col(ts) < now) & (F.col(ts) >= since)).select(*key, ts, price, F.lit(0).alias("if_pred"))
    future = pred.where(F.col(ts) >= now).select(*key, ts, price)
    first = R.last_rows(future.withColumn("_neg", -D.slot(ts)), key, "_neg", limit).drop("_neg")
    both = past.unionByName(first.withColumn("if_pred", F.lit(1)))
    # Halves of the scaled value go to the even digit.
    return both.withColumn(price, F.rint(F.col(price) * 100) / 100)


def price_range(merged: DataFrame, key: Sequence[str], price: str = "close_price", ts: str = "ds") -> DataFrame:
    """Lowest and highest forecast price and the current price."""
    pred = F.col("if_pred") == 1
    return merged.groupBy(*key).agg(
        F.min(F.when(pred, F.col(price))).alias("lowest"), F.max(F.when(pred, F.col(price))).alias("highest"),
        F.max_by(price, F.when(~pred, F.col(ts))).alias("current"))


def snapshot_lines(samples: DataFrame, key: Sequence[str], ts: str, value: Column, newest_first: bool = True) -> DataFrame:
    """Text lines ``past k hours (time): value``, newest first; a handful of rows per key."""
    line = F.format_string("past %d hours (%s): %s", F.abs("position"), D.stamp_text(ts), value.cast("string"))
    order = -D.slot(ts) if newest_first else D.slot(ts)
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return samples.groupBy(*key).agg(rows.alias("_r")).select(
        *key, F.array_join(F.transform("_r", lambda r: r["l"]), "\n").alias("lines"))
