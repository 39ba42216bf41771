"""Look-back means of post sentiment per bar.

A bar at hour E sees the posts of ``[E - w, E)``. Bars end on whole hours, so every clock hour
of posts lies wholly inside or outside: posts are first summed per hour, then windows of w rows
are summed over the hours. Cost is posts + hours, never posts x windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timefns as D
from . import grid as G, rolling as R
from .single import row_of

# Look-back windows in hours.
WINDOWS = (120, 168, 240, 360)


def hour_partials(posts: DataFrame, ts: str, cols: Sequence[str], weight: Column | None,
                  half_life_h: float) -> DataFrame:
    """Sums per clock hour; decayed sums measure age to the end of the hour."""
    w = F.lit(1.0) if weight is None else weight
    age = F.lit(1.0) - D.hours_between(F.col(ts), D.floor_hour(ts))
    d = F.pow(F.lit(0.5), age / F.lit(half_life_h))
    base = posts.select(D.floor_hour(ts).alias("ds"), w.cast("double").alias("_w"), d.alias("_d"),
                        *[F.col(c).cast("double").alias(c) for c in cols])
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sw")]
    for c in cols:
        x = F.col(c)
        aggs += [F.count(c).alias(f"_n_{c}"), F.sum(x).alias(f"_x_{c}"), F.sum(F.col("_w") * x).alias(f"_wx_{c}"),
                 F.sum(F.col("_d") * x).alias(f"_dx_{c}"), F.sum(F.col("_w") * F.col("_d") * x).alias(f"_wdx_{c}")]
    return base.groupBy("ds").agg(*aggs)


def lookback_panel(bars: DataFrame, posts: DataFrame, cols: Sequence[str], windows: Sequence[int] = WINDOWS,
                   post_ts: str = "created_at", weight: Column | None = None,
                   half_life_h: float = 24.0, weighted_only: bool = False,
                   block: int = R.BLOCK_STEPS) -> DataFrame:
    """Bars with plain, weighted, decayed and weighted-decayed means per window and column.

    Decayed sums are divided by the count, weighted-decayed ones by the undecayed weights.
    ``bars`` needs an hourly ``ds``; its other columns are kept. Bars before the first post are
    left out, as there is nothing to look back on.
    """
    far = max(windows)
    hours = hour_partials(posts, post_ts, cols, weight, half_life_h)
    lo = hours.agg(F.min("ds").alias("lo")).scalar()
    edges = bars.agg(F.max("ds").alias("hi")).select(lo.alias("lo"), "hi").where("lo <= hi")
    dense = G.densify(hours, [], "ds", bounds=edges)
    sums = [c for c in hours.columns if c != "ds"]
    dense = dense.fillna(0, sums)

    w = R.Blocked(dense, [], "ds", back=far, block=block)
    # Hours since the block start over the half life: a factor per row and one per frame end.
    at = (D.slot("ds") - F.col("_block") * F.lit(block)).cast("double") / F.lit(half_life_h)
    scaled = {}
    for c in cols:
        scaled |= {f"_dx_{c}": F.col(f"_dx_{c}") * F.pow(F.lit(2.0), at),
                   f"_wdx_{c}": F.col(f"_wdx_{c}") * F.pow(F.lit(2.0), at)}
    w.add(**scaled)
    back = F.pow(F.lit(2.0), F.lit(1.0 / half_life_h) - at)
    new: dict[str, Column] = {}
    for k in windows:
        f = w.window.rowsBetween(-k, -1)
        n, sw = F.sum("_n").over(f), F.sum("_sw").over(f)
        if not weighted_only:
            new[f"senti_sub_freq_w{k}"] = F.coalesce(n, F.lit(0)) / F.lit(float(k))
        for c in cols:
            new[f"{c}_rolling_w{k}"] = F.try_divide(F.sum(f"_x_{c}").over(f), F.sum(f"_n_{c}").over(f))
            new[f"{c}_rolling_wgt_w{k}"] = F.try_divide(F.sum(f"_wx_{c}").over(f), sw)
            if not weighted_only:
                new[f"{c}_rolling_timeDecay_w{k}"] = F.try_divide(F.sum(f"_dx_{c}").over(f) * back, n)
                new[f"{c}_rolling_wgt_timeDecay_w{k}"] = F.try_divide(F.sum(f"_wdx_{c}").over(f) * back, sw)
    panel = w.add(**new).done().select("ds", *new)
    return bars.join(panel, "ds")


def lookback_counts_unaligned(bars: DataFrame, posts: DataFrame, end: str, post_ts: str, window_h: int,
                              bar_id: Sequence[str]) -> DataFrame:
    """Posts in ``[end - w, end)`` for bar ends inside an hour.

    Whole hours come from the hourly sums. Only the posts of the two cut hours are matched to
    the bar, and they are counted before anything else is joined.
    """
    micros = F.unix_micros(F.col(end))
    width = F.lit(window_h * 3_600_000_000)
    hour = F.lit(3_600_000_000)
    b = bars.select(*bar_id, micros.alias("_e"), F.floor(micros / hour).cast("long").alias("_eh"),
                    F.floor((micros - width) / hour).cast("long").alias("_sh"))
    p = posts.select(F.unix_micros(F.col(post_ts)).alias("_t")).withColumn(
        "_h", F.floor(F.col("_t") / hour).cast("long"))
    per_hour = p.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    # Running count before each hour of a dense hour list turns any run of hours into a difference.
    edges = per_hour.agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    grid = edges.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("_h"))
    dense = grid.join(per_hour, "_h", "left").fillna(0, ["_n"])
    before = running_before(dense, "_h", "_n")
    span = row_of(edges)
    lo, hi = span["lo"], span["hi"]
    clip = lambda c: F.least(F.greatest(c, lo), hi + 1)
    whole = (b.withColumns({"_from": clip(F.col("_sh")), "_to": clip(F.col("_eh"))})
             .join(before.select(F.col("_h").alias("_from"), F.col("_before").alias("_b0")), "_from")
             .join(before.select(F.col("_h").alias("_to"), F.col("_before").alias("_b1")), "_to"))
    # The end hour adds its posts before E, the start hour gives back its posts before E - w.
    times = p.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_k"))
    cut = b.select(*bar_id, F.explode(F.array(
        F.struct(F.col("_eh").alias("h"), F.col("_e").alias("upto"), F.lit(1).alias("sign")),
        F.struct(F.col("_sh").alias("h"), (F.col("_e") - width).alias("upto"), F.lit(-1).alias("sign")),
    )).alias("c"))
    part = (cut.select(*bar_id, F.col("c.h").alias("_h"), F.col("c.upto").alias("_u"), F.col("c.sign").alias("_s"))
            .join(times, "_h").where(F.col("_t") < F.col("_u"))
            .groupBy(*bar_id).agg(F.sum(F.col("_s") * F.col("_k")).alias("_part")))
    return whole.join(part, list(bar_id), "left").select(
        *bar_id, (F.col("_b1") - F.col("_b0") + F.coalesce("_part", F.lit(0))).cast("long").alias("n_posts"))


def running_before(dense: DataFrame, pos: str, n: str, block: int = R.BLOCK_STEPS) -> DataFrame:
    """Sum of ``n`` over all smaller positions, block by block."""
    tagged = dense.withColumn("_g", F.floor(F.col(pos) / F.lit(block)).cast("long"))
    totals = tagged.groupBy("_g").agg(F.sum(n).alias("_t"))
    # One row per 4096 hours: 500 rows in two centuries.
    upto = Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_g", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_c"))
    inside = Window.partitionBy("_g").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.withColumn("_i", F.coalesce(F.sum(n).over(inside), F.lit(0)))
            .join(carried, "_g").select(pos, (F.col("_i") + F.col("_c")).alias("_before")))
