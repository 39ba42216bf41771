"""Registered queries: name -> (Spark plan, SQL with the same result or None)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as M, textfns as X, timefns as D
from ..operators import (
    backtest as B, dedupe as DD, forecast as P, grid as G, indicators as I, lookback as L, metrics as ME,
    origins as N, rolling as R, selection as SE, sentiment as S, serve as V, stats as ST)
from ..operators import single as R_
from ..operators.ewm import ewm_stds
from ..session import staged, work_dir
from ..sources import readers, schemas as SC
from ..streaming import streams as STR
from . import oracle as O, tables as T

KEY = T.KEY
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, cols, d: int = 6) -> DataFrame:
    # Adding 0.0 turns -0.0 into 0.0.
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c in cols})


# -- candles, calendars, checks -------------------------------------------------------------------

VOLUMES = ["volume", "taker_buy_base_asset_volume"]


@register("hourly_bars", O._with(O.BARS) + f"SELECT {O.BAR_COLS} FROM bars")
def hourly_bars(spark, sf):
    return rounded(T.bars(spark, sf), VOLUMES)


@register("dense_bars", O._with(O.BASE) + f"SELECT {O.BAR_COLS} FROM dense")
def dense_bars(spark, sf):
    return rounded(T.dense_bars(spark, sf), VOLUMES)


@register("gap_report", O._with(O.BARS) + """
SELECT * FROM (SELECT series_id, ds, lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS previous FROM bars)
WHERE ds > previous + INTERVAL 1 HOUR""")
def gap_report(spark, sf):
    return G.find_gaps(T.bars(spark, sf), KEY)


@register("missing_days", O._with(O.BARS, """
span AS (SELECT series_id, CAST(min(ds) AS DATE) AS lo FROM bars GROUP BY 1),
plan AS (SELECT series_id, CAST(unnest(generate_series(lo, DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day FROM span)""") + """
SELECT * FROM plan WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.series_id = plan.series_id AND CAST(b.ds AS DATE) = plan.day)""")
def missing_days(spark, sf):
    return readers.missing_days(T.bars(spark, sf), "series_id", "ds", "2024-02-10")


@register("bar_coverage", O._with(O.BASE) + """
SELECT h.series_id, count(*) AS n_rows, min(h.ds) AS first_ds, max(h.ds) AS last_ds, count(*) - count(b.y) AS missing_y,
       count(*) - count(b.volume) AS missing_volume
FROM hours h LEFT JOIN bars b USING (series_id, ds) GROUP BY 1""")
def bar_coverage(spark, sf):
    return G.coverage(G.densify(T.bars(spark, sf), KEY), KEY, "ds", ["y", "volume"])


@register("latest_hours", O._with(O.BASE) + """
SELECT series_id, ds, y FROM dense d
WHERE ds >= (SELECT max(ds) FROM dense m WHERE m.series_id = d.series_id) - INTERVAL 99 HOUR""")
def latest_hours(spark, sf):
    return T.latest_dense(spark, sf, 100).select(*KEY, "ds", "y")


@register("time_range", O._with(O.BARS) + """
SELECT series_id, ds, y FROM bars WHERE ds >= TIMESTAMP '2024-01-10 00:00:00' AND ds < TIMESTAMP '2024-01-20 00:00:00'""")
def time_range(spark, sf):
    return T.bars(spark, sf, datetime(2024, 1, 10), datetime(2024, 1, 20)).select(*KEY, "ds", "y")


@register("daily_means", O._with(O.BARS) + """
SELECT series_id, date_trunc('day', ds) AS ds, round(avg(y), 8) AS y, round(avg(volume), 8) AS volume FROM bars GROUP BY ALL""")
def daily_means(spark, sf):
    return rounded(G.resample(T.bars(spark, sf), KEY, D.floor_day("ds"), G.means(["y", "volume"])), ["y", "volume"], 8)


@register("weekly_means", O._with(O.BARS) + """
SELECT series_id, date_trunc('week', ds) + INTERVAL 6 DAY AS ds, round(avg(y), 8) AS y, round(avg(volume), 8) AS volume FROM bars GROUP BY ALL""")
def weekly_means(spark, sf):
    return rounded(G.resample(T.bars(spark, sf), KEY, D.week_ending_sunday("ds"), G.means(["y", "volume"])), ["y", "volume"], 8)


@register("hour_of_day_profile", O._with(O.BARS, """
per_hour AS (SELECT ds, sum(volume) AS volume, sum(num_of_trades) AS n FROM bars GROUP BY ds)""") + """
SELECT CAST(extract(hour FROM ds) AS INTEGER) AS hour, round(avg(volume), 6) AS mean_volume, round(avg(n), 6) AS mean_count FROM per_hour GROUP BY 1""")
def hour_of_day_profile(spark, sf):
    per_hour = T.bars(spark, sf).groupBy("ds").agg(F.sum("volume").alias("v"), F.sum("num_of_trades").alias("n"))
    out = per_hour.groupBy(F.hour("ds").alias("hour")).agg(F.avg("v").alias("mean_volume"), F.avg("n").alias("mean_count"))
    return rounded(out, ["mean_volume", "mean_count"])


@register("display_times", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, date_trunc('hour', ts) AS hour,
       make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS six_hours,
       timezone('US/Eastern', timezone('UTC', ts)) AS eastern,
       CASE WHEN epoch_us(ts) % 3600000000 > 1800000000 OR (epoch_us(ts) % 3600000000 = 1800000000 AND (epoch_us(ts) // 3600000000) % 2 = 1)
            THEN date_trunc('hour', ts) + INTERVAL 1 HOUR ELSE date_trunc('hour', ts) END AS nearest_hour,
       round((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 3600000000.0, 6) AS day_hours,
       date_trunc('second', ts) AS second_ FROM events""")
def display_times(spark, sf):
    e = T.events(spark, sf)
    return e.select(
        "event_id", D.stamp_text("ts").alias("shown"), D.floor_hour("ts").alias("hour"),
        D.floor_to("ts", 6 * 3600).alias("six_hours"), D.to_zone("ts").alias("eastern"),
        D.round_hour("ts").alias("nearest_hour"),
        F.round(D.hours_between("ts", D.floor_day("ts")), 6).alias("day_hours"),
        D.from_millis(F.unix_millis("ts")).alias("second_"))


# -- windows ---------------------------------------------------------------------------------------

LAGS = list(range(1, 8))


@register("lag_momentum", O._with(O.BASE) + f"""
SELECT series_id, ds, y, {', '.join(f'lag(y, {k}) {O.W} AS y_lag_{k}hr' for k in range(1, 8))},
       round(y - lag(y) {O.W}, 6) AS y_momentum FROM dense""")
def lag_momentum(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return rounded(R.diff(R.lags(d, KEY, "ds", ["y"], LAGS), KEY, "ds", ["y"]), ["y_momentum"])


@register("returns_past", O._with(O.BASE) + "SELECT series_id, ds, y, " + ", ".join(
    f"round(y / lag(y, {k}) {O.W} - 1, 6) AS ret_past_{k}_h" for k in I.HORIZONS) + " FROM dense")
def returns_past(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return rounded(R.returns(d, KEY, "ds", "y", I.HORIZONS), [f"ret_past_{k}_h" for k in I.HORIZONS])


@register("returns_fwd", O._with(O.BASE) + "SELECT series_id, ds, y, " + ", ".join(
    f"round(lead(y, {k}) {O.W} / y - 1, 6) AS ret_fwd_{k}_h" for k in I.HORIZONS) + " FROM dense")
def returns_fwd(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return rounded(R.returns(d, KEY, "ds", "y", I.HORIZONS, "fwd"), [f"ret_fwd_{k}_h" for k in I.HORIZONS])


@register("signal_label", O._with(O.BASE) + "SELECT series_id, ds, y, " + ", ".join(
    f"CAST(CASE WHEN lead(y, {k}) {O.W} / y - 1 > 0.005 THEN 1 WHEN lead(y, {k}) {O.W} / y - 1 < -0.005 THEN -1 ELSE 0 END AS INTEGER) AS ret_fwd_{k}_h"
    for k in I.HORIZONS) + " FROM dense")
def signal_label(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return I.label_returns(R.returns(d, KEY, "ds", "y", I.HORIZONS, "fwd"))


@register("rolling_volume", O._with(O.BASE) + "SELECT series_id, ds, " + ", ".join(
    f"round({O.framed('sum', 'volume', k)}, 4) AS vol_{k}_h" for k in I.HORIZONS) + " FROM dense")
def rolling_volume(spark, sf):
    w = R.Blocked(T.dense_bars(spark, sf).select(*KEY, "ds", "volume"), KEY, "ds", back=240)
    w.add(**{f"vol_{k}_h": R.rolling(w, "volume", k) for k in I.HORIZONS})
    return rounded(w.done().drop("volume"), [f"vol_{k}_h" for k in I.HORIZONS], 4)


@register("rolling_volatility", O._with(O.BASE) + "SELECT series_id, ds, " + ", ".join(
    f"round({O.framed('stddev_samp', 'y', k)}, 6) AS std_{k}_h" for k in (20, 72, 240)) + " FROM dense")
def rolling_volatility(spark, sf):
    w = R.Blocked(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY, "ds", back=240)
    w.add(**{f"std_{k}_h": R.rolling(w, "y", k, "stddev_samp") for k in (20, 72, 240)})
    return rounded(w.done().drop("y"), [f"std_{k}_h" for k in (20, 72, 240)])


@register("ewm_volatility", O.ewm_std_sql(I.HORIZONS))
def ewm_volatility(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=1)
    rets = w.add(ret=R.past_return(w, "y", 1)).done()
    spans = {f"volatilityEMA_{k}_h": k for k in I.HORIZONS}
    return rounded(ewm_stds(rets, KEY, "ds", "ret", spans).select(*KEY, "ds", *spans), spans)


@register("return_panel", O.panel_sql())
def return_panel(spark, sf):
    p = I.panel(T.dense_bars(spark, sf), KEY)
    cols = [c for c in p.columns if not c.startswith("volatilityEMA")]
    p = p.select(*cols)
    p = rounded(p, [c for c in cols if c.startswith(("ret_", "volatility_"))])
    return rounded(p, [c for c in cols if c.startswith(("vol_", "volBuy", "volSell"))], 4)


@register("gradient", O._with(O.BARS, """
daily AS (SELECT series_id, date_trunc('day', ds) AS ds, avg(y) AS y FROM bars GROUP BY ALL)""") + f"""
SELECT series_id, ds, round(y, 6) AS y, round(CASE WHEN lag(y) {O.W} IS NOT NULL AND lead(y) {O.W} IS NOT NULL THEN (lead(y) {O.W} - lag(y) {O.W}) / 2
  WHEN lead(y) {O.W} IS NOT NULL THEN lead(y) {O.W} - y ELSE y - lag(y) {O.W} END, 6) AS slope FROM daily""")
def gradient(spark, sf):
    daily = G.resample(T.bars(spark, sf), KEY, D.floor_day("ds"), G.means(["y"]))
    return rounded(R.gradient(daily, KEY, "ds", {"slope": "y"}), ["y", "slope"])


@register("supervised_frame", O._with(O.BASE, f"""
lagged AS (SELECT series_id, ds, {', '.join(f'lag({c}, {i}) {O.W} AS {c}_t_minus_{i}' for i in (3, 2, 1) for c in ('y', 'num_of_trades'))},
       {', '.join(f'lead({c}, {i}) {O.W} AS {c}_t_plus_{i}' for i in (0, 1) for c in ('y', 'num_of_trades'))} FROM dense)""") + """
SELECT * FROM lagged WHERE y_t_minus_3 IS NOT NULL AND y_t_plus_1 IS NOT NULL""")
def supervised_frame(spark, sf):
    return R.supervised(T.dense_bars(spark, sf), KEY, "ds", ["y", "num_of_trades"], 3, 2)


@register("sequences", O._with(O.BASE, f"""
s AS (SELECT series_id, ds, rn, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l,
      lead(y, 11) {O.W} AS target_y FROM dense)""") + """
SELECT series_id, ds, target_y, CAST(len(l) AS INTEGER) AS n_values, round(list_sum(l), 6) AS x_sum, l[1] AS x_first, l[24] AS x_last
FROM s WHERE rn >= 24 AND target_y IS NOT NULL""")
def sequences(spark, sf):
    s = R.sequences(T.dense_bars(spark, sf), KEY, "ds", ["y"], "y", 24, 12)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return s.select(*KEY, "ds", "target_y", F.size("x").alias("n_values"), F.round(total, 6).alias("x_sum"),
                    F.get("x", F.lit(0)).alias("x_first"), F.get("x", F.lit(23)).alias("x_last"))


@register("train_test_split", O._with(O.BASE, """
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM dense)""") + """
SELECT series_id, CASE WHEN back <= 120 THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds FROM n GROUP BY ALL""")
def train_test_split(spark, sf):
    train, test = R.split_last(T.dense_bars(spark, sf), KEY, "ds", 120)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@register("sample_positions", O._with(O.BASE, """
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n FROM dense)""") + """
SELECT series_id, ds, y, CAST(rn AS INTEGER) AS position FROM n WHERE rn IN (0, 5, 11, 23, 47, 95) AND rn < n
UNION ALL SELECT series_id, ds, y, CAST(-back AS INTEGER) FROM n WHERE back IN (1, 6, 12, 24, 48) AND back < n""")
def sample_positions(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return R.sample_positions(d, KEY, "ds", [-1, -6, -12, -24, -48, 0, 5, 11, 23, 47, 95])


# -- indicators -------------------------------------------------------------------------------------

@register("rsi", O._with(O.BASE, O.RSI) + "SELECT series_id, ds, y, round(RSI, 6) AS RSI FROM rsi")
def rsi(spark, sf):
    return rounded(I.rsi(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY), ["RSI"])


@register("macd", O._with(O.BASE, O.MACD) + f"SELECT series_id, ds, {O.r('MACD', 'MACD_signal', 'MACD_diff')} FROM macd")
def macd(spark, sf):
    out = I.macd(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY).drop("y")
    return rounded(out, ["MACD", "MACD_signal", "MACD_diff"])


FLOWS = ["typical_price", "raw_money_flow", "positive_money_flow", "negative_money_flow", "MFI"]


@register("money_flow", O._with(O.BASE, O.FLOW) + f"SELECT series_id, ds, {O.r(*FLOWS)} FROM flow")
def money_flow(spark, sf):
    return rounded(I.money_flow(T.dense_bars(spark, sf), KEY).select(*KEY, "ds", *FLOWS), FLOWS)


@register("bollinger", O._with(O.BASE, O.BANDS) + f"SELECT series_id, ds, y, {O.r('bollinger_upper', 'bollinger_lower')} FROM bands")
def bollinger(spark, sf):
    out = I.bollinger(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY)
    return rounded(out, ["bollinger_upper", "bollinger_lower"])


@register("tech_features", O._with(O.BASE, O.RSI, O.MACD, O.FLOW, O.BANDS) + f"""
SELECT {O.BAR_COLS}, {O.r(*I.FEATURES)} FROM (
  SELECT f.*, r.RSI, m.MACD, m.MACD_signal, m.MACD_diff, b.bollinger_upper, b.bollinger_lower
  FROM flow f JOIN rsi r USING (series_id, ds) JOIN macd m USING (series_id, ds) JOIN bands b USING (series_id, ds))
WHERE {' AND '.join(f'{c} IS NOT NULL' for c in I.FEATURES)}""")
def tech_features(spark, sf):
    return rounded(I.tech_features(T.dense_bars(spark, sf), KEY), [*VOLUMES, *I.FEATURES])


@register("rsi_events", O._with(O.BASE, O.RSI, """
live AS (SELECT series_id, ds, CAST(trunc(RSI) AS INTEGER) AS rsi FROM rsi WHERE rn >= 14 AND RSI > 1),
marked AS (
  SELECT *, rsi > 70 AND NOT coalesce(lag(rsi > 70) OVER (PARTITION BY series_id ORDER BY ds), FALSE) AS above,
         rsi < 30 AND NOT coalesce(lag(rsi < 30) OVER (PARTITION BY series_id ORDER BY ds), FALSE) AS below FROM live)""")
    + "SELECT * FROM marked WHERE above OR below")
def rsi_events(spark, sf):
    return I.rsi_events(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY)


@register("macd_events", O._with(O.BASE, O.MACD, f"""
flags AS (SELECT *, coalesce(MACD > MACD_signal, FALSE) AS up, coalesce(MACD < MACD_signal, FALSE) AS down FROM macd),
crossed AS (SELECT *, up AND NOT coalesce(lag(up) {O.W}, FALSE) AS buy, down AND NOT coalesce(lag(down) {O.W}, FALSE) AS sell FROM flags)""")
    + "SELECT series_id, ds, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS signal FROM crossed WHERE rn >= 26 AND (buy OR sell)")
def macd_events(spark, sf):
    return I.macd_events(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY)


def _bollinger_events(first_only: bool) -> str:
    keep = "" if not first_only else "AND NOT coalesce(lag(side) OVER (PARTITION BY series_id ORDER BY ds) = side, FALSE)"
    return O._with(O.BASE, O.BANDS, f"""
sided AS (SELECT *, CASE WHEN y > bollinger_upper THEN 'above' WHEN y < bollinger_lower THEN 'below' END AS side FROM bands),
kept AS (SELECT *, side IS NOT NULL {keep} AS hit FROM sided)""") + """
SELECT series_id, ds, y AS close_price, round(CASE WHEN side = 'above' THEN bollinger_upper ELSE bollinger_lower END, 6) AS level, side
FROM kept WHERE hit AND rn >= 19"""


@register("bollinger_events", _bollinger_events(False))
def bollinger_events(spark, sf):
    return rounded(I.bollinger_events(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY), ["level"])


@register("bollinger_first_events", _bollinger_events(True))
def bollinger_first_events(spark, sf):
    return rounded(I.bollinger_events(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY, first_only=True), ["level"])


@register("period_change", O._with(O.BASE, f"""
v AS (SELECT *, {O.framed('sum', 'volume', 24)} AS vn, y / lag(y, 24) {O.W} - 1 AS price_change FROM dense),
v2 AS (SELECT *, lag(vn, 24) {O.W} AS vb, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM v)""") + """
SELECT series_id, ds, y, round(price_change, 6) AS price_change, round(vn, 4) AS volume_now, round(vb, 4) AS volume_before,
       round(vn / vb - 1, 6) AS volume_change FROM v2 WHERE back = 1""")
def period_change(spark, sf):
    out = I.period_change(T.dense_bars(spark, sf), KEY)
    return rounded(rounded(out, ["price_change", "volume_change"]), ["volume_now", "volume_before"], 4)


@register("move_likelihood", O._with(O.BASE, f"m AS (SELECT series_id, ds, y, abs(y / lag(y, 8) {O.W} - 1) AS mv FROM dense)") + """
SELECT series_id, max_by(y, ds) AS price, round(max_by(y, ds) * 1.007, 6) AS target, round(1.007 - 1.0, 6) AS needed_move, round(avg(mv), 6) AS mean_move,
       avg(mv) >= 1.007 - 1.0 AS within_usual_move FROM m GROUP BY 1""")
def move_likelihood(spark, sf):
    out = I.move_likelihood(T.dense_bars(spark, sf), KEY, "ds", "y", 1.007, 8)
    return rounded(out, ["target", "needed_move", "mean_move"])


@register("daily_asof", O._with(O.BARS) + """
SELECT series_id, CAST(ds AS DATE) AS day, max(ds) AS ds, max_by(y, ds) AS y FROM bars WHERE extract(hour FROM ds) <= 16 GROUP BY 1, 2""")
def daily_asof(spark, sf):
    return I.daily_asof(T.bars(spark, sf).select(*KEY, "ds", "y"), KEY)


@register("normalised", O._with(O.BARS, """
daily AS (SELECT series_id, date_trunc('day', ds) AS ds, avg(y) AS y, avg(volume) AS volume FROM bars GROUP BY ALL)""") + """
SELECT series_id, ds, round((y - avg(y) OVER (PARTITION BY series_id)) / stddev_pop(y) OVER (PARTITION BY series_id), 6) AS y_z,
       round(volume / max(abs(volume)) OVER (), 6) AS volume_scaled FROM daily""")
def normalised(spark, sf):
    daily = G.resample(T.bars(spark, sf), KEY, D.floor_day("ds"), G.means(["y", "volume"]))
    z = I.normalise(daily, ["y"], "zscore", KEY, "_z")
    out = I.normalise(z, ["volume"], "maxabs", (), "_scaled").select(*KEY, "ds", "y_z", "volume_scaled")
    return rounded(out, ["y_z", "volume_scaled"])


@register("notional", O._with(O.BARS) + """
SELECT series_id, ds, round(volume - taker_buy_base_asset_volume, 6) AS sell_volume,
       round((volume - taker_buy_base_asset_volume) * y, 6) AS sell_notional FROM bars""")
def notional(spark, sf):
    out = I.notional(T.bars(spark, sf)).select(*KEY, "ds", "sell_volume", "sell_notional")
    return rounded(out, ["sell_volume", "sell_notional"])


# -- posts: versions, memos, text --------------------------------------------------------------------

NEWEST = "(fetch_datetime IS NULL) DESC, fetch_datetime DESC, self_text_md5 DESC, event_id DESC"


@register("latest_snapshot", O._with(O.SNAPSHOTS, f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {NEWEST}) AS rn FROM snapshots)""")
    + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def latest_snapshot(spark, sf):
    return DD.latest_per_id(T.snapshots(spark, sf), tie=("self_text_md5", "event_id"))


@register("latest_snapshot_dated", O._with(O.SNAPSHOTS, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (fetch_datetime IS NULL), fetch_datetime DESC, self_text_md5 DESC, event_id DESC) AS rn FROM snapshots)""")
    + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def latest_snapshot_dated(spark, sf):
    return DD.latest_per_id(T.snapshots(spark, sf), tie=("self_text_md5", "event_id"), nulls="lose")


@register("latest_snapshot_stamped", O._with(O.SNAPSHOTS, """
stamped AS (SELECT * REPLACE (coalesce(fetch_datetime, TIMESTAMP '2024-02-01 00:00:00') AS fetch_datetime) FROM snapshots),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetch_datetime DESC, self_text_md5 DESC, event_id DESC) AS rn FROM stamped)""")
    + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def latest_snapshot_stamped(spark, sf):
    return DD.latest_per_id(DD.stamp_missing(T.snapshots(spark, sf), "fetch_datetime", "2024-02-01 00:00:00"),
                            tie=("self_text_md5", "event_id"))


@register("upsert_memo", O._with(O.POSTS, O.MEMO, f"""
batch AS (SELECT id, self_text_md5, {O.relevance('body')} AS is_relevant, created_at AS fetch_datetime FROM posts),
both_sides AS (SELECT * FROM memo UNION ALL SELECT * FROM batch),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (fetch_datetime IS NULL) DESC, fetch_datetime DESC, self_text_md5 DESC) AS rn FROM both_sides)""")
    + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1")
def upsert_memo(spark, sf):
    batch = T.posts(spark, sf).select("id", "self_text_md5", X.mentions_any("body").alias("is_relevant"),
                                      F.col("created_at").alias("fetch_datetime"))
    return DD.upsert(T.relevance_memo(spark, sf), batch)


@register("keyword_relevance", O._with(O.CLEAN, O.MEMO, f"""
known AS (SELECT c.id, c.clean_text, m.is_relevant FROM cleaned c LEFT JOIN memo m USING (id, self_text_md5))""") + f"""
SELECT id, coalesce(is_relevant, {O.relevance('clean_text')}) AS is_relevant FROM known WHERE is_relevant IS DISTINCT FROM FALSE""")
def keyword_relevance(spark, sf):
    posts = T.with_text(T.posts(spark, sf))
    return DD.judge_relevance(posts, T.relevance_memo(spark, sf),
                              X.mentions_any("clean_text")).select("id", "is_relevant")


@register("score_reuse_split", O._with(O.SCORED, O.MEMO, """
held AS (SELECT m.id, m.self_text_md5, s.sentiment_positive FROM memo m JOIN scored s ON s.id = m.id),
looked AS (SELECT p.id, h.sentiment_positive AS s FROM posts p LEFT JOIN held h USING (id, self_text_md5))""") + """
SELECT id, CASE WHEN s IS NULL THEN 'to_score' ELSE 'reused' END AS part, round(s, 6) AS s_positive FROM looked""")
def score_reuse_split(spark, sf):
    scores = T.scored(spark, sf).select("id", F.col("sentiment_labels").alias("his_sentiment_labels"),
                                        F.col("sentiment_scores").alias("his_sentiment_scores"))
    # Both parts look it up; the test for a remembered score meets stored scores, not the scoring.
    memo = staged(T.relevance_memo(spark, sf).select("id", "self_text_md5").join(scores, "id"), "memo")
    posts = T.posts(spark, sf).select("id", "self_text_md5")
    done, todo = DD.reuse_scores(posts, memo, ["sentiment_labels", "sentiment_scores"])
    both = done.withColumn("part", F.lit("reused")).unionByName(todo.withColumn("part", F.lit("to_score")))
    wide = S.scores_to_columns(both, "sentiment_labels", "sentiment_scores", ["positive"], "s_")
    return rounded(wide.select("id", "part", "s_positive"), ["s_positive"])


@register("score_memo_upsert", O._with(O.SCORED, O.MEMO, """
old AS (SELECT m.id, m.self_text_md5, m.fetch_datetime, s.sentiment_positive + 1 AS p FROM memo m JOIN scored s USING (id)),
fresh AS (SELECT id, self_text_md5, created_at AS fetch_datetime, sentiment_positive AS p FROM scored WHERE sentiment_positive IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetch_datetime DESC, self_text_md5 DESC) AS rn
           FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh))""")
    + "SELECT id, self_text_md5, fetch_datetime, round(p, 6) AS p FROM ranked WHERE rn = 1")
def score_memo_upsert(spark, sf):
    # Memo and batch hold the same scores: written once, so that the test for missing ones doesn't repeat the scoring.
    wide = staged(T.scored_wide(spark, sf).select("id", "self_text_md5", "created_at", "sentiment_positive"), "scored")
    fresh = wide.select("id", "self_text_md5", F.col("created_at").alias("fetch_datetime"), F.col("sentiment_positive").alias("p"))
    old = (T.relevance_memo(spark, sf).drop("is_relevant")
           .join(wide.select("id", (F.col("sentiment_positive") + 1).alias("p")), "id"))
    return rounded(DD.upsert(old, fresh, require=["p"]), ["p"])


@register("clean_text", O._with(O.CLEAN) + "SELECT id, clean_text FROM cleaned")
def clean_text(spark, sf):
    return T.with_text(T.posts(spark, sf)).select("id", "clean_text")


@register("text_lengths", O._with(O.CLEAN) + """
SELECT link_flair_text, count(*) AS n_posts, sum(length(body))::BIGINT AS total_length, sum(least(length(body), 514))::BIGINT AS truncated_length,
       (count(*) FILTER (length(body) > 514))::BIGINT AS over_limit FROM cleaned GROUP BY 1""")
def text_lengths(spark, sf):
    p = T.posts(spark, sf)
    return p.groupBy("link_flair_text").agg(
        F.count(F.lit(1)).alias("n_posts"), F.sum(F.length("body")).alias("total_length"),
        F.sum(F.length(X.truncated("body"))).alias("truncated_length"),
        F.count_if(F.length("body") > X.MODEL_TEXT_LENGTH).alias("over_limit"))


@register("md5_check", "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS self_text_md5 FROM documents")
def md5_check(spark, sf):
    return table_text(spark, sf).select("id", X.fingerprint("text").alias("self_text_md5"))


def table_text(spark, sf):
    return T.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")


@register("post_previews", O._with(O.CLEAN) + """
SELECT id, left(clean_text, 220) || '...' AS preview, 'https://www.reddit.com' || permalink AS link,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_str FROM cleaned""")
def post_previews(spark, sf):
    p = T.with_text(T.posts(spark, sf))
    return p.select("id", X.preview("clean_text").alias("preview"), X.link("permalink").alias("link"),
                    D.stamp_text("created_at").alias("created_str"))


@register("masked_tokens", """
SELECT CAST(doc_id AS VARCHAR) AS id, md5(array_to_string(list_transform(string_split(text, ' '), lambda t:
  CASE WHEN starts_with(t, '@') AND length(t) > 1 THEN '@user' WHEN starts_with(t, 'http') THEN 'http' ELSE t END), ' ')) AS masked FROM documents""")
def masked_tokens(spark, sf):
    return table_text(spark, sf).select("id", F.md5(X.mask_users_and_links("text")).alias("masked"))


@register("excluded_authors", O._with(O.POSTS) + "SELECT id, author, score FROM posts WHERE NOT coalesce(contains(author, 'u1'), FALSE) AND score > 1")
def excluded_authors(spark, sf):
    p = T.posts(spark, sf).select("id", "author", "score")
    return p.where(X.excludes("author", "u1") & (F.col("score") > 1))


@register("lexicon_scores", O._with(O.SCORED) + f"SELECT id, {O.r('sentiment_negative', 'sentiment_neutral', 'sentiment_positive', 'emotion_fear', 'emotion_joy', 'emotion_neutral')} FROM scored")
def lexicon_scores(spark, sf):
    s = S.scores_to_columns(T.scored_wide(spark, sf), "emotion_labels", "emotion_scores", T.EMOTION.labels, "emotion_")
    cols = [f"sentiment_{l}" for l in T.SENTIMENT.labels] + [f"emotion_{l}" for l in T.EMOTION.labels]
    return rounded(s.select("id", *cols), cols)


@register("scores_exploded", O._with(O.SCORED) + """
SELECT id, unnest(['negative', 'neutral', 'positive']) AS sentiment_label,
       round(unnest([sentiment_negative, sentiment_neutral, sentiment_positive]), 6) AS sentiment_score FROM scored WHERE sentiment_neutral IS NOT NULL
UNION ALL SELECT id, NULL, NULL FROM scored WHERE sentiment_neutral IS NULL""")
def scores_exploded(spark, sf):
    s = T.scored(spark, sf).select("id", "sentiment_labels", "sentiment_scores")
    return rounded(S.explode_scores(s, "sentiment_labels", "sentiment_scores", "sentiment_"), ["sentiment_score"])


@register("scores_pivoted", O._with(O.SCORED) + f"SELECT id, {O.r('emotion_fear', 'emotion_joy', 'emotion_neutral')} FROM scored")
def scores_pivoted(spark, sf):
    e = S.explode_scores(T.scored(spark, sf).select("id", "emotion_labels", "emotion_scores"),
                         "emotion_labels", "emotion_scores", "emotion_")
    out = S.pivot_scores(e, "id", "emotion_label", "emotion_score", T.EMOTION.labels, "emotion_")
    return rounded(out, [f"emotion_{l}" for l in T.EMOTION.labels])


@register("ranked_labels", O._with(O.SCORED) + """
SELECT id, CASE WHEN sentiment_positive = top THEN 'positive' WHEN sentiment_neutral = top THEN 'neutral' WHEN sentiment_negative = top THEN 'negative' END AS top_label,
       round(top, 4) AS top_score FROM (SELECT id, round(sentiment_negative, 4) AS sentiment_negative, round(sentiment_neutral, 4) AS sentiment_neutral,
  round(sentiment_positive, 4) AS sentiment_positive, greatest(round(sentiment_negative, 4), round(sentiment_neutral, 4), round(sentiment_positive, 4)) AS top FROM scored)""")
def ranked_labels(spark, sf):
    s = T.scored(spark, sf).select("id", X.ranked_labels(F.col("sentiment_labels"), F.col("sentiment_scores")).alias("r"))
    top = F.get("r", F.lit(0))
    return s.select("id", top["label"].alias("top_label"), top["score"].alias("top_score"))


@register("dominant_sentiment", O._with(O.SCORED) + """
SELECT id, CASE greatest(sentiment_negative, sentiment_neutral, sentiment_positive) WHEN sentiment_negative THEN 'negative' WHEN sentiment_neutral THEN 'neutral' WHEN sentiment_positive THEN 'positive' END AS senti_most,
       CAST(CASE WHEN sentiment_positive > sentiment_negative AND sentiment_positive > sentiment_neutral THEN 1
                 WHEN sentiment_negative > sentiment_positive AND sentiment_negative > sentiment_neutral THEN -1 ELSE 0 END AS INTEGER) AS senti_dir FROM scored""")
def dominant_sentiment(spark, sf):
    p = T.sentiment_posts(spark, sf)
    c = {l: F.col(f"sentiment_{l}") for l in S.SENTIMENTS}
    return p.select("id", M.dominant(list(c.items())).alias("senti_most"),
                    M.direction(c["positive"], c["negative"], c["neutral"]).alias("senti_dir"))


@register("term_counts", O._with(O.CLEAN, O.TOKENS, "terms AS (SELECT unnest(words) AS term FROM tokenized)")
          + "SELECT term, count(*) AS n FROM terms GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def term_counts(spark, sf):
    return S.term_counts(T.with_text(T.posts(spark, sf)), "clean_text", 100)


@register("json_props", """
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS prop_k, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def json_props(spark, sf):
    e = T.table(spark, sf, "events").select("event_type", "value", F.from_json("props", "k BIGINT").alias("s"))
    out = e.groupBy("event_type", F.col("s.k").alias("prop_k")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(out, ["total"])


# -- hourly sentiment ---------------------------------------------------------------------------------

@register("sentiment_hourly", O._with(O.SCORED, O.HOURLY) + f"SELECT ds, {O.r(*O.SENTI_COLS)}, post_count_by_hour FROM hourly")
def sentiment_hourly(spark, sf):
    return rounded(T.sentiment_hourly(spark, sf), O.SENTI_COLS)


@register("sentiment_interpolated", O._with(O.SCORED, O.GRID) + f"SELECT ds, {O.r(*O.SENTI_COLS, 'post_count_by_hour')} FROM sgrid")
def sentiment_interpolated(spark, sf):
    return rounded(T.sentiment_grid(spark, sf), [*O.SENTI_COLS, "post_count_by_hour"])


@register("sentiment_features", O._with(O.SCORED, O.GRID, O.FEATURES) + f"SELECT ds, {O.r(*O.ALL_FEATURE_COLS)} FROM sfull")
def sentiment_features(spark, sf):
    out = S.sentiment_features(T.sentiment_grid(spark, sf))
    return rounded(out, O.ALL_FEATURE_COLS)


SCORE_SQL = "0 * tw_avg_negative + 50 * tw_avg_neutral + 100 * tw_avg_positive"


@register("sentiment_score", O._with(O.SCORED, O.GRID, O.FEATURES) + f"""
SELECT ds, CAST(trunc({SCORE_SQL}) AS INTEGER) AS sentiment_score,
       CASE WHEN trunc({SCORE_SQL}) < 34 THEN 'negative' WHEN trunc({SCORE_SQL}) < 67 THEN 'neutral' ELSE 'positive' END AS band,
       CASE WHEN trunc({SCORE_SQL}) < 33 THEN 'negative' WHEN trunc({SCORE_SQL}) < 67 THEN 'neutral' ELSE 'positive' END AS gauge FROM sfull""")
def sentiment_score(spark, sf):
    out = S.sentiment_score(S.sentiment_features(T.sentiment_grid(spark, sf)))
    return out.select("ds", "sentiment_score", M.score_band("sentiment_score").alias("band"),
                      M.score_band("sentiment_score", 33).alias("gauge"))


@register("time_weighted_price", O._with(O.BASE, f"""
k AS (SELECT series_id, ds, y, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS l FROM dense)""") + f"""
SELECT series_id, ds, y, CASE WHEN len(l) = 120 THEN round(list_sum(list_transform(l, lambda v, i: v * power(0.5, i / 120.0))) / {sum(0.5 ** ((120 - l) / 120) for l in range(120))!r}::DOUBLE, 6) END AS tw_oldest,
       CASE WHEN len(l) = 120 THEN round(list_sum(list_transform(l, lambda v, i: v * power(0.5, (121 - i) / 120.0))) / {sum(0.5 ** ((l + 1) / 120) for l in range(120))!r}::DOUBLE, 6) END AS tw_recent FROM k""")
def time_weighted_price(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=119)
    w.add(tw_oldest=R.kernel_average(w, "ds", "y"), tw_recent=R.kernel_average(w, "ds", "y", kernel="recent"))
    return rounded(w.done(), ["tw_oldest", "tw_recent"])


@register("fill_gaps", O._with(O.BASE) + """
SELECT series_id, ds, last_value(own_y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds) AS filled,
       first_value(own_y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_y FROM raw_dense""")
def fill_gaps(spark, sf):
    g = G.densify(T.bars(spark, sf).select(*KEY, "ds", "y"), KEY)
    near = R._with_neighbours(g, KEY, "ds", ["y"], R.BLOCK_STEPS, times=False)
    return near.select(*KEY, "ds", F.coalesce("y", "_prev_y").alias("filled"), F.coalesce("y", "_next_y").alias("next_y"))


@register("interpolate_price", O._with(O.BASE, O.interpolated("(SELECT series_id, ds, own_y FROM raw_dense)", ["own_y"], "ip", "series_id"))
          + "SELECT series_id, ds, round(own_y, 6) AS y FROM ip")
def interpolate_price(spark, sf):
    g = G.densify(T.bars(spark, sf).select(*KEY, "ds", "y"), KEY)
    return rounded(R.interpolate(g, KEY, "ds", ["y"]), ["y"])


# -- dashboard tables ------------------------------------------------------------------------------------

TAGGED = """
top AS (SELECT * FROM scored ORDER BY created_at DESC, id DESC LIMIT 500),
tagged AS (
  SELECT id, created_at, upvote_ratio, num_comments, sentiment_negative, sentiment_neutral, sentiment_positive,
         make_timestamp(epoch_us(created_at) // 21600000000 * 21600000000) AS time_group,
         CASE greatest(sentiment_negative, sentiment_neutral, sentiment_positive) WHEN sentiment_negative THEN 'negative' WHEN sentiment_neutral THEN 'neutral' WHEN sentiment_positive THEN 'positive' END AS senti_most FROM top)"""


@register("rep_posts", O._with(O.SCORED, TAGGED) + f"SELECT id, created_at, upvote_ratio, num_comments, time_group, senti_most, {O.r('sentiment_negative', 'sentiment_neutral', 'sentiment_positive')} FROM tagged")
def rep_posts(spark, sf):
    cols = [f"sentiment_{l}" for l in S.SENTIMENTS]
    p = T.newest_scored(spark, sf).select("id", "created_at", "upvote_ratio", "num_comments", *cols)
    return rounded(S.tag_posts(p), cols)


@register("representative_posts", O._with(O.SCORED, TAGGED, """
ranked AS (SELECT *, row_number() OVER (PARTITION BY senti_most ORDER BY time_group DESC, upvote_ratio, id) AS lo,
  row_number() OVER (PARTITION BY senti_most ORDER BY time_group DESC, upvote_ratio DESC, id) AS hi FROM tagged)""") + """
SELECT senti_most, 'low' AS prefer, id, upvote_ratio, time_group FROM ranked WHERE lo = 1
UNION ALL SELECT senti_most, 'high', id, upvote_ratio, time_group FROM ranked WHERE hi = 1""")
def representative_posts(spark, sf):
    tagged = S.tag_posts(T.newest_scored(spark, sf)).select("id", "upvote_ratio", "time_group", "senti_most")
    low = S.representative_posts(tagged, "low").withColumn("prefer", F.lit("low"))
    high = S.representative_posts(tagged, "high").withColumn("prefer", F.lit("high"))
    return low.unionByName(high).select("senti_most", "prefer", "id", "upvote_ratio", "time_group")


# -- look-back panel ----------------------------------------------------------------------------------------

LOOKBACK_COLS = ["sentiment_positive", "sentiment_negative"]


@register("lookback_panel", O.lookback_sql((120, 168, 240, 360), LOOKBACK_COLS))
def lookback_panel(spark, sf):
    bars = T.bars(spark, sf).select(*KEY, "ds", F.col("y").alias("close_price"))
    w = F.col("relevancy_score") * F.log1p("num_comments")
    out = L.lookback_panel(bars, T.sentiment_posts(spark, sf), LOOKBACK_COLS, weight=w)
    return rounded(out, [c for c in out.columns if "_w" in c])


@register("lookback_two_weeks", O.lookback_sql((336,), ["sentiment_positive"]).replace(
    "SELECT b.series_id, b.y AS close_price, a.*",
    "SELECT b.series_id, a.ds, b.y AS close_price, a.sentiment_positive_rolling_w336, a.sentiment_positive_rolling_wgt_w336"))
def lookback_two_weeks(spark, sf):
    bars = T.bars(spark, sf).select(*KEY, "ds", F.col("y").alias("close_price"))
    w = F.col("relevancy_score") * F.log1p("num_comments")
    out = L.lookback_panel(bars, T.sentiment_posts(spark, sf), ["sentiment_positive"], (336,), weight=w, weighted_only=True)
    return rounded(out, [c for c in out.columns if "_w" in c])


@register("lookback_unaligned", O._with(O.POSTS) + """
SELECT e.event_id, count(p.id) AS n_posts FROM events e LEFT JOIN posts p
  ON p.created_at >= e.ts - INTERVAL 120 HOUR AND p.created_at < e.ts GROUP BY 1""")
def lookback_unaligned(spark, sf):
    return L.lookback_counts_unaligned(T.events(spark, sf), T.posts(spark, sf), "ts", "created_at", 120, ["event_id"])


# -- statistics ----------------------------------------------------------------------------------------

DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@register("describe", " UNION ALL ".join(f"""
SELECT '{c}' AS field, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
       round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
    for c in DESCRIBED))
def describe(spark, sf):
    out = ST.describe(T.table(spark, sf, "lineitem"), DESCRIBED)
    return rounded(out, ["mean", "std", "q25", "q50", "q75"])


@register("histogram", """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50.0)), 49)::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY 1),
g AS (SELECT unnest(generate_series(0, 49))::INTEGER AS bin)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 50.0), 6) AS left, round(lo + (g.bin + 1) * ((hi - lo) / 50.0), 6) AS right,
       coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (), 6) AS percent
FROM g LEFT JOIN b USING (bin), e""")
def histogram(spark, sf):
    return rounded(ST.histogram(T.table(spark, sf, "lineitem"), "l_extendedprice", 50), ["left", "right", "percent"])


@register("histogram_by_class", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / ((hi - lo) / 30.0)), 29)::INTEGER AS bin, count(*) AS n FROM orders, e GROUP BY 1, 2),
g AS (SELECT o_orderstatus, unnest(generate_series(0, 29))::INTEGER AS bin FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT g.o_orderstatus, g.bin, round(lo + g.bin * ((hi - lo) / 30.0), 6) AS left, round(lo + (g.bin + 1) * ((hi - lo) / 30.0), 6) AS right,
       coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(coalesce(n, 0)) OVER (PARTITION BY g.o_orderstatus), 6) AS percent
FROM g LEFT JOIN b USING (o_orderstatus, bin), e""")
def histogram_by_class(spark, sf):
    out = ST.histogram(T.table(spark, sf, "orders"), "o_totalprice", 30, "o_orderstatus")
    return rounded(out, ["left", "right", "percent"])


def _box_sql(whisker: float) -> str:
    return f"""
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
f AS (SELECT o.o_totalprice AS v, q.*, v BETWEEN q1 - {whisker} * (q3 - q1) AND q3 + {whisker} * (q3 - q1) AS inside FROM orders o JOIN q USING (o_orderpriority))
SELECT o_orderpriority, round(any_value(f.q1), 6) AS q1, round(any_value(f.median), 6) AS median, round(any_value(f.q3), 6) AS q3, round(avg(v), 6) AS mean,
       min(v) FILTER (inside) AS whisker_lo, max(v) FILTER (inside) AS whisker_hi, count(*) FILTER (NOT inside) AS outliers
FROM f GROUP BY o_orderpriority"""


@register("box_stats", _box_sql(1.5))
def box_stats(spark, sf):
    out = ST.box_stats(T.table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(out, ["q1", "median", "q3", "mean"])


@register("box_stats_narrow", _box_sql(0.4))
def box_stats_narrow(spark, sf):
    out = ST.box_stats(T.table(spark, sf, "orders"), "o_totalprice", "o_orderpriority", 0.4)
    return rounded(out, ["q1", "median", "q3", "mean"])


@register("kde", """
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_extendedprice) * power(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
g AS (SELECT i::INTEGER AS point, lo + (hi - lo) * (i / 29.0) AS x FROM e, (SELECT unnest(generate_series(0, 29)) AS i))
SELECT l.l_returnflag, point, round(x, 6) AS x,
       round(1e6 * sum(exp(-0.5 * power((l_extendedprice - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density
FROM lineitem l JOIN s USING (l_returnflag), g GROUP BY ALL""")
def kde(spark, sf):
    out = ST.kde(T.table(spark, sf, "lineitem"), "l_extendedprice", 30, "l_returnflag")
    return rounded(out.withColumn("density", F.col("density") * 1e6), ["x", "density"])


@register("kde_2d", O._with(O.SCORED, """
s AS (SELECT count(*) AS n, min(sentiment_positive) AS alo, max(sentiment_positive) AS ahi, min(sentiment_negative) AS blo, max(sentiment_negative) AS bhi,
      var_samp(sentiment_positive) * power(count(*), -1/3.0) AS vaa, var_samp(sentiment_negative) * power(count(*), -1/3.0) AS vbb,
      covar_samp(sentiment_positive, sentiment_negative) * power(count(*), -1/3.0) AS vab FROM scored WHERE sentiment_positive IS NOT NULL)""",
    "d AS (SELECT *, vaa * vbb - vab * vab AS det FROM s)",
    "g AS (SELECT i::INTEGER AS ia, j::INTEGER AS ib, alo + (ahi - alo) * (i / 7.0) AS ga, blo + (bhi - blo) * (j / 7.0) AS gb, d.* FROM d, (SELECT unnest(generate_series(0, 7)) AS i), (SELECT unnest(generate_series(0, 7)) AS j))") + """
SELECT ia, ib, round(sum(exp(-0.5 * (vbb * power(p.sentiment_positive - ga, 2) - 2 * vab * (p.sentiment_positive - ga) * (p.sentiment_negative - gb)
       + vaa * power(p.sentiment_negative - gb, 2)) / det)) / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 6) AS density
FROM g, scored p WHERE p.sentiment_positive IS NOT NULL GROUP BY 1, 2""")
def kde_2d(spark, sf):
    return rounded(ST.kde_2d(T.sentiment_posts(spark, sf), "sentiment_positive", "sentiment_negative", 8), ["density"])


@register("author_stats", O._with(O.SCORED) + """
SELECT author, count(id) AS count, round(avg(score), 6) AS score_avg, round(avg(num_comments), 6) AS num_comments_avg,
       round(avg(sentiment_positive), 6) AS sentiment_positive_avg, round(stddev_samp(sentiment_positive), 6) AS sentiment_positive_std FROM scored GROUP BY 1""")
def author_stats(spark, sf):
    out = ST.author_stats(T.sentiment_posts(spark, sf), "author", "id", ["score", "num_comments", "sentiment_positive"], ["sentiment_positive"])
    return rounded(out, [c for c in out.columns if c.endswith(("_avg", "_std"))])


@register("customer_stats", """
SELECT o_custkey, count(o_orderkey) AS count, round(avg(o_totalprice), 8) AS o_totalprice_avg, round(stddev_samp(o_totalprice), 4) AS o_totalprice_std FROM orders GROUP BY 1""")
def customer_stats(spark, sf):
    out = ST.author_stats(T.table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_totalprice"], ["o_totalprice"])
    return rounded(rounded(out, ["o_totalprice_avg"], 8), ["o_totalprice_std"], 4)


@register("value_counts", " UNION ALL ".join(f"""
SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count({c}) FROM orders), 6) AS share FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in ("o_orderstatus", "o_orderpriority")))
def value_counts(spark, sf):
    return rounded(ST.value_counts(T.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]), ["share"])


@register("flagged_authors", O._with(O.POSTS) + """
SELECT id, author, score, num_comments FROM posts WHERE author IN (SELECT author FROM posts WHERE link_flair_text = 'scam')""")
def flagged_authors(spark, sf):
    p = T.posts(spark, sf).select("id", "author", "score", "num_comments", "link_flair_text")
    return ST.posts_by_flagged(p, F.col("link_flair_text").isin("scam")).drop("link_flair_text")


@register("quantile_bucket", """
SELECT o_orderkey, 1 + (o_totalprice > q[1])::INT + (o_totalprice > q[2])::INT + (o_totalprice > q[3])::INT + (o_totalprice > q[4])::INT AS score_quantile
FROM orders, (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)""")
def quantile_bucket(spark, sf):
    return ST.quantile_bucket(T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


@register("post_weights", O._with(O.POSTS, "q AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM posts)") + """
SELECT id, b AS score_quantile, round(b * b * relevancy_score * ln(num_comments + 1), 6) AS weight, b * b AS weight_plain FROM
 (SELECT *, 1 + (score > q[1])::INT + (score > q[2])::INT + (score > q[3])::INT + (score > q[4])::INT AS b FROM posts, q)""")
def post_weights(spark, sf):
    p = T.posts(spark, sf).select("id", "score", "relevancy_score", "num_comments")
    q = ST.quantile_bucket(p, "score")
    return q.select("id", "score_quantile", F.round(M.post_weight("score_quantile", "relevancy_score", "num_comments"), 6).alias("weight"),
                    M.post_weight("score_quantile").cast("int").alias("weight_plain"))


@register("signed_returns", O._with(O.SCORED, O.BASE, f"""
fwd AS (SELECT ds, avg(r) AS r FROM (SELECT ds, lead(y, 120) {O.W} / y - 1 AS r FROM dense) GROUP BY ds),
dirs AS (SELECT author, id, CASE WHEN epoch_us(created_at) % 3600000000 > 1800000000 OR (epoch_us(created_at) % 3600000000 = 1800000000 AND (epoch_us(created_at) // 3600000000) % 2 = 1)
            THEN date_trunc('hour', created_at) + INTERVAL 1 HOUR ELSE date_trunc('hour', created_at) END AS ds,
         CASE WHEN sentiment_positive > sentiment_negative AND sentiment_positive > sentiment_neutral THEN 1
              WHEN sentiment_negative > sentiment_positive AND sentiment_negative > sentiment_neutral THEN -1 ELSE 0 END AS dir FROM scored)""") + """
SELECT author, count(id) AS count, round(avg(r * dir), 6) AS ret_adj_avg, round(stddev_samp(r * dir), 6) AS ret_adj_std FROM dirs LEFT JOIN fwd USING (ds) GROUP BY 1""")
def signed_returns(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    fwd = R.returns(d, KEY, "ds", "y", [120], "fwd").groupBy("ds").agg(F.avg("ret_fwd_120_h").alias("r"))
    p = T.sentiment_posts(spark, sf)
    dirs = p.select("author", "id", D.round_hour("created_at").alias("ds"), M.direction(
        F.col("sentiment_positive"), F.col("sentiment_negative"), F.col("sentiment_neutral")).alias("dir"))
    both = dirs.join(fwd, "ds", "left").withColumn("ret_adj", F.col("r") * F.col("dir"))
    return rounded(ST.author_stats(both, "author", "id", ["ret_adj"], ["ret_adj"]), ["ret_adj_avg", "ret_adj_std"])


CORR = ["y", "volume", "num_of_trades", "taker_buy_base_asset_volume", "y_upper", "y_lower"]


@register("corr_matrix", O._with(O.BARS) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM bars" for i, a in enumerate(CORR) for b in CORR[i:]))
def corr_matrix(spark, sf):
    return rounded(ST.corr_matrix(T.bars(spark, sf), CORR), ["r"])


@register("corr_to_target", O._with(O.BARS) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS field, round(corr({a}, y), 6) AS correl FROM bars" for a in CORR[1:]) + ") WHERE abs(correl) > 0.2")
def corr_to_target(spark, sf):
    return rounded(ST.corr_to(T.bars(spark, sf), "y", CORR[1:], 0.2), ["correl"])


XCORR = """
price AS (SELECT series_id, date_trunc('day', ds) AS ds, avg(y) AS x FROM bars GROUP BY ALL),
mood AS (SELECT date_trunc('day', created_at) AS ds, avg(sentiment_positive) AS y FROM scored GROUP BY 1),
lags AS (SELECT unnest(generate_series(-20, 19))::INTEGER AS lag),
pairs AS (SELECT series_id, lag, x, m.y AS y FROM price p, lags l, mood m WHERE m.ds + l.lag * INTERVAL 1 DAY = p.ds)"""


def _daily_pair(spark, sf):
    price = G.resample(T.bars(spark, sf), KEY, D.floor_day("ds"), {"x": F.avg("y")})
    mood = G.resample(T.sentiment_posts(spark, sf), [], D.floor_day("created_at"), {"y": F.avg("sentiment_positive")})
    return price, mood


@register("cross_corr_pearson", O._with(O.BARS, O.SCORED, XCORR) + "SELECT series_id, lag, round(corr(x, y), 6) AS r FROM pairs GROUP BY 1, 2")
def cross_corr_pearson(spark, sf):
    a, b = _daily_pair(spark, sf)
    return rounded(ST.cross_corr(a, b, KEY, "ds", "x", "y"), ["r"])


@register("cross_corr_spearman", O._with(O.BARS, O.SCORED, XCORR, """
ranked AS (SELECT series_id, lag, rank() OVER (PARTITION BY series_id, lag ORDER BY x) + (count(*) OVER (PARTITION BY series_id, lag, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY series_id, lag ORDER BY y) + (count(*) OVER (PARTITION BY series_id, lag, y) - 1) / 2.0 AS ry FROM pairs)""")
    + "SELECT series_id, lag, round(corr(rx, ry), 6) AS r FROM ranked GROUP BY 1, 2")
def cross_corr_spearman(spark, sf):
    a, b = _daily_pair(spark, sf)
    return rounded(ST.cross_corr(a, b, KEY, "ds", "x", "y", method="spearman"), ["r"])


@register("cross_corr_kendall", O._with(O.BARS, O.SCORED, XCORR, """
num AS (SELECT series_id, lag, row_number() OVER (PARTITION BY series_id, lag) AS i, x, y FROM pairs),
signs AS (SELECT a.series_id, a.lag, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM num a JOIN num b ON a.series_id = b.series_id AND a.lag = b.lag AND a.i < b.i)""")
    + """SELECT series_id, lag, round(sum(sx * sy) / nullif(sqrt(sum(abs(sx)) * sum(abs(sy))), 0), 6) AS r
FROM (SELECT DISTINCT series_id, lag FROM pairs) LEFT JOIN signs USING (series_id, lag) GROUP BY 1, 2""")
def cross_corr_kendall(spark, sf):
    a, b = _daily_pair(spark, sf)
    return rounded(ST.cross_corr(a, b, KEY, "ds", "x", "y", method="kendall"), ["r"])


_LB = O.lookback_sql((120, 240), LOOKBACK_COLS)
_LBF = [f"{c}_rolling{t}_w{k}" for c in LOOKBACK_COLS for t in ('', '_wgt') for k in (120, 240)]


@register("weighted_correlation", "WITH panel AS (" + _LB + "), c AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, round(corr({f}, close_price), 6) AS correl FROM panel" for f in _LBF) + """),
a AS (SELECT regexp_extract(field, '^(.+)_rolling_w([0-9]+)$', 1) AS label, regexp_extract(field, '^(.+)_rolling_w([0-9]+)$', 2) AS w, field, correl FROM c WHERE field NOT LIKE '%wgt%'),
b AS (SELECT regexp_extract(field, '^(.+)_rolling_wgt_w([0-9]+)$', 1) AS label, regexp_extract(field, '^(.+)_rolling_wgt_w([0-9]+)$', 2) AS w, field AS field_wgt, correl AS correl_wgt FROM c WHERE field LIKE '%wgt%')
SELECT label, CAST(w AS INTEGER) AS window, field, correl, field_wgt, correl_wgt, round(correl - correl_wgt, 6) AS diff FROM a JOIN b USING (label, w) WHERE abs(correl) > 0.001 OR abs(correl_wgt) > 0.001""")
def weighted_correlation(spark, sf):
    bars = T.bars(spark, sf).select(*KEY, "ds", F.col("y").alias("close_price"))
    w = F.col("relevancy_score") * F.log1p("num_comments")
    panel = rounded(L.lookback_panel(bars, T.sentiment_posts(spark, sf), LOOKBACK_COLS, (120, 240), weight=w), _LBF)
    correl = rounded(ST.corr_to(panel, "close_price", _LBF), ["correl"])
    return rounded(ST.compare_weighted(correl, 0.001), ["diff"])


# -- model frame and selection ----------------------------------------------------------------------------

@register("model_frame", O._with(O.BASE, O.SCORED, O.GRID) + f"""
SELECT series_id, ds, d.y, {O.r(*O.SENTI_COLS)} FROM (SELECT DISTINCT series_id FROM dense) CROSS JOIN (SELECT ds FROM sgrid) LEFT JOIN dense d USING (series_id, ds)
LEFT JOIN sgrid s USING (ds)""")
def model_frame(spark, sf):
    bounds = T.events(spark, sf).agg(D.floor_hour(F.min("ts")).alias("lo"), D.floor_hour(F.max("ts")).alias("hi"))
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    # Every series on the hours of the sentiment grid: the strict guards then hold.
    own = d.select(*KEY).distinct().select("*", R_.row_of(bounds).alias("b")).select(*KEY, "b.lo", "b.hi")
    s = T.sentiment_grid(spark, sf).drop("post_count_by_hour")
    return rounded(V.guarded_model_frame(G.densify(d, KEY, bounds=own), s, KEY), O.SENTI_COLS)


SELECTED = [*I.FEATURES, "volume", "num_of_trades", "taker_buy_base_asset_volume"]


def _features(spark, sf):
    return I.tech_features(T.dense_bars(spark, sf), KEY)


_FEATS = O._with(O.BASE, O.RSI, O.MACD, O.FLOW, O.BANDS, f"""
feats AS (SELECT * FROM (
  SELECT f.*, r.RSI, m.MACD, m.MACD_signal, m.MACD_diff, b.bollinger_upper, b.bollinger_lower
  FROM flow f JOIN rsi r USING (series_id, ds) JOIN macd m USING (series_id, ds) JOIN bands b USING (series_id, ds))
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in I.FEATURES)})""")


@register("variance_filter", _FEATS + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance FROM feats" for c in SELECTED) + ") WHERE variance > 0.1")
def variance_filter(spark, sf):
    return rounded(SE.select_by_variance(_features(spark, sf), SELECTED), ["variance"], 4)


VIF_COLS = ["volume", "num_of_trades", "RSI", "MFI"]


@register("vif")
def vif(spark, sf):
    return rounded(SE.vif(staged(_features(spark, sf), "features"), VIF_COLS), ["vif"])



@register("vif_pair", _FEATS + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(1 / (1 - power(corr(volume, num_of_trades), 2)), 6) AS vif FROM feats" for c in ("volume", "num_of_trades")))
def vif_pair(spark, sf):
    return rounded(SE.vif(staged(_features(spark, sf), "features"), ["volume", "num_of_trades"]), ["vif"])


@register("rf_importance")
def rf_importance(spark, sf):
    return rounded(SE.select_by_forest(staged(_features(spark, sf), "features"), SELECTED, "y"), ["importance"])


@register("rfe")
def rfe(spark, sf):
    return SE.rfe(staged(_features(spark, sf), "features"), SELECTED, "y", 6)


@register("ols_pvalues")
def ols_pvalues(spark, sf):
    return rounded(SE.ols_pvalues(staged(_features(spark, sf), "features"), ["RSI", "MFI", "volume", "num_of_trades", "MACD"], "y"), ["coefficient", "p_value"])


@register("select_features")
def select_features(spark, sf):
    return SE.select_features(_features(spark, sf), SELECTED, "y", n_features=6)


# -- forecasts, metrics, backtests --------------------------------------------------------------------------

_SPLITS = """
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM dense),
blocks AS (SELECT *, n // 6 AS size, unnest(generate_series(0, 4))::INTEGER AS split FROM sized),
tagged AS (SELECT *, n - 5 * size + split * size AS begin FROM blocks),
parts AS (SELECT *, CASE WHEN rn < begin - 120 THEN 'train' WHEN rn >= begin AND rn < begin + size THEN 'test' END AS part FROM tagged)"""


@register("time_splits", O._with(O.BASE, _SPLITS) + """
SELECT series_id, split, part, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds FROM parts WHERE part IS NOT NULL GROUP BY ALL""")
def time_splits(spark, sf):
    s = B.time_splits(T.dense_bars(spark, sf).select(*KEY, "ds"), KEY, "ds", 5, 120)
    return s.groupBy(*KEY, "split", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@register("naive_forecast", O._with(O.BASE, f"""
r AS (SELECT series_id, lead(y, 120) {O.W} / y - 1 AS fwd, y / lag(y, 120) {O.W} - 1 AS past FROM dense)""") + """
SELECT series_id, count(*) AS n, round(sqrt(avg(power(fwd - past, 2))), 6) AS rmse_past, round(sqrt(avg(fwd * fwd)), 6) AS rmse_zero,
       round((sqrt(avg(power(fwd - past, 2))) / sqrt(avg(fwd * fwd)) - 1) * 100, 4) AS ratio_pct FROM r WHERE fwd IS NOT NULL AND past IS NOT NULL GROUP BY 1""")
def naive_forecast(spark, sf):
    out = P.naive_errors(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY, "ds", "y")
    return rounded(rounded(out, ["rmse_past", "rmse_zero"]), ["ratio_pct"], 4)


_NAIVE = f"shifted AS (SELECT series_id, ds, y, lag(y, 120) {O.W} AS yhat, rn FROM dense), good AS (SELECT * FROM shifted WHERE yhat IS NOT NULL)"


def _shifted(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=120)
    return w.add(yhat=F.lag("y", 120).over(w.window)).done().where(F.col("yhat").isNotNull())


@register("regression_metrics", O._with(O.BASE, _NAIVE) + """
SELECT series_id, count(*) AS n, round(avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, round(avg(power(y - yhat, 2)), 8) AS mse,
       round(avg(abs(y - yhat)), 6) AS mae, round(stddev_pop(abs(y - yhat)), 6) AS std_error, round(sqrt(avg(power((y - yhat) / nullif(y, 0), 2))) * 100, 4) AS rmspe,
       round(sqrt(avg(power(y - yhat, 2))), 6) AS rmse, round(avg(power(y - yhat, 2)), 8) AS rmse_ref, round(1 - avg(power(y - yhat, 2)) / var_pop(y), 6) AS r2,
       round(1 - var_pop(y - yhat) / var_pop(y), 6) AS explained_variance, round(median(abs(y - yhat)), 6) AS median_ae FROM good GROUP BY 1""")
def regression_metrics(spark, sf):
    out = ME.regression_metrics(_shifted(spark, sf), "y", "yhat", KEY, median=True)
    out = rounded(rounded(out, ["mse", "rmse_ref"], 8), ["rmspe"], 4)
    return rounded(out, [c for c in out.columns if c not in (*KEY, "n", "rmspe", "mse", "rmse_ref")])


@register("hit_rate", O._with(O.BASE, _NAIVE, f"mv AS (SELECT series_id, (y - lag(y) {O.W}) * (yhat - lag(yhat) {O.W}) AS p FROM good)") + """
SELECT series_id, round(count(*) FILTER (p > 0) / count(p), 6) AS pcg_same_dir FROM mv GROUP BY 1""")
def hit_rate(spark, sf):
    return rounded(ME.hit_rate(_shifted(spark, sf), KEY, "ds", "y", "yhat"), ["pcg_same_dir"])


_BYHOUR = """
good2 AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS i FROM good),
byhour AS (SELECT series_id, CAST(i % 120 AS INTEGER) AS hour, avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS avg_mape, stddev_pop(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS std_mape FROM good2 GROUP BY 1, 2)"""


@register("mape_by_horizon", O._with(O.BASE, _NAIVE, _BYHOUR) + "SELECT series_id, hour, round(avg_mape, 6) AS avg_mape, round(std_mape, 6) AS std_mape FROM byhour")
def mape_by_horizon(spark, sf):
    return rounded(ME.mape_by_horizon(_shifted(spark, sf), KEY, "ds", "y", "yhat", 120), ["avg_mape", "std_mape"])


@register("horizon_extremes", O._with(O.BASE, _NAIVE, _BYHOUR) + """
SELECT series_id, first(hour ORDER BY avg_mape, hour) AS best_hour, round(min(avg_mape), 6) AS best_mape, first(hour ORDER BY avg_mape DESC, hour) AS worst_hour,
       round(max(avg_mape), 6) AS worst_mape, round(avg(avg_mape), 6) AS mean_mape FROM byhour GROUP BY 1""")
def horizon_extremes(spark, sf):
    m = ME.mape_by_horizon(_shifted(spark, sf), KEY, "ds", "y", "yhat", 120)
    return rounded(ME.horizon_extremes(m, KEY), ["best_mape", "worst_mape", "mean_mape"])


@register("residual_percent", O._with(O.BASE, _NAIVE) + "SELECT series_id, ds, round((y - yhat) / nullif(y, 0) * 100, 6) AS residual FROM good")
def residual_percent(spark, sf):
    return _shifted(spark, sf).select(*KEY, "ds", (F.round(ME.residual_percent("y", "yhat"), 6) + 0.0).alias("residual"))


@register("class_metrics", """
WITH p AS (SELECT quality AS a, (n_chars > 1000)::INTEGER AS b, lang FROM labels JOIN documents USING (doc_id)),
s AS (SELECT lang, count(*) AS n, count(*) FILTER (a = b) AS ok, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (b = 1) AS pp, count(*) FILTER (a = 1) AS ap FROM p GROUP BY 1)
SELECT lang, n, round(ok / n, 6) AS accuracy, round(coalesce(tp / nullif(pp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ap, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(pp + ap, 0), 0), 6) AS f1_score FROM s""")
def class_metrics(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("b"))
    p = T.table(spark, sf, "labels").join(docs, "doc_id")
    return rounded(ME.class_metrics(p, "quality", "b", ["lang"]), ["accuracy", "precision", "recall", "f1_score"])


_CLASSES = f"""
r AS (SELECT series_id, lead(y, 120) {O.W} / y - 1 AS fwd, y / lag(y, 120) {O.W} - 1 AS past FROM dense),
c AS (SELECT series_id, CASE WHEN fwd > 0.005 THEN 1 WHEN fwd < -0.005 THEN -1 ELSE 0 END AS a, CASE WHEN past > 0.005 THEN 1 WHEN past < -0.005 THEN -1 ELSE 0 END AS p FROM r)"""


@register("confusion", O._with(O.BASE, _CLASSES) + """
SELECT coalesce(CAST(a AS VARCHAR), 'Total') AS actual, count(*) FILTER (p = -1) AS predicted_m1, count(*) FILTER (p = 0) AS predicted_0, count(*) FILTER (p = 1) AS predicted_1,
       count(*) AS total FROM c GROUP BY ROLLUP (a)""")
def confusion(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=120, ahead=120)
    w.add(a=M.signal_label(R.forward_return(w, "y", 120)), p=M.signal_label(R.past_return(w, "y", 120)))
    return ME.confusion(w.done(), "a", "p", [-1, 0, 1])


_ORIGINS = """
lim AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi, (epoch(max(ds)) - epoch(min(ds))) / 3600 + 1 AS n FROM dense GROUP BY 1)"""


@register("rolling_origin_splits", O._with(O.BASE, _ORIGINS, """
k AS (SELECT *, unnest(generate_series(0, 1000)) AS k FROM lim),
c AS (SELECT series_id, lo, hi - (120 + 1440 * k) * INTERVAL 1 HOUR AS cutoff FROM k WHERE hi - (120 + 1440 * k) * INTERVAL 1 HOUR >= lo + round_even(0.7 * n, 0)::INT * INTERVAL 1 HOUR)""") + """
SELECT series_id, cutoff, lo AS training_start, cutoff AS training_end, cutoff + INTERVAL 1 HOUR AS test_start, cutoff + INTERVAL 120 HOUR AS test_end,
       CAST((epoch(cutoff) - epoch(lo)) / 3600 + 1 AS BIGINT) AS n_train FROM c""")
def rolling_origin_splits(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds")
    return N.splits(d, KEY, "ds", N.origins_by_period(d, KEY, "ds"))


def _backtest_sql(select: str) -> str:
    return O._with(O.BASE, _NAIVE, _ORIGINS, """
cuts AS (SELECT series_id, lo, hi, unnest(generate_series(lo + (round_even(0.7 * n, 0)::INT - 1) * INTERVAL 1 HOUR, hi - INTERVAL 120 HOUR, INTERVAL 1 HOUR)) AS cutoff FROM lim),
trimmed AS (
  SELECT s.series_id, s.ds, s.y, s.yhat, c.cutoff, FALSE AS short_horizon
  FROM shifted s JOIN cuts c ON s.series_id = c.series_id AND s.ds > c.cutoff AND s.ds <= c.cutoff + INTERVAL 120 HOUR),
bounds AS (SELECT series_id, cutoff, greatest(lo, cutoff - INTERVAL 180 DAY + INTERVAL 1 HOUR) AS training_start, cutoff AS training_end FROM cuts),
runs AS (
  SELECT series_id, cutoff, short_horizon, min(ds) AS mystery_start, max(ds) AS mystery_end, count(*) AS n_test, avg(abs(y - yhat)) AS mae, avg(power(y - yhat, 2)) AS mse,
         avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape, list(y ORDER BY ds) AS y, list(yhat ORDER BY ds) AS yhat
  FROM trimmed GROUP BY 1, 2, 3)""") + select


def _naive_runs(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return B.summarise_runs(B.naive_rows(d, KEY, "ds", "y", N.origins_by_step(d, KEY, "ds")), KEY, "ds", "y")


@register("backtest_naive", _backtest_sql("""
SELECT r.series_id, cutoff, short_horizon, training_start, training_end, mystery_start, mystery_end, n_test, round(mae, 6) AS mae, round(mse, 8) AS mse, round(mape, 6) AS mape,
       round(((epoch_us(training_end) - epoch_us(training_start)) / 3600000000 + 1) * 0.2, 6) AS validation_size FROM runs r JOIN bounds USING (series_id, cutoff)"""))
def backtest_naive(spark, sf):
    cols = [*KEY, "cutoff", "short_horizon", "training_start", "training_end", "mystery_start", "mystery_end", "n_test", "mae", "mse", "mape", "validation_size"]
    return rounded(rounded(_naive_runs(spark, sf).select(*cols), ["mse"], 8), ["mae", "mape", "validation_size"])


@register("mape_per_step", _backtest_sql("""
, flat AS (SELECT unnest(y) AS y, unnest(yhat) AS yhat, unnest(generate_series(0, len(y) - 1)) AS hour FROM runs)
SELECT CAST(hour AS INTEGER) AS hour, round(avg(abs((y - yhat) / nullif(y, 0)) * 100), 4) AS mean_mape FROM flat GROUP BY 1"""))
def mape_per_step(spark, sf):
    return rounded(ME.mape_per_step(_naive_runs(spark, sf)), ["mean_mape"], 4)


@register("backtest_baseline")
def backtest_baseline(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    runs = P.backtest_baseline(d, KEY, N.origins_by_step(d, KEY, "ds"))
    return B.ranked_runs(runs.drop("y", "yhat"))


@register("backtest_side_by_side")
def backtest_side_by_side(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return B.side_by_side(P.backtest_baseline(d, KEY, N.origins_by_step(d, KEY, "ds")), _naive_runs(spark, sf), KEY, ("model", "naive"))


@register("baseline_forecast")
def baseline_forecast(spark, sf):
    return P.baseline_forecast(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY, prefix="baseline_")


def _tuned(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    return P.tune_baseline(d, KEY, N.origins_by_period(d, KEY, "ds"))


@register("tune_baseline")
def tune_baseline(spark, sf):
    return _tuned(spark, sf)


@register("best_parameters")
def best_parameters(spark, sf):
    return P.best_parameters(_tuned(spark, sf))


@register("regressor_subsets")
def regressor_subsets(spark, sf):
    return P.evaluate_regressors(T.dense_bars(spark, sf), KEY, "ds", "y", ["volume", "num_of_trades", "taker_buy_base_asset_volume"])


@register("lagged_forecast")
def lagged_forecast(spark, sf):
    return P.lagged_forecast(T.dense_bars(spark, sf).select(*KEY, "ds", "volume", "y"), KEY, cols=("volume", "y"))


@register("direction_model")
def direction_model(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=72, ahead=24)
    w.add(label=M.signal_label(R.forward_return(w, "y", 24)), **{f"r{k}": R.past_return(w, "y", k) for k in (1, 24, 72)})
    out = P.direction_model(w.done(), KEY, "ds", ["r1", "r24", "r72"], "label")
    return out.groupBy("split", "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@register("direction_scores")
def direction_scores(spark, sf):
    """Accuracy of every split, and the confusion matrix averaged over the splits."""
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=72, ahead=24)
    w.add(label=M.signal_label(R.forward_return(w, "y", 24)), **{f"r{k}": R.past_return(w, "y", k) for k in (1, 24, 72)})
    out = staged(P.direction_model(w.done(), KEY, "ds", ["r1", "r24", "r72"], "label").select("split", "label", "predicted"), "directions")
    acc = ME.accuracy_by(out, "label", "predicted", ["split"]).select(F.lit("accuracy").alias("part"), "split", F.lit(None).cast("int").alias("actual"),
                                                                      F.lit(None).cast("int").alias("predicted"), F.col("accuracy").alias("value"))
    cells = ME.mean_confusion(out, "label", "predicted", "split", [-1, 0, 1]).select(F.lit("confusion").alias("part"), F.lit(None).cast("int").alias("split"), "actual", "predicted",
                                                                                    F.col("mean_count").alias("value"))
    return acc.unionByName(cells)


@register("direction_holdout")
def direction_holdout(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "y")
    w = R.Blocked(d, KEY, "ds", back=72, ahead=24)
    w.add(label=M.signal_label(R.forward_return(w, "y", 24)), **{f"r{k}": R.past_return(w, "y", k) for k in (1, 24, 72)})
    tagged = P.random_holdout(w.done(), [*KEY, "ds"])
    return ME.confusion(P.direction_predictions(tagged, ["r1", "r24", "r72"], "label"), "label", "predicted", [-1, 0, 1])


@register("ablation")
def ablation(spark, sf):
    p = I.panel(T.dense_bars(spark, sf), KEY, horizons=(1, 6, 24))
    return P.ablation(p, KEY, "ds", "ret_fwd_24_h", [("returns", ["ret_past_"]), ("volumes", ["vol"]), ("trades", ["trdCnt"]),
                                                            ("returns and volumes", ["ret_past_", "vol"]), ("all", ["ret_past_", "vol", "trdCnt"])])


# -- dashboard tables over bars -----------------------------------------------------------------------------

AS_OF = "2024-01-25 00:00:00"
_SERVED = f"""
pred AS (SELECT series_id, ds + INTERVAL 120 HOUR AS ds, y * 1.0137731 AS close_price FROM dense),
future AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS k FROM pred WHERE ds >= TIMESTAMP '{AS_OF}'),
merged AS (
  SELECT series_id, ds, round_even(y * 100, 0) / 100 AS close_price, 0 AS if_pred FROM dense WHERE ds < TIMESTAMP '{AS_OF}' AND ds >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY
  UNION ALL SELECT series_id, ds, round_even(close_price * 100, 0) / 100, 1 FROM future WHERE k <= 120)"""


def _merged(spark, sf):
    # Ten days of history and the values that the first forecast hours come from: nothing older is read.
    now = datetime.fromisoformat(AS_OF)
    d = T.dense_between(spark, sf, now - timedelta(days=10), now + timedelta(hours=1)).select(*KEY, "ds", F.col("y").alias("close_price"))
    pred = d.select(*KEY, (F.col("ds") + F.expr("INTERVAL 120 HOURS")).alias("ds"), (F.col("close_price") * 1.0137731).alias("close_price"))
    return V.history_and_forecast(d, pred, KEY, AS_OF)


@register("history_and_forecast", O._with(O.BASE, _SERVED) + "SELECT * FROM merged")
def history_and_forecast(spark, sf):
    return _merged(spark, sf)


@register("price_range", O._with(O.BASE, _SERVED) + """
SELECT series_id, min(close_price) FILTER (if_pred = 1) AS lowest, max(close_price) FILTER (if_pred = 1) AS highest, max_by(close_price, ds) FILTER (if_pred = 0) AS current FROM merged GROUP BY 1""")
def price_range(spark, sf):
    return V.price_range(_merged(spark, sf), KEY)


@register("snapshot_lines", O._with(O.BASE, """
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back, count(*) OVER (PARTITION BY series_id) AS n FROM dense)""") + """
SELECT series_id, string_agg('past ' || back || ' hours (' || strftime(ds, '%Y-%m-%d %H:%M:%S') || '): ' || CAST(num_of_trades AS BIGINT), chr(10) ORDER BY ds DESC) AS lines
FROM n WHERE back IN (1, 6, 12, 24, 48) AND back < n GROUP BY 1""")
def snapshot_lines(spark, sf):
    d = T.dense_bars(spark, sf).select(*KEY, "ds", "num_of_trades")
    return V.snapshot_lines(R.sample_positions(d, KEY, "ds", [-1, -6, -12, -24, -48]), KEY, "ds", F.col("num_of_trades"))


# -- streams ---------------------------------------------------------------------------------------------------



def _run(spark, sf, name: str, shape, write_for, mode: str) -> str:
    root = f"{work_dir(spark)}/{name}-{uuid4().hex}"
    src = STR.stream_files(spark, f"{sf}/events.parque[t]", SC.EVENTS)  # exactly this file, or this folder of files
    STR.run_stream(shape(src.withColumn("ts", F.col("ts").cast("timestamp"))), write_for(f"{root}/out"), f"{root}/log", mode).awaitTermination()
    return f"{root}/out"


def _run_batches(spark, sf, name: str, shape, write_for, mode: str, batches: int = 5) -> str:
    """The events as a stream of several micro-batches whose times overlap."""
    root = f"{work_dir(spark)}/{name}-{uuid4().hex}"
    e = T.table(spark, sf, "events")
    e.repartition(batches, F.pmod("event_id", F.lit(batches))).write.parquet(f"{root}/in")
    src = STR.stream_files(spark, f"{root}/in", e.schema, files_per_batch=1)
    STR.run_stream(shape(src.withColumn("ts", F.col("ts").cast("timestamp"))), write_for(f"{root}/out"), f"{root}/log", mode).awaitTermination()
    return f"{root}/out"


@register("stream_hourly", """
SELECT event_type, date_trunc('hour', ts) AS ds, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 8) AS mean FROM events GROUP BY 1, 2""")
def stream_hourly(spark, sf):
    out = _run(spark, sf, "hourly", lambda e: STR.hourly_aggregates(e, "ts", ["event_type"], "value"), STR.append_delta, "update")
    return rounded(rounded(STR.read_last_update(spark, out, ["event_type", "ds"]), ["total"]), ["mean"], 8)


@register("stream_sliding", """
SELECT event_type, date_trunc('hour', ts) + h * INTERVAL 1 HOUR AS ds, count(*) AS n, round(avg(value), 8) AS mean
FROM events, (SELECT unnest(generate_series(1, 6)) AS h) GROUP BY 1, 2""")
def stream_sliding(spark, sf):
    out = _run(spark, sf, "sliding", lambda e: STR.sliding_means(e, "ts", ["event_type"], "value", 6), STR.append_delta, "update")
    return rounded(STR.read_last_update(spark, out, ["event_type", "ds"]), ["mean"], 8)


@register("stream_sliding_long", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)
SELECT event_type, hour + k * INTERVAL 1 HOUR AS ds, sum(n)::BIGINT AS n, round(sum(total) / sum(n) + 1e-9, 6) AS mean FROM h, (SELECT unnest(generate_series(1, 120)) AS k) GROUP BY 1, 2""")
def stream_sliding_long(spark, sf):
    out = _run_batches(spark, sf, "ring", lambda e: STR.sliding_ring(e, "ts", ["event_type"], "value", 120), STR.append_kinds, "update")
    # The small shift keeps exact halves from falling either way.
    return rounded(STR.read_sliding(spark, out, ["event_type"], 120).withColumn("mean", F.col("mean") + 1e-9), ["mean"])


@register("stream_late_merged", """
SELECT event_type, date_trunc('hour', ts) AS ds, count(value) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_late_merged(spark, sf):
    shape = lambda rows: STR.hourly_sums(rows, "ts", ["event_type"], "value")
    out = _run_batches(spark, sf, "late", lambda e: e, lambda t: STR.write_with_late(t, "ts", "72 HOURS", shape), "append")
    return rounded(STR.merge_late(spark, out, shape, ["event_type", "ds"], ["n", "total"]), ["total"])


@register("stream_compacted", O._with(O.SNAPSHOTS, f"ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {NEWEST}) AS rn FROM snapshots)")
          + "SELECT id, event_id, event_type, self_text_md5, fetch_datetime FROM ranked WHERE rn = 1")
def stream_compacted(spark, sf):
    tie, schema = ("self_text_md5", "event_id"), _snapshot_shape(T.events(spark, sf)).schema
    out = _run_batches(spark, sf, "compacted", _snapshot_shape, lambda t: STR.upsert_compacted(t, schema, "id", "fetch_datetime", tie, every=2), "append")
    return STR.read_compacted(spark, out, schema, "id", "fetch_datetime", tie)


def _snapshot_shape(e):
    return e.select(F.col("user_id").cast("string").alias("id"), "event_id", "event_type", F.md5("props").alias("self_text_md5"),
                    F.when(F.col("value") >= 1.0, F.col("ts")).alias("fetch_datetime"))


@register("stream_latest", O._with(O.SNAPSHOTS, f"ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {NEWEST}) AS rn FROM snapshots)")
          + "SELECT id, event_id, event_type, self_text_md5, fetch_datetime FROM ranked WHERE rn = 1")
def stream_latest(spark, sf):
    tie = ("self_text_md5", "event_id")
    out = _run(spark, sf, "latest", _snapshot_shape, lambda t: STR.upsert_batch(t, "id", "fetch_datetime", tie), "append")
    return STR.read_latest(spark, out, "id", "fetch_datetime", tie)


@register("stream_enriched", """
SELECT e.event_id, e.user_id, c.c_mktsegment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")
def stream_enriched(spark, sf):
    customers = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = _run(spark, sf, "enriched", lambda e: e.select("event_id", "user_id"),
               lambda t: STR.append_delta(t, lambda d: DD.attach_memo(d, customers, ["user_id"], ["c_mktsegment"])), "append")
    return spark.read.parquet(out).drop("batch_id")


# -- lookups, lists and scalar expressions ------------------------------------------------------------------------

@register("comments_by_post", O._with(O.POSTS, "comments AS (SELECT event_id, 't3_' || CAST(user_id AS VARCHAR) AS link_id, value FROM events)") + """
SELECT p.id, count(*) AS n_comments, round(sum(value), 6) AS total FROM posts p JOIN comments c ON 't3_' || p.id = c.link_id GROUP BY 1""")
def comments_by_post(spark, sf):
    comments = T.events(spark, sf).select("event_id", F.concat(F.lit("t3_"), F.col("user_id").cast("string")).alias("link_id"), "value")
    # Summed per post first: one row per post meets the posts, however many comments one post has.
    per_post = comments.groupBy("link_id").agg(F.count(F.lit(1)).alias("n_comments"), F.sum("value").alias("total"))
    out = S.attach_comments(T.posts(spark, sf).select("id"), per_post).drop("link_id")
    return rounded(out, ["total"])


@register("author_list", O._with(O.POSTS) + "SELECT author, max(num_comments) AS top FROM posts GROUP BY 1 ORDER BY top DESC, author")
def author_list(spark, sf):
    return T.posts(spark, sf).groupBy("author").agg(F.max("num_comments").alias("top")).orderBy(F.col("top").desc(), "author")


@register("common_days", O._with(O.BARS, O.POSTS) + """
SELECT date_trunc('day', ds) AS ds FROM bars INTERSECT SELECT date_trunc('day', created_at) FROM posts WHERE upvote_ratio > 0.7""")
def common_days(spark, sf):
    a = T.bars(spark, sf).select(D.floor_day("ds").alias("ds"))
    b = T.posts(spark, sf).where("upvote_ratio > 0.7").select(D.floor_day("created_at").alias("ds"))
    return a.intersect(b)


@register("classifier_relevance", O._with(O.SCORED) + """
SELECT id, coalesce(emotion_fear > 0.5 OR emotion_joy > 0.5 OR emotion_neutral > 0.5, FALSE) AS is_relevant FROM scored""")
def classifier_relevance(spark, sf):
    return T.scored(spark, sf).select("id", S.any_label_above("emotion_scores").alias("is_relevant"))


@register("entries_to_columns", O._with(O.SCORED) + f"SELECT id, {O.r('sentiment_negative', 'sentiment_neutral', 'sentiment_positive')} FROM scored")
def entries_to_columns(spark, sf):
    s = T.scored(spark, sf).select("id", F.arrays_zip(F.col("sentiment_labels").alias("l"), F.col("sentiment_scores").alias("s")).alias("e"))
    out = S.entries_to_columns(s, "e", T.SENTIMENT.labels, "sentiment_").drop("e")
    return rounded(out, [f"sentiment_{l}" for l in T.SENTIMENT.labels])


@register("scalar_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice)::BIGINT AS price_floor, round_even(l_discount * l_extendedprice * 1.37 * 100, 0) / 100 AS discount_2dp,
       abs(l_quantity - 25) AS distance, round(ln(l_quantity + 1), 6) AS log_quantity, round(power(l_tax, 2), 6) AS tax_squared, round(sqrt(l_extendedprice), 6) AS root_price,
       round(power(0.5, l_quantity / 24), 6) AS decay, trunc(l_extendedprice)::INTEGER AS price_int, greatest(coalesce(l_quantity - 30, 0), 0) AS above_30 FROM lineitem""")
def scalar_math(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return T.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(p).alias("price_floor"),
        (F.rint(F.col("l_discount") * p * 1.37 * 100) / 100).alias("discount_2dp"), F.abs(q - 25).alias("distance"),
        F.round(F.log1p(q), 6).alias("log_quantity"), F.round(F.pow("l_tax", F.lit(2.0)), 6).alias("tax_squared"),
        F.round(F.sqrt(p), 6).alias("root_price"), F.round(M.decay(q), 6).alias("decay"), p.cast("int").alias("price_int"),
        M.floor_zero(q - 30).alias("above_30"))


@register("baseline_features")
def baseline_features(spark, sf):
    return P.attach_baseline(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY)
