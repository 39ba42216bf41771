"""Technical indicators over dense hourly candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import signal_label
from . import rolling as R
from .ewm import ewm_means, ewm_stds
from .single import with_row

# The look-back horizons of the return and volume panel, in hours.
HORIZONS = (1, 6, 24, 48, 72, 96, 120, 240)

FEATURES = ("RSI", "MACD", "MACD_signal", "MACD_diff", "typical_price", "raw_money_flow",
            "positive_money_flow", "negative_money_flow", "MFI", "bollinger_upper", "bollinger_lower")


def _gain_loss(w: R.Blocked, close: str) -> dict[str, Column]:
    move = F.col(close) - F.lag(close).over(w.window)
    return {"_gain": F.when(move > 0, move).otherwise(F.lit(0.0)),
            "_loss": F.when(move < 0, -move).otherwise(F.lit(0.0))}


def _rsi_from(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain/loss); no loss gives 100, null while warming up."""
    return F.when(loss == 0, F.lit(100.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss)))


def rsi(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y", n: int = 14) -> DataFrame:
    w = R.Blocked(df, key, ts, back=1)
    base = w.add(**_gain_loss(w, close)).done()
    sm = ewm_means(base, key, ts, {"_ag": ("_gain", 1.0 / n, n), "_al": ("_loss", 1.0 / n, n)})
    return sm.withColumn("RSI", _rsi_from(F.col("_ag"), F.col("_al"))).select(*df.columns, "RSI")


def macd(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y", fast: int = 12,
         slow: int = 26, signal: int = 9) -> DataFrame:
    sm = ewm_means(df, key, ts, {"_fast": (close, 2.0 / (fast + 1), fast),
                                 "_slow": (close, 2.0 / (slow + 1), slow)})
    line = sm.withColumn("MACD", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ewm_means(line, key, ts, {"MACD_signal": ("MACD", 2.0 / (signal + 1), signal)})
    return out.withColumn("MACD_diff", F.col("MACD") - F.col("MACD_signal"))


def _flow_columns(w: R.Blocked) -> R.Blocked:
    w.add(typical_price=(F.col("y_upper") + F.col("y_lower") + F.col("y")) / 3)
    w.add(raw_money_flow=F.col("typical_price") * F.col("volume"))
    before = F.lag("typical_price").over(w.window)
    up = F.when(F.col("typical_price") > before, F.col("raw_money_flow")).otherwise(F.lit(0.0))
    down = F.when(F.col("typical_price") < before, F.col("raw_money_flow")).otherwise(F.lit(0.0))
    return w.add(positive_money_flow=up, negative_money_flow=down)


def _mfi(w: R.Blocked, n: int) -> Column:
    pos = R.rolling(w, "positive_money_flow", n)
    neg = R.rolling(w, "negative_money_flow", n)
    # No flow at all is undefined; flow in one direction only is an infinite ratio.
    return (F.when((neg == 0) & (pos > 0), F.lit(100.0))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(pos, neg))))


def money_flow(df: DataFrame, key: Sequence[str], ts: str = "ds", n: int = 14) -> DataFrame:
    w = _flow_columns(R.Blocked(df, key, ts, back=n))
    return w.add(MFI=_mfi(w, n)).done()


def _bands(w: R.Blocked, close: str, n: int, k: float) -> dict[str, Column]:
    mid = R.rolling(w, close, n, "avg")
    dev = R.rolling(w, close, n, "stddev_samp")
    return {"bollinger_upper": mid + dev * k, "bollinger_lower": mid - dev * k}


def bollinger(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y", n: int = 20,
              k: float = 2.0) -> DataFrame:
    w = R.Blocked(df, key, ts, back=n - 1)
    return w.add(**_bands(w, close, n, k)).done()


def tech_features(df: DataFrame, key: Sequence[str], ts: str = "ds", drop_incomplete: bool = True) -> DataFrame:
    """RSI, MACD, money flow and Bollinger columns; warm-up rows are dropped.

    All framed windows share one blocked pass, all averages of the price one scan.
    """
    w = _flow_columns(R.Blocked(df, key, ts, back=20))
    w.add(MFI=_mfi(w, 14), **_bands(w, "y", 20, 2.0), **_gain_loss(w, "y"))
    base = w.done()
    sm = ewm_means(base, key, ts, {
        "_ag": ("_gain", 1 / 14, 14), "_al": ("_loss", 1 / 14, 14),
        "_fast": ("y", 2 / 13, 12), "_slow": ("y", 2 / 27, 26)})
    line = sm.withColumns({"RSI": _rsi_from(F.col("_ag"), F.col("_al")),
                           "MACD": F.col("_fast") - F.col("_slow")}).drop("_ag", "_al", "_fast", "_slow")
    out = ewm_means(line, key, ts, {"MACD_signal": ("MACD", 2 / 10, 9)})
    out = out.withColumn("MACD_diff", F.col("MACD") - F.col("MACD_signal")).select(*df.columns, *FEATURES)
    return out.dropna() if drop_incomplete else out


def panel(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y",
          horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Returns, volume sums, trade counts and volatilities over all horizons."""
    far = max(horizons)
    w = R.Blocked(df, key, ts, back=far + 1, ahead=far)
    w.add(sell_volume=F.col("volume") - F.col("taker_buy_base_asset_volume"))
    w.add(_ret=R.past_return(w, close, 1))
    new: dict[str, Column] = {}
    for k in horizons:
        new |= {
            f"ret_past_{k}_h": R.past_return(w, close, k),
            f"vol_{k}_h": R.rolling(w, "volume", k),
            f"volBuy_{k}_h": R.rolling(w, "taker_buy_base_asset_volume", k),
            f"volSell_{k}_h": R.rolling(w, "sell_volume", k),
            f"trdCnt_{k}_h": R.rolling(w, "num_of_trades", k),
            f"volatility_{k}_h": R.rolling(w, "_ret", k, "stddev_samp"),
            f"ret_fwd_{k}_h": R.forward_return(w, close, k),
        }
    framed = w.add(**new).done()
    smooth = {f"volatilityEMA_{k}_h": k for k in horizons}
    out = ewm_stds(framed, key, ts, "_ret", smooth)
    return out.select(*key, ts, F.col(close).alias("close_price"), *new, *smooth)


def label_returns(df: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Replace every forward return by its three-class label."""
    return df.withColumns({c: signal_label(c, threshold) for c in df.columns if "ret_fwd_" in c})


def notional(df: DataFrame, close: str = "y") -> DataFrame:
    """Sell volume and sell notional."""
    sell = F.col("volume") - F.col("taker_buy_base_asset_volume")
    return df.withColumns({"sell_volume": sell, "sell_notional": sell * F.col(close)})


# -- events ------------------------------------------------------------------------------------

def rsi_events(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y",
               high: int = 70, low: int = 30) -> DataFrame:
    """Hours where the truncated RSI first leaves the band between the two levels."""
    live = (R.drop_warmup(rsi(df, key, ts, close), key, ts, 14).where(F.col("RSI") > 1)
            .select(*key, ts, F.col("RSI").cast("int").alias("rsi")))
    w = Window.partitionBy(*key).orderBy(ts)
    marked = live.withColumns({
        "above": R.first_cross(F.col("rsi") > high, w),
        "below": R.first_cross(F.col("rsi") < low, w)})
    return marked.where("above OR below")


def macd_events(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y") -> DataFrame:
    """Hours where MACD first crosses its signal line; the first 26 hours are left out."""
    lines = macd(df, key, ts, close)
    w = R.Blocked(lines, key, ts, back=1)
    w.add(buy=R.first_cross(F.col("MACD") > F.col("MACD_signal"), w.window),
          sell=R.first_cross(F.col("MACD") < F.col("MACD_signal"), w.window))
    marked = R.drop_warmup(w.done(), key, ts, 26).where("buy OR sell")
    return marked.select(*key, ts, F.when(F.col("buy"), "buy").otherwise("sell").alias("signal"))


def bollinger_events(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y",
                     first_only: bool = False) -> DataFrame:
    """Every hour outside the bands, or only the first of each run."""
    base = bollinger(df, key, ts, close)
    above, below = F.col(close) > F.col("bollinger_upper"), F.col(close) < F.col("bollinger_lower")
    if first_only:
        w = R.Blocked(base, key, ts, back=1)
        w.add(_a=R.first_cross(above, w.window), _b=R.first_cross(below, w.window))
        base = w.done()
        above, below = F.col("_a"), F.col("_b")
    tagged = base.withColumn("side", F.when(above, "above").when(below, "below"))
    return (R.drop_warmup(tagged, key, ts, 19).where(F.col("side").isNotNull())
            .select(*key, ts, F.col(close).alias("close_price"),
                    F.when(F.col("side") == "above", F.col("bollinger_upper"))
                    .otherwise(F.col("bollinger_lower")).alias("level"), "side"))


# -- comparisons the dashboard asks for ----------------------------------------------------------

def period_change(df: DataFrame, key: Sequence[str], ts: str = "ds", close: str = "y",
                  hours: int = 24) -> DataFrame:
    """Newest hour: price change vs ``hours`` ago, volume of the last and previous period."""
    w = R.Blocked(df, key, ts, back=2 * hours)
    w.add(price_change=R.past_return(w, close, hours), volume_now=R.rolling(w, "volume", hours))
    w.add(volume_before=F.lag("volume_now", hours).over(w.window))
    w.add(volume_change=F.try_divide(F.col("volume_now"), F.col("volume_before")) - 1)
    cols = (*key, ts, close, "price_change", "volume_now", "volume_before", "volume_change")
    # Only the newest 2 * hours + 1 hours can matter.
    return R.last_rows(w.done().select(*cols), key, ts, 1)


def move_likelihood(df: DataFrame, key: Sequence[str], ts: str, close: str, target_factor: float,
                    horizon: int) -> DataFrame:
    """Move needed to reach ``target_factor`` times the current price vs the usual move."""
    w = R.Blocked(df, key, ts, back=horizon)
    moves = w.add(_move=F.abs(R.past_return(w, close, horizon))).done()
    return moves.groupBy(*key).agg(
        F.avg("_move").alias("mean_move"),
        F.max_by(close, ts).alias("price")).select(
            *key, "price", (F.col("price") * target_factor).alias("target"),
            F.lit(target_factor - 1.0).alias("needed_move"), "mean_move",
            (F.col("mean_move") >= abs(target_factor - 1.0)).alias("within_usual_move"))


def daily_asof(df: DataFrame, key: Sequence[str], ts: str = "ds", hour: int = 16) -> DataFrame:
    """Last row at or before ``hour`` of each day."""
    others = [c for c in df.columns if c not in (*key, ts)]
    ok = df.where(F.hour(ts) <= hour)
    return ok.groupBy(*key, F.to_date(ts).alias("day")).agg(
        F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in others])


def normalise(df: DataFrame, cols: Sequence[str], how: str = "zscore", key: Sequence[str] = (),
              suffix: str = "_norm") -> DataFrame:
    """Population z-score or division by the largest absolute value, per key (or whole table)."""
    aggs = []
    for c in cols:
        aggs += ([F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}")] if how == "zscore"
                 else [F.max(F.abs(c)).alias(f"_s_{c}")])
    joined = df.join(df.groupBy(*key).agg(*aggs), list(key)) if key else with_row(df, df.agg(*aggs))
    new = {}
    for c in cols:
        # A constant column scales to 0, as a scaler with unit scale would give.
        s = F.col(f"_s_{c}")
        centred = F.col(c) - F.col(f"_m_{c}") if how == "zscore" else F.col(c)
        new[c + suffix] = F.when(s == 0, centred).otherwise(F.try_divide(centred, s))
    return joined.withColumns(new).select(*df.columns, *new)
