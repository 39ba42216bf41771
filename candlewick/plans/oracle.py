"""The registered queries as plain SQL over the given tables."""

from __future__ import annotations

from ..functions.textfns import RELEVANCE_WORDS
from ..operators.indicators import HORIZONS
from .tables import EMOTION, SENTIMENT


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BARS = """
bars AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ds,
         first(value ORDER BY ts, event_id) AS open_price, max(value) AS y_upper, min(value) AS y_lower,
         last(value ORDER BY ts, event_id) AS y, sum(value) AS volume, count(*) AS num_of_trades,
         sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS taker_buy_base_asset_volume
  FROM events GROUP BY ALL)"""

DENSE = """
hours AS (
  SELECT series_id, unnest(generate_series(min(ds), max(ds), INTERVAL 1 HOUR)) AS ds FROM bars GROUP BY series_id),
raw_dense AS (
  SELECT h.series_id, h.ds, b.open_price, b.y_upper, b.y_lower, b.y AS own_y,
         last_value(b.y IGNORE NULLS) OVER (PARTITION BY h.series_id ORDER BY h.ds) AS y,
         coalesce(b.volume, 0) AS volume, coalesce(b.num_of_trades, 0) AS num_of_trades,
         coalesce(b.taker_buy_base_asset_volume, 0) AS taker_buy_base_asset_volume
  FROM hours h LEFT JOIN bars b USING (series_id, ds)),
dense AS (
  SELECT series_id, ds, coalesce(open_price, y) AS open_price, coalesce(y_upper, y) AS y_upper,
         coalesce(y_lower, y) AS y_lower, y, volume, num_of_trades, taker_buy_base_asset_volume,
         row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS rn
  FROM raw_dense)"""

BASE = BARS + "," + DENSE

BAR_COLS = """series_id, ds, open_price, y_upper, y_lower, y, round(volume, 6) AS volume,
       CAST(num_of_trades AS BIGINT) AS num_of_trades,
       round(taker_buy_base_asset_volume, 6) AS taker_buy_base_asset_volume"""

POSTS = """
posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS body,
         CAST(1704067200 + (doc_id % 720) * 3600 + (doc_id * 37) % 3600 AS DOUBLE) AS created,
         make_timestamp((1704067200 + (doc_id % 720) * 3600 + (doc_id * 37) % 3600) * 1000000) AS created_at,
         ((doc_id * 31) % 101) / 100.0 AS upvote_ratio, (doc_id * 17) % 500 AS score,
         (doc_id * 7) % 90 AS num_comments, 'u' || CAST(doc_id % 50 AS VARCHAR) AS author,
         CASE WHEN source = 'src7' THEN 'scam' ELSE source END AS link_flair_text,
         ((doc_id * 13) % 100) / 100.0 AS relevancy_score, md5(text) AS self_text_md5,
         '/r/' || CAST(doc_id AS VARCHAR) AS permalink, doc_id
  FROM documents)"""

CLEAN_EXPR = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title || ' ' || body, "
    "'\\n+', ' ', 'g'), '\\t+', ' ', 'g'), 'http\\S+', ' ', 'g'), '[^a-zA-Z0-9 @#.,:_%$°|?]', ' ', 'g'))")

CLEAN = POSTS + f""",
cleaned AS (SELECT *, {CLEAN_EXPR} AS clean_text FROM posts)"""


def _logit(scorer, label: str) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {v}" for w, v in scorer.weights[label].items())
    return (f"coalesce(list_sum(list_transform(words, lambda t: CASE t {cases} ELSE 0.0 END)), 0.0) "
            f"/ greatest(len(words), 1) * {scorer.scale} + {float(scorer.bias.get(label, 0.0))}")


def _scores(scorer, prefix: str, src: str, out: str) -> str:
    ls = scorer.labels
    logits = ", ".join(f"{_logit(scorer, l)} AS z_{l}" for l in ls)
    top = "greatest(" + ", ".join(f"z_{l}" for l in ls) + ")"
    exps = ", ".join(f"exp(z_{l} - {top}) AS e_{l}" for l in ls)
    total = " + ".join(f"e_{l}" for l in ls)
    finals = ", ".join(f"CASE WHEN clean_text <> '' THEN e_{l} / ({total}) END AS {prefix}{l}" for l in ls)
    drop = ", ".join([f"z_{l}" for l in ls] + [f"e_{l}" for l in ls])
    return f"""
{out} AS (
  SELECT * EXCLUDE ({drop}), {finals} FROM (
    SELECT *, {exps} FROM (SELECT *, {logits} FROM {src})))"""


TOKENS = """
tokenized AS (SELECT *, list_filter(string_split_regex(lower(clean_text), '\\s+'), lambda t: t <> '') AS words FROM cleaned)"""

SCORED = (CLEAN + "," + TOKENS + "," + _scores(SENTIMENT, "sentiment_", "tokenized", "senti")
          + "," + _scores(EMOTION, "emotion_", "senti", "scored"))

SNAPSHOTS = """
snapshots AS (
  SELECT CAST(user_id AS VARCHAR) AS id, event_id, event_type, value, md5(props) AS self_text_md5,
         CASE WHEN value >= 1.0 THEN ts END AS fetch_datetime FROM events)"""

MEMO = """
memo AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, md5(CASE WHEN toxic = 1 THEN text || ' old' ELSE text END) AS self_text_md5,
         quality = 1 AS is_relevant, make_timestamp((1704067200 + doc_id * 900) * 1000000 + 500000) AS fetch_datetime
  FROM documents JOIN labels USING (doc_id))"""


# -- recursive averages ---------------------------------------------------------------------------

def ewm(col: str, alpha: float, need: int, src: str, part: str = "series_id", order: str = "ds") -> str:
    """Recursive average as a list fold; ``src`` rows must be dense and non-null."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return (f"CASE WHEN count({col}) {w} >= {need} THEN "
            f"list_reduce(list({col}) {w}, lambda a, b: a * (1.0::DOUBLE - {alpha!r}::DOUBLE) + b * {alpha!r}::DOUBLE) END")


W = "OVER (PARTITION BY series_id ORDER BY ds)"


def framed(fn: str, col: str, n: int) -> str:
    f = f"OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {f} >= {n} THEN {fn}({col}) {f} END"


MOVES = f"""
moves AS (
  SELECT *, greatest(coalesce(y - lag(y) {W}, 0.0), 0.0) AS gain, greatest(coalesce(lag(y) {W} - y, 0.0), 0.0) AS loss
  FROM dense)"""

RSI = MOVES + f""",
averaged AS (SELECT *, {ewm('gain', 1 / 14, 14, 'moves')} AS ag, {ewm('loss', 1 / 14, 14, 'moves')} AS al FROM moves),
rsi AS (SELECT *, CASE WHEN al = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS RSI FROM averaged)"""

MACD = f"""
lines AS (SELECT series_id, ds, rn, {ewm('y', 2 / 13, 12, 'dense')} - {ewm('y', 2 / 27, 26, 'dense')} AS MACD FROM dense),
signals AS (SELECT series_id, ds, {ewm('MACD', 2 / 10, 9, 'lines')} AS MACD_signal FROM lines WHERE MACD IS NOT NULL),
macd AS (SELECT l.*, s.MACD_signal, l.MACD - s.MACD_signal AS MACD_diff FROM lines l LEFT JOIN signals s USING (series_id, ds))"""

FLOW = f"""
typical AS (SELECT *, (y_upper + y_lower + y) / 3 AS typical_price, (y_upper + y_lower + y) / 3 * volume AS raw_money_flow FROM dense),
split AS (
  SELECT *, CASE WHEN typical_price > lag(typical_price) {W} THEN raw_money_flow ELSE 0 END AS positive_money_flow,
         CASE WHEN typical_price < lag(typical_price) {W} THEN raw_money_flow ELSE 0 END AS negative_money_flow FROM typical),
summed AS (SELECT *, {framed('sum', 'positive_money_flow', 14)} AS p14, {framed('sum', 'negative_money_flow', 14)} AS n14 FROM split),
flow AS (
  SELECT *, CASE WHEN n14 = 0 AND p14 > 0 THEN 100.0 WHEN n14 = 0 THEN NULL
                 ELSE 100.0 - 100.0 / (1.0 + p14 / n14) END AS MFI FROM summed)"""

BANDS = f"""
bands AS (
  SELECT *, {framed('avg', 'y', 20)} + 2 * {framed('stddev_samp', 'y', 20)} AS bollinger_upper,
         {framed('avg', 'y', 20)} - 2 * {framed('stddev_samp', 'y', 20)} AS bollinger_lower FROM dense)"""


def r(*cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


SENTI_COLS = ("sentiment_positive", "sentiment_negative", "sentiment_neutral")

HOURLY = """
hourly AS (
  SELECT date_trunc('hour', created_at) AS ds, avg(sentiment_positive) AS sentiment_positive,
         avg(sentiment_negative) AS sentiment_negative, avg(sentiment_neutral) AS sentiment_neutral,
         count(*) AS post_count_by_hour
  FROM scored WHERE upvote_ratio > 0.7 GROUP BY 1)"""


def _interp(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN n_{c} IS NOT NULL AND p_{c} IS NOT NULL THEN
      p_{c} + (n_{c} - p_{c}) * (epoch_us(ds) - pt_{c})::DOUBLE / (nt_{c} - pt_{c})::DOUBLE ELSE p_{c} END AS {c}"""


def interpolated(src: str, cols, out: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    near = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({p} ORDER BY ds) AS p_{c}, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ds) END IGNORE NULLS) OVER ({p} ORDER BY ds) AS pt_{c}, "
        f"first_value({c} IGNORE NULLS) OVER ({p} ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c}, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ds) END IGNORE NULLS) OVER ({p} ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt_{c}"
        for c in cols)
    keep = f"{part}, ds" if part else "ds"
    return f"""
{out} AS (SELECT {keep}, {', '.join(_interp(c) for c in cols)} FROM (SELECT *, {near} FROM {src}))"""


GRID = HOURLY + """,
edges AS (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events),
slots AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds FROM edges),
reindexed AS (
  SELECT s.ds, h.sentiment_positive, h.sentiment_negative, h.sentiment_neutral,
         CAST(CASE WHEN h.ds IS NOT NULL THEN h.post_count_by_hour
                   WHEN s.ds BETWEEN (SELECT min(ds) FROM hourly) AND (SELECT max(ds) FROM hourly) THEN 0 END AS DOUBLE) AS post_count_by_hour
  FROM slots s LEFT JOIN hourly h ON s.ds = h.ds),""" + interpolated(
    "reindexed", (*SENTI_COLS, "post_count_by_hour"), "sgrid")


def _features() -> str:
    parts = []
    for n in ("positive", "negative", "neutral"):
        c = f"sentiment_{n}"
        f72 = "OVER (ORDER BY ds ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)"
        f120 = "OVER (ORDER BY ds ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
        total = sum(0.5 ** ((120 - l) / 120) for l in range(120))
        parts.append(f"{c} - lag({c}) OVER (ORDER BY ds) AS {c}_momentum")
        parts.append(f"CASE WHEN count({c}) {f72} >= 72 THEN stddev_samp({c}) {f72} END AS {c}_volatility")
        # list positions run from the oldest of the 120 values (lag 119) to the newest (lag 0)
        parts.append(f"CASE WHEN count({c}) {f120} = 120 THEN list_sum(list_transform(list({c}) {f120}, "
                     f"lambda v, i: v * power(0.5, (120 - (120 - i)) / 120.0))) / {total!r}::DOUBLE END AS tw_avg_{n}")
        parts += [f"lag({c}, {k}) OVER (ORDER BY ds) AS {c}_lag_{k}hr" for k in range(1, 8)]
    return ", ".join(parts)


FEATURE_COLS = [x for n in ("positive", "negative", "neutral") for x in (
    [f"sentiment_{n}_momentum", f"sentiment_{n}_volatility", f"tw_avg_{n}"]
    + [f"sentiment_{n}_lag_{k}hr" for k in range(1, 8)])]
ALL_FEATURE_COLS = [*SENTI_COLS, "post_count_by_hour", *FEATURE_COLS]


def filled(src: str, cols, out: str) -> str:
    one = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY ds) AS {c}" for c in cols)
    two = ", ".join(f"first_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in cols)
    return f"""
{out} AS (SELECT ds, {two} FROM (SELECT ds, {one} FROM {src}))"""


FEATURES = f"""
sfeat AS (SELECT *, {_features()} FROM sgrid),""" + filled("sfeat", ALL_FEATURE_COLS, "sfull")


def relevance(col: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w.lower().replace("'", "''")}')" for w in RELEVANCE_WORDS) + ")"


def panel_sql() -> str:
    cols = []
    for k in HORIZONS:
        cols += [f"round(y / lag(y, {k}) {W} - 1, 6) AS ret_past_{k}_h",
                 f"round(lead(y, {k}) {W} / y - 1, 6) AS ret_fwd_{k}_h",
                 f"round({framed('sum', 'volume', k)}, 4) AS vol_{k}_h",
                 f"round({framed('sum', 'taker_buy_base_asset_volume', k)}, 4) AS volBuy_{k}_h",
                 f"round({framed('sum', 'sell_volume', k)}, 4) AS volSell_{k}_h",
                 f"CAST({framed('sum', 'num_of_trades', k)} AS BIGINT) AS trdCnt_{k}_h",
                 f"round({framed('stddev_samp', 'ret', k)}, 6) AS volatility_{k}_h"]
    return _with(BASE, f"rets AS (SELECT *, volume - taker_buy_base_asset_volume AS sell_volume, y / lag(y) {W} - 1 AS ret FROM dense)",
                 ) + f"SELECT series_id, ds, y AS close_price, {', '.join(cols)} FROM rets"


def ewm_std_sql(spans) -> str:
    """Weighted sums over the whole past, straight from the definition."""
    cols = []
    for k in spans:
        q = 1.0 - 2.0 / (k + 1.0)
        if q <= 0:
            cols.append(f"CAST(NULL AS DOUBLE) AS volatilityEMA_{k}_h")
            continue
        sw, sww, sx, sxx = (f"list_sum(list_transform(l, lambda v, i: power({q!r}, ({p} * (n - i))) * {e}))" for p, e in
                            ((1, "1.0"), (2, "1.0"), (1, "v"), (1, "v * v")))
        cols.append(f"CASE WHEN ret IS NOT NULL AND n >= 2 THEN round(sqrt(greatest({sxx} / {sw} - power({sx} / {sw}, 2), 0) "
                    f"* {sw} * {sw} / ({sw} * {sw} - {sww})), 6) END AS volatilityEMA_{k}_h")
    return _with(BASE, f"rets AS (SELECT *, y / lag(y) {W} - 1 AS ret FROM dense)",
                 f"hist AS (SELECT series_id, ds, ret, list(ret) FILTER (ret IS NOT NULL) OVER (PARTITION BY series_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS l FROM rets)",
                 "sized AS (SELECT *, len(l) AS n FROM hist)",
                 ) + f"SELECT series_id, ds, {', '.join(cols)} FROM sized"


def lookback_sql(windows, cols) -> str:
    """Per bar end and post: the range join written out."""
    outs, near = [], []
    for w in windows:
        p = f"age <= {w}"
        n = f"count(*) FILTER ({p})"
        sw = f"sum(wt) FILTER ({p})"
        outs.append(f"round({n} / {float(w)}, 6) AS senti_sub_freq_w{w}")
        for c in cols:
            outs += [f"round(avg({c}) FILTER ({p}), 6) AS {c}_rolling_w{w}",
                     f"round(sum(wt * {c}) FILTER ({p}) / nullif({sw}, 0), 6) AS {c}_rolling_wgt_w{w}",
                     f"round(sum(dk * {c}) FILTER ({p}) / nullif({n}, 0), 6) AS {c}_rolling_timeDecay_w{w}",
                     f"round(sum(wt * dk * {c}) FILTER ({p}) / nullif({sw}, 0), 6) AS {c}_rolling_wgt_timeDecay_w{w}"]
    far = max(windows)
    return _with(BARS, SCORED, f"""
ends AS (SELECT DISTINCT ds FROM bars WHERE ds >= (SELECT date_trunc('hour', min(created_at)) FROM scored)),
pairs AS (
  SELECT e.ds, (epoch_us(e.ds) - epoch_us(p.created_at)) / 3600000000.0 AS age, p.*,
         power(0.5, (epoch_us(e.ds) - epoch_us(p.created_at)) / 3600000000.0 / 24) AS dk,
         p.relevancy_score * ln(p.num_comments + 1) AS wt
  FROM ends e LEFT JOIN scored p ON p.created_at < e.ds AND p.created_at >= e.ds - INTERVAL {far} HOUR),
agg AS (SELECT ds, {', '.join(outs)} FROM pairs GROUP BY ds)""") + """SELECT b.series_id, b.y AS close_price, a.* FROM bars b JOIN agg a USING (ds)"""
