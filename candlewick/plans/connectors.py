"""Registered queries of sources and sinks: the given tables are written in a source's form, read back
by its reader and compared with SQL over the tables themselves. Also the lookups of later scoring."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as M, timefns as D
from ..operators import dedupe as DD, grid as G, lookback as LB, selection as SE, sentiment as S, stats as ST
from ..session import staged, work_dir
from ..sources import readers as RD, schemas as SC, writers as WR
from ..streaming import streams as STR
from . import oracle as O, tables as T
from .catalogue import CORR, KEY, SELECTED, _FEATS, _features, register, rounded


def folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid4().hex}"


# -- candle files ------------------------------------------------------------------------------------

@register("kline_files", O._with(O.BARS) + "SELECT series_id, ds, open_price, y_upper, y_lower, y, round(volume, 6) AS volume, CAST(num_of_trades AS BIGINT) AS num_of_trades FROM bars")
def kline_files(spark, sf):
    """Header-less candle files in one folder per series, all read under their prefix."""
    b, root = T.bars(spark, sf), folder(spark, "klines")
    ms = F.unix_millis("ds")
    raw = b.select(*KEY, ms.alias("open_time"), "open_price", "y_upper", "y_lower", "y", "volume", (ms + 3_599_999).alias("close"), F.lit(0.0).alias("quote"),
                   "num_of_trades", "taker_buy_base_asset_volume", F.lit(0.0).alias("taker_quote"), F.lit(0).alias("unused"))
    raw.write.partitionBy(*KEY).csv(root, header=False)
    return rounded(RD.read_klines(spark, root).select(*KEY, "ds", "open_price", "y_upper", "y_lower", "y", "volume", "num_of_trades"), ["volume"])


@register("next_days", O._with(O.BARS, "l AS (SELECT series_id, CAST(max(ds) + INTERVAL 1 HOUR AS DATE) AS lo FROM bars GROUP BY 1)") + """
SELECT series_id, CAST(unnest(generate_series(lo, DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day FROM l""")
def next_days(spark, sf):
    return RD.next_days(T.bars(spark, sf), "series_id", "ds", "2024-02-10")


@register("expected_rows", O._with(O.BASE) + """
SELECT series_id, CAST(ds AS DATE) AS day, 24::BIGINT AS n_rows FROM
(SELECT series_id, unnest(generate_series(date_trunc('day', min(ds)), date_trunc('day', max(ds)), INTERVAL 1 DAY)) AS ds FROM dense GROUP BY 1)""")
def expected_rows(spark, sf):
    """Whole days of every series, checked to hold 24 rows each."""
    b = T.bars(spark, sf)
    bounds = b.groupBy(*KEY).agg(D.floor_day(F.min("ds")).alias("lo"), (D.floor_day(F.max("ds")) + F.expr("INTERVAL 23 HOURS")).alias("hi"))
    grid = G.densify(b, KEY, bounds=bounds)
    days = bounds.agg(F.sum(F.datediff("hi", "lo") + 1)).first()[0] or 0
    return G.check_row_count(grid, days).groupBy(*KEY, F.to_date("ds").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


# -- history, versions ----------------------------------------------------------------------------------

BAR_SCHEMA = "series_id string, ds timestamp, y double, volume double, num_of_trades long"


@register("history_appended", O._with(O.BARS) + "SELECT series_id, ds, y, round(volume, 6) AS volume, CAST(num_of_trades AS BIGINT) AS num_of_trades FROM bars")
def history_appended(spark, sf):
    """A CSV history that doesn't exist at first and grows by three loads; an empty load writes nothing."""
    path = folder(spark, "history")
    schema = spark.createDataFrame([], BAR_SCHEMA).schema
    b = staged(T.bars(spark, sf).select(*schema.names), "loads")
    for k in range(3):
        held = RD.read_table(spark, path, schema, "csv")  # empty on the first run
        new = b.where(F.pmod(D.slot("ds"), F.lit(3)) == k).join(held, [*KEY, "ds"], "left_anti")
        WR.write_table(new, path, "csv", "append")
        WR.write_table(new.limit(0), path, "csv", "append")
    return rounded(RD.read_table(spark, path, schema, "csv"), ["volume"])


@register("versioned_table", O._with(O.BARS) + "SELECT series_id, ds, y, round(volume, 6) AS volume FROM bars")
def versioned_table(spark, sf):
    """A table written whole twice: each time a new version, the newest is read."""
    root, b = folder(spark, "versions"), T.bars(spark, sf).select(*KEY, "ds", "y", "volume")
    WR.write_version(b.where("y > 50"), root)
    WR.write_version(b, root)
    path, _ = WR.newest_version(spark, root)
    return rounded(RD.read_table(spark, path), ["volume"])


@register("stream_paced", """
SELECT event_type, date_trunc('hour', ts) AS ds, count(value) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stream_paced(spark, sf):
    """At most four files a batch, a batch every moment until all files are taken."""
    root, e = folder(spark, "paced"), T.table(spark, sf, "events")
    e.repartition(10).write.parquet(f"{root}/in")
    src = STR.stream_files(spark, f"{root}/in", e.schema, files_per_batch=4).withColumn("ts", F.col("ts").cast("timestamp"))
    shape = lambda d: STR.hourly_sums(d, "ts", ["event_type"], "value")
    q = STR.run_stream(src, STR.append_delta(f"{root}/out", shape), f"{root}/log", every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(f"{root}/out").groupBy("event_type", "ds").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return rounded(out, ["total"])


# -- post snapshots ---------------------------------------------------------------------------------------

SNAPSHOT_COLUMNS = ["id", "title", "body", "self_text_md5", "fetch_datetime"]
NAMED_AT = "202402010930"


@register("snapshot_files", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS body_md5, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE md5(text) END AS self_text_md5,
       CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-15 06:00:00' WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-02-01 09:30:00'
            ELSE TIMESTAMP '2024-03-01 00:00:00' END AS fetch_datetime FROM documents""")
def snapshot_files(spark, sf):
    """Two folders of CSV snapshots: one with stamps (some unreadable), one without, whose file names may hold it."""
    root, d = folder(spark, "snapshots"), F.col("doc_id")
    stamp = F.when(d % 9 == 0, "soon").when(d % 3 == 0, "2024-01-15 06:00:00")
    docs = T.documents(spark, sf).select(d.cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("body"),
                                         F.when(d % 2 == 0, "kept").alias("self_text_md5"), stamp.alias("fetch_datetime"), (d % 3).alias("part"))
    for part, place in ((0, "combined"), (1, "new/named"), (2, "new/plain")):
        WR.write_table(docs.where(F.col("part") == part).drop("part"), f"{root}/{place}", "csv")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath() for s in system.listStatus(path(f"{root}/new/named")) if s.getPath().getName().endswith(".csv")]
    for k, f in enumerate(files):  # as the fetcher names them
        system.rename(f, path(f"{root}/new/posts{k}_{NAMED_AT}.csv"))
    schema = SC.T.StructType([SC.POSTS_RAW[c] for c in SNAPSHOT_COLUMNS])
    both = RD.read_snapshots(spark, [f"{root}/combined", f"{root}/new", f"{root}/new/plain"], "2024-03-01 00:00:00", schema)
    return both.select("id", F.md5("body").alias("body_md5"), "self_text_md5", "fetch_datetime")


# -- scoring what is new --------------------------------------------------------------------------------------

def length_model():
    """A deterministic stand-in for an external text model: scores by the share of capital letters."""
    def score(texts: pd.Series) -> list:
        upper = texts.str.count("[A-Z]") / texts.str.len()
        return [(["loud", "calm"], [float(u), float(1 - u)]) for u in upper]
    return score


@register("model_scores", O._with(O.CLEAN) + """
SELECT id, round(length(regexp_replace(clean_text, '[^A-Z]', '', 'g')) / length(clean_text) + 1e-9, 6) AS loud FROM cleaned WHERE clean_text <> ''""")
def model_scores(spark, sf):
    """The hook for external models, run with a deterministic one."""
    p = T.with_text(T.posts(spark, sf)).select("id", "clean_text")
    s = S.scores_to_columns(S.score_text_with_model(p, "clean_text", length_model, "m_"), "m_labels", "m_scores", ["loud"], "")
    return rounded(s.where(F.col("loud").isNotNull()).select("id", (F.col("loud") + 1e-9).alias("loud")), ["loud"])


@register("score_only_new", O._with(O.SCORED, O.MEMO) + """
SELECT s.id, round(CASE WHEN m.id IS NOT NULL AND m.self_text_md5 = s.self_text_md5 THEN 0.25 ELSE s.sentiment_positive END, 6) AS s_positive FROM scored s LEFT JOIN memo m ON m.id = s.id""")
def score_only_new(spark, sf):
    """Texts that the memo knows unchanged keep its scores; only the others reach the scorer."""
    memo = T.relevance_memo(spark, sf).select("id", "self_text_md5").withColumns({
        "his_sentiment_labels": F.array(*[F.lit(l) for l in T.SENTIMENT.labels]), "his_sentiment_scores": F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))})
    names = ["sentiment_labels", "sentiment_scores"]
    done, todo = DD.reuse_scores(T.posts(spark, sf).select("id", "self_text_md5", "title", "body"), memo, names)
    fresh = S.score_text(T.with_text(todo.drop(*names)), "clean_text", T.SENTIMENT)
    both = done.select("id", *names).unionByName(fresh.select("id", *names))
    return rounded(S.scores_to_columns(both, *names, ["positive"], "s_").select("id", "s_positive"), ["s_positive"])


@register("scored_table_upsert", O._with(O.SCORED) + """
SELECT id, self_text_md5, created_at AS fetch_datetime, round(sentiment_positive, 6) AS s_positive, 3 AS n_scores FROM scored WHERE sentiment_positive IS NOT NULL""")
def scored_table_upsert(spark, sf):
    """The scored table with its nested scores: missing at first, then written, then upserted by a newer load."""
    root = folder(spark, "scored")
    s = T.scored(spark, sf).select("id", "self_text_md5", F.col("created_at").alias("fetch_datetime"), F.col("sentiment_labels").alias("his_sentiment_labels"),
                                   F.col("sentiment_scores").alias("his_sentiment_scores"))
    s = staged(s, "scored").dropna(subset=["his_sentiment_scores"])  # before the write the test would repeat the scoring
    schema = SC.T.StructType([SC.SCORE_MEMO[c] for c in s.columns])
    old = s.where("CAST(id AS LONG) % 2 = 0").withColumns({"fetch_datetime": F.col("fetch_datetime") - F.expr("INTERVAL 1 DAY"), "self_text_md5": F.lit("old")})
    for load in (old, s):
        path, _ = WR.newest_version(spark, root)
        WR.write_version(DD.upsert(RD.read_table(spark, path or root, schema), load, require=["his_sentiment_scores"]), root)
    out = RD.read_table(spark, WR.newest_version(spark, root)[0], schema)
    wide = S.scores_to_columns(out, "his_sentiment_labels", "his_sentiment_scores", ["positive"], "s_")
    return rounded(wide.select("id", "self_text_md5", "fetch_datetime", "s_positive", F.size("his_sentiment_scores").alias("n_scores")), ["s_positive"])


_LEARNED = f"""
lab AS (SELECT t.*, l.quality FROM tokenized t JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)),
words AS (SELECT unnest(words) AS token, quality FROM lab),
counts AS (SELECT token, sum(quality)::BIGINT AS n_1, (count(*) - sum(quality))::BIGINT AS n_0 FROM words GROUP BY 1),
totals AS (SELECT sum(n_1) AS t_1, sum(n_0) AS t_0 FROM counts),
learned AS (SELECT token, n_1, n_0, ln((n_1 + b) / (t_1 + 10 - n_1 - b)) - ln((n_0 + b) / (t_0 + 10 - n_0 - b)) AS weight
            FROM (SELECT *, 10.0::DOUBLE * (n_1 + n_0) / (t_1 + t_0) AS b FROM counts, totals))"""


def _clean_documents(spark, sf):
    return T.with_text(T.posts(spark, sf)).select("id", "clean_text")


def _learned(spark, sf):
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    # Joined first: only labelled texts are cleaned.
    posts = T.posts(spark, sf).select("id", "title", "body").join(labels, "id")
    return S.learn_weights(T.with_text(posts), "clean_text", "quality")


@register("learned_weights", O._with(O.CLEAN, O.TOKENS.strip().lstrip(","), _LEARNED) + "SELECT token, n_1, n_0, round(weight, 6) AS weight FROM learned")
def learned_weights(spark, sf):
    """Token weights for quality, learned from the labels."""
    return rounded(_learned(spark, sf), ["weight"])


@register("learned_scores", O._with(O.CLEAN, O.TOKENS.strip().lstrip(","), _LEARNED, """
hits AS (SELECT t.id, w.weight FROM (SELECT id, unnest(words) AS token FROM tokenized) t LEFT JOIN learned w USING (token))""") + """
SELECT t.id, len(t.words)::BIGINT AS n_tokens, round(1 / (1 + exp(-coalesce(h.s / len(t.words), 0))), 6) AS score FROM tokenized t
LEFT JOIN (SELECT id, sum(coalesce(weight, 0)) AS s FROM hits GROUP BY 1) h USING (id)""")
def learned_scores(spark, sf):
    """Every document scored with the learned weights."""
    weights = staged(_learned(spark, sf), "weights")
    return rounded(S.score_with_weights(_clean_documents(spark, sf), "id", "clean_text", weights).select("id", "n_tokens", "score"), ["score"])


# -- comparisons and sets -----------------------------------------------------------------------------------------

@register("sentiment_change", O._with(O.SCORED, O.GRID) + f"""
SELECT a.ds, {', '.join(f'round(a.{c}, 6) AS {c}_now, round(b.{c}, 6) AS {c}_before, round(a.{c} - b.{c}, 6) AS {c}_change' for c in O.SENTI_COLS)}
FROM sgrid a LEFT JOIN sgrid b ON b.ds = a.ds - INTERVAL 24 HOUR WHERE a.ds = (SELECT max(ds) FROM sgrid)""")
def sentiment_change(spark, sf):
    """Sentiment of the newest hour against 24 hours before."""
    g = staged(T.sentiment_grid(spark, sf), "grid")
    now = g.join(g.agg(F.max("ds").alias("ds")), "ds")
    before = g.select((F.col("ds") + F.expr("INTERVAL 24 HOURS")).alias("ds"), *[F.col(c).alias(f"{c}_before") for c in O.SENTI_COLS])
    out = now.join(before, "ds", "left")
    cols = [x for c in O.SENTI_COLS for x in (F.col(c).alias(f"{c}_now"), F.col(f"{c}_before"), (F.col(c) - F.col(f"{c}_before")).alias(f"{c}_change"))]
    out = out.select("ds", *cols)
    return rounded(out, out.columns[1:])


@register("corr_by_strength", O._with(O.BARS) + "SELECT *, row_number() OVER (ORDER BY abs(correl) DESC, field)::INTEGER AS place FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS field, round(corr({a}, y), 6) AS correl FROM bars" for a in CORR[1:]) + ")")
def corr_by_strength(spark, sf):
    """Correlations sorted by absolute value."""
    c = rounded(ST.corr_to(T.bars(spark, sf), "y", CORR[1:]), ["correl"])
    return ST.by_strength(c, "correl", "field")


@register("feature_sets", _FEATS + "SELECT * FROM (WITH one AS (SELECT feature FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_pop({c}) AS v FROM feats" for c in SELECTED) + ") WHERE v > 100.0), two AS (SELECT feature FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM feats" for c in SELECTED) + """) WHERE abs(r) > 0.1)
SELECT 'either' AS part, feature FROM (SELECT * FROM one UNION SELECT * FROM two) UNION ALL SELECT 'both', feature FROM (SELECT * FROM one INTERSECT SELECT * FROM two)
UNION ALL SELECT 'first only', feature FROM (SELECT * FROM one EXCEPT SELECT * FROM two) UNION ALL SELECT 'second only', feature FROM (SELECT * FROM two EXCEPT SELECT * FROM one))""")
def feature_sets(spark, sf):
    """Features that variance and correlation choose: together, in both, in one alone."""
    f = staged(_features(spark, sf), "features")
    one = SE.select_by_variance(f, SELECTED, 100.0).select("feature")
    two = ST.corr_to(f, "y", SELECTED, 0.1).select(F.col("field").alias("feature"))
    return SE.compared_sets(one, two)


@register("constant_class", O._with(O.BASE, f"""
c AS (SELECT series_id, CASE WHEN lead(y, 24) {O.W} / y - 1 > 0.005 THEN 1 WHEN lead(y, 24) {O.W} / y - 1 < -0.005 THEN -1 ELSE 0 END AS a FROM dense),
n AS (SELECT series_id, a, count(*) AS n FROM c GROUP BY 1, 2)""") + """
SELECT series_id, arg_max(a, n * 10 - a)::INTEGER AS label, sum(n)::BIGINT AS n, round(max(n) / sum(n), 6) AS accuracy FROM n GROUP BY 1""")
def constant_class(spark, sf):
    """The most frequent direction of each series as its only forecast."""
    from ..operators import metrics as ME, rolling as R
    w = R.Blocked(T.dense_bars(spark, sf).select(*KEY, "ds", "y"), KEY, "ds", ahead=24)
    w.add(a=M.signal_label(R.forward_return(w, "y", 24)))
    return rounded(ME.constant_class(w.done(), "a", KEY), ["accuracy"])


# -- densities at plotting resolution ------------------------------------------------------------------------------

@register("kde_binned", """
WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 511 AS step FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_extendedprice) * power(count(*), -0.2) AS h FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, (l_extendedprice - lo) / step AS u, least(floor((l_extendedprice - lo) / step), 511)::INTEGER AS i FROM lineitem, e),
w AS (SELECT l_returnflag, i, sum(w) AS w FROM (SELECT l_returnflag, i, 1 - (u - i) AS w FROM c UNION ALL SELECT l_returnflag, i + 1, u - i FROM c) GROUP BY 1, 2),
g AS (SELECT l_returnflag, n, h, lo, step, unnest(generate_series(0, 511))::INTEGER AS point FROM s, e)
SELECT g.l_returnflag, point, round(any_value(lo + step * point), 4) AS x,
       round(1e6 * coalesce(sum(w * exp(-0.5 * power((point - i) * step / h, 2))) FILTER (abs(point - i) <= ceil(6 * h / step)), 0) / any_value(n * h * sqrt(2 * pi())), 6) AS density
FROM g JOIN w ON g.l_returnflag = w.l_returnflag GROUP BY 1, 2""")
def kde_binned(spark, sf):
    out = ST.kde_binned(T.table(spark, sf, "lineitem"), "l_extendedprice", 512, "l_returnflag")
    return rounded(rounded(out.withColumn("density", F.col("density") * 1e6), ["density"]), ["x"], 4)


@register("kde_2d_binned", """
WITH s AS (SELECT count(*) AS n, min(l_quantity) AS alo, (max(l_quantity) - min(l_quantity)) / 63 AS sa, min(l_extendedprice) AS blo, (max(l_extendedprice) - min(l_extendedprice)) / 63 AS sb,
  var_samp(l_quantity) * power(count(*), -1/3.0) AS vaa, var_samp(l_extendedprice) * power(count(*), -1/3.0) AS vbb, covar_samp(l_quantity, l_extendedprice) * power(count(*), -1/3.0) AS vab FROM lineitem),
u AS (SELECT (l_quantity - alo) / sa AS x, (l_extendedprice - blo) / sb AS y FROM lineitem, s),
c AS (SELECT least(floor(x), 63)::INTEGER AS i, least(floor(y), 63)::INTEGER AS j, x - least(floor(x), 63) AS p, y - least(floor(y), 63) AS q FROM u),
w AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, (1 - p) * (1 - q) AS w FROM c UNION ALL SELECT i + 1, j, p * (1 - q) FROM c UNION ALL SELECT i, j + 1, (1 - p) * q FROM c
  UNION ALL SELECT i + 1, j + 1, p * q FROM c) GROUP BY 1, 2),
g AS (SELECT ia::INTEGER AS ia, ib::INTEGER AS ib FROM (SELECT unnest(generate_series(0, 63)) AS ia), (SELECT unnest(generate_series(0, 63)) AS ib)),
k AS (SELECT ia, ib, sum(w * exp(-0.5 * (vbb * power((i - ia) * sa, 2) - 2 * vab * (i - ia) * sa * (j - ib) * sb + vaa * power((j - ib) * sb, 2)) / (vaa * vbb - vab * vab))) AS k
  FROM g, s JOIN w ON TRUE WHERE abs(i - ia) <= ceil(6 * sqrt(vaa) / sa) AND abs(j - ib) <= ceil(6 * sqrt(vbb) / sb) GROUP BY 1, 2)
SELECT ia, ib, round(1e6 * coalesce(k, 0) / (n * 2 * pi() * sqrt(vaa * vbb - vab * vab)), 5) AS density FROM g CROSS JOIN s LEFT JOIN k USING (ia, ib)""")
def kde_2d_binned(spark, sf):
    out = ST.kde_2d_binned(T.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 64)
    return rounded(out.withColumn("density", F.col("density") * 1e6), ["density"], 5)


# -- look-back with the squared quantile in the weights --------------------------------------------------------------

_WEIGHED = "(1 + (p.score > q[1])::INT + (p.score > q[2])::INT + (p.score > q[3])::INT + (p.score > q[4])::INT)"


def _lookback_weighed_sql(windows, cols, weight: str) -> str:
    """The range join of ``O.lookback_sql`` with another weight."""
    edges = "\nquantiles AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM posts),\nends AS ("
    sql = O.lookback_sql(windows, cols).replace("p.relevancy_score * ln(p.num_comments + 1) AS wt", f"{weight} AS wt")
    return sql.replace("\nends AS (", edges).replace(f"INTERVAL {max(windows)} HOUR),", f"INTERVAL {max(windows)} HOUR, quantiles),")


def _weighed_posts(spark, sf):
    p = T.sentiment_posts(spark, sf)
    return staged(ST.quantile_bucket(p, "score"), "weighed")


@register("lookback_panel_weighed", _lookback_weighed_sql(LB.WINDOWS, ["sentiment_positive"], f"power({_WEIGHED}, 2) * p.relevancy_score * ln(p.num_comments + 1)"))
def lookback_panel_weighed(spark, sf):
    bars = T.bars(spark, sf).select(*KEY, "ds", F.col("y").alias("close_price"))
    w = M.post_weight("score_quantile", "relevancy_score", "num_comments")
    out = LB.lookback_panel(bars, _weighed_posts(spark, sf), ["sentiment_positive"], weight=w)
    return rounded(out, [c for c in out.columns if "_w" in c])


@register("lookback_two_weeks_weighed", _lookback_weighed_sql((336,), ["sentiment_positive"], f"power({_WEIGHED}, 2)").replace(
    "SELECT b.series_id, b.y AS close_price, a.*",
    "SELECT b.series_id, a.ds, b.y AS close_price, a.sentiment_positive_rolling_w336, a.sentiment_positive_rolling_wgt_w336"))
def lookback_two_weeks_weighed(spark, sf):
    bars = T.bars(spark, sf).select(*KEY, "ds", F.col("y").alias("close_price"))
    out = LB.lookback_panel(bars, _weighed_posts(spark, sf), ["sentiment_positive"], (336,), weight=M.post_weight("score_quantile"), weighted_only=True)
    return rounded(out, [c for c in out.columns if "_w" in c])
