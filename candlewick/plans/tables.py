"""Logical tables (bars, posts, memos, scores) derived from the given Parquet tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import textfns as X, timefns as D
from ..operators import grid as G, sentiment as S

KEY = ["series_id"]

# Stand-in word weights for the invented prose of the test documents, which holds no real
# sentiment words: frequent function words of its four languages. All are multiples of 1/8, so
# their sums are exact in any order and equal scores stay equal.
SENTIMENT_WORDS = {
    "negative": {"of": 1.0, "der": 1.5, "que": 1.0, "was": 2.0, "les": 1.25, "from": 1.5},
    "neutral": {"to": 1.0, "in": 0.75, "en": 0.875, "und": 1.25, "is": 0.75},
    "positive": {"the": 0.625, "and": 0.875, "la": 1.125, "die": 1.375, "le": 1.25, "with": 1.75},
}
EMOTION_WORDS = {
    "fear": {"of": 0.75, "der": 0.875, "by": 1.125},
    "joy": {"the": 0.375, "la": 0.875, "und": 1.0},
    "neutral": {"to": 0.75, "in": 0.625, "de": 0.5},
}
SENTIMENT = S.LexiconScorer(SENTIMENT_WORDS, {"neutral": 0.1})
EMOTION = S.LexiconScorer(EMOTION_WORDS, {"neutral": 0.2})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_between(spark: SparkSession, sf: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Events with ``since <= ts < until``. The bounds meet the column as it is stored, so they reach the scan."""
    e = table(spark, sf, "events")
    kind = e.schema["ts"].dataType
    for bound, keep in ((since, lambda b: F.col("ts") >= b), (until, lambda b: F.col("ts") < b)):
        if bound is not None:
            e = e.where(keep(F.lit(bound).cast(kind)))
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(spark: SparkSession, sf: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Hourly candles; with whole-hour bounds only the hours between them are read."""
    e = events_between(spark, sf, since, until).withColumnRenamed("event_type", "series_id")
    # Time inside the hour, then event id, packed in one decimal: a primitive sort key.
    order = F.expr("CAST(CAST(unix_micros(ts) % 3600000000 AS DECIMAL(10,0)) * 10000000000000000000BD "
                   "+ CAST(event_id AS DECIMAL(19,0)) AS DECIMAL(38,0))")
    return G.candles(e, KEY, D.floor_hour("ts"), order, "value", F.col("user_id") % 2 == 0)


def dense_bars(spark: SparkSession, sf: str) -> DataFrame:
    return G.fill_bar_gaps(bars(spark, sf), KEY)


def dense_between(spark: SparkSession, sf: str, since: datetime, until: datetime | None = None) -> DataFrame:
    """The rows of ``dense_bars`` with ``since <= ds < until``, without building the others.

    A gap at an edge is filled from the last bar before ``since`` and up to the first one from
    ``until`` on. Where those lie follows from one light scan each (series and time only), and the
    candles are read between them.
    """
    def edge(e: DataFrame, pick) -> datetime | None:
        found = e.groupBy("event_type").agg(pick("ts").alias("t"))
        return found.agg((F.min if pick is F.max else F.max)("t").alias("t")).select(D.floor_hour("t").alias("t")).first()["t"]
    first = edge(events_between(spark, sf, None, since), F.max) or since
    last = edge(events_between(spark, sf, until), F.min) if until else None
    last = last + timedelta(hours=1) if last else None
    dense = G.fill_bar_gaps(bars(spark, sf, first, last), KEY).where(F.col("ds") >= F.lit(since))
    return dense.where(F.col("ds") < F.lit(until)) if until else dense


def latest_dense(spark: SparkSession, sf: str, hours: int) -> DataFrame:
    """The last ``hours`` hours of every series of ``dense_bars``, read from the first of them on."""
    newest = events(spark, sf).groupBy("event_type").agg(F.max("ts").alias("t"))
    since = newest.agg(D.floor_hour(F.min("t") - F.make_dt_interval(hours=F.lit(hours - 1))).alias("t")).first()["t"]
    recent = dense_between(spark, sf, since) if since else dense_bars(spark, sf)
    return G.latest_hours(recent, KEY, "ds", hours)


def posts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    docs = documents(spark, sf)
    return docs.select(
        d.cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        (F.lit(1704067200) + (d % 720) * 3600 + (d * 37) % 3600).cast("double").alias("created"),
        (((d * 31) % 101) / F.lit(100.0)).alias("upvote_ratio"),
        ((d * 17) % 500).alias("score"),
        ((d * 7) % 90).alias("num_comments"),
        F.concat(F.lit("u"), (d % 50).cast("string")).alias("author"),
        F.when(F.col("source") == "src7", "scam").otherwise(F.col("source")).alias("link_flair_text"),
        (((d * 13) % 100) / F.lit(100.0)).alias("relevancy_score"),
        F.concat(F.lit("/r/"), d.cast("string")).alias("permalink"),
        F.concat(F.lit("http://x/"), d.cast("string")).alias("url"),
        X.fingerprint("text").alias("self_text_md5"),
        D.from_seconds((F.lit(1704067200) + (d % 720) * 3600 + (d * 37) % 3600).cast("double")).alias("created_at"),
    )


def with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("clean_text", X.clean_text(X.join_text("title", "body")))


def score_posts(df: DataFrame) -> DataFrame:
    return S.score_texts(with_text(df), "clean_text", {"sentiment_": SENTIMENT, "emotion_": EMOTION})


def widen(df: DataFrame) -> DataFrame:
    return S.scores_to_columns(df, "sentiment_labels", "sentiment_scores", SENTIMENT.labels, "sentiment_")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score_posts(posts(spark, sf))


def scored_wide(spark: SparkSession, sf: str) -> DataFrame:
    return widen(scored(spark, sf))


def newest_scored(spark: SparkSession, sf: str, n: int = 500) -> DataFrame:
    return widen(score_posts(S.newest_posts(posts(spark, sf), n=n)))


def sentiment_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Only the columns the numeric operators read; texts end here."""
    return scored_wide(spark, sf).select(
        "id", "created_at", "upvote_ratio", "score", "num_comments", "author", "relevancy_score",
        "link_flair_text", *[f"sentiment_{l}" for l in SENTIMENT.labels])


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Re-fetched posts: one row per event, id = user; a tiny value stands for an unparsable stamp."""
    return events(spark, sf).select(
        F.col("user_id").cast("string").alias("id"), "event_id", "event_type", "value",
        F.md5("props").alias("self_text_md5"),
        F.when(F.col("value") >= 1.0, F.col("ts")).alias("fetch_datetime"))


def relevance_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are remembered; a toxic one under an older text."""
    # Both variants are hashed before the join: no text is shuffled.
    old = F.concat(F.col("text"), F.lit(" old"))
    docs = documents(spark, sf).select("doc_id", X.fingerprint(F.col("text")).alias("_now"), X.fingerprint(old).alias("_old"))
    lab = table(spark, sf, "labels")
    return docs.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, F.col("_old")).otherwise(F.col("_now")).alias("self_text_md5"),
        (F.col("quality") == 1).alias("is_relevant"),
        D.from_seconds(F.lit(1704067200.5) + F.col("doc_id") * 900).alias("fetch_datetime"))


def sentiment_hourly(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"sentiment_{l}" for l in ("positive", "negative", "neutral")]
    return S.hourly_sentiment(sentiment_posts(spark, sf), cols, "created_at")


def sentiment_grid(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"sentiment_{l}" for l in ("positive", "negative", "neutral")]
    hours = events(spark, sf).agg(D.floor_hour(F.min("ts")).alias("lo"), D.floor_hour(F.max("ts")).alias("hi"))
    return S.on_hour_grid(sentiment_hourly(spark, sf), hours, cols)
