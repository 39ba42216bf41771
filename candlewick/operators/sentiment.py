"""Scores of texts, score tables and hourly sentiment."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..errors import DataQualityError
from ..functions import scalars as M, textfns as X, timefns as D
from . import grid as G, rolling as R
from .single import row_of

# The sentiment labels, in tie-break order of the arg-max.
SENTIMENTS = ("negative", "neutral", "positive")


@dataclass(frozen=True)
class LexiconScorer:
    """Word weights per label; label scores are the softmax of the scaled mean weights."""

    weights: Mapping[str, Mapping[str, float]]
    bias: Mapping[str, float] = field(default_factory=dict)
    scale: float = 20.0

    @property
    def labels(self) -> list[str]:
        return list(self.weights)

    @property
    def words(self) -> list[str]:
        return sorted({w for own in self.weights.values() for w in own})

    def scores(self, text: Column) -> Column:
        return M.bind(X.tokens(text), self.scores_of)

    def scores_of(self, words: Column) -> Column:
        """Scores of tokenised text. One hash look-up per word; the weights meet the few words that are left."""
        def logits(hits: Column) -> Column:
            size = F.greatest(F.size(words), F.lit(1)).cast("double")
            return F.array(*[
                X.lexicon_logit(hits, w) / size * F.lit(self.scale) + F.lit(float(self.bias.get(l, 0.0)))
                for l, w in self.weights.items()])
        return X.softmax(M.bind(F.filter(words, lambda t: t.isin(self.words)), logits))


def score_text(df: DataFrame, text: str, scorer: LexiconScorer, prefix: str = "sentiment_") -> DataFrame:
    """Add ``{prefix}labels`` and ``{prefix}scores``; an empty text has none."""
    return score_texts(df, text, {prefix: scorer})


def score_texts(df: DataFrame, text: str, scorers: Mapping[str, LexiconScorer]) -> DataFrame:
    """``score_text`` for several scorers (by prefix) with one tokenisation."""
    empty = F.col(text).isNull() | (F.col(text) == "")
    out = df.withColumn("_words", F.when(~empty, X.tokens(F.col(text))))
    return out.withColumns({c: v for prefix, scorer in scorers.items() for c, v in (
        (f"{prefix}labels", F.when(~empty, F.array(*[F.lit(l) for l in scorer.labels]))),
        (f"{prefix}scores", F.when(~empty, scorer.scores_of(F.col("_words")))))}).drop("_words")


# -- weights learned from labels ---------------------------------------------------------------------------

def learn_weights(labelled: DataFrame, text: str, label: str, prior: float = 10.0) -> DataFrame:
    """``token, n_1, n_0, weight``: log-odds of a token in texts of class 1 against class 0.

    Each class's counts are joined by ``prior`` tokens that follow the frequencies of both together, so
    rare tokens have weights near 0. Tokens are counted in the map tasks; one row per token and task is shuffled.
    """
    words = labelled.where(F.col(label).isin(0, 1)).select(F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token"), F.col(label).alias("_l"))
    counts = words.groupBy("token").agg(F.sum(F.col("_l").cast("long")).alias("n_1"), F.count(F.lit(1)).alias("_n"))
    counts = counts.select("token", "n_1", (F.col("_n") - F.col("n_1")).alias("n_0"))
    total = row_of(counts.agg(F.sum("n_1").alias("t_1"), F.sum("n_0").alias("t_0")))
    both = F.lit(prior) * (F.col("n_1") + F.col("n_0")) / (total["t_1"] + total["t_0"])

    def odds(n: Column, of: Column) -> Column:
        return F.ln((n + both) / (of + F.lit(prior) - n - both))
    return counts.withColumn("weight", odds(F.col("n_1"), total["t_1"]) - odds(F.col("n_0"), total["t_0"]))


def score_with_weights(df: DataFrame, id_col: str, text: str, weights: DataFrame) -> DataFrame:
    """``id, n_tokens, logit, score``: mean weight of a text's tokens and its logistic.

    One tokenisation for all labels; equal tokens are counted inside their row, and what is shuffled
    are token counts, never texts: once to meet the token table and once to the sums per id. The table
    grows with the texts and is never broadcast. Tokens without a weight count 0.
    """
    texts = df.select(F.col(id_col).alias("id"), X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    # A text without words keeps a row with no token, each under its own key: null tokens would meet in one task.
    none = F.array(F.struct(F.concat(F.lit(" "), F.xxhash64("id").cast("string")).alias("token"), F.lit(0).cast("long").alias("n")))
    rows = texts.select("id", F.inline(F.when(F.size("_words") > 0, X.token_counts(F.col("_words"))).otherwise(none)))
    joined = rows.join(weights.select("token", "weight").hint("shuffle_hash"), "token", "left")
    out = joined.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.coalesce("weight", F.lit(0.0))).alias("_sum"))
    logit = F.coalesce(F.try_divide(F.col("_sum"), F.col("n_tokens")), F.lit(0.0))
    return out.select("id", "n_tokens", logit.alias("logit"), (1.0 / (1.0 + F.exp(-logit))).alias("score"))


def score_text_with_model(df: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], list]],
                          prefix: str = "sentiment_", on_error: tuple[list, list] = ([], [])) -> DataFrame:
    """Score with an external model: ``load()`` runs once per task and returns a batch scorer.

    The scorer maps a series of texts to (labels, scores) pairs. A failing batch is retried text
    by text, and a failing text gets ``on_error``.
    """
    out = T.StructType([T.StructField("labels", T.ArrayType(T.StringType())),
                        T.StructField("scores", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def one(t: str) -> tuple:
            try:
                return model(pd.Series([t]))[0]
            except Exception:
                return on_error

        for texts in batches:
            full = texts.fillna("")
            live = full[full != ""]
            try:
                pairs = list(model(live)) if len(live) else []
            except Exception:
                pairs = [one(t) for t in live]
            got = dict(zip(live.index, pairs))
            yield pd.DataFrame({"labels": [got[i][0] if i in got else None for i in texts.index],
                                "scores": [got[i][1] if i in got else None for i in texts.index]})

    return (df.withColumn("_s", run(F.col(text)))
            .withColumns({f"{prefix}labels": F.col("_s.labels"), f"{prefix}scores": F.col("_s.scores")})
            .drop("_s"))


def any_label_above(scores: str | Column, threshold: float = 0.5) -> Column:
    """Relevance by a multi-label classifier: any score above the threshold."""
    return F.coalesce(F.exists(F.col(scores) if isinstance(scores, str) else scores,
                               lambda p: p > threshold), F.lit(False))


def scores_to_columns(df: DataFrame, labels: str, scores: str, known: Sequence[str],
                      prefix: str) -> DataFrame:
    """One column per known label, looked up in the row itself: no explode, pivot or join."""
    def first_of(label: str) -> Column:
        hits = F.filter(F.arrays_zip(F.col(labels).alias("l"), F.col(scores).alias("s")),
                        lambda z: z["l"] == label)
        return F.get(hits, F.lit(0))["s"]
    return df.withColumns({prefix + l: first_of(l) for l in known})


def explode_scores(df: DataFrame, labels: str, scores: str, prefix: str) -> DataFrame:
    """One row per (row, label); a row without labels stays with nulls."""
    zipped = F.explode_outer(F.arrays_zip(F.col(labels).alias("l"), F.col(scores).alias("s")))
    keep = [c for c in df.columns if c not in (labels, scores)]
    return (df.select(*keep, zipped.alias("_z"))
            .select(*keep, F.col("_z.l").alias(f"{prefix}label"), F.col("_z.s").alias(f"{prefix}score")))


def entries_to_columns(df: DataFrame, entries: str, known: Sequence[str], prefix: str) -> DataFrame:
    """An array of (label, score) structs to one column per known label."""
    pairs = F.map_from_entries(F.col(entries))
    return df.withColumns({prefix + l: F.try_element_at(pairs, F.lit(l)) for l in known})


def pivot_scores(df: DataFrame, id_col: str, label: str, score: str, known: Sequence[str],
                 prefix: str) -> DataFrame:
    """Exploded scores back to one column per label, first value per (id, label)."""
    wide = df.groupBy(id_col).pivot(label, list(known)).agg(F.first(score, ignorenulls=True))
    return wide.withColumnsRenamed({l: prefix + l for l in known})


def attach_comments(posts: DataFrame, comments: DataFrame, link: str = "link_id", kind: str = "t3_") -> DataFrame:
    """Comments next to their post: a comment names its post by type prefix and id."""
    return posts.join(comments, F.concat(F.lit(kind), posts["id"]) == comments[link])


def hourly_sentiment(posts: DataFrame, cols: Sequence[str], ts: str = "ds",
                     min_upvote: float = 0.7) -> DataFrame:
    """Mean score and post count per hour over posts with enough agreement."""
    kept = posts.where(F.col("upvote_ratio") > min_upvote)
    return kept.groupBy(D.floor_hour(ts).alias("ds")).agg(
        *[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("post_count_by_hour"))


def on_hour_grid(hourly: DataFrame, bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Reindex to the hours of ``bounds`` (lo, hi), then fill in time.

    Hours inside the posts' own span without a post count 0. Hours outside are missing and are
    interpolated like the scores: the last count is held, the start stays null.
    """
    own = row_of(hourly.agg(F.min("ds").alias("first_post"), F.max("ds").alias("last_post")))
    first, last = own["first_post"], own["last_post"]
    dense = G.densify(hourly, [], "ds", bounds=bounds)
    count = (F.when(F.col("post_count_by_hour").isNotNull(), F.col("post_count_by_hour"))
             .when((F.col("ds") >= first) & (F.col("ds") <= last), F.lit(0))).cast("double")
    return R.interpolate(dense.withColumn("post_count_by_hour", count), [], "ds",
                         [*cols, "post_count_by_hour"])


def sentiment_features(dense: DataFrame, names: Sequence[str] = ("positive", "negative", "neutral"),
                       volatility_hours: int = 72, kernel_hours: int = 120, lag_hours: int = 7,
                       kernel: str = "ref", back_fill: bool = True) -> DataFrame:
    """Momentum, volatility, time-weighted averages and lags of hourly sentiment, gaps filled."""
    w = R.Blocked(dense, [], "ds", back=max(volatility_hours, kernel_hours) + 1)
    new: dict[str, Column] = {}
    for n in names:
        c = f"sentiment_{n}"
        new[f"{c}_momentum"] = F.expr(f"{c} - lag({c}) {w.over()}")
        new[f"{c}_volatility"] = R.rolling(w, c, volatility_hours, "stddev_samp")
        new[f"tw_avg_{n}"] = R.kernel_average(w, "ds", c, kernel_hours, kernel=kernel)
        for k in range(1, lag_hours + 1):
            new[f"{c}_lag_{k}hr"] = F.expr(f"lag({c}, {k}) {w.over()}")
    framed = w.add(**new).done()
    return R.fill(framed, [], "ds", [c for c in framed.columns if c != "ds"],
                  "both" if back_fill else "forward")


def sentiment_score(df: DataFrame) -> DataFrame:
    """Composite 0..100 score from the time-weighted averages."""
    need = ["tw_avg_negative", "tw_avg_neutral", "tw_avg_positive"]
    absent = [c for c in need if c not in df.columns]
    if absent:
        raise DataQualityError(f"missing columns: {absent}")
    return df.withColumn("sentiment_score", M.composite_score(*need))


def newest_posts(posts: DataFrame, ts: str = "created_at", n: int = 500) -> DataFrame:
    """The n newest posts. Take them before scoring, so that only these are scored."""
    return posts.orderBy(F.col(ts).desc(), F.col("id").desc()).limit(n)


def tag_posts(posts: DataFrame, ts: str = "created_at") -> DataFrame:
    """Posts with their 6-hour group and strongest sentiment."""
    best = M.dominant([(l, F.col(f"sentiment_{l}")) for l in SENTIMENTS])
    return posts.withColumns({"time_group": D.floor_to(ts, 6 * 3600), "senti_most": best})


def representative_posts(tagged: DataFrame, prefer: str = "low") -> DataFrame:
    """One post per sentiment: newest 6-hour group, then lowest (or highest) upvote ratio."""
    ratio = F.col("upvote_ratio").asc() if prefer == "low" else F.col("upvote_ratio").desc()
    w = Window.partitionBy("senti_most").orderBy(F.col("time_group").desc(), ratio, F.col("id"))
    return (tagged.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn"))


def term_counts(df: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """Word counts over whole texts; ``k`` keeps the most frequent ones."""
    counts = (df.select(F.explode(X.tokens(F.col(text))).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.col("n").desc(), F.col("term")).limit(k) if k else counts
