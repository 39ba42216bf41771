"""Newest version per id, memo lookups and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_id(df: DataFrame, id_col: str = "id", ts: str = "fetch_datetime",
                  tie: Sequence[str] = ("self_text_md5",), nulls: str = "win") -> DataFrame:
    """One row per id: the newest by ``ts``; ties go to the largest ``tie`` values.

    A missing time counts as newest (``nulls='win'``) or oldest (``'lose'``). The filter on the
    first rank is applied inside each map task too, so at most one row per id and task is
    shuffled even when one id holds most of the table.
    """
    newest = F.col(ts).desc_nulls_first() if nulls == "win" else F.col(ts).desc_nulls_last()
    w = Window.partitionBy(id_col).orderBy(newest, *[F.col(c).desc_nulls_last() for c in tie])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def stamp_missing(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Fill missing fetch times with the batch time."""
    return df.withColumn(ts, F.coalesce(F.col(ts), F.to_timestamp(F.lit(as_of))))


def upsert(base: DataFrame, batch: DataFrame, id_col: str = "id", ts: str = "fetch_datetime",
           tie: Sequence[str] = ("self_text_md5",), require: Sequence[str] = (),
           nulls: str = "win") -> DataFrame:
    """Base plus batch, newest row per id; batch rows with a null in ``require`` are left out."""
    fresh = batch.dropna(subset=list(require)) if require else batch
    return latest_per_id(base.unionByName(fresh, allowMissingColumns=True), id_col, ts, tie, nulls)


def attach_memo(df: DataFrame, memo: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left lookup of remembered columns; AQE broadcasts the memo only when it measures small."""
    return df.join(memo.select(*on, *cols), list(on), "left")


def missing_any(cols: Sequence[str]) -> Column:
    p = F.lit(False)
    for c in cols:
        p = p | F.col(c).isNull()
    return p


def split_missing(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with any of ``cols`` missing, rows with all present)."""
    p = missing_any(cols)
    return df.where(p), df.where(~p)


def reuse_scores(df: DataFrame, memo: DataFrame, cols: Sequence[str],
                 on: Sequence[str] = ("id", "self_text_md5"), prefix: str = "his_") -> tuple[DataFrame, DataFrame]:
    """(reused, to_score): remembered values win over present ones; unchanged texts are reused."""
    held = attach_memo(df, memo, on, [prefix + c for c in cols])
    out = held.withColumns({
        c: F.coalesce(F.col(prefix + c), F.col(c)) if c in df.columns else F.col(prefix + c) for c in cols
    }).drop(*[prefix + c for c in cols])
    todo, done = split_missing(out, cols)
    return done, todo


def keep_not_false(df: DataFrame, col: str) -> DataFrame:
    """Keep true and unknown."""
    return df.where(~F.col(col).eqNullSafe(F.lit(False)))


def judge_relevance(posts: DataFrame, memo: DataFrame, rule: Column,
                    on: Sequence[str] = ("id", "self_text_md5")) -> DataFrame:
    """Known-irrelevant posts are dropped, unknown ones judged by ``rule``.

    The rule is evaluated before the lookup: when the caller goes on without the text, the
    lookup shuffles ids and one flag instead of texts.
    """
    judged = posts.withColumn("_judged", rule)
    known = keep_not_false(attach_memo(judged, memo, on, ["is_relevant"]), "is_relevant")
    return known.withColumn("is_relevant", F.coalesce(F.col("is_relevant"), F.col("_judged"))).drop("_judged")
