"""Small results inside other queries: single rows, and group tables of checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F


def row_of(one: DataFrame) -> Column:
    """The only row of an aggregate as a struct: one scalar subquery, run once however often used."""
    return one.select(F.struct(*one.columns).alias("r")).scalar()


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate added to every row."""
    return df.withColumn("_row", row_of(one)).select("*", *[F.col(f"_row.{c}").alias(c) for c in one.columns]).drop("_row")


SMALL_ROWS = 20_000


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> list[Row] | None:
    """The rows of an aggregate, or None when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """An aggregate to join back to its input: broadcast only when it was counted as small.

    Up to ``limit`` rows are fetched once and sent to every task, so the large side is not
    shuffled. A larger table stays a plain join, which AQE plans and splits when skewed.
    """
    rows = small_rows(df, limit)
    return df if rows is None else sent(rows, df)


def sent(rows: list[Row], like: DataFrame) -> DataFrame:
    """Fetched rows as a table for every task."""
    return F.broadcast(like.sparkSession.createDataFrame(rows, like.schema))
