"""Table and file scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import textfns as X, timefns as D
from .schemas import KLINES_RAW, POSTS_RAW


def read_klines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header-less candle files under one or more paths, close time as hourly ``ds``."""
    raw = spark.read.schema(KLINES_RAW).csv(path, header=False)
    return (raw.drop("unused_field_ignore", "open_time")
            .withColumn("ds", D.floor_hour(D.from_millis("ds"))))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """One table. With a schema, a missing path is an empty table (first run)."""
    if schema is None and fmt != "parquet":
        raise ValueError("text formats need a declared schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        return reader.load(path)
    except AnalysisException as e:
        if schema is not None and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_snapshots(spark: SparkSession, paths: Sequence[str], as_of: str,
                   schema: T.StructType = POSTS_RAW, fmt: str = "csv") -> DataFrame:
    """Union of post snapshot folders with fetch time and text hash filled in.

    A missing fetch time comes from the file name, else it is ``as_of`` (the batch time, passed
    in so that a rerun gives the same table). A missing hash is computed from the body.
    """
    parts = []
    for p in paths:
        reader = spark.read.schema(schema).format(fmt)
        if fmt == "csv":
            reader = (reader.option("header", True).option("multiLine", True)
                      .option("escape", '"').option("enforceSchema", False))
        parts.append(reader.load(p).withColumn("_file", F.col("_metadata.file_path")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    return (df.withColumn("fetch_datetime", fetch_time("fetch_datetime", "_file", as_of))
            .withColumn("self_text_md5", backfilled_hash("self_text_md5", "body"))
            .drop("_file"))


def fetch_time(stamp: str | Column, file_name: str | Column, as_of: str) -> Column:
    c = F.col(stamp) if isinstance(stamp, str) else stamp
    return (F.when(c.isNotNull(), D.parse_lenient(c))
            .otherwise(F.coalesce(D.stamp_from_name(file_name), F.to_timestamp(F.lit(as_of)))))


def backfilled_hash(md5: str | Column, body: str | Column) -> Column:
    c = F.col(md5) if isinstance(md5, str) else md5
    return F.coalesce(c, X.fingerprint(body))


def missing_days(bars: DataFrame, key: str, ts: str, until: str, since: str | None = None) -> DataFrame:
    """Days without any bar from the first loaded day (or ``since``) to ``until``, per series."""
    days = bars.groupBy(key, F.to_date(ts).alias("day")).count().drop("count")
    span = days.groupBy(key).agg(F.min("day").alias("first_day"))
    first = F.lit(since).cast("date") if since else F.col("first_day")
    plan = span.where(first <= F.lit(until).cast("date")).select(
        key, F.explode(F.sequence(first, F.lit(until).cast("date"))).alias("day"))
    return plan.join(days, [key, "day"], "left_anti")


def next_days(bars: DataFrame, key: str, ts: str, until: str) -> DataFrame:
    """Days to load: from the hour after the last loaded bar to ``until``; none when up to date."""
    last = bars.groupBy(key).agg(F.to_date(F.max(ts) + F.expr("INTERVAL 1 HOUR")).alias("lo"))
    stop = F.lit(until).cast("date")
    return last.where(F.col("lo") <= stop).select(
        key, F.explode(F.sequence("lo", stop)).alias("day"))
