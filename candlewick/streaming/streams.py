"""The scheduled jobs as Structured Streaming queries.

Late rows are merged whenever they arrive: each micro-batch is appended to a delta table and a
read takes the newest version per key. A row is never dropped for being late: what a bounded state
can no longer take goes to a side table, and the batch merge adds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import timefns as D
from ..operators.dedupe import latest_per_id


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """Each file once: the checkpoint's file log replaces moving files away after reading."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def append_delta(target: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer; a replayed batch overwrites its own folder, so it counts once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    return write


def run_stream(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               every: str | None = None) -> StreamingQuery:
    """Start; without ``every`` all available files are processed and the query stops."""
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def upsert_batch(target: str, id_col: str, ts: str, tie: Sequence[str],
                 enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """Writer that keeps the newest row per id of each batch; ``enrich`` may join static tables."""
    return append_delta(target, lambda d: latest_per_id(enrich(d), id_col, ts, tie))


def read_latest(spark: SparkSession, target: str, id_col: str, ts: str, tie: Sequence[str]) -> DataFrame:
    return latest_per_id(spark.read.parquet(target), id_col, ts, tie).drop("batch_id")


# -- a latest-per-id table with compaction ---------------------------------------------------------------
#
# target/deltas/batch_id=N   one folder per micro-batch
# target/base-<uuid>         a folded state
# target/pointer             rows (version, base, upto): the highest version counts

POINTER = "version long, base string, upto long"


def pointer(spark: SparkSession, target: str) -> tuple[int, str | None, int]:
    """(version, base folder or None, newest delta that the base holds)."""
    try:
        row = spark.read.schema(POINTER).parquet(f"{target}/pointer").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return (row["version"], row["base"], row["upto"]) if row else (0, None, -1)


def read_compacted(spark: SparkSession, target: str, schema: T.StructType, id_col: str, ts: str, tie: Sequence[str]) -> DataFrame:
    """The newest row per id: the base that the pointer names, and the deltas behind it.

    The pointer is read once, so a fold that ends meanwhile changes nothing for this reader. Folded
    deltas are pruned by their folder names.
    """
    _, base, upto = pointer(spark, target)
    parts = [spark.read.schema(schema).parquet(f"{target}/{base}")] if base else []
    wide = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        parts.append(spark.read.schema(wide).parquet(f"{target}/deltas").where(F.col("batch_id") > upto).drop("batch_id"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest_per_id(rows, id_col, ts, tie)


def fold(spark: SparkSession, target: str, schema: T.StructType, id_col: str, ts: str, tie: Sequence[str], upto: int) -> None:
    """Write base and deltas up to ``upto`` as a new base, then turn the pointer to it.

    The pointer is one small file that appears at once. Nothing that a reader may hold is changed;
    ``clean`` takes away what the last pointers no longer name.
    """
    version, _, held = pointer(spark, target)
    if held >= upto:
        return  # a replayed batch: its rows are in the base
    base = f"base-{uuid4().hex}"
    read_compacted(spark, target, schema, id_col, ts, tie).write.parquet(f"{target}/{base}")
    spark.createDataFrame([(version + 1, base, upto)], POINTER).coalesce(1).write.mode("append").parquet(f"{target}/pointer")


def clean(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Delete bases and deltas that none of the last ``keep`` pointers needs."""
    rows = spark.read.schema(POINTER).parquet(f"{target}/pointer").orderBy(F.desc("version")).limit(keep).collect()
    named, upto = {r["base"] for r in rows}, min(r["upto"] for r in rows)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(path(target)):
        name = status.getPath().getName()
        if name.startswith("base-") and name not in named:
            system.delete(status.getPath(), True)
    for status in system.listStatus(path(f"{target}/deltas")):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name[9:]) <= upto:
            system.delete(status.getPath(), True)


def upsert_compacted(target: str, schema: T.StructType, id_col: str, ts: str, tie: Sequence[str], every: int = 8,
                     enrich: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """Writer that keeps the newest row per id of each batch and folds after every ``every`` batches."""
    write_delta = upsert_batch(f"{target}/deltas", id_col, ts, tie, enrich)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_delta(batch.select(*schema.fieldNames()) if batch.columns != schema.fieldNames() else batch, batch_id)
        if batch_id - pointer(batch.sparkSession, target)[2] >= every:
            fold(batch.sparkSession, target, schema, id_col, ts, tie, batch_id)
    return write


# -- late rows -------------------------------------------------------------------------------------------

def split_late(batch: DataFrame, ts: str, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a batch against a watermark."""
    late = F.coalesce(F.col(ts) < watermark, F.lit(False))
    return batch.where(~late), batch.where(late)


def write_with_late(target: str, ts: str, delay: str, shape: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Writer with a side table: rows older than the watermark go to ``late`` as they are, the others,
    aggregated by ``shape``, to ``on_time``.

    The watermark is the newest time of the batches before, less ``delay``. A replayed batch finds
    the same watermark and overwrites its own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = None
        if batch_id:
            marks = spark.read.schema("newest timestamp, batch_id long").parquet(f"{target}/marks")
            mark = marks.where(F.col("batch_id") < batch_id).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        batch = batch.persist()
        on_time, late = split_late(batch, ts, F.lit(mark).cast("timestamp"))
        shape(on_time).write.mode("overwrite").parquet(f"{target}/on_time/batch_id={batch_id}")
        late.write.mode("overwrite").parquet(f"{target}/late/batch_id={batch_id}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{target}/marks/batch_id={batch_id}")
        batch.unpersist()
    return write


def merge_late(spark: SparkSession, target: str, shape: Callable[[DataFrame], DataFrame], key: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """On-time partial sums plus those of the late rows: what one batch over all rows would give."""
    on_time = spark.read.parquet(f"{target}/on_time").drop("batch_id")
    late = shape(spark.read.parquet(f"{target}/late").drop("batch_id"))
    return on_time.unionByName(late).groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])


def hourly_sums(rows: DataFrame, ts: str, key: Sequence[str], value: str) -> DataFrame:
    """``key, ds, n, total``: partial sums that can be added."""
    return rows.groupBy(*key, D.floor_hour(ts).alias("ds")).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


# -- sliding means over many hours --------------------------------------------------------------------------

RING = "hours array<long>, n array<long>, total array<double>, newest long"


def sliding_ring(events: DataFrame, ts: str, key: Sequence[str], value: str, hours: int, lateness: int = 24) -> DataFrame:
    """Sums over the last ``hours`` hours, every hour, from a ring of hourly partial sums per key.

    A row changes one entry of the ring, however long the window is. The ring holds at most
    ``hours + lateness`` entries. Tasks add up their own rows per key and hour first, so a key with
    most rows sends a few numbers. Output (update mode): ``key, slot, n, total, kind``; kind
    ``window`` is the window that ends at ``slot``, ``hour`` what this batch adds to an hour, ``late`` the
    same for an hour more than ``lateness`` hours older than the newest of the batches before, whose
    windows the ring can't take any more (see ``read_sliding``).
    """
    names, fields = list(key), [events.schema[k] for k in key]
    part = T.StructType([*fields, T.StructField("slot", T.LongType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    out = T.StructType([*part.fields, T.StructField("kind", T.StringType())])

    def add_up(batches):
        for b in batches:
            g = pa.Table.from_batches([b]).group_by([*names, "slot"], use_threads=False).aggregate([("v", "count"), ("v", "sum")])
            yield from g.select([*names, "slot", "v_count", "v_sum"]).rename_columns([*names, "slot", "n", "total"]).combine_chunks().to_batches()

    def update(own, frames, state):
        batch = pd.concat(frames).groupby("slot", as_index=False)[["n", "total"]].sum()
        ring, newest = {}, None
        if state.exists:
            h, n, total, newest = state.get
            ring = dict(zip(h, zip(n, total)))
        old = batch["slot"] <= newest - lateness if newest is not None else np.zeros(len(batch), dtype=bool)
        late, fresh = batch[old], batch[~old]
        rows = [("hour", *r) for r in fresh.itertuples(index=False)] + [("late", *r) for r in late.itertuples(index=False)]
        for s, n, total in fresh.itertuples(index=False):
            m, t = ring.get(s, (0, 0.0))
            ring[s] = (m + n, t + total)
        if len(fresh):
            first, last = int(fresh["slot"].min()), int(fresh["slot"].max())
            lo = first + 1 - hours
            n, total = np.zeros(last - lo + 1 + hours, dtype=np.int64), np.zeros(last - lo + 1 + hours)
            for s, (m, t) in ring.items():
                if lo <= s < lo + len(n):
                    n[s - lo], total[s - lo] = m, t
            n, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, total))
            ends = np.arange(first + 1, last + hours + 1)
            sums = n[ends - lo] - n[ends - lo - hours], total[ends - lo] - total[ends - lo - hours]
            rows += [("window", e, a, b) for e, a, b in zip(ends, *sums) if a]
            newest = last if newest is None else max(newest, last)
        held = sorted(s for s in ring if s > newest - hours - lateness) if newest is not None else []
        state.update(([int(s) for s in held], [int(ring[s][0]) for s in held], [float(ring[s][1]) for s in held], newest))
        yield pd.DataFrame([(*own, int(s), int(n), float(total), kind) for kind, s, n, total in rows], columns=out.names)

    partial = events.select(*names, D.slot(ts).alias("slot"), F.col(value).cast("double").alias("v")).where("slot IS NOT NULL").mapInArrow(add_up, part)
    return partial.groupBy(*names).applyInPandasWithState(update, out, RING, "update", "NoTimeout")


def append_kinds(target: str) -> Callable[[DataFrame, int], None]:
    """Writer of ``sliding_ring`` output: one folder per kind and batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "batch_id").parquet(target)
    return write


def read_sliding(spark: SparkSession, target: str, key: Sequence[str], hours: int) -> DataFrame:
    """``key, ds, n, mean`` of every window: the stream's newest answer, or, where late hours belong to a
    window, the sum over the hours themselves."""
    names = list(key)
    rows = spark.read.parquet(target)
    w = Window.partitionBy(*names, "slot").orderBy(F.desc("batch_id"))
    streamed = rows.where("kind = 'window'").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*names, "slot", "n", "total")
    late = rows.where("kind = 'late'").select(*names, "slot").distinct()
    ends = F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + hours)).alias("slot")
    redone = late.select(*names, ends).distinct()
    per_hour = rows.where("kind <> 'window'").groupBy(*names, "slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # Only keys with late rows; hours and wanted ends side by side in one range frame.
    some = per_hour.join(late.select(*names).distinct(), names, "left_semi").withColumn("asked", F.lit(False))
    asked = redone.withColumns({"n": F.lit(0).cast("long"), "total": F.lit(0.0), "asked": F.lit(True)})
    frame = Window.partitionBy(*names).orderBy("slot").rangeBetween(-hours, -1)
    both = some.unionByName(asked).withColumns({"n": F.sum("n").over(frame), "total": F.sum("total").over(frame)})
    again = both.where("asked").select(*names, "slot", "n", "total")
    kept = streamed.join(redone, [*names, "slot"], "left_anti")
    return kept.unionByName(again).select(*names, D.slot_start("slot").alias("ds"), "n", (F.col("total") / F.col("n")).alias("mean"))


# -- windowed aggregates ----------------------------------------------------------------------------------------

def hourly_aggregates(events: DataFrame, ts: str, key: Sequence[str], value: str, delay: str | None = None) -> DataFrame:
    """Count and sum per key and clock hour; ``delay`` bounds the state and drops later rows."""
    src = events.withWatermark(ts, delay) if delay else events
    hour = F.window(ts, "1 hour")
    return src.groupBy(*key, hour.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")
    ).select(*key, F.col("w.start").alias("ds"), "n", "total", "mean")


def sliding_means(events: DataFrame, ts: str, key: Sequence[str], value: str, hours: int, delay: str | None = None) -> DataFrame:
    """Mean over the last ``hours`` hours, every hour. Each row feeds ``hours`` windows: for short ones; see ``sliding_ring``."""
    src = events.withWatermark(ts, delay) if delay else events
    return src.groupBy(*key, F.window(ts, f"{hours} hours", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(*key, F.col("w.end").alias("ds"), "n", "mean")


def read_last_update(spark: SparkSession, target: str, key: Sequence[str]) -> DataFrame:
    """Newest delta row per key of an update-mode stream."""
    w = Window.partitionBy(*key).orderBy(F.col("batch_id").desc())
    return (spark.read.parquet(target).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn", "batch_id"))
