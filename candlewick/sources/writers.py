"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), skip_empty: bool = True) -> bool:
    """Write ``df``; with ``skip_empty`` nothing is written when it has no row. True if written."""
    if skip_empty and df.isEmpty():
        return False
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # Blanks at the ends of a text are part of it.
        writer = writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return True


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` whole as the next version below ``root``; readers of the former one go on undisturbed."""
    _, newest = newest_version(df.sparkSession, root)
    path = f"{root}/version={newest + 1}"
    write_table(df, path, skip_empty=False)
    return path


def newest_version(spark: SparkSession, root: str) -> tuple[str | None, int]:
    """Path and number of the newest version that was written to its end; (None, 0) without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [0]
    if system.exists(path(root)):
        names = [s.getPath().getName() for s in system.listStatus(path(root))]
        found += [int(n[8:]) for n in names if n.startswith("version=") and system.exists(path(f"{root}/{n}/_SUCCESS"))]
    return (f"{root}/version={max(found)}" if max(found) else None), max(found)


def append_history(new: DataFrame, path: str, partition_by: Sequence[str] = ()) -> bool:
    """Add rows to a history table without rewriting what is there."""
    return write_table(new, path, mode="append", partition_by=partition_by)


def compact(df: DataFrame, path: str, files: int, fmt: str = "parquet") -> None:
    """Rewrite many small inputs as ``files`` evenly filled files in a new folder."""
    write_table(df.repartition(files), path, fmt=fmt, skip_empty=False)
