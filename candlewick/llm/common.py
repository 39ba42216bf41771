"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import staged, work_dir

__all__ = ["staged", "work_dir", "table", "text_of", "id_of", "fresh", "row_key", "elected", "tasks_for", "WHITE", "components"]

#: ASCII white space, as the contracts of the queries name it.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str) -> Column:
    return F.col(name).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """32 bytes that tell rows apart which differ in id or text."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(id_of(id_col).cast("string"), F.lit("null")), text_of(text_col)), 256))


def elected(docs: DataFrame, key: Column, winners: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``key`` is among the distinct ``winners`` (one column):
    one row per key, the first by ``order``, then by a hash of the row.

    Join and window share their key, so rows are shuffled once.
    """
    k, w, n, h = (fresh(docs, x) for x in ("_elect_key", "_elect_winner", "_elect_nth", "_elect_hash"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tagged = docs.select("*", key.alias(k), F.xxhash64(*plain).alias(h))
    wanted = winners.select(winners[winners.columns[0]].alias(w))
    kept = tagged.join(wanted, tagged[k] == wanted[w], "left_semi")
    nth = F.row_number().over(Window.partitionBy(k).orderBy(*order, h))
    return kept.withColumn(n, nth).where(F.col(n) == 1).drop(k, n, h)


def tasks_for(spark: SparkSession, size: int, each: int) -> int:
    """Tasks for ``size`` bytes that files hold, ``each`` or less in a task; at least one per core.

    For ``repartition(n, ...)`` of rows that only name what a task will read: AQE measures the rows,
    and would join them, but keeps a given number.
    """
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)``: root is the smallest
    node of its component.

    Large and small stars alternate until no edge changes. A node's smallest neighbour comes from
    a combining aggregate and is joined back, so a node with very many neighbours is split among
    tasks. Each round is written to the shared folder: lineage stays short.
    """
    pair = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = staged(edges.where("u <> v").select(pair.alias("e")).select("e.*").distinct(), "edges")
    state = None
    for _ in range(rounds):
        # Large star: neighbours above a node move to its smallest neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        large = staged(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.*").where("u <> v").distinct(), "edges")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
        state = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
