"""Mixing sources to target weights with a low-discrepancy schedule.

Words are dealt in blocks of ``BLOCK``. Slot i of the schedule has the golden-ratio point
``i * g mod 1``; the cumulative targets of the sources cut [0, 1) into intervals, and the slot
belongs to the source whose interval holds its point. The r-th slot of a source takes block
``r mod n`` of the source's n blocks, which cut the stream of its documents, shuffled by a hash,
into equal numbers of words. A block is taken three times at most.

Nothing is ordered in one task: positions in a stream are running sums inside hash buckets plus
the sums of the buckets before, ranks of slots are row numbers inside chunks of slots plus the
counts of the chunks before. Only tables with one row per source are windowed whole.

Defined results: a null or blank text has size 0 and is never taken; the null source is a source
and comes last; repeated rows are documents of their own; with no words at all every target is 0;
an empty table gives an empty result; further columns are ignored by ``mix`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh, id_of, staged, text_of

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # times a source can be taken
BLOCK = 64  # words of a block
GOLDEN, PERIOD = 1327217885, 1 << 31  # the golden ratio's fraction as a fixed-point number
BUCKET_ROWS = 20_000  # documents a hash bucket is planned for
LEAST_BUCKETS = 256
CHUNK = 1 << 16  # slots ranked together
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, h, th)``: words, and the hashes that order a source's stream."""
    t = text_of(text_col)
    return docs.select(id_of(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64(F.lit("mix"), id_of(id_col)).alias("h"), F.xxhash64(t).alias("th"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: s (its place), source, source_size, weight, target.

    Water-filling: in order of ``most * size / weight``, a source is full when that is no more
    than what a unit of weight gets of the words that the fuller sources leave; the level at
    which the rest stands is the largest such share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = per.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int") + 1).cast("double")
    full = place.withColumn("weight", w).withColumn("full", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("full") / F.col("weight"), "s")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("full").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    share = (F.sum("source_size").over(whole) - before) / rest
    level = full.withColumn("share", share).withColumn("level", F.max("share").over(whole))
    return level.select("s", "source", "source_size", "weight", F.least(F.col("full").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def schedule(sources: DataFrame, words: int, n_sources: int, block: int = BLOCK) -> DataFrame:
    """``(s, r)``: the source of every slot and the slot's rank within its source."""
    spark = sources.sparkSession
    slots = -(-words // block)
    up = F.sum("target").over(Window.orderBy("s"))
    total = F.sum("target").over(Window.partitionBy())
    cells = max(4096, 4 * n_sources)
    # A source's interval, once for each cell of [0, 1) that it meets: slots join by their cell.
    spans = sources.where("target > 0").select("s", ((up - F.col("target")) / total).alias("lo"), (up / total).alias("hi"), (F.col("s") == F.max("s").over(Window.partitionBy())).alias("last"))
    met = spans.withColumn("hi", F.when(F.col("last"), 2.0).otherwise(F.col("hi"))).select(
        "s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1).cast("long")))).alias("cell"))
    i = spark.range(slots).select("id", ((F.col("id") % PERIOD * GOLDEN + GOLDEN // 2) % PERIOD / F.lit(float(PERIOD))).alias("x"))
    dealt = i.withColumn("cell", F.floor(F.col("x") * cells)).join(met, "cell").where("x >= lo AND x < hi").select("s", "id", F.expr(f"id div {CHUNK}").alias("chunk"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("id")) - 1
    counts = dealt.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("s", "chunk", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("before"))
    return dealt.withColumn("k", inside).join(before, ["s", "chunk"]).select("s", (F.col("before") + F.col("k")).alias("r"))


def _streams(sizes: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Documents with their place ``start`` in the word stream of their source."""
    placed = sizes.join(sources.select("s", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("h", "th"), F.lit(buckets)))
    order = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select("s", "bucket", (F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")).alias("before"))
    return inside.join(before, ["s", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))


def _taken(sizes: DataFrame, block: int, most: int, weights: tuple) -> DataFrame:
    """Every row of ``sizes`` with source_size, target and taken."""
    sources = staged(targets(sizes, weights, most), "sources")
    whole = sources.agg(F.sum("source_size"), F.count("*")).first()
    words, n_sources = whole[0] or 0, whole[1]
    rows = _streams(sizes, sources, max(LEAST_BUCKETS, -(-sizes.count() // BUCKET_ROWS)))
    blocks = sources.select("s", F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"))
    ranked = schedule(sources, words, n_sources, block).join(blocks, "s").where(F.col("r") < most * F.col("blocks"))
    times = ranked.select("s", (F.col("r") % F.col("blocks")).alias("b")).groupBy("s", "b").agg(F.count("*").alias("times"))
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = rows.where("size > 0").withColumn("b", F.explode(F.sequence(first, last)))
    own = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block)
    keys = ["doc_id", "source", "size", "h", "th", "s", "start", "source_size", "target"]
    taken = parts.withColumn("own", own).join(times, ["s", "b"], "left").groupBy(*keys).agg(
        F.sum(F.col("own") * F.coalesce("times", F.lit(0))).alias("taken"))
    return taken.union(rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source."""
    sizes = staged(sized(docs, id_col, text_col, source_col), "sizes")
    return _taken(sizes, block, most, weights).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it: taken words over
    size, rounded. The end of a source's last pass cuts at most one block, so this is whole
    passes for nearly all documents. Repeated rows share their takes evenly."""
    sizes = staged(sized(docs, id_col, text_col, source_col), "sizes")
    i, f, t, n, k = (fresh(docs, x) for x in ("_mix_id", "_mix_source", "_mix_text", "_mix_times", "_mix_nth"))
    times = F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int")
    per = _taken(sizes, block, most, weights).groupBy("doc_id", "source", "h", "th").agg(times.alias("times")).where("times > 0").select(
        F.col("doc_id").alias(i), F.col("source").alias(f), F.col("th").alias(t), F.col("times").alias(n))
    on = (F.xxhash64(text_of(text_col)) == per[t]) & id_of(id_col).eqNullSafe(per[i]) & F.col(source_col).cast("string").eqNullSafe(per[f])
    joined = docs.join(per, on).drop(i, f, t)
    return joined.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, k)
