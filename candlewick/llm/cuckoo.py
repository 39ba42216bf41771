"""Exact dedup over a cuckoo-filter index of live digests.

A digest is the SHA-256 of the text without ASCII white space. Digests are dealt to shards by
their first bytes; a shard holds a cuckoo filter over its live digests and the stored keys
themselves, in content buckets. A digest that the filter does not know is new; one that it seems
to know is looked up among the stored keys of its bucket. Copies are combined per Arrow batch
before the shuffle, so the shard of a text that a third of all rows repeat gets one row per batch.

Defined results: null text is empty text; all texts of white space only are equal; a null id
sorts after every other id; repeated rows count as copies; an empty table gives an empty result;
further columns are ignored by ``exact_dedup`` and kept by ``kept_rows``.
"""

from __future__ import annotations

from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, elected, id_of, staged, text_of

SLOTS = 4  # per filter bucket
KICKS = 200  # moves before the filter counts as full
CONTENT = 64  # content buckets of a shard
SHARD_KEYS = 100_000  # rows a shard is planned for
LEAST_SHARDS = 512
STALE = -1  # points of an entry whose best row was deleted

KEYS = "shard int, digest binary, copies long, points long, keep_id long, log2 int, slots binary"


class CuckooIndex:
    """Live digests of one shard: 16-bit tags in a cuckoo filter, the keys in content buckets."""

    def __init__(self, log2: int = 6):
        self.content: list[dict[bytes, list]] = [{} for _ in range(CONTENT)]
        self.live = 0
        self._clear(log2)

    def _clear(self, log2: int) -> None:
        self.log2, self.mask = log2, (1 << log2) - 1
        self.slots = array("H", bytes(2 * SLOTS << log2))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[20:22], "little") or 1
        one = int.from_bytes(digest[8:16], "little") & self.mask
        return tag, one, self._other(one, tag)

    def _other(self, place: int, tag: int) -> int:
        return place ^ ((tag * 0x5BD1E995 >> 7) & self.mask)

    def seems_known(self, digest: bytes) -> bool:
        tag, one, two = self._places(digest)
        return tag in self.slots[one * SLOTS:one * SLOTS + SLOTS] or tag in self.slots[two * SLOTS:two * SLOTS + SLOTS]

    def stored(self, digest: bytes) -> list | None:
        """The entry of a live digest: the filter first, then the keys of its content bucket."""
        return self.content[digest[24] % CONTENT].get(digest) if self.seems_known(digest) else None

    def _swap(self, place: int, old: int, new: int) -> bool:
        for k in range(place * SLOTS, place * SLOTS + SLOTS):
            if self.slots[k] == old:
                self.slots[k] = new
                return True
        return False

    def _file(self, digest: bytes) -> bool:
        """Put the tag of a digest into the filter; False when it overflows."""
        tag, place, two = self._places(digest)
        if self._swap(place, 0, tag) or self._swap(two, 0, tag):
            return True
        for kick in range(KICKS):
            k = place * SLOTS + (tag + kick) % SLOTS
            tag, self.slots[k] = self.slots[k], tag
            place = self._other(place, tag)
            if self._swap(place, 0, tag):
                return True
        return False

    def resize(self) -> None:
        """Twice the buckets, filled again from the stored keys."""
        full = True
        while full:
            self._clear(self.log2 + 1)
            full = not all(self._file(d) for keys in self.content for d in keys)

    def insert(self, digest: bytes, copies: int, points: int, doc_id: int | None) -> bool:
        """Add copies of a digest; True when it is new. The entry keeps the best row."""
        if (entry := self.stored(digest)) is not None:
            entry[0] += copies
            if entry[1] != STALE and better((points, doc_id), (entry[1], entry[2])):
                entry[1:] = points, doc_id
            return False
        self.content[digest[24] % CONTENT][digest] = [copies, points, doc_id]
        self.live += 1
        if not self._file(digest):
            self.resize()
        return True

    def delete(self, digest: bytes, copies: int, points: int, doc_id: int | None) -> bool:
        """Take copies away, ``points`` and ``doc_id`` being the best of them; the digest goes, from
        filter and content, with its last copy. When the row that stays goes, the entry is stale
        until another is elected."""
        entry = self.stored(digest)
        if entry is None:
            return False
        entry[0] -= copies
        if entry[1] == STALE or not better((entry[1], entry[2]), (points, doc_id)):
            entry[1:] = STALE, None
        if entry[0] <= 0:
            del self.content[digest[24] % CONTENT][digest]
            self.live -= 1
            tag, one, two = self._places(digest)
            if not self._swap(one, tag, 0):
                self._swap(two, tag, 0)
        return True

    def rows(self, shard: int) -> pd.DataFrame:
        """The live keys, after one row (digest null) with the filter."""
        keys = [(shard, d, *e, None, None) for c in self.content for d, e in c.items()]
        return pd.DataFrame([(shard, None, 0, 0, None, self.log2, self.slots.tobytes()), *keys], columns=COLUMNS).astype(KINDS)

    @classmethod
    def of_rows(cls, pdf: pd.DataFrame) -> CuckooIndex:
        index = cls()
        for r in pdf.itertuples():
            if r.digest is None:
                index._clear(int(r.log2))
                index.slots = array("H", r.slots)
            else:
                index.content[r.digest[24] % CONTENT][r.digest] = [int(r.copies), int(r.points), none_or_int(r.keep_id)]
                index.live += 1
        return index


COLUMNS = [c.split()[0] for c in KEYS.split(", ")]
KINDS = {"shard": "int32", "copies": "int64", "points": "int64", "keep_id": "Int64", "log2": "Int32"}


def none_or_int(x) -> int | None:
    return None if x is None or x is pd.NA or x != x else int(x)


def better(a: tuple, b: tuple) -> bool:
    """More code points, then the smaller id; a null id comes last."""
    return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, digest, points)`` of every row, from whole texts."""
    t = text_of(text_col)
    digest = F.unhex(F.sha2(F.regexp_replace(t, f"{WHITE}+", ""), 256))
    return docs.select(id_of(id_col).alias("doc_id"), digest.alias("digest"), F.length(t).cast("long").alias("points"))


def _combined(batches):
    """Rows of equal digest within a batch become one: copies, and the row that would stay."""
    for b in batches:
        t = pa.Table.from_batches([b]).sort_by([("points", "descending"), ("doc_id", "ascending")])
        g = t.group_by(["digest", "shard"], use_threads=False).aggregate([("points", "count"), ("points", "first"), ("doc_id", "first")])
        out = pa.table({"shard": g["shard"], "digest": g["digest"], "copies": g["points_count"], "points": g["points_first"], "doc_id": g["doc_id_first"]})
        yield from out.combine_chunks().to_batches()


def _changes(found: DataFrame, shards: int) -> DataFrame:
    # The shard comes from bytes of the digest, so it is the same in every run.
    shard = (F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % shards).cast("int")
    return found.withColumn("shard", shard).select("shard", "digest", "points", "doc_id").mapInArrow(
        _combined, "shard int, digest binary, copies long, points long, doc_id long")


def shards_for(rows: int) -> int:
    return max(LEAST_SHARDS, -(-rows // SHARD_KEYS))


def apply_changes(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None, shards: int = LEAST_SHARDS) -> DataFrame:
    """The index (``KEYS`` rows) after inserting and then deleting rows of ``digests``.

    Deleting takes live copies away; a digest keeps its entry until its last copy goes. An entry
    whose best row goes is stale (points ``STALE``) until ``reelected``. The number of shards belongs
    to an index and must stay the same for it.
    """
    changes = _changes(inserts, shards).withColumn("gone", F.lit(False))
    if deletes is not None:
        changes = changes.union(_changes(deletes, shards).withColumn("gone", F.lit(True)))

    def run(store: CuckooIndex, pdf: pd.DataFrame) -> CuckooIndex:
        for gone in (False, True):
            part = pdf[pdf["gone"] == gone]
            for d, n, p, i in zip(part["digest"], part["copies"], part["points"], part["doc_id"].astype(object)):
                if gone:
                    store.delete(d, n, p, none_or_int(i))
                else:
                    store.insert(d, n, p, none_or_int(i))
        return store

    if index is None:
        def alone(key, pdf):
            return run(CuckooIndex(), pdf).rows(key[0])
        return changes.groupBy("shard").applyInPandas(alone, KEYS)

    def onto(key, old, pdf):
        return run(CuckooIndex.of_rows(old), pdf).rows(key[0])
    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(onto, KEYS)


def reelected(index: DataFrame, live: DataFrame) -> DataFrame:
    """The index with the best row of every stale entry, from the ``digests`` rows that are live now.

    Rows of stale digests alone are aggregated, combined before the shuffle.
    """
    stale = index.where(F.col("points") == STALE).select(F.col("digest").alias("d"))
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("minus")))
    again = live.join(stale, live["digest"] == stale["d"], "left_semi").groupBy("digest").agg(best.alias("b")).select(
        F.col("digest").alias("d"), F.col("b.points").alias("p"), (-F.col("b.minus")).alias("i"))
    joined = index.join(again, index["digest"] == again["d"], "left")
    return joined.select("shard", "digest", "copies", F.coalesce("p", "points").alias("points"),
                         F.when(F.col("d").isNotNull(), F.col("i")).otherwise(F.col("keep_id")).alias("keep_id"), "log2", "slots")


def _winners(found: DataFrame) -> DataFrame:
    live = apply_changes(None, found, shards=shards_for(found.count())).where("digest IS NOT NULL")
    return live.select("digest", "copies", F.col("points").alias("keep_points"), "keep_id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest id. Rows that tie
    in both (repeated rows with one id) are all marked as kept.
    """
    found = staged(digests(docs, id_col, text_col), "digests")
    return found.join(_winners(found), "digest").select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of each group. Of repeated
    rows with the id and length that stay, the one with the smallest text does."""
    found = staged(digests(docs, id_col, text_col), "digests")

    def key(digest: Column, points: Column, doc: Column) -> Column:
        return F.unhex(F.sha2(F.concat_ws(":", F.hex(digest), points.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))), 256))
    t = text_of(text_col)
    own = key(F.unhex(F.sha2(F.regexp_replace(t, f"{WHITE}+", ""), 256)), F.length(t), id_of(id_col))
    winners = _winners(found).select(key(F.col("digest"), F.col("keep_points"), F.col("keep_id")).alias("key"))
    return elected(docs, own, winners, [t])
