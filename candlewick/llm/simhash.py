"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits, cut into five blocks. Two fingerprints that differ in at most two bits
agree in at least three blocks, so every choice of three blocks is a join key; joined pairs are
verified by their Hamming distance. A bucket of more than ``BUCKET`` fingerprints is not paired:
its fingerprints are filed under every value at most one bit away. Two of them are within two
bits exactly when they share such a value, no value has more than 65 of them, and the work is
linear however large the bucket is. Equal fingerprints are one node before any of this. Links take one
or two bits; more are refused, as the filing of large buckets is exact up to two.

Defined results: null text is empty text; a text without words has fingerprint zero and links
like any other; a null id never names a component while another id is there; repeated rows are
equal fingerprints; further columns are ignored by ``near_components`` and kept by ``kept_rows``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, elected, id_of, row_key, staged, text_of

WORDS = 3  # of a shingle
BITS = 2  # largest distance of a link
BUCKET = 32  # largest bucket whose pairs are emitted
SEED = 42
CHUNK = 1 << 16  # shingles counted at once


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits: bit i is 1 when over half of the shingles' XXH64 values have it."""
    from xxhash import xxh64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    shingles = (b" ".join(s) for s in zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter((b" ".join(w),))
    n, counts = max(1, len(w) - words + 1), np.zeros(64, dtype=np.int64)
    for done in range(0, n, CHUNK):
        size = min(CHUNK, n - done)
        h = np.fromiter((xxh64_intdigest(s, SEED) for _, s in zip(range(size), shingles)), dtype="<u8", count=size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, key, fp)``; fp holds the 64 bits as a signed long, key tells id and text."""
    def run(batches):
        for b in batches:
            f = [fingerprint(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(np.array(f, dtype=np.uint64).view(np.int64))], ["doc_id", "key", "fp"])
    rows = docs.select(id_of(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key binary, fp long")


def block_masks(bits: int = BITS) -> list[int]:
    """Masks (signed) of every choice of three among ``bits + 3`` blocks: one of them holds no differing bit."""
    n = bits + 3
    edges = [round(64 * i / n) for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [sum(c) for c in combinations(blocks, n - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _members(nodes: DataFrame, bits: int) -> DataFrame:
    """``(t, key, fp, n)`` for every bucket that more than one fingerprint shares."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(bits))])
    keyed = nodes.select("fp", F.explode(masks).alias("b")).select("b.t", "b.key", "fp")
    shared = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(shared, ["t", "key"])


def _flips(hot: DataFrame, bits: int) -> DataFrame:
    """``(fp, key)`` with at most 65 fingerprints per key, all within ``bits`` of each other."""
    at = "transform(sequence(0, 63), i -> {})"
    if bits == 2:  # every value at most one bit away
        keys = "concat(array(named_struct('place', 0, 'value', fp)), " + at.format("named_struct('place', 0, 'value', fp ^ shiftleft(1L, i))") + ")"
    else:  # one bit, named, left out
        keys = at.format("named_struct('place', i, 'value', fp & ~shiftleft(1L, i))")
    return hot.select("fp", F.explode(F.expr(keys)).alias("key"))


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp`` that connect exactly what pairs within
    ``bits`` differing bits connect. ``bits`` is 1 or 2."""
    if bits not in (1, 2):
        raise ValueError("large buckets are exact for one or two bits")
    m = staged(_members(nodes, bits), "blocks")
    few = m.where(F.col("n") <= bucket)
    a, b = few.select("t", "key", F.col("fp").alias("u")), few.select("t", "key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = a.join(b, ["t", "key"]).where((F.col("u") > F.col("v")) & near).select("u", "v")
    hot = m.where(F.col("n") > bucket).select("fp").distinct()
    around = _flips(hot, bits).groupBy("key").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    star = around.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where((F.col("u") > F.col("v")) & near)
    return pairs.union(star).distinct()


def rooted(found: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``(fp, root)``: the smallest fingerprint that each one reaches."""
    nodes = staged(found.select("fp").distinct(), "nodes")
    tree = staged(components(links(nodes, bits, bucket)), "roots")
    return nodes.join(tree, nodes["fp"] == tree["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS,
                    bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (the smallest id reachable)."""
    found = staged(fingerprints(docs, id_col, text_col, words).select("doc_id", "fp"), "fingerprints")
    roots = rooted(found, bits, bucket)
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(roots, "fp")
    lowest = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return found.join(first.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """``near_components`` with the fingerprint as 16 lower-case hex digits."""
    return near_components(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component, that with the
    smallest id (null last); of several with that id the one whose id and text have the smallest hash."""
    found = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    best = found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    winners = best.join(rooted(found, bits, bucket), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.key")
    return elected(docs, row_key(id_col, text_col), winners, [])
