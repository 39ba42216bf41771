"""Token counts by scanning flat token files for separators.

A token file is nothing but identifiers, two bytes each, an end-of-document identifier after every
document: no header, no index. Files are cut into blocks of equal size that are scanned
independently; one vectorised comparison finds the separators of a block. What a block leaves
open, the tokens behind its last separator, belongs to the first document of a later block:
running sums over the blocks of a file give every block its place, the number of documents before
it, and the end of the last document before it.

Defined results: null and empty texts are documents of 0 tokens; a text that spells the separator
is ordinary text; tokens behind the last separator of a file are one more document; an empty file
has none; repeated rows are documents of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import files
from .common import id_of, staged, tasks_for, text_of, work_dir

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256  # an identifier that the vocabulary leaves free
KIND = "<u2"
BLOCK = 1 << 22  # bytes scanned together
FILE = 1 << 27  # bytes after which a file ends

# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(vocabulary: bytes):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 file_bytes: int = FILE) -> DataFrame:
    """Tokenise documents into flat files. ``(path, ordinal, doc_id)``: which document stands where."""
    spark = docs.sparkSession
    folder = folder or files.new_folder(work_dir(spark), "tokens")
    with open(vocabulary, "rb") as f:  # on the driver only; bounded by the vocabulary
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(sent.value).encode_ordinary
        path, out, size, ordinal = None, None, 0, 0
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if out is None:
                    path, out = files.new_file(folder, ".tokens")
                    size = ordinal = 0
                raw = np.array([*encode(text), SEPARATOR], dtype=KIND).tobytes()
                out.write(raw)
                size += len(raw)
                rows.append((path, ordinal, doc))
                ordinal += 1
                if size >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))] if rows else
                                             [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["path", "ordinal", "doc_id"])
        if out is not None:
            out.close()
    rows = docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "path string, ordinal long, doc_id long"), "token-files")


def blocks(paths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(path, b, size, first, last, ends)`` per block: tokens; places of the first and last
    separator (null without one); lengths of the documents that begin and end inside."""
    step = block - block % np.dtype(KIND).itemsize

    def cut(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                n = -(-files.read_at(path).size() // step)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n))], ["path", "b"])

    def scan(batches):
        for batch in batches:
            for path, b in zip(batch.column("path").to_pylist(), batch.column("b").to_pylist()):
                f = files.read_at(path)
                f.seek(b * step)
                tokens = np.frombuffer(f.read(step), dtype=KIND)
                at = np.flatnonzero(tokens == SEPARATOR)
                some = len(at) > 0
                yield pa.RecordBatch.from_pylist([{"path": path, "b": b, "size": len(tokens), "first": int(at[0]) if some else None,
                                                   "last": int(at[-1]) if some else None, "inner": (np.diff(at) - 1).tolist()}], SCANNED)
    spark = paths.sparkSession
    names = staged(paths.select("path").distinct(), "paths")
    # A name is a few bytes here, and files or a whole block in a task: the numbers of tasks are given.
    cuts = staged(names.repartitionByRange(max(1, min(names.count(), spark.sparkContext.defaultParallelism)), "path").mapInArrow(cut, "path string, b long"), "cuts")
    return cuts.repartitionByRange(tasks_for(spark, cuts.count() * step, 4 * step), "path", "b").mapInArrow(scan, "path string, b long, size long, first long, last long, inner array<long>")


SCANNED = pa.schema([("path", pa.string()), ("b", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("inner", pa.list_(pa.int64()))])


def documents(scanned: DataFrame) -> DataFrame:
    """``(path, ordinal, n_tokens)`` of every document, from scanned blocks."""
    s = staged(scanned, "blocks")
    before = Window.partitionBy("path").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    placed = s.select("path", "b", "size", "first", "last", (F.size("inner") + F.when(F.col("first").isNotNull(), 1).otherwise(0)).alias("n"))
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last") + 1).over(before), F.lit(0)))
    placed = placed.withColumn("final", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("b"))) == 1)
    firsts = placed.where("first IS NOT NULL").select("path", F.col("done").alias("ordinal"), (F.col("start") + F.col("first") - F.col("open")).alias("n_tokens"))
    inner = placed.select("path", "b", "done").join(s.select("path", "b", F.posexplode("inner").alias("i", "n_tokens")), ["path", "b"]).select(
        "path", (F.col("done") + F.col("i") + 1).alias("ordinal"), "n_tokens")
    end = F.col("start") + F.col("size")
    closed = F.greatest("open", F.coalesce(F.col("start") + F.col("last") + 1, F.lit(0)))
    rest = placed.where(F.col("final") & (end > closed)).select("path", (F.col("done") + F.col("n")).alias("ordinal"), (end - closed).alias("n_tokens"))
    return firsts.union(inner).union(rest)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row: tokenise to flat files, scan them, name the documents."""
    written = write_tokens(docs, vocabulary, None, id_col, text_col)
    return documents(blocks(written, block)).join(written, ["path", "ordinal"]).select("doc_id", "n_tokens")
