"""Token-id files: the code against plain Huffman, the files against the library."""

import heapq
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from candlewick.llm import common, huffman

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(huffman.VOCABULARY)


def wanted(rows):
    """doc_id, start, n_tokens, ids_crc32 of rows (doc_id, text) in order."""
    out, start = [], 0
    for doc, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, huffman.END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_lengths_are_best_and_limited():
    rng = np.random.default_rng(2)
    for n in (2, 3, 9, 400):
        counts = np.zeros(1000, dtype=np.int64)
        counts[rng.choice(1000, n, replace=False)] = (rng.pareto(1.2, n) * 9).astype(int) + 1
        lengths = huffman.code_lengths(counts, 30)
        heap, best = [int(c) for c in counts if c], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            best += (both := heapq.heappop(heap) + heapq.heappop(heap))
            heapq.heappush(heap, both)
        assert (counts * lengths).sum() == best and ((lengths > 0) == (counts > 0)).all()
        short = huffman.code_lengths(counts, 10)
        assert short.max() <= 10 and np.isclose((0.5 ** short[short > 0].astype(float)).sum(), 1.0)
    growing = np.array([1 << k for k in range(12)])
    assert huffman.code_lengths(growing, 30).max() == 11 and huffman.code_lengths(growing, 4).tolist() == sorted(huffman.code_lengths(growing, 4), reverse=True)
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17, dtype=np.int64), 4)


def test_codes_are_canonical_prefixes():
    lengths = huffman.code_lengths(np.array([5, 0, 1, 1, 9, 3]), 8)
    codes = huffman.canonical_codes(lengths)
    words = [f"{int(c):0{n}b}" for c, n in zip(codes, lengths) if n]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    order = sorted((n, i) for i, n in enumerate(lengths) if n)
    assert [words_i for words_i in (f"{int(codes[i]):0{n}b}" for n, i in order)] == sorted(words, key=lambda w: (len(w), w))


def test_bits_come_back_from_any_checkpoint():
    rng = np.random.default_rng(3)
    for n_ids, n in ((1, 700), (2, 1), (300, 5000), (300, huffman.STEP), (300, huffman.STEP + 1)):
        ids = rng.integers(0, n_ids, n)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=n_ids))
        raw, checkpoints = huffman.pack(ids, lengths, huffman.canonical_codes(lengths))
        table = huffman.decoding_table(lengths)
        assert (huffman.unpack(raw, n, checkpoints, table) == ids).all()
        assert (huffman.unpack(raw, n // 2, checkpoints, table) == ids[:n // 2]).all() if n > 1 else True


def test_parts_of_texts_encode_like_the_whole():
    coder = huffman.Encoder(LIBRARY.to_str())
    texts = ["", " ", "a", " a", "a b", "a  b", "a   b \n c", "a\n b", "a\n  b\t c ", "x   y", "  z", "it's we'll 12 3,4...  ", "\x1c q\x85 r", "<|endoftext|> b <|endoftext|>",
             "\U0001f642 ß", "\n\n  \n a", "tab\t tab", "end \n", "﻿ x", "a​ b", "w" * 3000 + " x"]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(r, dtype=coder.kind).tolist() for r in coder.encode(texts)]
        assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_hostile_rows(hostile, nothing):
    rows = sorted(((r["doc_id"], r["text"]) for r in hostile.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in huffman.token_files(hostile).collect() if r["doc_id"] is not None}
    want = wanted(rows)
    assert got == {(d, n, c): s for d, s, n, c in want if d is not None and d != 11} | {k: v for k, v in got.items() if k[0] == 11}
    every = sorted(tuple(r) for r in huffman.token_files(hostile).select("start", "n_tokens").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(every, every[1:])) and len(every) == len(rows)  # no gap, no overlap
    assert huffman.token_files(nothing).count() == 0


def test_documents_over_blocks_and_files(spark):
    rows = [(i, " ".join(f"w{(i * j) % 91}" for j in range((i * 37) % 211))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = huffman.write_ids(docs, block=100, file_bytes=1000)
    assert index.select("path").distinct().count() > 3 and index.where("block > 1").count() > 0 and index.where("docs = 0").count() > 0
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())) for r in huffman.read_ids(index).collect())
    assert got == wanted(rows)
    assert huffman.placed(index, chunk=1).groupBy().sum("start").first() == huffman.placed(index).groupBy().sum("start").first()


def test_query_against_the_library(spark):
    from candlewick.llm.queries import op13_token_files
    docs = common.table(spark, SF, "documents").orderBy("doc_id").collect()
    assert sorted(map(tuple, op13_token_files(spark, SF).collect())) == wanted([(r["doc_id"], r["text"]) for r in docs])
