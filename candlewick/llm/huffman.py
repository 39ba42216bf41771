"""Token ids in canonical length-limited Huffman files.

The counts of all ids give one code: lengths by package-merge, at most ``LIMIT`` bits, codes in
order of length and id. A file holds the lengths, then blocks, then a table of its blocks. A block
stands alone: how many of its ids belong to a document that began earlier, the documents that
begin in it (id and length), the bit offset of every ``STEP``-th id, and the bits. Decoding looks
up ``longest`` bits at a time in one table, for all checkpoints of a block at once.

Documents are range-partitioned and sorted by id, so files follow one another in that order;
running sums over files and blocks give the number of ids before every document. A block is read
by the task that it is dealt to, which goes on into later blocks only for the rest of its last
document.

Texts are cut where a space follows a character that is no white space. No piece of a byte-level
vocabulary crosses such a place, so the library's model merges the letters of each distinct part
once, while it is remembered.

Defined results: null and empty texts are the end id alone; the string of a special token in a
text is that token, as the library reads it; a null id comes last; rows that share an id are in
order of their text's XXH64, equal rows in any order; an empty table writes no file and gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import files
from .common import id_of, staged, tasks_for, text_of, work_dir
from .tokencount import PATTERN

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END = 0  # appended to every document
LIMIT = 18  # bits of the longest code
STEP = 256  # ids between two checkpoints
BLOCK = 1 << 18  # ids of a block
FILE = 1 << 27  # bytes after which a file ends
CACHE = 600_000  # parts of texts a task remembers, twice
MARKS = frozenset(".,;:!?)")  # behind a word they are pieces of their own
MAGIC = b"CWHUFF01"

TOKENS = "doc_id long, h long, ids binary, sym int, n long"
INDEX = "part int, seq int, path string, block int, ids long, docs long"


# -- the code

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of every id (0 for ids that don't occur): the best prefix code of at most ``limit`` bits.

    Package-merge. Leaves enter each merge in order of weight, so a level takes a prefix of them.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    now, levels = leaves, []
    for _ in range(limit - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        now = both[rank]
    take, own = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in levels[::-1]:
        n = int(is_leaf[:take].sum())
        own[:n] += 1
        take = 2 * (take - n)
    own[:take] += 1
    lengths[order] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): each is one more than the last, shifted to its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        place = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]])
        codes[order] = place >> (top - size)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length of the code that each string of ``longest`` bits begins with, and ``longest``."""
    top = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (top - lengths[order].astype(np.int64))
    fill = (1 << top) - int(width.sum())  # a single code leaves half of the table unused
    ids = np.concatenate([np.repeat(order, width), np.zeros(fill, dtype=np.int64)])
    return ids.astype(np.int32), lengths[ids].astype(np.uint8), top


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` in bytes, and the bit offset of every ``step``-th id."""
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size)
    start = end - size
    word, last = start >> np.uint64(6), (end - np.uint64(1)) >> np.uint64(6)
    free = np.uint64(64) - (start & np.uint64(63))
    c = codes[ids]
    inside = size <= free
    high = np.where(inside, c << (free - np.minimum(size, free)), c >> (size - np.minimum(size, free)))
    firsts = np.flatnonzero(np.diff(word, prepend=word[:1] - np.uint64(1)))  # codes are shorter than a word: one starts in each
    words = np.zeros(int(last[-1]) + 1, dtype=np.uint64)
    words[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
    over = np.flatnonzero(~inside)
    words[last[over]] |= c[over] << (np.uint64(64) - (size[over] - free[over]))
    return words.astype(">u8").tobytes(), start[::step].astype(np.int64)


def unpack(raw: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int], step: int = STEP) -> np.ndarray:
    """The first ``n`` ids of a block, all checkpoints side by side."""
    ids, sizes, top = table
    lanes = -(-n // step)
    b = np.frombuffer(raw + bytes(8), dtype=np.uint8).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    at, out = checkpoints[:lanes].copy(), np.empty((step, lanes), dtype=np.int32)
    mask, last = (1 << top) - 1, len(window) - 1
    for k in range(step):
        # Lanes that are through read on, harmlessly, inside the block.
        code = window[np.minimum(at >> 3, last)] >> (32 - top - (at & 7)).astype(np.uint32) & mask
        out[k] = ids[code]
        at += sizes[code]
    return out.T.ravel()[:n]


# -- texts to ids

def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable,
    else the next letter from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory(dict):
    """What ``make`` gives for a key. Of more than ``most`` keys the older ones are forgotten."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of texts as raw integers, from the tokenizers library."""

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(vocabulary)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters, self.merge = byte_letters(), self.library.model.tokenize
        self.pieces = regex.compile(PATTERN).findall
        self.spaced, self.bare = Memory(self._spaced), Memory(self._bare)  # parts behind a space, and others
        self.blank = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S)(?= )").split

    def _one(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelt = piece.replace(" ", self.letters[32])
        else:
            spelt = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array("H" if self.kind.itemsize == 2 else "I", [t.id for t in self.merge(spelt)]).tobytes()

    def _spaced(self, part: str) -> bytes:
        if part.isalpha():
            return self._one(f" {part}")
        if part[-1:] in MARKS and part[:-1].isalpha():
            return self.spaced[part[:-1]] + self.bare[part[-1]]
        first, *rest = self.pieces(f" {part}")
        if not rest:
            return self._one(first)
        return (self.spaced[first[1:]] if len(first) > 1 and first[0] == " " else self.bare[first]) + b"".join([self.bare[p] for p in rest])

    def _bare(self, part: str) -> bytes:
        found = self.pieces(part)
        return self._one(part) if len(found) == 1 else b"".join([self.bare[p] for p in found])

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if self.blank(text) is None:
            first, *rest = text.split(" ")
        else:
            first, *rest = self.cut(text)
            rest = [x[1:] for x in rest]
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]


_CODER: list[tuple[int, Encoder]] = []


def coder_of(vocabulary: str) -> Encoder:
    """The encoder of this worker process: later tasks go on with what it remembers."""
    mark = hash(vocabulary)
    if not _CODER or _CODER[0][0] != mark:
        _CODER[:] = [(mark, Encoder(vocabulary))]
    return _CODER[0][1]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, h, ids (raw integers, the end id included), n; then one row per
    id that a task has met: sym, n."""
    with open(vocabulary, encoding="utf-8") as f:  # on the driver only; bounded by the vocabulary
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        coder = coder_of(sent.value)
        kind = coder.kind
        closing = np.array([end], dtype=kind).tobytes()
        counts = np.zeros(max(coder.library.get_vocab_size(), end + 1), dtype=np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                raw = [r + closing for r in coder.encode(part.column("text").to_pylist())]
                counts += np.bincount(np.frombuffer(b"".join(raw), dtype=kind), minlength=len(counts))
                none = pa.nulls(len(raw), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(raw, pa.binary()), none,
                                                  pa.array([len(r) // kind.itemsize for r in raw], pa.int64())], FIELDS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.binary()),
                                          pa.array(met.astype(np.int32)), pa.array(counts[met])], FIELDS)
    rows = docs.select(id_of(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, TOKENS)


FIELDS = [c.split()[0] for c in TOKENS.split(", ")]


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: one number per id of the vocabulary."""
    found = tokens.where("sym IS NOT NULL").groupBy("sym").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["sym"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["sym"]] = r["n"]
    return counts


# -- files

class Writer:
    """An open file: blocks as ids come, the block table at the end."""

    def __init__(self, folder: str, lengths: np.ndarray, codes: np.ndarray, block: int):
        self.path, self.out = files.new_file(folder, ".huff")
        self.lengths, self.codes, self.block = lengths, codes, block
        head = zlib.compress(lengths.tobytes())
        self._put(MAGIC + struct.pack("<II", len(lengths), len(head)) + head)
        self.table: list[tuple[int, int, int]] = []  # bytes, ids, documents
        self._fresh(0)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)

    def _fresh(self, open_ids: int) -> None:
        self.held, self.n, self.docs, self.open = [], 0, [], open_ids

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        at = 0
        while at < len(ids):
            some = ids[at:at + self.block - self.n]
            self.held.append(some)
            self.n += len(some)
            at += len(some)
            if self.n == self.block:
                self.flush(len(ids) - at)

    def flush(self, open_ids: int = 0) -> None:
        if not self.n:
            return
        bits, checkpoints = pack(np.concatenate(self.held), self.lengths, self.codes)
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        named = np.array([d is not None for d, _ in self.docs], dtype=np.uint8)
        sizes = np.array([n for _, n in self.docs], dtype="<i8")
        raw = b"".join([struct.pack("<IIQ", self.n, len(self.docs), min(self.open, self.n)), ids.tobytes(), sizes.tobytes(), named.tobytes(),
                        checkpoints.astype("<u4").tobytes(), bits])
        self._put(raw)
        self.table.append((len(raw), self.n, len(self.docs)))
        self._fresh(open_ids)

    def size(self) -> int:
        return sum(t[0] for t in self.table)

    def close(self) -> list[tuple[str, int, int, int]]:
        self.flush()
        raw = b"".join(struct.pack("<QQQ", *t) for t in self.table)
        self._put(raw + struct.pack("<I", len(self.table)) + MAGIC)
        self.out.close()
        return [(self.path, i, n, d) for i, (_, n, d) in enumerate(self.table)]


class Reader:
    """Blocks of a file by number."""

    def __init__(self, path: str):
        self.file = files.read_at(path)
        size = self.file.size()
        n, magic = struct.unpack("<I8s", self._at(size - 12, 12))
        start, symbols, packed = struct.unpack("<8sII", self._at(0, 16))
        if magic != MAGIC or start != MAGIC:
            raise ValueError(f"{path} is no file of Huffman codes")
        self.table = list(struct.iter_unpack("<QQQ", self._at(size - 12 - 24 * n, 24 * n)))
        self.codes = decoding_table(np.frombuffer(zlib.decompress(self._at(16, packed)), dtype=np.uint8)[:symbols])
        self.starts = np.cumsum([16 + packed, *[t[0] for t in self.table]]).tolist()
        self.firsts = np.cumsum([0, *[t[1] for t in self.table]]).tolist()  # ids before each block

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def block(self, k: int, most: int | None = None) -> tuple[np.ndarray, list[tuple[int | None, int]], int]:
        """The ids of block ``k`` (the first ``most``), the documents that begin in it, and how many
        of its ids belong to an earlier one."""
        raw = self._at(self.starts[k], self.table[k][0])
        n, docs, open_ids = struct.unpack_from("<IIQ", raw)
        at = 16
        ids, sizes = (np.frombuffer(raw, dtype="<i8", count=docs, offset=at + 8 * docs * i).tolist() for i in (0, 1))
        named = raw[at + 16 * docs:at + 17 * docs]
        at += 17 * docs
        lanes = -(-n // STEP)
        checkpoints = np.frombuffer(raw, dtype="<u4", count=lanes, offset=at).astype(np.int64)
        found = unpack(raw[at + 4 * lanes:], n if most is None else min(n, most), checkpoints, self.codes)
        return found, [(d if ok else None, s) for d, ok, s in zip(ids, named, sizes)], open_ids

    def documents(self, k: int):
        """``(doc_id, place, ids)`` of the documents that begin in block ``k``; place counts ids of the file."""
        ids, docs, at = self.block(k)
        for doc, size in docs:
            own, more = [ids[at:at + size]], k + 1
            left = size - len(own[0])
            while left:
                own.append(self.block(more, left)[0])
                left -= len(own[-1])
                more += 1
            yield doc, self.firsts[k] + at, np.concatenate(own)
            at += size


def write_ids(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None, end: int = END, limit: int = LIMIT, block: int = BLOCK,
              file_bytes: int = FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents into files in order of their ids; the index of blocks, itself written to the shared folder."""
    spark = docs.sparkSession
    folder = folder or files.new_folder(work_dir(spark), "ids")
    tokens = staged(tokenised(docs, vocabulary, end, id_col, text_col), "tokens")
    counts = id_counts(tokens)
    lengths = code_lengths(counts, limit)
    codes = canonical_codes(lengths)
    raw_bytes = 2 * int(counts.sum())

    def run(batches):
        from pyspark import TaskContext
        part, out, found = TaskContext.get().partitionId(), None, []

        def done(seq):
            return [(part, seq, *x) for x in out.close()]
        seq = 0
        for b in batches:
            for doc, raw, n in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("n").to_pylist()):
                out = out or Writer(folder, lengths, codes, block)
                buffer = raw.as_buffer()
                out.add(doc, np.frombuffer(buffer, dtype=f"<u{len(buffer) // n}"))
                if out.size() >= file_bytes:
                    found += done(seq)
                    out, seq = None, seq + 1
        if out:
            found += done(seq)
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        columns = zip(*found) if found else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in INDEX.split(", ")])

    # Equal ids may hold a third of all rows: the text's hash, then the row's own number go on ordering them.
    rows = tokens.where("sym IS NULL").withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("row")]
    dealt = rows.repartitionByRange(tasks_for(spark, raw_bytes, file_bytes), *order).sortWithinPartitions(*order)
    return staged(dealt.select("doc_id", "ids", "n").mapInArrow(run, INDEX), "id-files")


def placed(index: DataFrame, chunk: int = 1000) -> DataFrame:
    """The blocks of an index with ``start``: how many ids all files before theirs hold.

    Sums run inside chunks of partitions and over the chunks.
    """
    per = index.groupBy("part", "seq").agg(F.sum("ids").alias("n")).withColumn("chunk", F.expr(f"part div {chunk}"))
    sums = per.groupBy("chunk").agg(F.sum("n").alias("n"))
    before = sums.select("chunk", (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("chunk").orderBy("part", "seq")) - F.col("n")
    starts = per.withColumn("inside", inside).join(before, "chunk").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    return index.join(starts, ["part", "seq"])


def read_ids(index: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens of every document of the files, and its ids (with ``digests``: their CRC-32 only)."""
    last = ("ids_crc32", pa.int64()) if digests else ("ids", pa.list_(pa.int32()))

    def run(batches):
        reader, path = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["path"] != path:
                    reader, path = Reader(r["path"]), r["path"]
                rows = [(doc, r["start"] + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int32))
                        for doc, place, ids in reader.documents(r["block"])]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 1000]), (pa.int64(), pa.int64(), pa.int64(), last[1]))],
                                                     ["doc_id", "start", "n_tokens", last[0]])
    spark = index.sparkSession
    size = index.agg(F.coalesce(F.sum("ids"), F.lit(0))).first()[0]
    # A few bytes here are a block in a task: the number of tasks is given, so they stay apart.
    dealt = placed(index).where("docs > 0").repartitionByRange(tasks_for(spark, 2 * size, 16 << 20), "path", "block").sortWithinPartitions("path", "block")
    return dealt.select("path", "block", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids array<int>'}")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of every document and read the files back: doc_id, start, n_tokens, ids_crc32."""
    return read_ids(write_ids(docs, **options), digests=True)
