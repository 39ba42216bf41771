"""WARC archives in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each with whole WARC records, and a skippable frame
at the end with the seek table: compressed size, plain size and checksum of every frame. Writing returns
the index: for every record its bundle, frame, and the record's offset inside the frame. Reading goes
through the seek table, whole bundles or single records.

Of records with equal payloads one holds the payload (type response, the largest id); the others
are revisits that name it. Payloads are equal when length and SHA-1 are.

Defined results: null html is an empty payload; a null url gets ``urn:page:<id>`` as its target; control
characters and white space in urls are percent-encoded; rows without an id are records named ``null``,
revisits unless no equal record has an id; repeated rows that share the largest id are all responses; an empty
table gives no bundle and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import files
from .common import staged, tasks_for, work_dir

FRAME = 256 << 10  # plain bytes after which a frame ends
BUNDLE = 64 << 20  # compressed bytes after which a bundle ends
STRETCH = 64  # frames that are read back together
LEAST = 0  # payloads shorter than this are never revisited
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no date

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = "path string, frame int, record_id string, start long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # One row per payload that repeats: combined before the shuffle, and small beside the pages.
    groups = rows.groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least))
    joined = rows.join(groups, ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    value = record[len("<urn:page:"):-1]
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else record_id(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> list[dict]:
    """The records of a frame; digests of payloads are verified."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        body = raw[end + 4:end + 4 + size]
        http, _, payload = body.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != length or b32(hashlib.sha1(payload).hexdigest()) != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its header")
        refers = head.get("WARC-Refers-To")
        out.append({"page_id": page_of(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload": payload, "payload_bytes": length, "payload_digest": digest,
                    "record_type": head["WARC-Type"], "refers_to": page_of(refers) if refers else None})
        at = end + 4 + size + 4
    return out


def b32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


class Bundle:
    """An open bundle: frames as they come, the seek table at the end."""

    def __init__(self, folder: str, level: int = LEVEL):
        import zstandard
        self.path, self.out = files.new_file(folder, ".warc.zst")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.table: list[tuple[int, int, int]] = []
        self.size = 0

    def frame(self, records: list[bytes]) -> None:
        from xxhash import xxh64_intdigest
        raw = b"".join(records)
        packed = self.pack(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxh64_intdigest(raw, 0) & 0xFFFFFFFF))
        self.size += len(packed)

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, path: str):
        import zstandard
        self.file = files.read_at(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & CHECKSUMS else 8
        self.entries = list(struct.iter_unpack("<III" if width == 12 else "<II", self._at(size - 9 - n * width, n * width)))
        self.starts = [0]
        for e in self.entries:
            self.starts.append(self.starts[-1] + e[0])
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        from xxhash import xxh64_intdigest
        raw = self.unpack(self._at(self.starts[k], self.entries[k][0]), max_output_size=self.entries[k][1])
        if len(self.entries[k]) > 2 and xxh64_intdigest(raw, 0) & 0xFFFFFFFF != self.entries[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return raw


def write_bundles(pages: DataFrame, folder: str | None = None, frame: int = FRAME, bundle: int = BUNDLE, **columns) -> DataFrame:
    """Write ``roles`` of pages into bundles; the index, itself written to the shared folder."""
    folder = folder or files.new_folder(work_dir(pages.sparkSession), "warc")

    def run(batches):
        b, held, plain, index = None, [], 0, []

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                              ["path", "frame", "record_id", "start", "length"])
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                b = b or Bundle(folder)
                raw = record(page, url, payload, b32(digest), refers)
                index.append((b.path, len(b.table), record_id(page), plain, len(raw)))
                held.append(raw)
                plain += len(raw)
                if plain >= frame:
                    b.frame(held)
                    held, plain = [], 0
                    if b.size >= bundle:
                        b.close()
                        yield rows()
                        b, index = None, []
        if b:
            if held:
                b.frame(held)
            b.close()
            yield rows()
    return staged(roles(pages, **columns).mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``RECORD`` rows of every record of the bundles that an index names, by stretches of frames."""
    def run(batches):
        reader, path = None, None
        for b in batches:
            for name, part in zip(b.column("path").to_pylist(), b.column("part").to_pylist()):
                if name != path:
                    reader, path = Reader(name), name
                for k in range(part * stretch, min((part + 1) * stretch, len(reader.entries))):
                    yield pa.RecordBatch.from_pylist([{c: x[c] for c in FIELDS.names} for x in parse(reader.frame(k))], FIELDS)
    parts = index.groupBy("path", F.expr(f"frame div {stretch}").alias("part")).agg(F.sum("length").alias("size"))
    plain = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # A row is a few bytes here and megabytes in a task: the number of tasks is given.
    dealt = parts.repartitionByRange(tasks_for(index.sparkSession, plain, stretch * FRAME), "path", "part").sortWithinPartitions("path", "part")
    return dealt.select("path", "part").mapInArrow(run, RECORD)


FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(wanted: DataFrame) -> DataFrame:
    """``(record_id, page_id, url, payload)`` of single index rows: only their frames are read."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = Reader(r["path"]).frame(r["frame"])[r["start"]:r["start"] + r["length"]]
                x = parse(raw)[0]
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"]]), pa.array([x["page_id"]], pa.int64()), pa.array([x["url"]]), pa.array([x["payload"]], pa.binary())],
                                                 ["record_id", "page_id", "url", "payload"])
    return wanted.select("path", "frame", "record_id", "start", "length").mapInArrow(run, "record_id string, page_id long, url string, payload binary")


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write every page and read the archives back: one ``RECORD`` row per page."""
    return read_bundles(write_bundles(pages, **columns))
