"""Vector code compression: codebooks per part of a vector, with norm-of-sum bounds.

Every vector is cut into ``PARTS`` equal parts; a part becomes the number of the nearest entry of
its position's codebook. Codebooks are fitted by rounds of exact assignment and floored means.

For every part a task keeps its entry, an upper bound of the distance to it and a lower bound of the
distance to any other entry, each stamped with the round it was measured in. All codebooks so far
are retained, so a bound of round s holds in round t after adding (taking away) the net
displacement of the entry between s and t, which is never more than the sum of the rounds' drifts. Only
where the bounds meet is the distance to the own entry measured, and only where they still meet
are all entries scanned again.

Vectors are written once, in packs, to files in the shared folder; a round reads them there and writes
the bounds and, per pack, by how much the sums of entries change. The driver holds the codebooks and
those sums: ``parts * entries`` rows, however long the table is.

Defined results: null vectors and vectors with null or non-finite components are dropped; a vector that
is shorter than the longest has zeros behind, and so has every vector when the width does not divide into
parts; components beyond the range of a long saturate, and so do errors; rows that share an id start
codebooks in order of their components, null ids come last; fewer rows than entries give smaller codebooks;
null labels are one label; repeated rows get equal answers; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import files
from .common import staged, tasks_for, work_dir
from .topk import quantised

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
PACK = 1 << 15  # vectors of a pack
MOST = (1 << 63) - 1
SLACK = 1e-9  # relative, for what bounds lose in floating point

PACKS = "path string, start long, head long, size long, kind string, n long"
STATE = PACKS + ", state binary, scanned long, change array<string>"


def vectors_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & ~bad)


# -- packs in files

def write_packs(vectors: DataFrame, width: int, scale: int = SCALE, size: int = PACK, folder: str | None = None) -> DataFrame:
    """Quantised vectors with ids and labels in files; one row per pack."""
    folder = folder or files.new_folder(work_dir(vectors.sparkSession), "vectors")

    def run(batches):
        path, out, held, n = None, None, [], 0

        def done():
            ids, labels, x = (f([h[i] for h in held]) for i, f in enumerate((pa.concat_arrays, pa.concat_arrays, np.concatenate)))
            kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or (x.min(initial=0) >= np.iinfo(k).min and x.max(initial=0) <= np.iinfo(k).max))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("vec_id", pa.int64()), ("label", pa.string())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids, labels], ["vec_id", "label"]))
            head, body, start = sink.getvalue().to_pybytes(), x.astype(kind).tobytes(), out.tell()
            out.write(head + body)
            return pa.RecordBatch.from_pylist([{"path": path, "start": start, "head": len(head), "size": len(body), "kind": kind, "n": len(x)}])
        for b in batches:
            for k in range(0, b.num_rows, size):
                s = b.slice(k, size)
                good, x = quantised(s.column(2), scale)
                if not len(good):
                    continue
                if out is None:
                    path, out = files.new_file(folder, ".vectors")
                if n and n + len(x) > size:
                    yield done()
                    held, n = [], 0
                held.append((s.column(0).take(pa.array(good)), s.column(1).take(pa.array(good)), np.pad(x, ((0, 0), (0, width - x.shape[1])))))
                n += len(x)
        if held:
            yield done()
        if out is not None:
            out.close()
    return staged(vectors.select("vec_id", "label", "v").mapInArrow(run, PACKS), "vector-packs")


def read_pack(row: dict, names: bool = False):
    """The matrix of a pack; with ``names`` its ids and labels too."""
    f = files.read_at(row["path"])
    f.seek(row["start"])
    raw = f.read(row["head"] + row["size"])
    x = np.frombuffer(raw, dtype=row["kind"], offset=row["head"]).reshape(row["n"], -1)
    return (x, pa.ipc.open_stream(raw[:row["head"]]).read_all()) if names else x


# -- bounds

def exact_kind(*arrays: np.ndarray) -> type:
    """float64 where it holds every squared distance exactly, else Python integers."""
    most = max(max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0)))) for a in arrays)
    return np.float64 if 4 * arrays[0].shape[-1] * most * most < 1 << 53 else object


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exactly."""
    if x.dtype == np.float64:
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    out = np.zeros((len(x), len(entries)), dtype=object)
    for k in range(0, len(x), 1024):
        d = x[k:k + 1024, None, :] - entries[None]
        out[k:k + 1024] = (d * d).sum(axis=2)
    return out


def lengths(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Bounds:
    """The entry of every part, bounds of its distances and the rounds that they were measured in."""

    FIELDS = (("code", "u1"), ("since_up", "u1"), ("since_low", "u1"), ("up", "<f4"), ("low", "<f4"))

    def __init__(self, rows: int, parts: int, raw: bytes | None = None):
        self.new, at = raw is None, 0
        for name, kind in self.FIELDS:
            size = rows * parts * np.dtype(kind).itemsize
            own = np.zeros((parts, rows), dtype=kind) if raw is None else np.frombuffer(raw, dtype=kind, count=rows * parts, offset=at).reshape(parts, rows).copy()
            setattr(self, name, own)
            at += size

    def raw(self) -> bytes:
        return b"".join(getattr(self, name).tobytes() for name, _ in self.FIELDS)

    def assign(self, p: int, x: np.ndarray, history: np.ndarray) -> int:
        """Bring part ``p`` of the rows up to the last of the codebooks ``history`` (round, entry,
        component); how many rows were scanned against all entries."""
        now = len(history) - 1
        kind = exact_kind(x, history)
        books = history.astype(kind)
        entries = books[now]
        if self.new:
            scan = np.arange(len(x))
        else:
            net = lengths(((books - entries) ** 2).sum(axis=2))  # of each entry since each round
            order = np.sort(net, axis=1)
            other = np.where(net == order[:, -1:], order[:, -2:-1] if len(entries) > 1 else 0.0, order[:, -1:])  # the largest of the others
            code, s_up, s_low = self.code[p], self.since_up[p], self.since_low[p]
            up = self.up[p].astype(np.float64) + net[s_up, code]
            low = self.low[p].astype(np.float64) - other[s_low, code]
            close = np.flatnonzero(~(up * (1 + SLACK) < low * (1 - SLACK)))
            d = x[close].astype(kind) - entries[code[close]]
            own = lengths((d * d).sum(axis=1))
            self.up[p][close] = above(own)
            self.since_up[p][close] = now
            scan = close[~(own * (1 + SLACK) < low[close] * (1 - SLACK))]
        if len(scan):
            d = squares(x[scan].astype(kind), entries)
            best = d.argmin(axis=1)  # the lower index of ties
            every = np.arange(len(scan))
            self.code[p][scan] = best
            self.up[p][scan] = above(lengths(d[every, best]))
            second = np.full(len(scan), np.inf)
            if len(entries) > 1:
                second = lengths(np.where(np.arange(len(entries)) == best[:, None], np.inf, d).min(axis=1))
            self.low[p][scan] = below(second)
            self.since_up[p][scan] = self.since_low[p][scan] = now
        return len(scan)


def above(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        f = (x * (1 - SLACK)).astype(np.float32)
    return np.where(np.isinf(x), f, np.maximum(np.nextafter(f, np.float32(-np.inf)), np.float32(0)))


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> np.ndarray:
    """What each entry's (count, component sums) gain over one round, as exact integers."""
    out = np.zeros((entries, 1 + x.shape[1]), dtype=object)
    moved = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    for sign, code in ((1, after), (-1, before)):
        if code is None or not len(moved):
            continue
        own, kind = code[moved], object if x.dtype == np.int64 else np.int64
        for j in np.unique(own):
            rows = x[moved[own == j]]
            out[j] += sign * np.array([len(rows), *rows.sum(axis=0, dtype=kind).tolist()], dtype=object)
    return out


# -- rounds

def part_of(x: np.ndarray, p: int, parts: int) -> np.ndarray:
    w = x.shape[1] // parts
    return x[:, p * w:(p + 1) * w]


def _round(state: DataFrame, history: np.ndarray, tasks: int) -> DataFrame:
    """``STATE`` rows after assigning every part to the last of ``history`` (round, part, entry, component)."""
    parts, entries = history.shape[1:3]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x = read_pack(r)
                bounds = Bounds(r["n"], parts, r["state"])
                scanned, change = 0, []
                for p in range(parts):
                    before = None if bounds.new else bounds.code[p].copy()
                    scanned += bounds.assign(p, part_of(x, p, parts), history[:, p])
                    change.append(changes(part_of(x, p, parts), before, bounds.code[p], entries))
                r |= {"state": bounds.raw(), "scanned": scanned, "change": [str(v) for v in np.concatenate(change).ravel().tolist()]}
                yield pa.RecordBatch.from_pylist([r], SCHEMA)
    # A row names what a task will read: dealt out evenly, in a given number.
    dealt = state.select(*FIELDS, "state").repartition(tasks)
    return staged(dealt.mapInArrow(run, STATE), "vector-state")


KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
FIELDS = [c.split()[0] for c in PACKS.split(", ")]
SCHEMA = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in STATE.split(", ")])


def first_codebooks(vectors: DataFrame, width: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """(part, entry, component) from the rows with the smallest ids."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    good, x = quantised(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return np.stack([part_of(x, p, parts) for p in range(parts)])


class Model:
    """Codebooks (part, entry, component), the state of every pack, and the share of parts that each
    round scanned against all entries."""

    def __init__(self, codebooks: np.ndarray, history: np.ndarray, state: DataFrame, scanned: list[float], tasks: int):
        self.codebooks, self.history, self.state, self.scanned, self.tasks = codebooks, history, state, scanned, tasks

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, size: int = PACK) -> Model | None:
    """Fit codebooks to ``vectors_of`` rows; None for an empty table."""
    spark = vectors.sparkSession
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    books = first_codebooks(vectors, width, parts, entries, scale)
    entries = books.shape[1]
    packs = write_packs(vectors, width, scale, size)
    rows, raw = packs.agg(F.sum("n"), F.sum("size")).first()
    tasks = tasks_for(spark, raw, 32 << 20)
    state = packs.withColumn("state", F.lit(None).cast("binary"))
    totals = np.zeros((parts, entries, 1 + width // parts), dtype=object)
    history, scanned = [books], []
    for _ in range(rounds):
        state = _round(state, np.stack(history), tasks)
        scanned.append(state.agg(F.sum("scanned")).first()[0] / rows / parts)
        gained = state.select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        flat = totals.ravel()
        for r in gained.collect():
            flat[r["at"]] += int(r["v"])
        totals = flat.reshape(totals.shape)
        books = history[-1].copy()
        for p, j in zip(*np.nonzero(totals[:, :, 0])):
            books[p, j] = totals[p, j, 1:] // totals[p, j, 0]
        if (books == history[-1]).all():  # later rounds would change nothing
            break
        history.append(books)
    return Model(history[-1], np.stack(history), state, scanned, tasks)


def encode(model: Model) -> DataFrame:
    """vec_id, label, code and error of every vector, by the bounds of the last round."""
    history = model.history
    parts = history.shape[1]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x, names = read_pack(r, True)
                bounds = Bounds(r["n"], parts, r["state"])
                error = np.zeros(r["n"], dtype=object)
                for p in range(parts):
                    own = part_of(x, p, parts)
                    bounds.assign(p, own, history[:, p])
                    kind = exact_kind(own, history[-1:, p])
                    d = own.astype(kind) - history[-1, p].astype(kind)[bounds.code[p]]
                    squared = (d * d).sum(axis=1)
                    error = error + (squared if kind is object else squared.astype(np.int64).astype(object))
                code = np.ascontiguousarray(bounds.code.T).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [*(names[c].combine_chunks() for c in ("vec_id", "label")), pa.array([code[2 * parts * i:2 * parts * (i + 1)] for i in range(r["n"])], pa.string()),
                     pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
    return model.state.select(*FIELDS, "state").repartition(model.tasks).mapInArrow(run, CODES)


CODES = "vec_id long, label string, code string, error long"


def decode(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Further column ``vector``: the components that a code stands for, as integers."""
    parts = codebooks.shape[0]

    def run(batches):
        for b in batches:
            code = np.frombuffer(bytes.fromhex("".join(b.column("code").to_pylist())), dtype=np.uint8).reshape(b.num_rows, parts)
            flat = np.concatenate([codebooks[p][code[:, p]] for p in range(parts)], axis=1)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], [*b.schema.names, "vector"])
    return codes.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in codes.dtypes) + ", vector array<long>")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels), codebooks_sha256."""
    model = fit(vectors_of(rows, id_col, vector_col, label_col), **options)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = staged(encode(model), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    per = codes.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    return codes.join(per, codes["label"].eqNullSafe(per["of_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
