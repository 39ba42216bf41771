"""Hard-negative mining by threshold joins over pruned inverted indexes.

For a pack of vectors and a threshold, the dimensions are ordered by energy and cut into segments. The
index of a segment lists the vectors whose norm from this segment on can still lift a score to the
threshold; the dimensions behind are covered by that suffix norm and stay out of the index. A
query adds up partial scores segment by segment and drops a vector as soon as the partial score plus
the product of the remaining norms is below the threshold; what is left is scored in full.

A window asks for the ``k`` best vectors with scores between two limits. Its threshold starts at
the upper limit and is lowered over a bounded sample of vectors until the window is full or the lower
limit is reached. The k-th best of the sample is a lower bound of the k-th best of all, so one
threshold join over every pack then finds the answer exactly.

Positives are found first (window without limits, equal labels), then the windows of negatives
(limits from the positive's score, other labels). Vectors and queries lie in packs in files of the
shared folder; what Spark joins are the names of packs, every query pack with every vector pack
once, and a task holds one of each.

Defined results: rows with a null label, null vector or a null or non-finite component take no part, nor
do labels that are no integers; a vector that is shorter than another has zeros behind; an empty
vector scores 0; components and scores beyond the range of a long saturate; an anchor's own row is no
positive, another row with its id may be; null ids are never anchors and come last among ties;
equal rows count one by one; an anchor without positives, or a positive without a row in its
window, gives no row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import files
from .common import staged, tasks_for, work_dir
from .vectorcodes import read_pack, vectors_of, write_packs

SCALE = 256
EVERY = 100  # ids of anchors
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SEGMENT = 8  # dimensions of an index segment
SAMPLE = 4096  # vectors that thresholds are first lowered over
ASKED = 1 << 12  # anchors of a pack
LAST = np.iinfo(np.int64).max

NAME = "path string, start long, head long, size long, kind string, n long"
POSITIVE = "q_path string, q_start long, q_at int, anchor_id long, positive_id long, positive_score long"
NEGATIVE = POSITIVE + ", window int, negative_id long, negative_score long"


class Index:
    """Inverted lists of the vectors ``x`` for queries whose threshold over norm is ``tau`` or more."""

    def __init__(self, x: np.ndarray, tau: float, segment: int = SEGMENT):
        self.x = x
        energy = (x.astype(np.float64) ** 2)
        self.order = np.argsort(-energy.sum(axis=0), kind="stable")
        cuts = np.arange(0, max(x.shape[1], 1), segment)
        self.segments = [self.order[c:c + segment] for c in cuts]
        per = np.stack([energy[:, s].sum(axis=1) for s in self.segments], axis=1)
        rest = np.sqrt(np.cumsum(per[:, ::-1], axis=1)[:, ::-1])
        self.rest = np.concatenate([rest, np.zeros((len(x), 1))], axis=1)  # norm from each segment on
        self.slack = 1e-9 * float(rest[:, 0].max(initial=0.0))
        self.top = float(rest[:, 0].max(initial=0.0))
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        depth = (rest >= tau - self.slack).sum(axis=1)  # indexed segments of a vector
        self.rows = np.argsort(-depth, kind="stable")  # lists are then prefixes
        self.depth = depth[self.rows]
        for s, dims in enumerate(self.segments):
            n = int((depth > s).sum())
            self.lists.append(x[np.ix_(self.rows[:n], dims)].astype(np.float64))
        self.rest = self.rest[self.rows]
        self.most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))

    def at_least(self, q: np.ndarray, t: float, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the ``allowed`` (boolean per vector) with a score of ``t`` or more."""
        f = q.astype(np.float64)
        per = np.array([(f[s] ** 2).sum() for s in self.segments])
        left = np.append(np.sqrt(np.cumsum(per[::-1])[::-1]), 0.0)  # the query's norm from each segment on
        slack = self.slack * left[0] + 1e-6
        live = np.flatnonzero(allowed[self.rows])
        part = np.zeros(len(live))
        for s, own in enumerate(self.lists):
            listed = np.searchsorted(live, len(own))  # live places inside the list
            if listed:
                part[:listed] += own[live[:listed]] @ f[self.segments[s]]
            behind = np.minimum(self.depth[live], s + 1)
            keep = part + self.rest[live, behind] * left[behind] >= t - slack
            live, part = live[keep], part[keep]
        places = self.rows[live]
        scores = dots(self.x[places], q, self.most)
        good = scores >= t
        return places[good], scores[good]


def dots(x: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Exact inner products, as integers."""
    if most * max(abs(int(q.min(initial=0))), abs(int(q.max(initial=0)))) * max(1, len(q)) < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(a * b for a, b in zip(row, q.tolist())) for row in x.tolist()]
    return np.array([max(-LAST - 1, min(LAST, s)) for s in exact], dtype=np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` by falling score, then id."""
    if len(scores) > 4 * k:  # only what reaches the k-th score
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return few[np.lexsort((ids[few], ~scores[few]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


def lowered(index: Index, q: np.ndarray, windows: list[tuple[float, float]], k: int, allowed: np.ndarray) -> list[float]:
    """Per window (low, high): the k-th best score inside it over the index, ``low`` where there are fewer.

    The threshold starts at the highest limit that a score can reach, and falls until the windows are full.
    """
    reach = float(np.linalg.norm(q.astype(np.float64))) * index.top + 1.0
    out = [low for low, _ in windows]
    open_ = [i for i, (low, high) in enumerate(windows) if low <= min(high, reach)]
    share = 0.9
    while open_:
        floor = {i: max(windows[i][0], -reach) for i in open_}
        at = {i: floor[i] + (min(windows[i][1], reach) - floor[i]) * share for i in open_}
        _, scores = index.at_least(q, min(at.values()), allowed)
        for i in list(open_):
            inside = scores[(scores >= at[i]) & (scores <= windows[i][1])]
            if len(inside) >= k:
                out[i] = float(np.partition(inside, len(inside) - k)[len(inside) - k])
                open_.remove(i)
            elif share <= 0:
                open_.remove(i)
        share = share - 0.15 if share > 0.15 else 0.0 if share > 0 else -1.0
    return out


# -- packs

def _write(out, batch: pa.RecordBatch, body: bytes = b"") -> dict:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    head, start = sink.getvalue().to_pybytes(), out.tell()
    out.write(head + body)
    return {"start": start, "head": len(head), "size": len(body), "n": batch.num_rows}


def _integers(column) -> np.ndarray:
    return np.array([LAST if v is None else int(v) for v in column.to_pylist()], dtype=np.int64)


class Pack:
    """Vectors with ids, labels and the name that tells their rows apart."""

    def __init__(self, row: dict):
        self.x, names = read_pack(row, True)
        self.ids, self.labels = _integers(names["vec_id"]), _integers(names["label"])
        self.key = f"{row['path']}:{row['start']}"


class Asked:
    """Anchors: vectors, ids, labels, their place (pack and row), and the least score of a positive."""

    def __init__(self, row: dict, prefix: str = "q_"):
        self.x, t = read_pack({k[len(prefix):]: v for k, v in row.items() if k.startswith(prefix)}, True)
        self.ids, self.labels, self.at = (_integers(t[c]) for c in ("vec_id", "label", "at"))
        self.own, self.least = t["own"].to_pylist(), np.array(t["least"].to_pylist(), dtype=np.float64)

    def allowed(self, i: int, labels: np.ndarray, same: bool, key: str | None = None, places: dict | None = None) -> np.ndarray:
        """Vectors with the anchor's label (or another); never the anchor's own row."""
        out = labels == self.labels[i] if same else labels != self.labels[i]
        if places is not None and (self.own[i], int(self.at[i])) in places:
            out[places[self.own[i], int(self.at[i])]] = False
        if key is not None and self.own[i] == key:
            out[self.at[i]] = False
        return out


class Sample:
    """A bounded sample of all vectors; hashes of their places choose it."""

    def __init__(self, packs: DataFrame, rows: int, size: int):
        share = min(1.0, 2.0 * size / max(rows, 1))

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    p = Pack(r)
                    from xxhash import xxh64_intdigest
                    h = np.array([xxh64_intdigest(f"{p.ids[i]}:{i}") >> 1 for i in range(len(p.ids))], dtype=np.int64)
                    at = np.flatnonzero(h <= share * LAST)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array([p.key] * len(at)), pa.array(at.astype(np.int32)), pa.array(p.labels[at]),
                                                          pa.array([p.x[i].astype("<i8").tobytes() for i in at])], ["h", "own", "at", "label", "v"])
        found = packs.mapInArrow(run, "h long, own string, at int, label long, v binary").orderBy("h", "own", "at").limit(size).collect()
        self.x = np.frombuffer(b"".join(r["v"] for r in found), dtype="<i8").reshape(len(found), -1)
        self.labels = np.array([r["label"] for r in found], dtype=np.int64)
        self.places = {(r["own"], r["at"]): i for i, r in enumerate(found)}


def ask(packs: DataFrame, sample: Sample, tasks: int, every: int, k: int, folder: str) -> DataFrame:
    """Packs of anchors, with the least score that can be among their ``k`` positives."""
    sent = packs.sparkSession.sparkContext.broadcast(sample)  # at most ``SAMPLE`` vectors

    def run(batches):
        index = Index(sent.value.x, -np.inf)
        path, out, held, n = None, None, [], 0

        def done():
            a = Asked.__new__(Asked)
            a.x = np.concatenate([h[0] for h in held]).astype("<i8")
            a.ids, a.labels, a.at = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            a.own = [key for h in held for key in [h[4]] * len(h[1])]
            least = [lowered(index, a.x[i], [(-np.inf, np.inf)], k, a.allowed(i, sent.value.labels, True, None, sent.value.places))[0] for i in range(len(a.ids))]
            batch = pa.RecordBatch.from_arrays([pa.array(a.ids), pa.array(a.labels), pa.array(a.at), pa.array(a.own, pa.string()), pa.array(least, pa.float64())],
                                               ["vec_id", "label", "at", "own", "least"])
            return pa.RecordBatch.from_pylist([{"path": path, "kind": "<i8"} | _write(out, batch, a.x.tobytes())], NAMES)
        for b in batches:
            for r in b.to_pylist():
                p = Pack(r)
                at = np.flatnonzero((p.ids % every == 0) & (p.ids != LAST))
                for k0 in range(0, len(at), ASKED):
                    some = at[k0:k0 + ASKED]
                    if out is None:
                        path, out = files.new_file(folder, ".anchors")
                    if n + len(some) > ASKED and n:
                        yield done()
                        held, n = [], 0
                    held.append((p.x[some], p.ids[some], p.labels[some], some, p.key))
                    n += len(some)
        if held:
            yield done()
        if out is not None:
            out.close()
    return staged(packs.select(*NAMES.names).repartition(tasks).mapInArrow(run, NAME), "anchors")


NAMES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("head", pa.int64()), ("size", pa.int64()), ("kind", pa.string()), ("n", pa.int64())])


def pairs(asked: DataFrame, packs: DataFrame, tasks: int) -> DataFrame:
    """Names of every query pack with every vector pack, dealt out evenly; a task keeps to one vector
    pack as long as it can."""
    groups = max(1, packs.count())
    every = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    both = every.join(packs.select(*NAMES.names).withColumn("g", F.pmod(F.xxhash64("path", "start"), F.lit(groups))), "g").drop("g")
    keys = ["path", "start", "q_path", "q_start"]
    return both.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)


def _named(asked: DataFrame) -> DataFrame:
    return asked.withColumnsRenamed({c: f"q_{c}" for c in NAMES.names})


class Held:
    """The vector pack that a task works on, and its index."""

    def __init__(self):
        self.key = None

    def take(self, row: dict, tau: float) -> tuple[Pack, Index]:
        key = (row["path"], row["start"])
        if key != self.key:
            self.pack, self.key, self.tau = Pack({c: row[c] for c in NAMES.names}), key, None
        if self.tau is None or tau < self.tau:
            self.index, self.tau = Index(self.pack.x, tau), tau
        return self.pack, self.index


def _tau(thresholds: np.ndarray, x: np.ndarray) -> float:
    """The least threshold over norm: vectors with smaller norms reach no threshold of these queries."""
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    return float(min(np.where(norms > 0, thresholds / np.where(norms > 0, norms, 1.0), -np.inf), default=-np.inf))


def find_positives(asked: DataFrame, packs: DataFrame, tasks: int, k: int = POSITIVES) -> DataFrame:
    """``POSITIVE`` rows: the ``k`` best vectors of each anchor's own label."""
    def run(batches):
        held, now, q = Held(), None, None
        for b in batches:
            for r in b.to_pylist():
                if now != (r["q_path"], r["q_start"]):
                    now, q = (r["q_path"], r["q_start"]), Asked(r)
                pack, index = held.take(r, _tau(q.least, q.x))
                rows = []
                for i in range(len(q.ids)):
                    at, scores = index.at_least(q.x[i], q.least[i], q.allowed(i, pack.labels, True, pack.key))
                    rows += [(*now, i, int(q.ids[i]), None if pack.ids[p] == LAST else int(pack.ids[p]), int(s))
                             for p, s in ((at[j], scores[j]) for j in best(scores, pack.ids[at], k))]
                if rows:
                    yield _batch(rows, POSITIVE)
    found = pairs(_named(asked), packs, tasks).mapInArrow(run, POSITIVE)
    rank = F.row_number().over(Window.partitionBy("q_path", "q_start", "q_at").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    return staged(found.withColumn("window", rank).where(F.col("window") <= k), "positives")


TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [c for c, _ in fields])


def ask_windows(positives: DataFrame, asked: DataFrame, sample: Sample, low: int, high: int, k: int, folder: str, tasks: int) -> DataFrame:
    """Per query pack a file with the windows of its anchors and the least score each can need."""
    sent = positives.sparkSession.sparkContext.broadcast(sample)
    row = F.struct("q_at", "window", "positive_id", "positive_score")
    grouped = positives.groupBy("q_path", "q_start").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # bounded by the pack

    def run(batches):
        index = Index(sent.value.x, -np.inf)
        path, out = None, None
        for b in batches:
            for r in b.to_pylist():
                q, of = Asked(r), defaultdict(list)
                for w in r["rows"]:
                    lo, hi = -(-low * w["positive_score"] // 100), high * w["positive_score"] // 100
                    if lo <= hi:
                        of[w["q_at"]].append((w["window"], w["positive_id"], w["positive_score"], lo, hi))
                if not of:
                    continue
                if out is None:
                    path, out = files.new_file(folder, ".windows")
                rows = []
                for i, own in of.items():
                    least = lowered(index, q.x[i], [(lo, hi) for *_, lo, hi in own], k, q.allowed(i, sent.value.labels, False, None, sent.value.places))
                    rows += [(i, *w, t) for w, t in zip(own, least)]
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.float64())
                batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["at", "window", "positive_id", "positive_score", "lo", "hi", "least"])
                name = _write(out, batch)
                yield pa.RecordBatch.from_pylist([{f"q_{c}": r[f"q_{c}"] for c in NAMES.names} | {"w_path": path, "w_start": name["start"], "w_head": name["head"]}], WINDOWS)
        if out is not None:
            out.close()
    named = grouped.join(_named(asked), ["q_path", "q_start"]).repartition(tasks)
    return staged(named.mapInArrow(run, ", ".join(f"q_{c}" for c in NAME.split(", ")) + ", w_path string, w_start long, w_head long"), "windows")


WINDOWS = pa.schema([*[(f"q_{f.name}", f.type) for f in NAMES], ("w_path", pa.string()), ("w_start", pa.int64()), ("w_head", pa.int64())])


def _windows(row: dict) -> list[dict]:
    f = files.read_at(row["w_path"])
    f.seek(row["w_start"])
    return pa.ipc.open_stream(f.read(row["w_head"])).read_all().to_pylist()


def find_negatives(windows: DataFrame, packs: DataFrame, tasks: int, k: int = NEGATIVES) -> DataFrame:
    """``NEGATIVE`` rows, ranked: the ``k`` best vectors of other labels inside each window."""
    def run(batches):
        held, now, q, of = Held(), None, None, {}
        for b in batches:
            for r in b.to_pylist():
                if now != (r["q_path"], r["q_start"]):
                    now, q, of = (r["q_path"], r["q_start"]), Asked(r), defaultdict(list)
                    for w in _windows(r):
                        of[w["at"]].append(w)
                some = np.array(list(of))
                least = np.array([min(w["least"] for w in of[i]) for i in some])
                pack, index = held.take(r, _tau(least, q.x[some]))
                rows = []
                for i, t in zip(some.tolist(), least):
                    at, scores = index.at_least(q.x[i], t, q.allowed(i, pack.labels, False))
                    ids = pack.ids[at]
                    for w in of[i]:
                        inside = np.flatnonzero((scores >= w["least"]) & (scores <= w["hi"]))
                        rows += [(*now, i, int(q.ids[i]), w["positive_id"], w["positive_score"], w["window"], None if ids[p] == LAST else int(ids[p]), int(scores[p]))
                                 for p in inside[best(scores[inside], ids[inside], k)]]
                if rows:
                    yield _batch(rows, NEGATIVE)
    found = pairs(windows, packs, tasks).mapInArrow(run, NEGATIVE)
    rank = F.row_number().over(Window.partitionBy("q_path", "q_start", "q_at", "window").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def labelled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vectors_of`` rows with a label, changed where the id is divisible by 7."""
    label = F.expr("try_cast(label AS long)")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return vectors_of(rows, id_col, vector_col, label_col).withColumn("label", moved.cast("string")).where("label IS NOT NULL")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         size: int = 1 << 15, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``(vec_id, label, v)`` rows."""
    spark = vectors.sparkSession
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], columns)
    folder = files.new_folder(work_dir(spark), "negatives")
    packs = write_packs(vectors, max(1, width), scale, size, folder)
    rows, raw = packs.agg(F.sum("n"), F.sum("size")).first()
    tasks = tasks_for(spark, raw, 32 << 20)
    seed = Sample(packs, rows, sample)
    asked = ask(packs, seed, tasks, every, positives, folder)
    met = tasks_for(spark, asked.count() * raw, 64 << 20)  # bytes that all pairs read
    found = find_positives(asked, packs, met, positives)
    windows = ask_windows(found, asked, seed, low, high, negatives, folder, tasks)
    return find_negatives(windows, packs, met, negatives).select(*[c.split()[0] for c in columns.split(", ")])


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``mine`` on a table of vectors, with labels changed where the id is divisible by 7."""
    return mine(labelled(rows, id_col, vector_col, label_col), **options)
