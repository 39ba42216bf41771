"""Exact top-k inner products with block-at-a-time pruning.

Vectors are quantised to integers and packed into forward-index packs. A pack is ordered by halving it
at the median of its widest dimension again and again, then cut into blocks (document ranges), so that
near vectors share a block; for every block and dimension the largest and smallest component are kept. For a query, the sum over dimensions of the larger of the two products bounds
every score in a block. Blocks are visited in order of their bounds and scored through their part
of the pack until the next bound falls below the k-th score.

A bounded sample of all vectors gives every query a first lower bound of its k-th score, which travels
with it, so pruning begins with the first block of every pack.

Queries are packed as well, as many as fit. Every pack of queries meets every pack of vectors once: packs are
dealt to groups, query packs are repeated per group and joined on the group's number, so no task
holds more than two packs. The k best per pack go on to the k best of all.

Defined results: null vectors and vectors with null or non-finite components take no part; a vector
that is shorter than another has zeros behind; an empty vector scores 0; components beyond the
range of a long saturate and sums beyond it wrap; a query's own row is no candidate, but another row
with the same id is; a null id is never a query and comes last among ties; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from .common import staged

K = 20
SCALE = 64
BLOCK = 128  # vectors under one row of maxima
PACK = 1 << 15  # vectors of a pack
ASKED = 1 << 12  # queries of a pack
SAMPLE = 4096  # vectors that give the first bounds
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max

PACKED = "pack long, dim int, kind string, ids array<long>, body binary, tops binary, lows binary"


def quantised(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components floor(scale * x) padded with zeros to one width."""
    values = column.flatten()
    flat = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    good[row[~np.isfinite(flat)]] = False  # nulls are NaN here
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * np.where(np.isfinite(flat), flat, 0.0))
    return np.flatnonzero(good), np.clip(out[good], -2.0**63, 2.0**63 - 1024).astype(np.int64)


def halved(x: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which blocks are small boxes: halves at the median of the widest dimension."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= block:
            out.append(own)
            continue
        part = x[own]
        widest = part[:, (part.max(axis=0) - part.min(axis=0)).argmax()] if x.shape[1] else np.zeros(len(own))
        cut = max(block, len(own) // 2 // block * block)  # whole blocks on the left
        order = np.argpartition(widest, cut)
        todo += [own[order[cut:]], own[order[:cut]]]
    return np.concatenate(out)


def packs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, size: int = PACK) -> DataFrame:
    """Forward-index packs of the rows of each task."""
    def run(batches):
        from pyspark import TaskContext
        part, seq, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def done():
            width = max(m.shape[1] for m in rows)
            x = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in rows])
            order = halved(x, block)
            x, names = x[order], [ids[i] for i in order.tolist()]
            cuts = np.arange(0, len(x), block)
            tops, lows = (f.reduceat(x, cuts, axis=0) if width else x[cuts] for f in (np.maximum, np.minimum))
            kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 and x.min(initial=0) > NONE else "<i8"
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([width], pa.int32()), pa.array([kind]), pa.array([names], pa.list_(pa.int64())),
                 *[pa.array([m.astype(kind).tobytes()], pa.binary()) for m in (x, tops, lows)]], ["pack", "dim", "kind", "ids", "body", "tops", "lows"])
        for b in batches:
            for k in range(0, b.num_rows, size):
                s = b.slice(k, size)
                good, x = quantised(s.column(1), scale)
                own = s.column(0).to_pylist()
                if len(ids) + len(good) > size and ids:
                    yield done()
                    seq, ids, rows = seq + 1, [], []
                if len(good):
                    ids += [own[i] for i in good]
                    rows.append(x)
        if ids:
            yield done()
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, PACKED)


class Sample:
    """At most ``size`` vectors, chosen by hashes of their places; bounded, so it may be sent to every task."""

    def __init__(self, packed: DataFrame, rows: int, size: int = SAMPLE):
        share = min(1.0, 2.0 * size / max(rows, 1))

        def run(batches):
            from xxhash import xxh64_intdigest
            for b in batches:
                for r in b.to_pylist():
                    h = np.array([xxh64_intdigest(f"{r['pack']}:{i}") >> 1 for i in range(len(r["ids"]))], dtype=np.int64)
                    at = np.flatnonzero(h <= share * LAST)
                    if len(at):
                        x = matrix(r["body"], r["kind"], r["dim"], len(r["ids"]))[at]
                        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.full(len(at), r["pack"])), pa.array(at.astype(np.int32)),
                                                          pa.array([v.astype("<i8").tobytes() for v in x], pa.binary())], ["h", "pack", "at", "v"])
        found = packed.select("pack", "dim", "kind", "ids", "body").mapInArrow(run, "h long, pack long, at int, v binary").orderBy("h", "pack", "at").limit(size).collect()
        width = max((len(r["v"]) // 8 for r in found), default=0)
        self.x = np.zeros((len(found), width), dtype=np.int64)
        for i, r in enumerate(found):
            self.x[i, :len(r["v"]) // 8] = np.frombuffer(r["v"], dtype="<i8")
        self.places = {(r["pack"], r["at"]): i for i, r in enumerate(found)}

    def least(self, q: np.ndarray, own: list[tuple[int, int]], k: int) -> np.ndarray:
        """Each query's k-th best score among the sample without the query itself; NONE with fewer."""
        if len(self.x) <= k:
            return np.full(len(q), NONE)
        n = max(q.shape[1], self.x.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (q, self.x))
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n < 2.0**53
        s = (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact else a @ b.T
        for i, place in enumerate(own):
            if place in self.places:
                s[i, self.places[place]] = NONE
        return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


QUERIES = "qp long, q_dim int, q_pack array<long>, q_at array<int>, q_ids array<long>, q_least array<long>, q_body binary"


def queries_of(packed: DataFrame, every: int, sample: Sample, k: int, size: int = ASKED) -> DataFrame:
    """Packs of the vectors whose id is divisible by ``every``, each with a lower bound of its k-th score."""
    sent = packed.sparkSession.sparkContext.broadcast(sample)
    asked = F.expr(f"size(filter(ids, x -> x % {every} = 0))")
    n = packed.agg(F.coalesce(F.sum(asked), F.lit(0))).first()[0]

    def run(batches):
        from pyspark import TaskContext
        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def done():
            width = max(x.shape[1] for x, *_ in held)
            x = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x, *_ in held])
            own = [(pack, a) for _, pack, at, _ in held for a in at]
            least = sent.value.least(x, own, k)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq]), pa.array([width], pa.int32()), pa.array([[p for p, _ in own]], pa.list_(pa.int64())), pa.array([[a for _, a in own]], pa.list_(pa.int32())),
                 pa.array([[i for *_, ids in held for i in ids]], pa.list_(pa.int64())), pa.array([least.tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())],
                [c.split()[0] for c in QUERIES.split(", ")])
        for b in batches:
            for r in b.to_pylist():
                at = [i for i, x in enumerate(r["ids"]) if x is not None and x % every == 0]
                for j in range(0, len(at), size):
                    some = at[j:j + size]
                    if rows and rows + len(some) > size:
                        yield done()
                        seq, held, rows = seq + 1, [], 0
                    held.append((matrix(r["body"], r["kind"], r["dim"], len(r["ids"]))[some], r["pack"], some, [r["ids"][i] for i in some]))
                    rows += len(some)
        if held:
            yield done()
    # A pack of queries takes part of its rows from many packs of vectors.
    return packed.where(asked > 0).select("pack", "dim", "kind", "ids", "body").repartition(max(1, -(-n // size))).mapInArrow(run, QUERIES)


def matrix(raw: bytes, kind: str, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(rows, dim).astype(np.int64)


def best_in_pack(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, tops: np.ndarray, lows: np.ndarray, k: int = K,
                 block: int = BLOCK, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and places of each query's ``k`` best vectors (NONE where there are fewer), and how
    many (query, block) pairs were scored. ``own``: the place of a query's own row, or -1;
    ``least``: scores below which nothing is wanted."""
    n = max(q.shape[1], x.shape[1])
    q, x, tops, lows = (np.pad(m, ((0, 0), (0, n - m.shape[1]))) for m in (q, x, tops, lows))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * n < 2.0**53  # then doubles hold every sum
    kind = np.float64 if exact else np.int64
    q, x, tops, lows = (m.astype(kind) for m in (q, x, tops, lows))
    bound = np.maximum(q, 0) @ tops.T + np.minimum(q, 0) @ lows.T if exact else np.full((len(q), len(tops)), LAST)
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(q), k), NONE, dtype=np.int64)
    at = np.full((len(q), k), -1, dtype=np.int64)
    by_id = np.append(ids, LAST)  # of place -1
    visited = 0
    least = np.full(len(q), NONE) if least is None else least
    for j in range(order.shape[1]):
        live = np.flatnonzero(bound[np.arange(len(q)), order[:, j]] >= np.maximum(score[:, -1], least))  # equal bounds may hold a smaller id
        if not len(live):
            break
        visited += len(live)
        for b in np.unique(order[live, j]):
            rows = live[order[live, j] == b]
            lo, hi = b * block, min((b + 1) * block, len(x))
            s = (q[rows] @ x[lo:hi].T).astype(np.int64)
            inside = np.flatnonzero((own[rows] >= lo) & (own[rows] < hi))
            s[inside, own[rows][inside] - lo] = NONE
            some = np.flatnonzero(s.max(axis=1) >= np.maximum(score[rows, -1], least[rows]))
            if not len(some):
                continue
            rows, s = rows[some], s[some]
            all_s = np.concatenate([score[rows], s], axis=1)
            all_at = np.concatenate([at[rows], np.where(s == NONE, -1, np.arange(lo, hi))], axis=1)
            pick = np.lexsort((by_id[all_at], ~all_s), axis=1)[:, :k]  # ~s falls as s rises
            score[rows], at[rows] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_at, pick, 1)
    return score, at, visited


def top_k(vectors: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          block: int = BLOCK, size: int = PACK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best vectors of every query."""
    found = scored(vectors, k, every, id_col, vector_col, scale, block, size, sample).where("q_at IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("q_pack", "q_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited_share(vectors: DataFrame, **options) -> float:
    """The share of (query, block) pairs that a search scores; the others are pruned by their bounds."""
    visited, total = scored(vectors, **options).where("q_at IS NULL").agg(F.sum("query_id"), F.sum("score")).first()
    return visited / total if total else 0.0


def scored(vectors: DataFrame, k: int = K, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           block: int = BLOCK, size: int = PACK, sample: int = SAMPLE) -> DataFrame:
    """q_pack, q_at, query_id, vec_id, score of the ``k`` best per query and pack; and one row per pair of
    packs with q_at null: how many blocks were scored (query_id) of how many (score)."""
    packed = staged(packs(vectors, id_col, vector_col, scale, block, size), "packs")
    groups, rows = packed.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    groups = max(1, groups)
    group = F.pmod(F.xxhash64("pack"), F.lit(groups))
    asked = staged(queries_of(packed, every, Sample(packed, rows, sample), k), "queries")
    every_pack = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    # The query packs are repeated, but their estimate is that of one copy: without a hint they are broadcast through the driver.
    # Few rows with large bodies: the number of tasks is given.
    pairs = every_pack.hint("merge").join(packed.withColumn("g", group), "g").drop("g").repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, groups), "pack", "qp")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids = np.array([LAST if v is None else v for v in r["ids"]], dtype=np.int64)
                n, q_at, q_pack = -(-len(ids) // block), np.array(r["q_at"], dtype=np.int32), np.array(r["q_pack"])
                own = np.where(q_pack == r["pack"], q_at, -1)
                score, at, visited = best_in_pack(matrix(r["q_body"], "<i8", r["q_dim"], len(q_at)), own, *[
                    matrix(r["body"], r["kind"], r["dim"], len(ids)), ids, *(matrix(r[c], r["kind"], r["dim"], n) for c in ("tops", "lows"))], k, block,
                    np.array(r["q_least"], dtype=np.int64))
                q, c = np.nonzero(at >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_pack[q]), pa.array(q_at[q]), pa.array(np.array(r["q_ids"], dtype=np.int64)[q]),
                     pa.array([r["ids"][p] for p in at[q, c]], pa.int64()), pa.array(score[q, c])], ["q_pack", "q_at", "query_id", "vec_id", "score"])
                yield pa.RecordBatch.from_arrays([pa.array([r["pack"]]), pa.nulls(1, pa.int32()), pa.array([visited], pa.int64()), pa.nulls(1, pa.int64()), pa.array([n * len(q_at)], pa.int64())],
                                                 ["q_pack", "q_at", "query_id", "vec_id", "score"])
    return pairs.mapInArrow(run, "q_pack long, q_at int, query_id long, vec_id long, score long")
