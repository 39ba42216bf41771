"""SentencePiece encoding and decoding with a batched Viterbi pass.

The model is read from its file on the driver; pieces, scores and the tables below go to the
tasks (bounded by the vocabulary). A text is cut before every white-space mark, across which no
piece reaches. Distinct units of equal length advance together through their positions: hashes of
the substrings that end there probe the sorted hashes of the pieces of that length, and the best
candidate's length is stored as backpointer.

A BPE model has at most one candidate per position that agrees with its merges: the one whose
piece could stand beside the last piece of the shorter prefix. Whether two pieces can stand side
by side follows from the ranks of the merges along the right edge of the one and the left edge of
the other. All other candidates count as minus infinity, and the maximum runs over what is left.
The ids equal those of the library for BPE models without normalisation rules.

Characters outside the vocabulary become byte pieces. Decoding reverses this exactly; only the
mark U+2581 itself comes back as a space.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows get
equal ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_of, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 600_000  # units a worker remembers
BATCH = 1 << 15  # units that advance together
LONG = 1024  # characters of a unit that is encoded in stretches
OVERLAP = 128  # characters that stretches share
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1 << 40)


class Vocabulary:
    """Tables of a BPE model: ids, scores, sorted hashes by length, merges."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.unknown_id = sp.unk_id()
        self.bytes_of: list[bytes] = [b""] * size  # what decoding writes
        self.byte_id = np.full(256, -1, dtype=np.int64)
        score: dict[str, float] = {}
        ids: dict[str, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                score[piece], ids[piece] = sp.get_score(i), i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.runs = {len(p): i for p, i in ids.items() if set(p) == {MARK}}  # marks alone
        known = [p for p in ids if MARK not in p[1:]]
        self.lines = not any("\n" in p for p in known)  # then a line break is never part of a merge
        self.longest = max(map(len, known))
        if any(score[p] != int(score[p]) for p in known):
            raise ValueError("only BPE models are encoded here: their scores are ranks")
        rank = {p: int(-score[p]) for p in known}
        order = {p: k for k, p in enumerate(known)}
        self.ids = np.array([ids[p] for p in known] + [self.unknown_id])  # the last entry: a character outside
        self.width = np.array([len(p) for p in known])
        self.outside = len(known)
        self.rank = np.array([rank[p] if len(p) > 1 else -1 for p in known] + [-1], dtype=np.int64)
        self.left = np.zeros(len(known) + 1, dtype=np.int64)
        self.right = np.zeros(len(known) + 1, dtype=np.int64)
        keys, ranks = [], []
        for p in known:
            for k in range(1, len(p)):
                if p[:k] in order and p[k:] in order:
                    keys.append(order[p[:k]] << 20 | order[p[k:]])
                    ranks.append(rank[p])
            if len(p) > 1:
                done, last = merged(p, rank)
                if done == [p]:
                    self.left[order[p]], self.right[order[p]] = order[last[0]], order[last[1]]
                else:  # never made by merges
                    self.rank[order[p]] = NEVER
        by_key = np.argsort(np.array(keys))
        self.pair_keys, self.pair_ranks = np.array(keys)[by_key], np.array(ranks, dtype=np.int64)[by_key]
        self.power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                self.power.append(self.power[-1] * BASE)
        self.sorted: list = [None] * (self.longest + 1)
        self.maybe = np.zeros(1 << 21, dtype=bool)  # by the high bits of a hash
        for n in range(1, self.longest + 1):
            some = [p for p in known if len(p) == n and self.rank[order[p]] < NEVER]
            if some:
                codes = codes_of(some, n)
                h = hashes(codes)[:, -1]
                at = np.argsort(h)
                self.sorted[n] = (h[at], np.array([order[p] for p in some])[at], codes[at])
                self.maybe[h >> np.uint64(43)] = True


def codes_of(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, n).astype(np.uint64)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: column i is that of the first i characters."""
    h = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            h[:, i + 1] = h[:, i] * BASE + (codes[:, i] + np.uint64(1)) * (codes[:, i] + np.uint64(0xC2B2AE3D27D4EB4F))
    return h


def merged(word: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE by its definition: the lowest rank first, the leftmost of equals. Also the last merge."""
    parts, last = list(word), None
    while True:
        options = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not options:
            return parts, last
        i = min(options)[1]
        last = parts[i], parts[i + 1]
        parts[i:i + 2] = ["".join(last)]


class Coder:
    """Encodes and decodes texts; remembers units it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kind = np.dtype("<u2" if len(vocabulary.bytes_of) <= 1 << 16 else "<u4")
        self.marked: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.pair_key = np.full(1 << 20, -1, dtype=np.int64)
        self.pair_ok = np.zeros(1 << 20, dtype=bool)

    # -- which pieces can stand side by side
    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.v.pair_keys, key), len(self.v.pair_keys) - 1)
        return np.where(self.v.pair_keys[at] == key, self.v.pair_ranks[at], NEVER)

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """No merge across the border would have come before the merges inside ``a`` and ``b``."""
        v, ok = self.v, np.ones(len(a), dtype=bool)
        act, x, y = np.arange(len(a)), a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(act):
            z = self._merge_rank(x, y)
            bad = (z < gone_x) & (z <= gone_y) & (z < NEVER)
            ok[act[bad]] = False
            rx, ry = v.rank[x], v.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            act, x, y, rx, ry, gone_x, gone_y = act[go], x[go], y[go], rx[go], ry[go], gone_x[go], gone_y[go]
            back_x = rx > ry  # undo the later merge; of equal ranks the right one is later
            gone_x, x = np.where(back_x, rx, gone_x), np.where(back_x, v.right[x], x)
            gone_y, y = np.where(back_x, gone_y, ry), np.where(back_x, y, v.left[y])
        return ok

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            some, inverse = np.unique(key[new], return_inverse=True)
            found = self._agree(some >> 20, some & ((1 << 20) - 1))
            ok[new] = found[inverse]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    # -- units of one length
    def _probe(self, n: int, h: np.ndarray, codes: np.ndarray, end: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``rows`` have a piece of ``n`` characters ending at ``end``, and the piece."""
        if self.v.sorted[n] is None:
            return rows[:0], rows[:0]
        keys, pieces, spelt = self.v.sorted[n]
        maybe = np.flatnonzero(self.v.maybe[h >> np.uint64(43)])
        at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
        hit = keys[at] == h[maybe]
        hit[hit] = (spelt[at[hit]] == codes[rows[maybe[hit]], end - n:end]).all(axis=1)
        return maybe[hit], pieces[at[hit]]

    def _units(self, words: list[str], n: int, paths: bool = False) -> list[bytes] | list[np.ndarray]:
        v, rows = self.v, len(words)
        codes = codes_of(words, n)
        h = np.ascontiguousarray(hashes(codes).T)
        last, back = np.full((n + 1, rows), -1, dtype=np.int64), np.ones((n + 1, rows), dtype=np.int64)
        for i in range(1, n + 1):
            left = np.arange(rows)  # rows without a candidate so far
            for size in range(min(i, v.longest), 0, -1):
                with np.errstate(over="ignore"):
                    some = h[i, left] - h[i - size, left] * v.power[size]
                hit, cand = self._probe(size, some, codes, i, left)
                if size == 1:  # what is left ends with a single character, known or not
                    last[i, left] = v.outside
                    last[i, left[hit]] = cand
                    break
                if not len(hit):
                    continue
                at = left[hit]
                ok = np.ones(len(at), dtype=bool) if i == size else self.agree(last[i - size, at], cand)
                last[i, at[ok]], back[i, at[ok]] = cand[ok], size
                left = np.delete(left, hit[ok])
        ends = np.full(rows, n)
        steps, every = [], np.arange(rows)
        while ends.any():
            live = ends > 0
            piece = np.where(live, last[ends, every], -1)
            steps.append(piece)
            ends = ends - np.where(live, back[ends, every], 0)
        path = np.stack(steps[::-1], axis=1)
        if paths:
            return [row[row >= 0] for row in path]
        odd = (path == v.outside).any(axis=1)
        flat = v.ids[np.where(path < 0, 0, path)].astype(self.kind)
        width = flat.shape[1]
        skip = (path < 0).sum(axis=1)  # left padding
        raw, item = flat.tobytes(), self.kind.itemsize
        out = [raw[(r * width + s) * item:(r + 1) * width * item] for r, s in enumerate(skip.tolist())]
        for r in np.flatnonzero(odd):
            out[r] = self._with_bytes(words[r], path[r][skip[r]:])
        return out

    def _long(self, unit: str, size: int = LONG, overlap: int = OVERLAP) -> bytes:
        """A unit without blanks: stretches that overlap advance together and are joined where their
        pieces meet.

        Where all neighbours could stand side by side, pieces are those of the merges. So two stretches
        join at any border they share if the pieces beside it agree; without such a border they are
        encoded as one longer stretch.
        """
        cuts = [*range(0, max(1, len(unit) - overlap), size), len(unit)]
        starts, ends = [max(0, c - overlap) for c in cuts[:-1]], cuts[1:]
        if len(ends) > 1:  # the last stretch is as long as the others
            starts[-1] = max(0, min(starts[-1], ends[-1] - size - overlap))
        rows: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(zip(starts, ends)):
            rows.setdefault(b - a, []).append(k)
        found: list = [None] * len(ends)
        for n, some in rows.items():
            step = max(1, BATCH * 8 // n)
            for i in range(0, len(some), step):
                for k, path in zip(some[i:i + step], self._units([unit[starts[k]:ends[k]] for k in some[i:i + step]], n, True)):
                    found[k] = path
        width = np.append(self.v.width, 1)  # characters of a piece; one outside the vocabulary
        done, path, border = [], found[0], np.cumsum(width[found[0]])  # border: where its pieces end
        for k in range(1, len(ends)):
            sizes = width[found[k]]
            begin = starts[k] + np.cumsum(sizes) - sizes
            _, left, right = np.intersect1d(border, begin, return_indices=True)
            ok = np.flatnonzero(self.agree(path[left], found[k][right])) if len(left) else left
            if not len(ok):
                return self._long(unit, 2 * size, 2 * overlap) if 2 * size < len(unit) else self._units([unit], len(unit))[0]
            i, j = left[ok[len(ok) // 2]] + 1, right[ok[len(ok) // 2]]
            done.append(path[:i])
            path, border = found[k][j:], (begin + sizes)[j:]
        path = np.concatenate([*done, path])
        return self._with_bytes(unit, path) if (path == self.v.outside).any() else self.v.ids[path].astype(self.kind).tobytes()

    def _with_bytes(self, word: str, path: np.ndarray) -> bytes:
        ids, at = [], 0
        for p in path.tolist():
            if p == self.v.outside:
                b = [int(self.v.byte_id[x]) for x in word[at].encode("utf-8", "surrogatepass")]
                ids += b if min(b) >= 0 else [self.v.unknown_id]
                at += 1
            else:
                ids.append(int(self.v.ids[p]))
                at += len(self.v.bytes_of[ids[-1]].decode())
        return np.array(ids, dtype=self.kind).tobytes()

    def _learn(self, words: set[str], memory: dict[str, bytes], prefix: str) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= LONG:
                by_size.setdefault(len(w), []).append(w)
            else:
                memory[w] = self._long(prefix + w)
        for n, group in by_size.items():
            step = max(1, BATCH * 8 // (n + len(prefix)))
            for k in range(0, len(group), step):
                some = group[k:k + step]
                memory.update(zip(some, self._units([prefix + w for w in some], n + len(prefix))))

    # -- texts
    def _blanks(self, n: int) -> bytes:
        """A run of marks alone: the longest known runs from the left."""
        ids, size = [], max(self.v.runs)
        while n:
            size = max(k for k in self.v.runs if k <= min(n, size))
            ids += [self.v.runs[size]] * (n // size)
            n %= size
        return np.array(ids, dtype=self.kind).tobytes()

    def _line(self, words: list[str], first: bool) -> bytes:
        """``words`` between single spaces; the first has a mark only at the start of the text."""
        out = []
        if not first:
            out, words = [self.bare[words[0]]] if words[0] else [], words[1:]
        if "" not in words:
            return b"".join(out) + b"".join([self.marked[w] for w in words])
        blank, alone = 0, np.array([self.v.runs[1]], dtype=self.kind).tobytes()
        for w in words:
            if not w:
                blank += 1
                continue
            ids = self.marked[w]
            if blank and ids.startswith(alone):  # the mark before the word joins the run
                out += [self._blanks(blank + 1), ids[len(alone):]]
            else:
                out += [self._blanks(blank), ids]
            blank = 0
        return b"".join([*out, self._blanks(blank)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.marked) + len(self.bare) > CACHE:
            self.marked.clear()
            self.bare.clear()
        lines = [[x.split(" ") for x in (t.split("\n") if self.v.lines else [t])] if t else [] for t in (t.replace(MARK, " ") for t in texts)]
        marked, bare = set(), set()
        for t in lines:
            for k, words in enumerate(t):
                marked.update(words if not k else words[1:])
                if k:
                    bare.add(words[0])
        self._learn(marked.difference(self.marked, ("",)), self.marked, MARK)
        self._learn(bare.difference(self.bare, ("",)), self.bare, "")
        feed = np.array([self.v.byte_id[10] if self.v.byte_id[10] >= 0 else self.v.unknown_id], dtype=self.kind).tobytes()
        return [np.frombuffer(feed.join([self._line(w, not k) for k, w in enumerate(t)]), dtype=self.kind) for t in lines]

    def decode(self, ids) -> str:
        table = self.v.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def load(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as f:  # on the driver only
        return Vocabulary(f.read())


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, round_trip (decoding gives the text back)."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))  # bounded by the vocabulary

    def run(batches):
        coder = Coder(sent.value)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                texts = part.column("text").to_pylist()
                ids = coder.encode(texts)
                ends = np.cumsum([0, *map(len, ids)])
                values = np.concatenate([np.zeros(0, dtype=np.int32), *ids]).astype(np.int32)
                same = [coder.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                    pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
    return docs.select(id_of(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` of rows with ``ids``; null ids decode to the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        coder = Coder(sent.value)
        for b in batches:
            texts = [coder.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
