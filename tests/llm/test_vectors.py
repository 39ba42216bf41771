"""Vector code compression against plain rounds."""

import hashlib
import random

import numpy as np
import pytest

from candlewick.llm import vectorcodes as V


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Straight from the contract, in Python integers; rows (vec_id, vector, label)."""
    kept = sorted(((i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows
                   if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    w = width // parts
    cut = [[(v + [0] * width)[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                if mine := [c[p] for c, o in zip(cut, own) if o[p] == j]:
                    books[p][j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [min(sum(s for s, _ in x), V.MOST) for x in last]
    by_label = {}
    for (_, _, lab), e in zip(kept, error):
        by_label[lab] = min(by_label.get(lab, 0) + e, V.MOST)
    sha = hashlib.sha256(",".join(str(a) for b in books for e in b for a in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in x), e, by_label[lab], sha) for (i, _, lab), x, e in zip(kept, last, error)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


SCHEMA = "vec_id long, embedding array<double>, label int, code string, v string, path int"


@pytest.mark.parametrize("width,size", [(16, 7), (16, 1 << 15), (13, 50), (4, 50)])
def test_like_plain_rounds(spark, width, size):
    rng = np.random.default_rng(width + size)
    centres = rng.normal(size=(9, width))
    rows = [(int(i * 3 % 401), (centres[i % 9] + rng.normal(size=width) / 8).tolist(), None if i % 11 == 0 else int(i % 3)) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA).repartition(3)
    assert ordered(V.compress(df, size=size).collect()) == ordered(plain(rows))


def test_hostile_rows(spark):
    rng = random.Random(5)
    base = [rng.uniform(-1, 1) for _ in range(16)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)], i % 2) for i in range(0, 60, 2)]
    rows += [(1, None, 1), (3, [1.0, None] * 8, 1), (5, [float("nan")] + base[1:], 1), (7, [float("-inf")] + base[1:], None), (2, base, 1), (2, base, 1),
             (None, base, None), (None, base[:3], 1), (9, [], 4), (11, [-0.0001] * 16, None), (-4, [1e9, -1e9] * 8, 2), (-4, base, 2)]
    rows += [(100 + i, base, 0) for i in range(150)]  # one vector many times
    df = spark.createDataFrame([(*r, None, "x", None) for r in rows], SCHEMA)
    assert ordered(V.compress(df).collect()) == ordered(plain(rows))
    assert V.compress(df.limit(0)).count() == 0 and V.compress(df.where("vec_id IN (1, 3, 5, 7)")).count() == 0
    few = df.where("vec_id IN (2, 4)")
    assert ordered(V.compress(few).collect()) == ordered(plain([r for r in rows if r[0] in (2, 4)]))


def test_values_beyond_double_precision(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 17) for _ in range(8)], 0) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA)
    limited = [(i, [max(min(x, 2.0**63 / 4096 - 1), -2.0**51) for x in v], lab) for i, v, lab in rows]
    got, want = ordered(V.compress(df).collect()), ordered(plain(limited))
    assert [r[1:4] for r in got] == [r[1:4] for r in want]


def test_bounds_spare_scans_and_decode(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) / 30).tolist(), 0) for i in range(600)]
    vectors = V.vectors_of(spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA))
    model = V.fit(vectors)
    assert model.scanned[0] == 1.0 and model.scanned[-1] < 0.5
    back = {r["vec_id"]: (r["vector"], r["error"]) for r in V.decode(V.encode(model), model.codebooks).collect()}
    for i, v, _ in rows:
        assert sum((a - b) ** 2 for a, b in zip(back[i][0], np.floor(4096 * np.array(v)).astype(int).tolist())) == back[i][1]
