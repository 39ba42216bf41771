"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from candlewick.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, path string, window int, least double"


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """Straight from the contract, in Python integers; rows (vec_id, vector, label)."""
    kept = []
    for i, v, lab in rows:
        if lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        moved = (lab + 1) % 10 if i is not None and i % 7 == 0 else lab
        kept.append((i, [math.floor(scale * x) for x in v], moved))
    out = []
    for a, (i, v, lab) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, other) for b, (j, w, other) in enumerate(kept) if b != a), key=lambda r: r[:3])
        for ps, _, _, p, other in [s for s in scored if s[4] == lab][:positives]:
            inside = [s for s in scored if s[4] != lab and 30 * -ps <= 100 * -s[0] <= 90 * -ps]
            out += [(i, p, k + 1, s[3], -ps, -s[0]) for k, s in enumerate(inside[:negatives])]
    return sorted(out, key=str)


def answer(df, **options):
    return sorted(map(tuple, N.hard_negatives(df, **options).collect()), key=str)


@pytest.mark.parametrize("size,sample", [(17, 8), (64, 4096), (1 << 15, 50)])
def test_like_all_pairs(spark, size, sample):
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(5, 21)) / 4
    rows = [(int(i), (centres[i % 5] + rng.normal(size=21) / 6).tolist(), int(i % 4)) for i in range(500)]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(4)
    want = plain(rows)
    assert want and answer(df, size=size, sample=sample) == want


def test_hostile_rows(spark):
    rng = random.Random(3)
    base = [rng.uniform(-1, 1) for _ in range(9)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)], i % 3) for i in range(1, 120)]
    rows += [(0, base, 2), (100, base, 3), (100, base, 3), (200, None, 1), (300, [None] * 9, 1), (400, [float("nan")] * 9, 1), (500, base, None), (600, [], 1), (700, base[:2], 9),
             (None, base, 3), (None, base, 1), (800, [0.0] * 9, 1), (900, [-x for x in base], 3), (1000, [x * 1e8 for x in base], 3), (1100, [x * 1e8 for x in base], 1)]
    rows += [(2001 + i, base, 1 + i % 2) for i in range(90)]  # one vector many times
    df = spark.createDataFrame([(*r, None, 1, None) for r in rows], SCHEMA)
    assert answer(df, size=40) == plain(rows)
    assert answer(df.limit(0)) == [] and answer(df.where("vec_id IN (200, 300, 400, 500)")) == [] and answer(df.where("vec_id % 100 > 0")) == []


def test_lists_leave_out_what_suffix_norms_cover():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 32)) * np.geomspace(900, 1, 32)).astype(np.int64)
    q = x[7]
    full = x @ q
    every = np.ones(400, dtype=bool)
    t = float(np.partition(full, -5)[-5])
    index = N.Index(x, t / np.linalg.norm(q))
    assert sum(len(v) for v in index.lists) < 400 * len(index.lists) // 2
    places, scores = index.at_least(q, t, every)
    assert sorted(places) == np.flatnonzero(full >= t).tolist() and (scores == full[places]).all()
    windows = [(t / 4, t), (-np.inf, np.inf), (t * 5, t * 9)]
    for (lo, hi), least in zip(windows, N.lowered(index, q, windows, 3, every)):
        inside = np.sort(full[(full >= lo) & (full <= hi)])
        assert least == (inside[-3] if len(inside) >= 3 else lo)
