"""Gradients across gaps, versions, sets, classes."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from candlewick.operators import metrics as ME, rolling as R, selection as SE, stats as ST
from candlewick.sources import writers as WR


def test_gradient_across_blocks_and_missing_days(spark):
    days = [d for d in range(40) if d not in (9, 10, 19, 20, 21)]
    y = [float(d * d % 37) for d in days]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), v) for d, v in zip(days, y)] + [("b", dt.datetime(2024, 1, 1), 1.0)], "k string, ds timestamp, y double")
    for block in (24, 240, 4096):
        got = R.gradient(df, ["k"], "ds", {"slope": "y"}, block).orderBy("k", "ds").collect()
        np.testing.assert_allclose([r["slope"] for r in got[:-1]], np.gradient(y))
        assert got[-1]["slope"] is None and set(got[0].asDict()) == {"k", "ds", "y", "slope"}


def test_versions_are_whole_and_unfinished_ones_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    assert WR.newest_version(spark, root) == (None, 0)
    first = WR.write_version(spark.range(3), root)
    held = spark.read.parquet(first)
    second = WR.write_version(spark.range(5), root)
    (tmp_path / "t/version=3").mkdir()  # a write that did not end
    assert WR.newest_version(spark, root) == (second, 2) and held.count() == 3 and spark.read.parquet(second).count() == 5


def test_sets_strength_and_classes(spark):
    one, two = (spark.createDataFrame([(x,) for x in s], "feature string") for s in ("aab", "bc"))
    got = {(r["part"], r["feature"]) for r in SE.compared_sets(one, two).collect()}
    assert got == {("either", "a"), ("either", "b"), ("either", "c"), ("both", "b"), ("first only", "a"), ("second only", "c")}
    c = spark.createDataFrame([("x", -0.9), ("y", 0.5), ("z", None), ("w", 0.5)], "field string, correl double")
    assert [r["field"] for r in ST.by_strength(c, "correl", "field").orderBy("place").collect()] == ["x", "w", "y", "z"]
    p = spark.createDataFrame([("k", 1, 1, 0), ("k", 1, -1, 0), ("k", 0, 0, 1), ("k", 0, 1, 1), ("k", -1, -1, 1)], "k string, a int, p int, split int")
    best = ME.constant_class(p, "a", ["k"]).first()
    assert (best["label"], best["n"], best["accuracy"]) == (0, 5, 0.4)
    assert {r["split"]: r["accuracy"] for r in ME.accuracy_by(p, "a", "p", ["split"]).collect()} == {0: 0.5, 1: 2 / 3}
    mean = {(r["actual"], r["predicted"]): r["mean_count"] for r in ME.mean_confusion(p, "a", "p", "split", [-1, 0, 1]).collect()}
    assert len(mean) == 9 and mean[(1, 1)] == 0.5 and mean[(-1, 1)] == 0.0
    assert ME.constant_class(p.limit(0), "a", ["k"]).count() == 0


def test_binned_densities_follow_the_direct_sum(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(size=900), rng.normal(4, 0.5, size=400)])
    b = 0.6 * a + rng.normal(size=len(a))
    df = spark.createDataFrame([("k" if i % 3 else "m", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))] + [("k", None, 1.0)], "k string, a double, b double")
    direct = {(r["k"], r["point"]): r["density"] for r in ST.kde(df, "a", 129, "k").collect()}
    fine = {(r["k"], r["point"]): r["density"] for r in ST.kde_binned(df, "a", 513, "k").collect()}
    top = max(direct.values())
    assert len(fine) == 2 * 513 and max(abs(fine[k, 4 * p] - d) for (k, p), d in direct.items()) < 2e-3 * top
    one = {r["point"]: r["density"] for r in ST.kde_binned(df, "a", 200).collect()}
    assert len(one) == 200 and abs(sum(one.values()) * (a.max() - a.min()) / 199 - 1) < 0.02
    two = {(r["ia"], r["ib"]): r["density"] for r in ST.kde_2d(df.dropna(), "a", "b", 10).collect()}
    grid = {(r["ia"], r["ib"]): r["density"] for r in ST.kde_2d_binned(df.dropna(), "a", "b", 64).collect()}
    assert len(grid) == 4096 and max(abs(grid[7 * i, 7 * j] - d) for (i, j), d in two.items()) < 0.03 * max(two.values())
    flat = ST.kde_binned(df.where("a IS NOT NULL").withColumn("a", F.lit(2.0)), "a", 8)
    assert {r["density"] for r in flat.collect()} == {None} and ST.kde_binned(df.limit(0), "a", 8, "k").count() == 0
