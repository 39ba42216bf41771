"""Distributions, exact quantiles, correlations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .single import row_of, sent, small_rows, small_side, with_row

# Value ranges per cut, and the rows a range may hold before it is cut again.
RANGES = 256
RANGE_ROWS = 4_000_000
BOUND_ROWS = 500  # rows of RANGES numbers that are broadcast: a megabyte


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, without gathering a group in one task.

    A mergeable sketch cuts each group into value ranges, the ranges are counted, and only rows
    of the ranges that hold a wanted position go on. Ranges that are still large are cut again.
    What is left is ordered, after equal values were merged.
    """
    by = list(by)
    names = list(names) if names else [f"q{round(p * 100)}" for p in probs]
    position = {p: f"((_size - 1) * {float(p)!r}D)" for p in probs}
    ends = {(p, tag): f"{fn}({position[p]})" for p in probs for tag, fn in (("lo", "floor"), ("hi", "ceil"))}
    wanted = F.expr(" OR ".join(f"({k} >= _start AND {k} < _start + _m)" for k in ends.values()))

    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    path: list[str] = []
    largest = None
    while True:
        tagged, counts = _cut(rows, [*by, *path], f"_g{len(path)}", first=not path)
        path.append(f"_g{len(path)}")
        hit = counts.where(wanted)
        few = small_rows(hit)
        rows = tagged.join((hit if few is None else sent(few, hit)).drop("_m"), [*by, *path])
        most = hit.agg(F.max("_m")).first()[0] or 0 if few is None else max((r["_m"] for r in few), default=0)
        if most <= RANGE_ROWS or most == largest:
            break
        largest = most

    values = rows.groupBy(*by, *path, "_start", "_size", "_v").agg(F.count(F.lit(1)).alias("_m"))
    inside = Window.partitionBy(*by, *path).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    got = placed.groupBy(*by).agg(F.first("_size").alias("_size"), *[
        F.expr(f"max(CASE WHEN {ends[p, tag]} >= _at AND {ends[p, tag]} < _at + _m THEN _v END) AS _{tag}_{i}")
        for i, p in enumerate(probs) for tag in ("lo", "hi")])
    return got.selectExpr(*by, *[
        f"_lo_{i} + ({position[p]} - floor({position[p]})) * (_hi_{i} - _lo_{i}) AS `{n}`"
        for i, (p, n) in enumerate(zip(probs, names))])


def _cut(rows: DataFrame, keys: list[str], out: str, first: bool) -> tuple[DataFrame, DataFrame]:
    """Tag rows with their value range in ``out``; also the count and start position per range."""
    cuts = F.expr("array(" + ", ".join(f"{i / RANGES!r}D" for i in range(1, RANGES)) + ")")
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 4 * RANGES).alias("_b"))
    tagged = rows.join(small_side(bounds, BOUND_ROWS), keys) if keys else with_row(rows, bounds)
    # Binary search of the value among the cuts, one short projection per halving.
    tagged = tagged.withColumn(out, F.lit(0))
    half = RANGES // 2
    while half:
        tagged = tagged.withColumn(out, F.expr(f"{out} + CASE WHEN _v > get(_b, {out} + {half - 1}) THEN {half} ELSE 0 END"))
        half //= 2
    tagged = tagged.drop("_b")

    held = [] if first else ["_start", "_size"]
    counts = tagged.groupBy(*keys, out, *held).agg(F.count(F.lit(1)).alias("_m"))
    # At most RANGES rows per key.
    one = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_m").over(one.orderBy(out).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(
        *keys, out, "_m", (before if first else F.col("_start") + before).alias("_start"),
        (F.sum("_m").over(one) if first else F.col("_size")).alias("_size"))
    return tagged.drop(*held), counts


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "field", "value")
    basic = long.groupBy("field").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, ["field"], "value", (0.25, 0.5, 0.75)), "field")


def quantile_bucket(df: DataFrame, col: str, q: int = 5, out: str = "score_quantile",
                    strict: bool = True) -> DataFrame:
    """Bucket 1..q by right-closed quantile edges, the lowest value included.

    ``strict`` raises when edges coincide, as equal-frequency buckets are then undefined.
    """
    probs = [i / q for i in range(q + 1)]
    names = [f"e{i}" for i in range(q + 1)]
    edges = exact_quantiles(df, [], col, probs, names)
    x = F.col(col).cast("double")
    if strict:
        same = F.lit(False)
        for a, b in zip(names, names[1:]):
            same = same | (F.col(a) == F.col(b))
        edges = edges.withColumn("e1", F.when(same, F.raise_error(F.lit("quantile edges coincide")).cast("double"))
                                 .otherwise(F.col("e1")))
    bucket = F.lit(1)
    for n in names[1:-1]:
        bucket = bucket + (x > F.col(f"_edges.{n}")).cast("int")
    return df.withColumn("_edges", row_of(edges)).withColumn(out, F.when(x.isNotNull(), bucket)).drop("_edges")


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over the whole range, empty ones included; the last is closed."""
    v = df.where(F.col(col).isNotNull()).select(*([by] if by else []), F.col(col).cast("double").alias("_v"))
    edges = v.agg(F.min("_v").alias("_lo"), ((F.max("_v") - F.min("_v")) / F.lit(float(bins))).alias("_width"))
    key = [by] if by else []
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_width")), F.lit(0.0))), F.lit(bins - 1))
    counts = with_row(v, edges).groupBy(*key, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = with_row(counts.groupBy(*key).agg(F.sum("n").alias("_all")), edges)
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*key, "bin"], "left").select(
        *key, "bin", (F.col("_lo") + F.col("bin") * F.col("_width")).alias("left"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("right"),
        n.alias("n"), (n * F.lit(100.0) / F.col("_all")).alias("percent"))


def box_stats(df: DataFrame, col: str, by: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, mean, whisker ends and outlier count per group."""
    v = df.select(by, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    q = exact_quantiles(v, [by], "_v", (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return v.join(small_side(q), by).groupBy(by, "q1", "median", "q3").agg(
        F.avg("_v").alias("mean"), F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"), F.count_if(~inside).alias("outliers"))


def kde(df: DataFrame, col: str, points: int = 50, by: str | None = None) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) on an even grid over the value range.

    Exact: every row adds to the fixed number of grid sums in its own task; only those travel.
    """
    key = [by] if by else []
    v = df.where(F.col(col).isNotNull()).select(*key, F.col(col).cast("double").alias("_v"))
    stats = v.groupBy(*key).agg((F.stddev_samp("_v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("_h"))
    rows = v.join(small_side(stats), key) if key else with_row(v, stats)
    rows = with_row(rows, v.agg(F.min("_v").alias("_lo"), (F.max("_v") - F.min("_v")).alias("_w")))
    grid = [f"(_lo + _w * {i / (points - 1)!r}D)" for i in range(points)]
    z = [f"((_v - {g}) / _h)" for g in grid]
    sums = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_h", "_lo", "_w")],
        *[F.expr(f"sum(exp(-0.5D * {z[i]} * {z[i]})) AS _k{i}") for i in range(points)])
    norm = f"(_n * _h * {math.sqrt(2 * math.pi)!r}D)"
    cells = ", ".join(f"struct({i} AS point, {grid[i]} AS x, _k{i} / {norm} AS density)" for i in range(points))
    return sums.selectExpr(*key, f"inline(array({cells}))")


BAND = 6.0  # bandwidths after which a kernel counts as 0 (below 1.6e-8 of its top)


def kde_binned(df: DataFrame, col: str, points: int = 512, by: str | None = None) -> DataFrame:
    """``kde`` at plotting resolution: values are shared between their two nearest grid points in the map
    tasks, and the grid's sums meet the kernel as a band. What moves are ``points`` sums per key and task.

    Against the direct sum the error falls with the square of the grid step over the bandwidth.
    """
    key = [by] if by else []
    v = df.where(F.col(col).isNotNull()).select(*key, F.col(col).cast("double").alias("_v"))
    ends = v.agg(F.min("_v").alias("_lo"), ((F.max("_v") - F.min("_v")) / (points - 1)).alias("_step"))
    stats = v.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), (F.stddev_samp("_v") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("_h"))
    u = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_step")), F.lit(0.0))
    placed = with_row(v, ends).withColumn("_u", u).withColumn("_i", F.least(F.floor("_u"), F.lit(points - 1)).cast("int"))
    cells = placed.groupBy(*key, "_i").agg(F.count(F.lit(1)).cast("double").alias("_c"), F.sum(F.col("_u") - F.col("_i")).alias("_f"))
    shares = F.explode(F.array(F.struct(F.col("_i").alias("i"), (F.col("_c") - F.col("_f")).alias("w")), F.struct((F.col("_i") + 1).alias("i"), F.col("_f").alias("w"))))
    # One row per key and grid point from here on.
    bins = cells.select(*key, shares.alias("_s")).groupBy(*key, F.col("_s.i").alias("i")).agg(F.sum("_s.w").alias("w")).where("w > 0")
    known = with_row(stats, ends)
    grid = known.select(*key, "_n", "_h", "_lo", "_step", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    reach = F.least(F.ceil(F.lit(BAND) * F.col("_h") / F.col("_step")), F.lit(points)).cast("int")
    spread = (bins.join(known, key) if key else with_row(bins, known)).where("_h > 0 AND _step > 0").withColumn(
        "point", F.explode(F.sequence(F.greatest(F.col("i") - reach, F.lit(0)), F.least(F.col("i") + reach, F.lit(points - 1)))))
    z = (F.col("point") - F.col("i")) * F.col("_step") / F.col("_h")
    sums = spread.groupBy(*key, "point").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("_k"))
    density = F.try_divide(F.coalesce("_k", F.when(F.col("_h") > 0, 0.0)), F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.join(sums, [*key, "point"], "left").select(*key, "point", (F.col("_lo") + F.col("_step") * F.col("point")).alias("x"), density.alias("density"))


def kde_2d_binned(df: DataFrame, a: str, b: str, points: int = 64) -> DataFrame:
    """``kde_2d`` at plotting resolution: ``ia, ib, density`` on a points x points grid from sums at the
    grid's crossings, each value shared between the four around it."""
    v = df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).dropna()
    factor = F.pow(F.count(F.lit(1)).cast("double"), F.lit(-1.0 / 3.0))
    s = v.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.min("_a").alias("_alo"), ((F.max("_a") - F.min("_a")) / (points - 1)).alias("_sa"),
              F.min("_b").alias("_blo"), ((F.max("_b") - F.min("_b")) / (points - 1)).alias("_sb"), (F.var_samp("_a") * factor).alias("_vaa"),
              (F.var_samp("_b") * factor).alias("_vbb"), (F.covar_samp("_a", "_b") * factor).alias("_vab"))
    s = s.withColumn("_det", F.col("_vaa") * F.col("_vbb") - F.col("_vab") * F.col("_vab"))
    u = {"i": F.coalesce(F.try_divide(F.col("_a") - F.col("_alo"), F.col("_sa")), F.lit(0.0)), "j": F.coalesce(F.try_divide(F.col("_b") - F.col("_blo"), F.col("_sb")), F.lit(0.0))}
    placed = with_row(v, s).select(*[e.alias(f"_u{c}") for c, e in u.items()]).withColumns({c: F.least(F.floor(f"_u{c}"), F.lit(points - 1)).cast("int") for c in u})
    fi, fj = F.col("_ui") - F.col("i"), F.col("_uj") - F.col("j")
    cells = placed.groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum(fi).alias("fi"), F.sum(fj).alias("fj"), F.sum(fi * fj).alias("ff"))
    corner = lambda di, dj, w: F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), w.alias("w"))
    c, x, y, xy = (F.col(n) for n in ("c", "fi", "fj", "ff"))
    four = F.explode(F.array(corner(0, 0, c - x - y + xy), corner(1, 0, x - xy), corner(0, 1, y - xy), corner(1, 1, xy)))
    bins = cells.select(four.alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.w").alias("w")).where("w > 1e-12")
    reach = lambda var, step: F.least(F.ceil(F.lit(BAND) * F.sqrt(var) / step), F.lit(points)).cast("int")
    span = lambda at, r: F.explode(F.sequence(F.greatest(F.col(at) - r, F.lit(0)), F.least(F.col(at) + r, F.lit(points - 1))))
    spread = with_row(bins, s).where("_det > 0").withColumn("ia", span("i", reach(F.col("_vaa"), F.col("_sa")))).withColumn("ib", span("j", reach(F.col("_vbb"), F.col("_sb"))))
    da, db = (F.col("i") - F.col("ia")) * F.col("_sa"), (F.col("j") - F.col("ib")) * F.col("_sb")
    form = (F.col("_vbb") * da * da - 2.0 * F.col("_vab") * da * db + F.col("_vaa") * db * db) / F.col("_det")
    sums = spread.groupBy("ia", "ib").agg(F.sum(F.col("w") * F.exp(-0.5 * form)).alias("_k"))
    each = F.sequence(F.lit(0), F.lit(points - 1))
    grid = s.select("_n", "_det", F.explode(each).alias("ia")).withColumn("ib", F.explode(each))
    density = F.try_divide(F.coalesce("_k", F.when(F.col("_det") > 0, 0.0)), F.col("_n") * 2 * math.pi * F.sqrt("_det"))
    return grid.join(sums, ["ia", "ib"], "left").select("ia", "ib", density.alias("density"))


def kde_2d(df: DataFrame, a: str, b: str, points: int = 12) -> DataFrame:
    """Joint Gaussian kernel density with the full data covariance, on a points x points grid.

    The two values of every row are written once: spread and kernel read them, and the test for missing
    ones doesn't repeat what computes them.
    """
    v = staged(df.select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")), "pairs").dropna()
    factor = F.pow(F.count(F.lit(1)).cast("double"), F.lit(-1.0 / 3.0))
    s = v.agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("_a").alias("alo"), F.max("_a").alias("ahi"),
              F.min("_b").alias("blo"), F.max("_b").alias("bhi"),
              (F.var_samp("_a") * factor).alias("vaa"), (F.var_samp("_b") * factor).alias("vbb"),
              (F.covar_samp("_a", "_b") * factor).alias("vab"))
    s = s.withColumn("det", F.col("vaa") * F.col("vbb") - F.col("vab") * F.col("vab"))
    s = s.select([F.col(c).alias(f"_{c}") for c in s.columns])
    rows = with_row(v, s)
    last = float(points - 1)
    rows = rows.withColumn("ia", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = rows.withColumn("_da", F.expr(f"_a - (_alo + (_ahi - _alo) * (ia / {last!r}D))"))

    def kernel(j: int) -> Column:
        db = f"(_b - (_blo + (_bhi - _blo) * {j / last!r}D))"
        return F.expr(f"sum(exp(-0.5D * (_vbb * _da * _da - 2D * _vab * _da * {db} + _vaa * {db} * {db}) / _det)) AS _k{j}")

    sums = rows.groupBy("ia").agg(F.first("_n").alias("_n"), F.first("_det").alias("_det"), *[kernel(j) for j in range(points)])
    cells = ", ".join(f"struct({j} AS ib, _k{j} / (_n * {2 * math.pi!r}D * sqrt(_det)) AS density)" for j in range(points))
    return sums.selectExpr("ia", f"inline(array({cells}))")


def author_stats(posts: DataFrame, by: str, count: str, means: Sequence[str], spread: Sequence[str] = ()) -> DataFrame:
    """Count, means and sample deviations per author."""
    return posts.groupBy(by).agg(
        F.count(count).alias("count"), *[F.avg(c).alias(f"{c}_avg") for c in means],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in spread])


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts and shares of the non-null values of several columns, in one pass."""
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "field", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "field").select("field", "value", "n", (F.col("n") / F.col("_all")).alias("share"))


def posts_by_flagged(posts: DataFrame, flag: Column, author: str = "author") -> DataFrame:
    """All posts of every author with at least one flagged post."""
    flagged = posts.where(flag).select(author).distinct()
    return posts.join(flagged, author, "left_semi")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint", "float", "double")]


def select_family(df: DataFrame, contains: Sequence[str], ts: str, target: str,
                  among: Sequence[str] | None = None) -> list[str]:
    """Column names holding any of the substrings (and listed in ``among``), time and target first."""
    picked = [c for c in df.columns if c not in (ts, target) and any(s in c for s in contains)
              and (among is None or c in among)]
    return [ts, target, *picked]


def drop_constant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns whose rows all equal the first one. A column with a missing value stays."""
    row = df.agg(*[e for c in cols for e in (
        (F.min(c) == F.max(c)).alias(f"s_{c}"), F.count_if(F.col(c).isNull()).alias(f"n_{c}"))]).first()
    return df.drop(*[c for c in cols if row[f"s_{c}"] and row[f"n_{c}"] == 0])


# -- correlations -------------------------------------------------------------------------------------

def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, rows with either value missing left out per pair."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def corr_to(df: DataFrame, target: str, cols: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Correlation of each column with the target, optionally only beyond the threshold."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    out = row.unpivot([], list(cols), "field", "correl")
    return out.where(F.abs("correl") > threshold) if threshold is not None else out


def by_strength(df: DataFrame, value: str, name: str, place: str = "place") -> DataFrame:
    """Few rows (one per column) with their place by absolute value, strongest first; ties by ``name``."""
    return df.withColumn(place, F.row_number().over(Window.orderBy(F.abs(value).desc_nulls_last(), name)))


def compare_weighted(correls: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Plain against weighted look-back features of the same label and window."""
    plain = r"^(.+)_rolling_w(\d+)$"
    weighted = r"^(.+)_rolling_wgt_w(\d+)$"
    side = lambda pat, tag: (correls.where(F.col("field").rlike(pat)).select(
        F.regexp_extract("field", pat, 1).alias("label"), F.regexp_extract("field", pat, 2).cast("int").alias("window"),
        F.col("field").alias("field" + tag), F.col("correl").alias("correl" + tag)))
    both = side(plain, "").join(side(weighted, "_wgt"), ["label", "window"])
    return (both.where((F.abs("correl") > threshold) | (F.abs("correl_wgt") > threshold))
            .withColumn("diff", F.col("correl") - F.col("correl_wgt")))


def lagged_pairs(a: DataFrame, b: DataFrame, key: Sequence[str], ts: str, x: str, y: str,
                 lags: Sequence[int]) -> DataFrame:
    """x at day t next to y at day t - lag, for each lag."""
    lag = F.explode(F.array(*[F.lit(int(l)) for l in lags])).alias("lag")
    moved = b.select(F.col(ts), F.col(y).alias("y"), lag).withColumn(
        ts, F.col(ts) + F.make_dt_interval(days=F.col("lag"))).where(F.col("y").isNotNull())
    left = a.select(*key, ts, F.col(x).alias("x")).where(F.col("x").isNotNull())
    return left.join(moved, ts)


def cross_corr(a: DataFrame, b: DataFrame, key: Sequence[str], ts: str, x: str, y: str,
               lags: Sequence[int] = range(-20, 20), method: str = "pearson") -> DataFrame:
    """Correlation of x with y shifted by each lag; daily points, so a lag group is a calendar."""
    pairs = lagged_pairs(a, b, key, ts, x, y, lags)
    group = [*key, "lag"]
    if method == "pearson":
        return pairs.groupBy(*group).agg(F.corr("x", "y").alias("r"))
    if method == "spearman":
        def ranks(c: str) -> Column:
            ties = F.count(F.lit(1)).over(Window.partitionBy(*group, c))
            return F.rank().over(Window.partitionBy(*group).orderBy(c)) + (ties - 1) / 2
        ranked = pairs.withColumns({"rx": ranks("x"), "ry": ranks("y")})
        return ranked.groupBy(*group).agg(F.corr("rx", "ry").alias("r"))
    if method == "kendall":
        return _kendall(pairs, group)
    raise ValueError(method)


def _kendall(pairs: DataFrame, group: list[str]) -> DataFrame:
    """tau-b in n log n rows: each pair with different x is met at the highest bit where ranks differ."""
    w = Window.partitionBy(*group)
    ranked = pairs.select(*group, F.dense_rank().over(w.orderBy("x")).alias("rx"),
                          F.dense_rank().over(w.orderBy("y")).alias("ry"))
    ranked = ranked.withColumn("_top", F.max("rx").over(w))
    bits = F.ceil(F.log2(F.col("_top") + F.lit(1.0))).cast("int")
    rows = ranked.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.greatest(bits - 1, F.lit(0)))))
    low = (F.expr("shiftright(rx, _bit)") % 2 == 0).cast("long")
    rows = rows.withColumns({"_node": F.expr("shiftright(rx, _bit + 1)"), "_low": low})
    node = Window.partitionBy(*group, "_bit", "_node")
    below = F.sum("_low").over(node.orderBy("ry").rangeBetween(Window.unboundedPreceding, -1))
    upto = F.sum("_low").over(node.orderBy("ry").rangeBetween(Window.unboundedPreceding, 0))
    gain = F.coalesce(below, F.lit(0)) - (F.sum("_low").over(node) - upto)
    score = (rows.withColumn("_s", F.when(F.col("_low") == 0, gain).otherwise(F.lit(0)))
             .groupBy(*group).agg(F.sum("_s").alias("s")))

    def tied(c: str, out: str) -> DataFrame:
        n = F.col("n").cast("double")
        return (ranked.groupBy(*group, c).agg(F.count(F.lit(1)).alias("n"))
                .groupBy(*group).agg(F.sum(n * (n - 1) / 2).alias(out), F.sum("n").alias(f"n_{out}")))

    full = score.join(tied("rx", "tx"), group).join(tied("ry", "ty").drop("n_ty"), group)
    n = F.col("n_tx").cast("double")
    total = n * (n - 1) / 2
    return full.select(*group, F.try_divide(
        F.col("s"), F.sqrt((total - F.col("tx")) * (total - F.col("ty")))).alias("r"))
