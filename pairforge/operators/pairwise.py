"""Statistics between columns: histograms, differences, correlations, distribution distances, densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import equal_bin, min_max
from ..session import Scratch
from .ordered import average_ranks, present, running_sums

LEAST_ROWS = 10


def kept_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns as doubles, written once to the shared folder: statistics of column pairs read them more than
    once, and what made them (joins, distances) need not run again. Rows with no two values fall out."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    known = sum((F.when(present(c), 1).otherwise(0) for c in columns), F.lit(0))
    return Scratch(df.sparkSession, "columns").save(values.filter(known >= 2), "columns")


def column_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of all column pairs i < j: `col_a`, `col_b`, `x`, `y` of rows with both values (pairwise complete)."""
    each = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(columns, 2)])
    return df.select(F.explode(each).alias("_p")).select("_p.*").filter(present("x", "y"))


def difference_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median absolute difference of each column pair, over rows with both values."""
    return column_pairs(df, columns).groupBy("col_a", "col_b").agg(F.round(F.median(F.abs(F.col("x") - F.col("y"))), 6).alias("median_diff"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """`bin`, `count`, `density` of equal-width bins from the smallest to the largest value; empty bins are left out."""
    x = df.filter(present(column)).select(F.col(column).cast("double").alias("x"))
    edge = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    counted = x.join(F.broadcast(edge)).groupBy(equal_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi", "n").agg(F.count("*").alias("count"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) / bins
    return counted.select("bin", "count", F.round(F.col("count") / (F.col("n") * width), 6).alias("density"))


def histogram_2d(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Rectangular bins of all ordered column pairs; pairs with fewer than ten complete rows are left out."""
    pairs = column_pairs(kept_columns(df, columns), columns)
    edge = pairs.groupBy("col_a", "col_b").agg(*[f(c).alias(n) for c in "xy" for f, n in ((F.min, f"{c}lo"), (F.max, f"{c}hi"))], F.count("*").alias("n")).filter(F.col("n") >= LEAST_ROWS)
    placed = pairs.join(F.broadcast(edge), ["col_a", "col_b"])
    bx, by = (equal_bin(F.col(c), F.col(f"{c}lo"), F.col(f"{c}hi"), bins) for c in "xy")
    counted = placed.groupBy("col_a", "col_b", bx.alias("bin_x"), by.alias("bin_y")).agg(F.count("*").alias("count"))
    # The other order of a pair has the same bins, turned.
    turned = F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("bin_y").alias("bin_x"), F.col("bin_x").alias("bin_y"), "count")
    return counted.select(F.explode(F.array(F.struct("col_a", "col_b", "bin_x", "bin_y", "count"), turned)).alias("c")).select("c.*")


def hexbin(df: DataFrame, x: str, y: str, grid: int = 100) -> DataFrame:
    """Hexagonal bins: `lattice` (0 or 1), `i`, `j` and `count` of the nearer centre of two shifted lattices.

    Coordinates run from the smallest to the largest value without padding; a constant axis is widened by 0.5.
    """
    ny = int(grid / math.sqrt(3))
    v = df.filter(present(x, y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    edge = v.agg(F.min("x").alias("xl"), F.max("x").alias("xh"), F.min("y").alias("yl"), F.max("y").alias("yh"))
    scale = lambda c, l, h, n: (c - F.when(h > l, l).otherwise(l - 0.5)) / (F.when(h > l, h - l).otherwise(F.lit(1.0)) / n)  # noqa: E731, E741
    at = v.join(F.broadcast(edge)).select(scale(F.col("x"), F.col("xl"), F.col("xh"), grid).alias("sx"), scale(F.col("y"), F.col("yl"), F.col("yh"), ny).alias("sy"))
    at = at.select("sx", "sy", F.bround("sx").alias("i1"), F.bround("sy").alias("j1"), F.floor("sx").alias("i2"), F.floor("sy").alias("j2"))
    d1 = F.pow(F.col("sx") - F.col("i1"), 2) + 3 * F.pow(F.col("sy") - F.col("j1"), 2)
    d2 = F.pow(F.col("sx") - F.col("i2") - 0.5, 2) + 3 * F.pow(F.col("sy") - F.col("j2") - 0.5, 2)
    near = d1 < d2
    pick = lambda a, b: F.when(near, F.col(a)).otherwise(F.col(b)).cast("int")
    return at.groupBy(F.when(near, 0).otherwise(1).alias("lattice"), pick("i1", "i2").alias("i"), pick("j1", "j2").alias("j")).agg(F.count("*").alias("count"))


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to 0..1 over their finite values; a constant column is 0.5, missing values stay null."""
    finite = {c: F.when(present(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c in columns}
    edge = df.agg(*[f(v).alias(f"_{n}_{c}") for c, v in finite.items() for f, n in ((F.min, "lo"), (F.max, "hi"))])
    out = df.join(F.broadcast(edge))
    return out.select(*[c for c in df.columns if c not in columns], *[F.when(finite[c].isNotNull(), min_max(finite[c], F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))).alias(c) for c in columns])


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, population deviation, quartiles, extremes, skewness and excess kurtosis."""
    v = F.when(present(column), F.col(column).cast("double"))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"), F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"))
    r = lambda c: F.round(c, 6)
    return out.select("n", *[r(c).alias(c) for c in ("mean", "std")], *[r(F.col("q")[i]).alias(n) for i, n in enumerate(("q25", "median", "q75"))], *[r(c).alias(c) for c in ("min", "max", "skew", "kurtosis")])


def moments_correlation(x: str, y: str) -> F.Column:
    """Pearson's r as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman_by(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """`rho`, `n` per key from average ranks; ranks are taken among the key's own complete rows."""
    rows = df.filter(present(x, y))
    rx, ry = average_ranks(rows, keys, x, "_rx").drop("n"), average_ranks(rows, keys, y, "_ry").drop("n")
    counts = rows.groupBy(*keys, x, y).agg(F.count("*").alias("_n"))
    ranked = counts.join(rx, [*keys, x]).join(ry, [*keys, y])
    # Weighted moments of the ranks, centred on their known mean, so large counts lose no digits.
    n = F.sum("_n")
    mid = ranked.groupBy(*keys).agg(((n + 1) / 2).alias("_mid"), n.alias("n"))
    m = ranked.join(mid, list(keys)) if keys else ranked.join(F.broadcast(mid))
    dx, dy, w = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid"), F.col("_n")
    out = m.groupBy(*keys, "n").agg(F.sum(w * dx * dy).alias("_xy"), F.sum(w * dx * dx).alias("_xx"), F.sum(w * dy * dy).alias("_yy"))
    return out.select(*keys, "n", F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("rho"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman's rho of each column pair with its 95 % interval by Fisher's transformation; pairs of at most three rows have none."""
    rho = spearman_by(column_pairs(kept_columns(df, columns), columns), ["col_a", "col_b"])
    z, half = F.atanh("rho"), 1.959963984540054 / F.sqrt(F.col("n") - 3)
    sure = F.abs("rho") > 0.9999
    ok = F.col("n") > 3
    low = F.when(ok, F.when(sure, F.col("rho")).otherwise(F.tanh(z - half)))
    high = F.when(ok, F.when(sure, F.col("rho")).otherwise(F.tanh(z + half)))
    return rho.select("col_a", "col_b", "n", *[F.round(c, 6).alias(n) for c, n in ((F.when(ok, F.col("rho")), "rho"), (low, "ci_low"), (high, "ci_high"))])


def _steps(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both ECDFs at each distinct value of two samples: `samples` has keys, `v` and `side` (0 or 1)."""
    return _count_steps(samples.groupBy(*keys, "v").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("u"), F.sum("side").alias("w")), keys)


def _count_steps(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = counts.groupBy(*keys).agg(F.sum("u").alias("nu"), F.sum("w").alias("nw"))
    cum = running_sums(counts, keys, "v", ["u", "w"], lead=True)
    return cum.join(sizes, list(keys)).withColumn("gap", F.abs(F.col("cum_u") / F.col("nu") - F.col("cum_w") / F.col("nw")))


def ecdf_distances(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`wasserstein` and `ks` of each key in one pass, from counts `u` and `w` of both samples at each distinct `v`."""
    area = F.sum(F.col("gap") * (F.coalesce("next_v", "v") - F.col("v")))
    return _count_steps(counts, keys).groupBy(*keys).agg(F.round(area, 6).alias("wasserstein"), F.round(F.max("gap"), 6).alias("ks"))


def wasserstein_by(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wasserstein-1 distance of the two samples of each key: the area between their ECDFs."""
    return _steps(samples, keys).groupBy(*keys).agg(F.round(F.sum(F.col("gap") * (F.coalesce("next_v", "v") - F.col("v"))), 6).alias("wasserstein"))


def ks_by(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each key."""
    return _steps(samples, keys).groupBy(*keys).agg(F.round(F.max("gap"), 6).alias("ks"))


def wasserstein_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wasserstein-1 of each column pair after scaling both to 0..1 over their complete rows; null below ten rows."""
    pairs = column_pairs(kept_columns(df, columns), columns)
    edge = pairs.groupBy("col_a", "col_b").agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.count("*").alias("n"))
    both = pairs.join(F.broadcast(edge.filter(F.col("n") >= LEAST_ROWS)), ["col_a", "col_b"])
    scaled = F.array(*[F.struct(min_max(F.col(c), F.col(f"{c}lo"), F.col(f"{c}hi")).alias("v"), F.lit(i).alias("side")) for i, c in enumerate("xy")])
    samples = both.select("col_a", "col_b", F.explode(scaled).alias("s")).select("col_a", "col_b", "s.*")
    return edge.select("col_a", "col_b", "n").join(wasserstein_by(samples, ["col_a", "col_b"]), ["col_a", "col_b"], "left")


def density(df: DataFrame, column: str, points: int = 500, scaled: bool = False) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at `points` places from the smallest to the largest value.

    `k`, `x`, `density`. Partial sums are taken batch by batch, so only `points` numbers per task are moved. A constant
    column and one of fewer than two values have no density (no rows).
    """
    v = F.when(present(column), F.col(column).cast("double"))
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    schema = "k int, x double, density double"
    if not s["n"] or s["n"] < 2 or not s["sd"]:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = s["lo"], s["hi"]
    span = (hi - lo) if scaled else 1.0
    base = lo if scaled else 0.0
    h = s["sd"] / span * s["n"] ** -0.2
    grid = np.linspace((lo - base) / span, (hi - base) / span, points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(points)
        for b in batches:
            x = (b.column(0).to_numpy() - base) / span
            for at in range(0, len(x), 4096):
                total += np.exp(-0.5 * ((grid[:, None] - x[None, at : at + 4096]) / h) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], names=["k", "part"])

    parts = df.select(v.alias("v")).filter(F.col("v").isNotNull()).mapInArrow(run, "k int, part double")
    x = F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("k") + 1)
    return parts.groupBy("k").agg(F.sum("part").alias("t")).select("k", x.alias("x"), (F.col("t") / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def density_summary(grid: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Peak of a density (the first of equals) with the column's extremes and median."""
    v = F.when(present(column), F.col(column))
    peak = grid.agg(F.max_by("x", F.struct("density", -F.col("k"))).alias("peak"))
    return df.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median")).join(F.broadcast(peak)).select(*[F.round(c, 6).alias(c) for c in ("peak", "min", "max", "median")])


def density_quantiles(grid: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """First place at which the normalised running sum of a density (a few hundred rows) reaches each quantile."""
    from pyspark.sql import Window

    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.round(F.sum("density").over(order) / F.sum("density").over(Window.partitionBy()), 9)
    places = grid.select("x", cum.alias("cum"))
    return places.agg(*[F.round(F.min(F.when(F.col("cum") >= q, F.col("x"))), 6).alias(f"q{round(q * 100)}") for q in quantiles])


def _hull(x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
    """Indices of the lower (sign 1) or upper (sign -1) hull of points sorted by x."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if sign * ((y[b] - y[a]) * (x[i] - x[a]) - (y[i] - y[a]) * (x[b] - x[a])) >= 0:
                keep.pop()
            else:
                break
        keep.append(i)
    return np.array(keep)


def dip(values: np.ndarray, counts: np.ndarray) -> float:
    """Hartigan's dip of a weighted sample: half the least sup-distance of its ECDF band to unimodal distributions.

    Alternates greatest convex minorant and least concave majorant on a shrinking modal interval.
    """
    n = counts.sum()
    if n == 0:
        return float("nan")
    if len(values) < 2:
        return 1.0 / (2 * n)
    high = np.cumsum(counts) / n
    low = high - counts / n
    a, b, best = 0, len(values) - 1, 1.0 / n
    while True:
        x = values[a : b + 1]
        g, h = _hull(x, low[a : b + 1], 1), _hull(x, high[a : b + 1], -1)
        minorant = np.interp(x, x[g], low[a : b + 1][g])
        majorant = np.interp(x, x[h], high[a : b + 1][h])
        at_g, at_h = majorant[g] - low[a : b + 1][g], high[a : b + 1][h] - minorant[h]
        widest = max(at_g.max(), at_h.max())
        if widest <= best:
            return best / 2
        if at_g.max() >= at_h.max():
            i = g[np.argmax(at_g)]
            left, right = i, h[np.searchsorted(h, i)]
        else:
            j = h[np.argmax(at_h)]
            left, right = g[np.searchsorted(g, j, "right") - 1], j
        outside = max(
            (high[a : a + left + 1] - minorant[: left + 1]).max(initial=0.0),
            (majorant[right:] - low[a + right : b + 1]).max(initial=0.0),
        )
        best = max(best, outside)
        if left == 0 and right == b - a or left >= right:
            return best / 2
        a, b = a + left, a + right


#: Uniform samples by whose dips a p-value is found, and their largest size; beyond it the dip's root-n law holds.
DIP_SAMPLES, DIP_ROWS = 400, 256


@lru_cache(maxsize=64)
def _uniform_dips(rows: int) -> np.ndarray:
    """Ascending dips of uniform samples, times the root of their size."""
    rng = np.random.default_rng([20_24, rows])
    return np.sort([dip(np.sort(rng.uniform(size=rows)), np.ones(rows)) for _ in range(DIP_SAMPLES)]) * math.sqrt(rows)


def dip_p_value(d: float, n: int) -> float:
    """The share of uniform samples of n rows whose dip is at least `d`, in steps of 1 / DIP_SAMPLES."""
    null = _uniform_dips(min(n, DIP_ROWS))
    return float((null >= d * math.sqrt(n) - 1e-12).mean())


def dip_statistics(long: DataFrame, key: str, value: str, places: int = 4) -> DataFrame:
    """`n`, `dip`, `p_value` per key of values rounded to `places` (the precision distances are stored with).

    A task holds one key's distinct rounded values, whose number doesn't grow with the rows; below ten rows null.
    """
    counts = long.filter(present(value)).select(F.col(key).alias("k"), F.bround(F.col(value).cast("double"), places).alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))

    def run(t: pa.Table) -> pa.Table:
        v, n = t.column("v").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(v)
        d = round(float(dip(v[order], n[order])), 6) if n.sum() >= LEAST_ROWS else None
        p = None if d is None else dip_p_value(d, int(n.sum()))
        return pa.table({"k": t.column("k")[:1], "n": pa.array([int(n.sum())], pa.int64()), "dip": pa.array([d], pa.float64()), "p_value": pa.array([p], pa.float64())})

    kind = long.schema[key].dataType.simpleString()
    return counts.groupBy("k").applyInArrow(run, f"k {kind}, n bigint, dip double, p_value double").withColumnRenamed("k", key)
