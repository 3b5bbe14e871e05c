"""Regression metrics, their bootstrap intervals, fitted lines, error curves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism
from .joins import HOT_ROWS, spread_join
from .ordered import average_ranks, present, running_sums
from .pairwise import moments_correlation, spearman_by


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    """t with a two-sided tail of 2 * (1 - p), by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def correlation_p(r, n):
    """p-value of a correlation (or a line's slope) of n rows; null below three rows or without r."""
    out = []
    for x, k in zip(r, n):
        if x is None or math.isnan(x) or k < 3:
            out.append(None)
        elif abs(x) >= 1:
            out.append(0.0)
        else:
            out.append(t_two_sided(x * math.sqrt((k - 2) / (1 - x * x)), k - 2))
    import pandas as pd

    return pd.Series(out, dtype="float64")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = df.filter(present(x, y))
    out = rows.agg(F.count("*").alias("n"), moments_correlation(x, y).alias("r"))
    return out.select("n", F.round("r", 6).alias("pearson"), F.round(correlation_p("r", "n"), 6).alias("p_value"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    out = spearman_by(df, [], x, y)
    return out.select("n", F.round("rho", 6).alias("spearman"), F.round(correlation_p("rho", "n"), 6).alias("p_value"))


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and Pearson's r (squared too) of complete rows; null below two rows.

    R2 of a constant truth is 1 if all residuals are 0, else 0; correlations of a constant side are null.
    """
    rows = df.filter(present(truth, prediction)).select(F.col(truth).cast("double").alias("t"), F.col(prediction).cast("double").alias("p"))
    err = F.col("t") - F.col("p")
    a = rows.agg(F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("t").alias("v"), moments_correlation("t", "p").alias("r"))
    return a.select(*_metric_columns())


def _metric_columns() -> list[F.Column]:
    r2 = F.when(F.col("v") > 0, 1 - F.try_divide(F.col("mse"), F.col("v"))).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    ok = F.col("n") >= 2
    named = [("mse", F.col("mse")), ("rmse", F.sqrt("mse")), ("mae", F.col("mae")), ("r2", r2), ("pearson", F.col("r")), ("pearson_r2", F.col("r") * F.col("r"))]
    return [F.col("n"), *[F.round(F.when(ok, c), 6).alias(k) for k, c in named]]


def metrics_by(df: DataFrame, keys: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """`regression_metrics` of every group of `keys` in one pass, so all experiments are evaluated by one job."""
    rows = df.filter(present(truth, prediction)).select(*keys, F.col(truth).cast("double").alias("t"), F.col(prediction).cast("double").alias("p"))
    err = F.col("t") - F.col("p")
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("t").alias("v"), moments_correlation("t", "p").alias("r"))
    return a.select(*keys, *_metric_columns())


def unevaluated(predictions: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions of experiments that have no metrics yet, so that a second evaluation does only what is left."""
    return predictions.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _occurrences() -> np.ndarray:
    """Poisson(1) occurrences by a 16-bit draw."""
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(chances, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def bootstrap_sums(df: DataFrame, key: Sequence[str], columns: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """`replicate`, `weight` and `moments`: weighted sums of all `columns` (doubles) in each replicate.

    Each row counts Poisson(1) times in a replicate, by a hash of its key, four replicates to a hash. Sums are taken
    batch by batch, so a task moves one row per replicate whatever it reads.
    """
    k = len(columns)
    blocks = -(-replicates // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = _occurrences()
        salt = _mix(np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        total = np.zeros((4 * blocks, k + 1))
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            m = np.stack([np.ones(b.num_rows), *[b.column(i + 1).to_numpy() for i in range(k)]], 1)
            for at in range(0, len(h), 1024):
                part = h[at : at + 1024]
                draw = _mix(part[None, :] ^ salt[:, None]).view(np.uint16).reshape(blocks, len(part), 4)
                total += times[draw].transpose(0, 2, 1).reshape(4 * blocks, len(part)).astype(np.float64) @ m[at : at + 1024]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(total[:replicates, i]) for i in range(k + 1)]], names=["replicate", "weight", *[f"s{i}" for i in range(k)]])

    rows = df.select(F.xxhash64(*key).alias("h"), *columns)
    sums = rows.mapInArrow(run, "replicate int, weight double, " + ", ".join(f"s{i} double" for i in range(k)))
    return sums.groupBy("replicate").agg(F.sum("weight").alias("weight"), *[F.sum(f"s{i}").alias(c) for i, c in enumerate(columns)])


def moment_correlation(x: str, y: str) -> F.Column:
    """Correlation from a replicate's sums of x, y, xx, yy, xy; null where a side is (nearly) constant."""
    n = F.col("weight")
    vx, vy = F.col(f"{x}{x}") / n - F.pow(F.col(x) / n, 2), F.col(f"{y}{y}") / n - F.pow(F.col(y) / n, 2)
    c = F.col(f"{x}{y}") / n - F.col(x) * F.col(y) / (n * n)
    return F.when((n >= 2) & (vx > 1e-9) & (vy > 1e-9), c / F.sqrt(vx * vy))


#: Statistics of a replicate by name: expressions over its sums. More may be added.
STATISTICS: dict[str, Callable[[], F.Column]] = {
    "pearson_r2": lambda: F.pow(moment_correlation("t", "p"), 2),
    "spearman": lambda: moment_correlation("u", "v"),
}


def bootstrap_interval(df: DataFrame, key: Sequence[str], truth: str, prediction: str, replicates: int = 1000, level: float = 0.95, seed: int = 42, statistics: dict[str, Callable[[], F.Column]] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`statistic`, `valid`, `se`, `ci_low`, `ci_high`, `doubtful` of each statistic, by default Pearson's r squared and
    Spearman's rho.

    `statistics` are expressions, made by the caller's functions, over a replicate's sums: `weight` (its rows), `t` and `p`
    (truth and prediction), `u` and `v` (their ranks as shares), products `tt`, `pp`, `tp`, `uu`, `vv`, `uv`, and `abs`
    and `square` of the errors. `doubtful` says that fewer than half of the replicates are valid.

    A Poisson bootstrap: like drawing with replacement, but no row needs to know the others, so one pass over the data
    serves all replicates and statistics, and the result doesn't depend on partitions. Spearman uses the sample's own
    average ranks in every replicate. Replicates with a constant side are invalid; with at most one valid, the
    interval is null.
    """
    rows = df.filter(present(truth, prediction)).select(*key, F.col(truth).cast("double").alias("t"), F.col(prediction).cast("double").alias("p"))
    # A value that very many rows share is not brought together: rows look its rank up where they are.
    total = rows.count()
    ranked = spread_join(spread_join(rows, average_ranks(rows, [], "t", "u"), "t", total, hot_rows), average_ranks(rows, [], "p", "v"), "p", total, hot_rows)
    size = F.broadcast(rows.agg(F.count("*").alias("_n")))
    ranked = ranked.join(size).withColumns({c: F.col(c) / F.col("_n") for c in "uv"})
    sums = {"t": F.col("t"), "p": F.col("p"), "tt": F.col("t") * F.col("t"), "pp": F.col("p") * F.col("p"), "tp": F.col("t") * F.col("p")}
    error = F.col("t") - F.col("p")
    sums |= {"abs": F.abs(error), "square": error * error}
    sums |= {"u": F.col("u"), "v": F.col("v"), "uu": F.col("u") * F.col("u"), "vv": F.col("v") * F.col("v"), "uv": F.col("u") * F.col("v")}
    # Each row costs thousands of draws, so it is worth a shuffle to keep all cores busy.
    wide = max(2 * default_parallelism(df.sparkSession), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    data = ranked.repartition(wide).select(*key, *[c.alias(n) for n, c in sums.items()])
    each = F.array(*[F.struct(F.lit(n).alias("statistic"), f().alias("s")) for n, f in (statistics or STATISTICS).items()])
    values = bootstrap_sums(data, key, list(sums), replicates, seed).select(F.explode(each).alias("e")).select("e.*")
    tail = (1 - level) / 2
    q = F.percentile("s", F.array(F.lit(tail), F.lit(1 - tail)))
    a = values.groupBy("statistic").agg(F.count("s").alias("valid"), F.stddev_samp("s").alias("se"), q.alias("q"))
    ok = F.col("valid") > 1
    return a.select("statistic", "valid", *[F.round(F.when(ok, c), 6).alias(k) for k, c in (("se", F.col("se")), ("ci_low", F.col("q")[0]), ("ci_high", F.col("q")[1]))], (2 * F.col("valid") < replicates).alias("doubtful"))


def line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per key: `slope`, `intercept`, `r2`, `p_value`; null where x is constant."""
    rows = df.filter(present(x, y))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), moments_correlation(x, y).alias("r"))
    return out.select(*keys, "n", "slope", "intercept", (F.col("r") * F.col("r")).alias("r2"), correlation_p("r", "n").alias("p_value"))


def line_band(df: DataFrame, x: str, y: str, points: int = 100, level: float = 0.95) -> DataFrame:
    """Fitted line and confidence band of the mean response at `points` places; one row of moments reaches the driver."""
    rows = df.filter(present(x, y))
    m = rows.agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c")).first()
    schema = "k int, x double, fit double, low double, high double"
    if m["n"] < 3 or not m["vx"]:
        return df.sparkSession.createDataFrame([], schema)
    slope = m["c"] / m["vx"]
    rest = max(0.0, (m["vy"] - slope * m["c"]) * m["n"] / (m["n"] - 2))
    t = t_quantile(1 - (1 - level) / 2, m["n"] - 2)
    at = df.sparkSession.range(points).select(F.col("id").cast("int").alias("k"), (F.lit(m["lo"]) + F.col("id") * (m["hi"] - m["lo"]) / max(points - 1, 1)).alias("x"))
    fit = F.lit(m["my"]) + slope * (F.col("x") - m["mx"])
    half = t * F.sqrt(rest * (1.0 / m["n"] + F.pow(F.col("x") - m["mx"], 2) / (m["n"] * m["vx"])))
    return at.select("k", *[F.round(c, 6).alias(n) for n, c in (("x", F.col("x")), ("fit", fit), ("low", fit - half), ("high", fit + half))])


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row `edges`: the q + 1 linear-interpolated quantiles."""
    return df.filter(present(column)).agg(F.percentile(column, F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("edges"))


def with_slices(df: DataFrame, column: str, q: int) -> DataFrame:
    """`slice` 1..q by right-closed quantile intervals, the lowest value included; repeated edges raise an error."""
    e = quantile_edges(df, column, q)
    checked = e.select(F.when(F.size(F.array_distinct("edges")) < q + 1, F.raise_error(F.lit("quantile edges must be unique")).cast("array<double>")).otherwise(F.col("edges")).alias("_edges"))
    inner = F.slice("_edges", 2, q - 1)
    return df.filter(present(column)).join(F.broadcast(checked)).withColumn("slice", 1 + F.size(F.filter(inner, lambda x: x < F.col(column)))).drop("_edges")


def error_ecdf(df: DataFrame, truth: str, prediction: str, q: int = 4) -> DataFrame:
    """`slice`, `error`, `share`: per truth slice, the percentage of absolute errors (6 places) up to each distinct one."""
    rows = with_slices(df.filter(present(truth, prediction)), truth, q).select("slice", F.round(F.abs(F.col(prediction) - F.col(truth)), 6).alias("error"))
    counts = rows.groupBy("slice", "error").agg(F.count("*").alias("n"))
    cum = running_sums(counts, ["slice"], "error", ["n"])
    sizes = counts.groupBy("slice").agg(F.sum("n").alias("_all"))
    return cum.join(F.broadcast(sizes), "slice").select("slice", "error", F.round(F.col("cum_n") * 100.0 / F.col("_all"), 6).alias("share"))
