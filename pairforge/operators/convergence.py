"""How fast sampled pair distances converge to a reference distribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import euclidean, pair_index
from ..session import Scratch
from .ordered import present, running_sums
from .pairwise import ecdf_distances


def log_sizes(low: int, high: int, steps: int) -> list[int]:
    """Log-spaced whole sample sizes, each once."""
    a, b = math.log10(low), math.log10(high)
    return sorted({int(10 ** (a + (b - a) * i / max(steps - 1, 1))) for i in range(steps)})


def row_numbers(ids: DataFrame, key: str) -> DataFrame:
    """`key`, `row` from 0 in the order of a unique numeric key, without a global window."""
    cum = running_sums(ids.select(key, F.lit(1).alias("_one")), [], key, ["_one"])
    return cum.select(key, (F.col("cum__one") - 1).alias("row"))


def sampled_indices(spark, n: int, cells: Sequence[tuple[int, int, int]]) -> DataFrame:
    """`sample_size`, `repetition`, `k`: distinct linear indices of the n (n - 1) / 2 pairs for each cell (size,
    repetition, seed), drawn by hash; all pairs if there are fewer.

    Draws are hashes of a running number, a few more than needed; after removal of repeats those with the smallest
    second hash stay, so no part of the triangle is favoured.
    """
    total = n * (n - 1) // 2
    out = None
    for size, rep, seed in cells:
        if size >= total:
            part = spark.range(total).select(F.col("id").alias("k"), F.col("id").alias("h"))
        else:
            # Draws until `size` distinct ones can be expected, and a margin of six standard deviations.
            need = -total * math.log1p(-size / total)
            draws = int(need + 6 * math.sqrt(need + 1) + 16)
            part = spark.range(draws).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("k")).select("k", F.xxhash64("k", F.lit(seed + 1)).alias("h"))
        part = part.select(F.lit(size).alias("sample_size"), F.lit(rep).alias("repetition"), "k", "h")
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy("sample_size", "repetition").orderBy("h", "k")
    kept = out.distinct().withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= F.col("sample_size"))
    return kept.select("sample_size", "repetition", "k")


def sampled_distances(vectors: DataFrame, key: str, vector: str, cells: Sequence[tuple[int, int, int]], n: int | None = None) -> DataFrame:
    """`sample_size`, `repetition`, `k`, `i`, `j`, `distance` of sampled pairs of rows of all cells: two equi-joins on the
    row number, no cross product."""
    n = vectors.count() if n is None else n
    numbered = row_numbers(vectors, key).join(vectors.select(key, vector), key)
    i, j = pair_index(F.col("k"), n)
    at = sampled_indices(vectors.sparkSession, n, cells).withColumns({"i": i, "j": j})
    side = lambda c: numbered.select(F.col("row").alias(c), F.col(vector).alias(f"_{c}"))
    return at.join(side("i"), "i").join(side("j"), "j").select("sample_size", "repetition", "k", "i", "j", euclidean("_i", "_j").alias("distance"))


def all_distances(vectors: DataFrame, key: str, vector: str, block: int = 256) -> DataFrame:
    """`i`, `j`, `distance` of every pair of rows, i < j, numbered from 0 in the order of a unique numeric key.

    Rows go into blocks of `block`; one equi-join on the pair of blocks brings each pair of rows together once, so no
    row meets the whole table in one task.
    """
    numbered = row_numbers(vectors, key).join(vectors.select(key, vector), key)
    blocks = -(-vectors.count() // block)
    own = F.floor(F.col("row") / block).cast("int")
    side = lambda c, x, y: numbered.select(F.col("row").alias(c), F.col(vector).alias(f"_{c}"), own.alias(x), F.explode(F.sequence(*((own, F.lit(blocks - 1)) if y == "_y" else (F.lit(0), own)))).alias(y))
    pairs = side("i", "_x", "_y").join(side("j", "_y", "_x"), ["_x", "_y"]).filter(F.col("i") < F.col("j"))
    return pairs.select("i", "j", euclidean("_i", "_j").alias("distance"))


def convergence(vectors: DataFrame, key: str, vector: str, sizes: Sequence[int], repetitions: int, reference_size: int, seed: int = 42) -> DataFrame:
    """Per sample size, over repetitions: `mean_error` (of the mean of means), `mean_spread` (population deviation of
    means), mean `wasserstein` and `ks` against a reference sample. All samples are drawn and compared in one pass."""
    work = Scratch(vectors.sparkSession, "convergence")
    cells = [(s, r, seed + 1000 * (r + 1) + s) for s in sizes for r in range(repetitions)]
    drawn = work.save(sampled_distances(vectors, key, vector, [*cells, (reference_size, -1, seed)]).select("sample_size", "repetition", F.col("distance").alias("v")), "samples")
    return convergence_of(drawn.filter("repetition >= 0"), drawn.filter("repetition < 0").select("v"))


def convergence_of(parts: DataFrame, reference: DataFrame) -> DataFrame:
    """The same table of samples that are there: `sample_size`, `repetition`, `v`, against the column `v` of `reference`.

    The reference counts by distinct value before it meets the cells (sample size and repetition, a short list).
    """
    keys = ["sample_size", "repetition"]
    parts, reference = (x.filter(present("v")) for x in (parts, reference))
    cells = [F.struct(*[F.lit(r[k]).alias(k) for k in keys]) for r in parts.select(*keys).distinct().collect()]
    if not cells:
        return parts.sparkSession.createDataFrame([], "sample_size bigint, mean_error double, mean_spread double, wasserstein double, ks double")
    theirs = reference.groupBy("v").agg(F.count("*").alias("w")).select("v", "w", F.explode(F.array(*cells)).alias("c")).select("v", "w", "c.*")
    mine = parts.groupBy(*keys, "v").agg(F.count("*").alias("u"))
    counts = mine.withColumn("w", F.lit(0).cast("long")).unionByName(theirs.withColumn("u", F.lit(0).cast("long")).select(*keys, "v", "u", "w"))
    distances = ecdf_distances(counts.groupBy(*keys, "v").agg(F.sum("u").alias("u"), F.sum("w").alias("w")), keys)
    means = parts.groupBy(*keys).agg(F.avg("v").alias("mean"))
    ref = reference.agg(F.avg("v").alias("ref"))
    each = means.join(distances, keys).join(F.broadcast(ref))
    out = each.groupBy("sample_size", "ref").agg(F.abs(F.avg("mean") - F.col("ref")).alias("mean_error"), F.stddev_pop("mean").alias("mean_spread"), mean_of_places("wasserstein").alias("wasserstein"), mean_of_places("ks").alias("ks"))
    return out.select("sample_size", *[F.round(c, 6).alias(c) for c in ("mean_error", "mean_spread")], "wasserstein", "ks")


def mean_of_places(column: str) -> F.Column:
    """Aggregate: the mean, to 6 places, of a column that has been rounded to 6 places.

    An even number of such values often has a mean half-way between two places, where a sum of doubles falls to either
    side by the order of its rows; so the sum is one of decimals. Values that no decimal holds have a mean of doubles.
    """
    exact = F.col(column).try_cast("decimal(28,6)")
    mean = F.round(F.try_divide(F.sum(exact), F.count(exact)), 6).cast("double")
    return F.when(F.count(exact) == F.count(column), mean).otherwise(F.round(F.avg(column), 6))


def gamma_fit(df: DataFrame, column: str) -> DataFrame:
    """Gamma distribution by moments: `shape` = mean^2 / var, `scale` = var / mean."""
    m = df.agg(F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    return m.select(F.round(F.try_divide(F.col("m") * F.col("m"), F.col("v")), 6).alias("shape"), F.round(F.try_divide(F.col("v"), F.col("m")), 6).alias("scale"))


def gamma_density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """`k`, `x`, `density` of the fitted gamma distribution at `points` places from the smallest to the largest value.

    One row of moments reaches the driver. No rows without spread or with a mean of zero or less; places at or below
    zero have density 0.
    """
    v = F.col(column).cast("double")
    m = df.filter(present(column)).agg(F.avg(v).alias("m"), F.var_pop(v).alias("v"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    spark = df.sparkSession
    if not m["v"] or m["m"] <= 0:
        return spark.createDataFrame([], "k int, x double, density double")
    shape, scale = m["m"] ** 2 / m["v"], m["v"] / m["m"]
    x = F.lit(m["lo"]) + F.col("k") * ((m["hi"] - m["lo"]) / max(points - 1, 1))
    density = F.exp((shape - 1) * F.log("x") - F.col("x") / scale - (math.lgamma(shape) + shape * math.log(scale)))
    grid = spark.range(points).select(F.col("id").cast("int").alias("k")).withColumn("x", x)
    return grid.select("k", F.round("x", 6).alias("x"), F.round(F.when(F.col("x") > 0, density).otherwise(0.0), 6).alias("density"))


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Exactly `size` rows without replacement, the same in every run: those with the smallest hash of a unique key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


def fraction_sample(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    return hash_sample(df, key, int(df.count() * fraction), seed)
