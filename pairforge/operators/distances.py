"""Distances of pairs in many embedding stores at once, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import euclidean


def mean_pool(df: DataFrame, keys: list[str], matrix: str) -> DataFrame:
    """Mean over the outer array of an array of vectors (rows of one length), in double; null or empty gives null."""
    zeros = F.transform(F.element_at(matrix, 1), lambda x: F.lit(0.0))
    total = F.aggregate(matrix, zeros, lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b.cast("double")))
    pooled = F.when(F.size(matrix) > 0, F.transform(total, lambda x: x / F.size(matrix)))
    return df.select(*keys, pooled.alias("embedding"))


def pair_distances(pairs: DataFrame, stores: DataFrame, names: list[str] | None = None) -> DataFrame:
    """`pairs` x stores: every pair's distance in every store, null where a side is missing.

    `pairs` has `query`, `target`; `stores` has `id`, `embedding_name`, `embedding`, each (id, name) once. `names` are
    the stores to report, by default all (one name per model, so a short list). Two equi-joins on
    (id, embedding_name) serve all stores. Distances are rounded half-even to four places.
    """
    if names is None:
        names = [r[0] for r in stores.select("embedding_name").distinct().orderBy("embedding_name").collect()]
    grid = pairs.withColumn("embedding_name", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    side = lambda c: stores.select(F.col("id").alias(c), "embedding_name", F.col("embedding").alias(f"_{c}"))
    out = grid.join(side("query"), ["query", "embedding_name"], "left").join(side("target"), ["target", "embedding_name"], "left")
    return out.select(*pairs.columns, "embedding_name", F.bround(euclidean("_query", "_target"), 4).alias("distance"))


def coverage(long: DataFrame) -> DataFrame:
    """Valid distances per store, with mean and sample standard deviation; NaN counts as missing."""
    d = F.when(~F.isnan("distance"), F.col("distance"))
    out = long.groupBy("embedding_name").agg(F.count("*").alias("pairs"), F.count(d).alias("valid"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"))
    return out.select("embedding_name", "pairs", "valid", F.round(F.col("valid") * 100.0 / F.col("pairs"), 6).alias("coverage_pct"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def widen(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One `dist_<name>` column per store."""
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("embedding_name") == n, F.col("distance"))).alias(f"dist_{n}") for n in names])


def distance_columns(df: DataFrame, without: tuple[str, ...] = ("random",)) -> list[str]:
    """The `dist_` columns, but those of stores whose name starts with a word in `without`."""
    return [c for c in df.columns if c.startswith("dist_") and not c[5:].startswith(without)]


def store_name(column: str) -> str:
    """The store of a `dist_` column."""
    return column.removeprefix("dist_")


def unfinished(names: DataFrame, done: DataFrame) -> DataFrame:
    """Stores that an interrupted run has yet to compute."""
    return names.join(done.select("embedding_name").distinct(), "embedding_name", "left_anti")
