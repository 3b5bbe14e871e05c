"""Roll-up of experiment results: metrics files, trends, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import line

NUMBER = r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|nan)"

# Display order of the three target scores and of the model types.
PARAMETER_ORDER = ("fident", "alntmscore", "hfsp")
MODEL_ORDER = ("fnn", "linear", "linear_distance", "euclidean")


def parse_key_values(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`path` and one double column per key from `path`, `line` rows of `key: value` text.

    Comments (#) are skipped; a missing key and a value that is neither a number nor nan are null, nan is NaN. Of
    repeated keys the largest counts.
    """
    kept = lines.filter(~F.trim("line").startswith("#"))
    value = lambda k: F.nullif(F.regexp_extract(F.trim("line"), f"^{k}:{NUMBER}\\s*$", 1), F.lit("")).try_cast("double")
    return kept.groupBy("path").agg(*[F.max(value(k)).alias(k) for k in keys])


def path_keys(paths: DataFrame, column: str = "path") -> DataFrame:
    """`dataset`, `model_type`, `parameter`, `embedding`: the four path parts before `evaluation_results`; others drop out."""
    m = lambda i: F.regexp_extract(column, r"([^/]+)/([^/]+)/([^/]+)/([^/]+)/evaluation_results/", i)
    out = paths.select("*", *[m(i).alias(n) for i, n in enumerate(("dataset", "model_type", "parameter", "embedding"), 1)])
    return out.filter(F.col("dataset") != "")


def with_lookup(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join of a lookup table (unique keys), with defaults for unknown keys; Spark broadcasts it if it is small."""
    out = df.join(lookup, key, "left")
    return out.select(*df.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def parameter_key(c: Column | str = "parameter") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PARAMETER_ORDER]), col), F.lit(0).cast("long")), F.lit(len(PARAMETER_ORDER) + 1).cast("long"))


def trend_lines(results: DataFrame, metric: str, skip: tuple[str, str] = ("fnn", "esm2_3b")) -> DataFrame:
    """Line of metric against model size per (parameter, model_type), slope per 1e9.

    `skip` (model type, embedding key) isn't fitted. Groups of fewer than two rows, or with a size of zero or less, are
    left out whole.
    """
    rows = results.filter(F.col("plm_size").isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric))
    rows = rows.filter(~((F.col("model_type") == skip[0]) & (F.col("embedding_key") == skip[1])))
    good = rows.groupBy("parameter", "model_type").agg(F.count("*").alias("_n"), F.min("plm_size").alias("_low")).filter("_n >= 2 and _low > 0")
    fit = line(rows.join(good, ["parameter", "model_type"], "left_semi"), "plm_size", metric, ["parameter", "model_type"])
    return fit.select("parameter", "model_type", "n", F.round(F.col("slope") * 1e9, 6).alias("slope_per_1b"), F.round("r2", 6).alias("r2"), F.round("p_value", 6).alias("p_value"))


def rank_by_parameter(results: DataFrame, model_type: str = "fnn", without: Sequence[str] = ()) -> DataFrame:
    """`parameter`, `embedding`, `abs_spearman`, `rank`: 1 is best; equal values rank by name, nulls last. Embeddings in
    `without` are left out before ranks are given."""
    a = results.filter((F.col("model_type") == model_type) & ~F.col("embedding").isin(*without)).select("parameter", "embedding", F.abs("spearman").alias("abs_spearman"))
    w = Window.partitionBy("parameter").orderBy(F.desc_nulls_last("abs_spearman"), "embedding")
    return a.withColumn("rank", F.row_number().over(w))


def final_ranking(ranks: DataFrame) -> DataFrame:
    """One row per embedding: its rank and value per parameter, the mean of the ranks there are, and the final rank."""
    wide = ranks.groupBy("embedding").agg(
        *[F.max(F.when(F.col("parameter") == p, F.col(c))).alias(f"{n}_{p}") for p in PARAMETER_ORDER for c, n in (("rank", "rank"), ("abs_spearman", "abs_spearman"))],
        F.avg("rank").alias("average_rank"),
    )
    # One row per embedding model, so one window over all is small.
    out = wide.withColumn("final_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("average_rank", "embedding")))
    return out.withColumn("average_rank", F.round("average_rank", 2))


def best_two(results: DataFrame, metric: str) -> DataFrame:
    """Best and second-best distinct score per (model_type, parameter): the smallest for mae, by size for spearman."""
    rows = results.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).select("model_type", "parameter", F.col(metric).alias("s")).distinct()
    order = {"mae": [F.asc("s")], "spearman": [F.desc(F.abs("s")), F.desc("s")]}.get(metric, [F.desc("s")])
    at = rows.withColumn("r", F.row_number().over(Window.partitionBy("model_type", "parameter").orderBy(*order))).filter("r <= 2")
    return at.groupBy("model_type", "parameter").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("second_best"))


def latest(df: DataFrame, keys: Sequence[str], stamp: str, value: str) -> DataFrame:
    """The row with the largest (stamp, value) per key; a null stamp is the oldest."""
    return df.groupBy(*keys).agg(F.max(F.struct(stamp, value)).alias("_m")).select(*keys, f"_m.{stamp}", f"_m.{value}")


def family_boundaries(models: DataFrame) -> DataFrame:
    """Places (from 0) in the order family, size, key at which another family begins; the table has one row per model."""
    w = Window.partitionBy(F.lit(0)).orderBy("family", "plm_size", "embedding_key")
    at = models.select("family", "embedding_key", (F.row_number().over(w) - 1).alias("position"), F.lag("family").over(w).alias("before"))
    return at.filter("before is not null and before <> family").select("position", "before", "family")


def experiment_grid(models: Sequence[str], parameters: Sequence[str], embeddings: DataFrame) -> DataFrame:
    """All cells (model_type, param_name, embedding_name) of an experiment."""
    lists = [F.explode(F.array(*[F.lit(x) for x in values])).alias(n) for n, values in (("model_type", models), ("param_name", parameters))]
    return embeddings.select("embedding_name").distinct().select("embedding_name", lists[0]).select("embedding_name", "model_type", lists[1])


def experiment_status(grid: DataFrame, files: DataFrame) -> DataFrame:
    """`status` per experiment_dir from the files found under it: completed, interrupted, empty or not_started."""
    known = files.groupBy("experiment_dir").agg(
        F.bool_or(F.col("file") == "training_complete.txt").alias("_done"), F.bool_or(F.col("file") == "checkpoints/last.ckpt").alias("_open"), F.count("*").alias("_n"))
    status = F.when(F.col("_done"), "completed").when(F.col("_open"), "interrupted").when(F.col("_n").isNotNull(), "empty").otherwise("not_started")
    return grid.join(known, "experiment_dir", "left").select(*grid.columns, status.alias("status"))
