"""Comparison of two runs by unordered pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import number_or_null
from ..functions.scores import pair_key


def keyed(run: DataFrame, value: str) -> DataFrame:
    """`pair_key`, `value` of each row with both ends; the key is the same in either direction. A NaN is a missing value, like null."""
    return run.select(pair_key("query", "target").alias("pair_key"), number_or_null(F.col(value).try_cast("double")).alias("value")).filter(F.col("pair_key").isNotNull())


def one_per_pair(run: DataFrame) -> DataFrame:
    """One row per key: the largest value, null only if there is no other."""
    return run.groupBy("pair_key").agg(F.max("value").alias("value"))


def overlap_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of either run, in both, and in one only, by one full join of the de-duplicated keys."""
    a = first.select("pair_key").distinct().withColumn("in_1", F.lit(1))
    b = second.select("pair_key").distinct().withColumn("in_2", F.lit(1))
    j = a.join(b, "pair_key", "full")
    one, two = F.col("in_1").isNotNull(), F.col("in_2").isNotNull()
    return j.agg(F.count_if(one).alias("pairs_1"), F.count_if(two).alias("pairs_2"), F.count_if(one & two).alias("common"), F.count_if(one & ~two).alias("only_1"), F.count_if(two & ~one).alias("only_2"))


def common_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """`pair_key`, `value`, `value_2` of pairs in both runs."""
    return one_per_pair(first).join(one_per_pair(second).withColumnRenamed("value", "value_2"), "pair_key")
