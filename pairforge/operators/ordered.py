"""Ordered computations over whole columns without a task that holds a whole column.

Rows are cut into value ranges by approximate quantiles, windows run inside a range, and each range starts from the
sums of those before it. The number of ranges follows the number of rows of each key, so a range, and with it a task,
holds a bounded number of rows up to FINE * ROWS_PER_RANGE rows of a key. The ranges only decide where work happens;
results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a key has at most, a power of two, and rows that a range holds below that.
FINE = 1024
ROWS_PER_RANGE = 200_000


def _place(order: str) -> Column:
    """How many of the FINE - 1 ascending `_edges` lie below the value, by bisection; 0 without edges."""
    steps = F.array(*[F.lit(FINE >> i) for i in range(1, FINE.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_edges", at + step - 1) < F.col(order), at + step).otherwise(at))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], lead: bool = False, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`df` with `cum_<s>`: the sum of s over the rows of the same keys up to and including this row's `order`; with
    `lead` also `next_<order>`: the following order of the same keys, null at the last.

    `order` must be unique within the keys and numeric. Null orders fall out.
    """
    df = df.filter(F.col(order).isNotNull())
    keys = list(keys) or ["_all"]
    one = df if "_all" not in keys else df.withColumn("_all", F.lit(0))
    steps = F.array(*[F.lit(i / FINE) for i in range(1, FINE)])
    edges = one.groupBy(*keys).agg(F.percentile_approx(order, steps, 10 * FINE).alias("_edges"), F.count("*").alias("_rows"))
    # A key of few rows has few ranges: neighbouring fine ones are taken together.
    wide = F.least(F.lit(FINE), F.greatest(F.lit(1), F.floor(FINE * rows_per_range / F.col("_rows")))).cast("int")
    edges = edges.select(*keys, F.when(F.col("_rows") > rows_per_range, F.col("_edges")).alias("_edges"), wide.alias("_wide"))
    cut = one.join(edges, keys).withColumn("_range", F.floor(_place(order) / F.col("_wide")).cast("int")).drop("_edges", "_wide")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_range").agg(F.min(order).alias("_first"), *[F.sum(s).alias(f"_t_{s}") for s in sums])
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")).alias("_after")
    starts = totals.select(*keys, "_range", after, *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(starts, [*keys, "_range"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_s_{s}"))
    if lead:
        out = out.withColumn(f"next_{order}", F.coalesce(F.lead(order).over(Window.partitionBy(*keys, "_range").orderBy(order)), F.col("_after")))
    drop = ["_range", "_after", *[f"_s_{s}" for s in sums]] + (["_all"] if "_all" in keys else [])
    return out.drop(*drop)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks from 1 with ties averaged: one row per (keys, value), `out` and the number `n` of rows with that value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cum = running_sums(counts, keys, value, ["_n"])
    return cum.select(*keys, value, (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2).alias(out), F.col("_n").alias("n"))


def present(*columns: str) -> Column:
    """Neither null nor NaN, in all columns."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return cond
