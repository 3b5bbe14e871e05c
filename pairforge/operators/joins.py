"""Joins whose hot keys are never brought together in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more rows than this are joined by a broadcast, if they also hold a HOT_SHARE of all rows.
HOT_ROWS = 100_000
HOT_SHARE = 0.001


def spread_join(rows: DataFrame, sums: DataFrame, key: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`rows` joined with `sums` (`key`, `n` rows of that key in `rows`, ...) on `key`, without `n`; inner, and each key
    once in `sums`.

    Rows of hot keys stay where they are: their sums are broadcast. At most 1 / HOT_SHARE keys hold such a share of
    `total` rows, so the broadcast is bounded whatever the input; all other keys are joined by a shuffle. Null keys
    match nothing.
    """
    hot = sums.filter(F.col("n") > max(hot_rows, int(total * HOT_SHARE)))
    few = hot.collect()
    cold = rows.join(sums.drop("n"), key)
    if not few:
        return cold
    known = F.broadcast(rows.sparkSession.createDataFrame(few, sums.schema).drop("n"))
    rest = rows.join(known.select(key), key, "left_anti").join(sums.drop("n"), key)
    return rest.unionByName(rows.join(known, key))
