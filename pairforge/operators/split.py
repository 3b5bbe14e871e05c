"""Cluster-wise train/val/test split with leakage control.

Clusters are taken largest first (equal sizes by id), each for the split with the largest relative deficit; train and
val only while they have room. Clusters of equal size differ only in their ids, so a block of them is allocated in
closed form: the driver folds over the distinct sizes (N records have at most sqrt(2N) of them) and keeps only counts,
and each cluster finds its split from its rank in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

NAMES = ("train", "val", "test")


def cluster_sizes(members: DataFrame) -> DataFrame:
    """`cluster_id`, `size`: distinct members per cluster; null ids and members don't count."""
    return members.filter(F.col("cluster_id").isNotNull() & F.col("member").isNotNull()).groupBy("cluster_id").agg(F.countDistinct("member").alias("size"))


def group_by_representative(members: DataFrame, order: str) -> DataFrame:
    """`cluster_id` (from 0, by first appearance), `representative`, `size` of a (representative, member) table."""
    groups = members.groupBy("representative").agg(F.count("*").alias("size"), F.min(order).alias("first"))
    ranked = running_sums(groups.withColumn("_one", F.lit(1)), [], "first", ["_one"])
    return ranked.select((F.col("cum__one") - 1).alias("cluster_id"), "representative", "size")


class Block:
    """How many of a block's first k clusters of one size each split gets.

    The j-th cluster of a split is given at the deficit (room - j * size) / target; the block's order is that of all
    such levels, highest first, train before val before test, where train and val have positive levels only.
    """

    def __init__(self, size: int, targets: tuple[int, int, int], counts: tuple[int, int, int]):
        self.s, self.t = size, targets
        self.room = tuple(t - c for t, c in zip(targets, counts))

    def _levels(self, i: int) -> int:
        """Positive levels of split i."""
        return max(0, -(-self.room[i] // self.s)) if self.t[i] > 0 else 0

    def _ahead(self, i: int, a: int, k: int, equal: bool) -> int:
        """Levels of split k above (or, if `equal`, at) the level a / targets[i]."""
        if self.t[k] <= 0:
            return 0
        x = self.room[k] * self.t[i] - self.t[k] * a
        n = x // (self.s * self.t[i]) + 1 if equal else -(-x // (self.s * self.t[i]))
        return max(0, min(n, self._levels(k)))

    def place(self, i: int, j: int) -> int:
        """The rank in the block at which split i (train or val) gets its j-th cluster."""
        a = self.room[i] - j * self.s
        return j + sum(self._ahead(i, a, k, k < i) for k in range(3) if k != i)

    def given(self, i: int, k: int) -> int:
        """Clusters of train or val among the first k of the block."""
        low, high = 0, self._levels(i)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.place(i, mid) < k else (low, mid)
        return low

    def counts(self, m: int) -> tuple[int, int, int]:
        a, b = self.given(0, m), self.given(1, m)
        return a, b, m - a - b

    def split(self, k: int) -> int:
        """The split of the cluster of rank k."""
        return int(self.splits(np.array([k]))[0])

    def splits(self, ranks: np.ndarray) -> np.ndarray:
        """The splits of the clusters of these ranks, all at once.

        Products of totals may exceed 64 bits; then Python's whole numbers are used in the same steps.
        """
        largest = max(abs(x) for x in (*self.room, *self.t, 1)) + self.s * (int(ranks.max(initial=0)) + 2)
        kind = np.int64 if largest * max(*self.t, 1) * 2 < 2**62 else object
        ranks = ranks.astype(kind)
        out = np.full(len(ranks), 2)
        for i in (1, 0):
            gained = self._given(i, ranks + 1) > self._given(i, ranks)
            out[gained.astype(bool)] = i
        return out

    def _given(self, i: int, k: np.ndarray) -> np.ndarray:
        """As `given`, for an array of k: one bisection for all."""
        levels = self._levels(i)
        if not levels:
            return np.zeros(len(k), np.int64)
        low, high = np.zeros(len(k), k.dtype), np.full(len(k), levels, k.dtype)
        for _ in range(levels.bit_length() + 1):
            mid = (low + high) // 2
            a = self.room[i] - mid * self.s
            place = mid.copy()
            for j in range(3):
                if j != i and self.t[j] > 0:
                    x = self.room[j] * self.t[i] - self.t[j] * a
                    n = x // (self.s * self.t[i]) + 1 if j < i else -(-x // (self.s * self.t[i]))
                    place += np.clip(n, 0, self._levels(j))
            up = (place < k) & (low < high)
            low, high = np.where(up, mid + 1, low), np.where(up, high, np.where(low < high, mid, high))
        return low


def greedy_split(sizes: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """`cluster_id`, `size`, `split` of every cluster of (`cluster_id`, `size`).

    Targets are the truncated shares of all records, test takes the rest. Ratios must sum to one.
    """
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1.0, got {sum(ratios)}")
    blocks = [(int(r["size"]), int(r["n"])) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()]
    total = sum(s * n for s, n in blocks)
    train, val = int(total * ratios[0]), int(total * ratios[1])
    targets, counts, starts = (train, val, total - train - val), (0, 0, 0), {}
    for size, n in blocks:
        starts[size] = counts
        counts = tuple(c + size * g for c, g in zip(counts, Block(size, targets, counts).counts(n)))
    ranked = running_sums(sizes.select("cluster_id", "size", F.lit(1).alias("_one")), ["size"], "cluster_id", ["_one"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(NAMES)
        for b in batches:
            sizes_, ranks = (b.column(i).to_numpy() for i in (1, 2))
            chosen = np.empty(b.num_rows, np.int64)
            for s in np.unique(sizes_).tolist():
                rows = np.flatnonzero(sizes_ == s)
                chosen[rows] = Block(s, targets, starts[s]).splits(ranks[rows] - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), names.take(pa.array(chosen))], names=["cluster_id", "size", "split"])

    return ranked.select("cluster_id", "size", "cum__one").mapInArrow(run, "cluster_id bigint, size bigint, split string")


def split_members(members: DataFrame, splits: DataFrame) -> DataFrame:
    """`member`, `split`: each distinct member once; one of several splits goes to the first of train, val, test."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    placed = members.filter(F.col("member").isNotNull()).join(splits.select("cluster_id", "split"), "cluster_id")
    first = placed.groupBy("member").agg(F.min(order).alias("_o"))
    return first.select("member", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("_o") + 1).alias("split"))


def pair_splits(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """`pairs` with `query_split`, `target_split`; null for ends in no split."""
    side = lambda c: membership.select(F.col("member").alias(c), F.col("split").alias(f"{c}_split"))
    return pairs.join(side("query"), "query", "left").join(side("target"), "target", "left")


def same_split(pairs: DataFrame) -> DataFrame:
    """Pairs both of whose ends are in one split; pairs with an end in no split fall out."""
    return pairs.filter("query_split = target_split").withColumn("pair_split", F.col("query_split"))


def across_splits(pairs: DataFrame) -> DataFrame:
    return pairs.filter("query_split <> target_split")


def split_summary(splits: DataFrame) -> DataFrame:
    """Clusters and records of each split with their shares."""
    per = splits.groupBy("split").agg(F.count("*").alias("clusters"), F.sum("size").alias("items"))
    whole = splits.agg(F.sum("size").alias("_all"))
    return per.join(F.broadcast(whole)).select("split", "clusters", "items", F.round(F.col("items") / F.col("_all"), 6).alias("share"))
