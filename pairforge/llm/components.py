"""Consolidating pairwise matches into groups: union-find in edge partitions, then merges of spanning forests.

Round 0 runs union-find over each scan partition as it is (no shuffle) and keeps only a spanning forest: one row per
vertex and partition. A vertex seen in several partitions links their trees, so the next graph has the trees' roots as
vertices and one edge per link. A tree's root is the vertex with the smallest hash of that round, so of any graph, an
ordered chain included, every round keeps only a fixed share of the vertices, however edges fall to partitions; each
root carries the smallest name below it. Rounds go on over hash partitions of bounded size until the remaining links
fit one bounded partition; then the labels are handed down through the saved rounds by equi-joins. No step needs a task
that holds all edges of a vertex, and nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Edges that a task joins in memory at a time; more are joined in several forests.
FOREST_EDGES = 1_000_000
#: Links that one partition of a later round holds on average, and that the last, single task finishes.
TASK_EDGES = 200_000


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Union-find over integer vertices 0..n-1: for each the smallest vertex of its component.

    Trees are hooked onto smaller roots for all edges at once, paths are halved until flat, and edges inside a tree drop out.
    """
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(a: pa.Array, b: pa.Array, turn: int) -> tuple[pa.Array, pa.Array]:
    """(vertex, root) of the edges a-b, each vertex once; the root is the vertex of its tree with the smallest hash of
    this `turn` (equal hashes by name), so it depends on the edges alone and not on their order."""
    n = len(a)
    enc = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    by_name = pc.sort_indices(enc.dictionary).to_numpy()
    hashes = pd.util.hash_array(enc.dictionary.to_numpy(zero_copy_only=False), hash_key=f"components-{turn % 10_000:05d}", categorize=False)
    order = by_name[np.argsort(hashes[by_name], kind="stable")]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[enc.indices.to_numpy()]
    root = roots(ids[:n], ids[n:], len(order))
    names = enc.dictionary.take(pa.array(order))
    return names, names.take(pa.array(root))


def _forests(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[pa.Array] = []
        b: list[pa.Array] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                x, y = forest(pa.concat_arrays(a), pa.concat_arrays(b), turn)
                yield pa.RecordBatch.from_arrays([x, y], names=["vertex", "root"])

        for batch in batches:
            a.append(batch.column(0).cast(pa.string()))
            b.append(batch.column(1).cast(pa.string()))
            held += batch.num_rows
            if held >= FOREST_EDGES:
                yield from flush()
                a, b, held = [], [], 0
        yield from flush()

    return run


def connected_components(edges: DataFrame, a: str | Column, b: str | Column, task_edges: int = TASK_EDGES) -> DataFrame:
    """`vertex`, `group_id` of every vertex of the graph; group_id is the smallest vertex of its component.

    `a` and `b` are string columns or expressions. An edge with one null end links nothing, but its other end is a
    vertex; an edge with two null ends is nothing. Loops and repeated edges change nothing. No edges give no rows.
    """
    spark = edges.sparkSession
    work = Scratch(spark, "components")
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    pairs = edges.select(a.cast("string").alias("a"), b.cast("string").alias("b"))
    pairs = pairs.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).filter(F.col("a").isNotNull())
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        trees = pairs.mapInArrow(_forests(len(levels)), "vertex string, root string")
        if not levels:
            trees = trees.withColumn("low", F.col("vertex"))
        else:
            trees = trees.withColumn("low", F.lit(None).cast("string")).unionByName(lows.select("vertex", F.lit(None).cast("string").alias("root"), "low"))
        # At most one root per vertex and forest: the sets are as long as there are partitions, not rows.
        level = trees.groupBy("vertex").agg(F.collect_set("root").alias("roots"), F.min("low").alias("low")).filter(F.size("roots") > 0)
        level = work.save(level.select("vertex", F.array_min("roots").alias("parent"), "roots", "low"), "forest")
        lows = work.save(level.groupBy(F.col("parent").alias("vertex")).agg(F.min("low").alias("low")), "lows")
        levels.append((level, lows))
        links = level.filter(F.size("roots") > 1).select(
            F.col("parent").alias("a"), F.explode(F.array_except("roots", F.array("parent"))).alias("b")
        )
        links = work.save(links.distinct(), "links")
        count = links.count()
        if count <= task_edges:
            # One bounded task ends it: these are the links between trees, not the edges.
            last = work.save(links.coalesce(1).mapInArrow(_forests(len(levels)), "vertex string, root string"), "last")
            least = lows.join(last, "vertex").groupBy("root").agg(F.min("low").alias("group_id"))
            label = work.save(last.join(least, "root").select("vertex", "group_id"), "labels")
            work.drop(links, last)
            break
        parts = -(-count * 2 // task_edges)
        # By the larger end first, so that a vertex with very many links is spread; by both ends in every other round.
        # Sorted, so that a task that runs again makes the same forests.
        pairs = links.repartition(parts, *(["b"] if len(levels) % 2 else ["a", "b"])).sortWithinPartitions("a", "b")
    while levels:
        level, lows = levels.pop()
        # A root without links is a component's only tree.
        named = lows.join(label, "vertex", "left").select(F.col("vertex").alias("parent"), F.coalesce("group_id", "low").alias("group_id"))
        out = level.select("vertex", "parent").join(named, "parent").select("vertex", "group_id")
        if not levels:
            return out
        done = work.save(out, "labels")
        work.drop(level, lows, label)
        label = done
    raise AssertionError("no level")
