"""Splits that keep related records together.

Records and entities (sources, authors, clusters, pairs) form a bipartite graph. Labels propagate along it: an entity
takes the smallest record it touches, a record the smallest its entities took. After each round the records of one
label are contracted to one, and entities that are left with one record fall out, so every round works on a smaller
graph. Then whole groups are assigned to splits such that each split's sizes by label come close to its share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import HOT_ROWS, spread_join
from ..session import Scratch

#: Groups of more than this share of all records are placed one by one, largest first.
LARGE_SHARE = 0.0005
#: Other groups are placed by the cell of their label and hash; so many cells per label.
CELLS = 256
#: Memberships that one task finishes in memory.
TASK_ROWS = 20_000
#: Labels beyond this many are stratified together.
MOST_LABELS = 64


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same propagation over one bounded graph in memory."""
    table = pa.Table.from_batches(batches)
    if not table.num_rows:
        return
    record, entity = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    record, entity = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (record, entity))
    order = pc.sort_indices(record.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    r, e = rank[record.indices.to_numpy()], entity.indices.to_numpy()
    label = np.arange(len(order))
    while True:
        low = np.full(len(entity.dictionary), len(order))
        np.minimum.at(low, e, label[r])
        new = label.copy()
        np.minimum.at(new, r, low[e])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    names = record.dictionary.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["record", "parent"])


def propagate(memberships: DataFrame, work: Scratch, task_rows: int = TASK_ROWS, hot_rows: int = HOT_ROWS, stars: DataFrame | None = None) -> DataFrame:
    """`record`, `group_id` (the smallest record of its component) of every record that shares an entity with another.

    `memberships`: `record`, `entity` (strings, no nulls); repeated rows change nothing. `stars`, if there are any, are
    memberships of entities that are named by their smallest record already, its own row included. In a round every entity takes its smallest record and is
    from then on named by it, so entities that took the same record are one; every record takes the smallest its
    entities took, and records with the same label are one. Each round needs partial aggregations and one join per
    side; the rows of a hot entity or record are never brought together in one place. A contracted graph of at most
    `task_rows` memberships is finished by one bounded task.
    """
    steps: list[DataFrame] = []
    graph = work.save(memberships, "graph")
    while True:
        total = graph.count() + (stars.count() if stars is not None else 0)
        if 0 < total <= task_rows:
            whole = graph if stars is None else graph.unionByName(stars)
            steps.append(work.save(whole.coalesce(1).mapInArrow(_local, "record string, parent string"), "parent"))
            work.drop(graph)
            break
        low = graph.groupBy("entity").agg(F.min("record").alias("low"), F.max("record").alias("high"), F.count("*").alias("n"))
        low = work.save(low.filter("low <> high").select("entity", "low", "n"), "low")
        linked = spread_join(graph, low, "entity", total, hot_rows).select("record", F.col("low").alias("entity"))
        linked, stars = work.save(linked if stars is None else linked.unionByName(stars), "linked"), None
        work.drop(graph, low)
        parent = work.save(linked.groupBy("record").agg(F.min("entity").alias("parent"), F.count("*").alias("n")), "parent")
        if parent.isEmpty():
            work.drop(linked, parent)
            break
        # Labels move on to their own parents, so a chain of labels is halved once more in each round.
        above = parent.filter("parent <> record").select(F.col("record").alias("parent"), F.col("parent").alias("above"))
        further = work.save(parent.join(above, "parent", "left").select("record", F.coalesce("above", "parent").alias("parent"), "n"), "parent")
        work.drop(parent)
        steps.append(further)
        moved = spread_join(linked, further, "record", total, hot_rows).select(F.col("parent").alias("record"), "entity").distinct()
        graph = work.save(moved, "graph")
        work.drop(linked)
    label = None
    while steps:
        step = steps.pop()
        if label is None:
            label = work.save(step.withColumnRenamed("parent", "group_id"), "label")
        else:
            up = label.select(F.col("record").alias("parent"), "group_id")
            below = step.join(up, "parent", "left").select("record", F.coalesce("group_id", "parent").alias("group_id"))
            done = work.save(below, "label")
            work.drop(label)
            label = done
        work.drop(step)
    if label is None:
        label = memberships.limit(0).select("record", F.col("record").alias("group_id"))
    return label


def place(sizes: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """The split of each unit, given its records by label (units x labels), in the order given.

    Each unit goes where the summed squared deviation of all splits' label counts from their targets, each relative to
    the label's total, grows least; equal growth goes to the split with the most room.
    """
    total = sizes.sum(0).astype(float)
    weight = 1.0 / np.maximum(total, 1.0) ** 2
    whole = sizes.sum()
    target = np.outer(np.asarray(shares, float), total)
    have = np.zeros_like(target)
    out = np.empty(len(sizes), np.int64)
    for i, unit in enumerate(sizes):
        gap = target - have
        growth = ((unit**2 - 2 * gap * unit) * weight).sum(1) + (unit.sum() ** 2 - 2 * gap.sum(1) * unit.sum()) / max(whole, 1) ** 2
        best = np.flatnonzero(growth <= growth.min() + 1e-15)
        s = best[np.argmax(gap[best].sum(1))]
        out[i] = s
        have[s] += unit
    return out


def with_groups(records: DataFrame, memberships: DataFrame, work: Scratch, stars: DataFrame | None = None) -> DataFrame:
    """`record`, `group_id`, `label` of every record; a record without entity is a group, a null label is ''."""
    known = memberships.filter(F.col("record").isNotNull() & F.col("entity").isNotNull()).select("record", "entity")
    label = propagate(known, work, stars=stars)
    return records.join(label, "record", "left").select("record", F.coalesce("group_id", "record").alias("group_id"), F.coalesce("label", F.lit("")).alias("label"))


def split_groups(records: DataFrame, memberships: DataFrame, shares: dict[str, float], seed: int = 0, stars: DataFrame | None = None) -> DataFrame:
    """`record`, `group_id`, `split` of every record.

    `records`: `record` (string, unique) and `label` (string, null is a label of its own); `memberships`: `record`,
    `entity`. Records that share an entity, directly or through others, get one group and one split; a record without
    entity is a group. A membership with a null end is nothing. Shares need not sum to one. `stars` are
    further memberships, in the form that `propagate` names. Groups of more than
    LARGE_SHARE of all records (at most 1 / LARGE_SHARE of them) are placed one by one, all others in CELLS cells per
    label, by the label most of their records have (smallest label at a tie) and a hash of the group: what the driver
    places is bounded, whatever the input. A cell holds about 1 / CELLS of its label's records, so that is about what
    a label's share of a split can miss. Empty tables give no rows.
    """
    spark = records.sparkSession
    work = Scratch(spark, "groupsplit")
    grouped = work.save(with_groups(records, memberships, work, stars), "grouped")
    by_label = grouped.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS + 1).collect()
    if not by_label:
        return grouped.select("record", "group_id", F.lit(None).cast("string").alias("split"))
    labels = [r["label"] for r in by_label[:MOST_LABELS]]
    # All other labels share one further column.
    columns = range(len(by_label))
    total = grouped.count()
    at = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")), F.lit(0)), F.lit(len(labels) + 1)).cast("int") - 1
    counts = grouped.groupBy("group_id", at.alias("index")).agg(F.count("*").alias("n"))
    index = F.col("index")
    vector = [F.sum(F.when(index == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in columns]
    groups = counts.groupBy("group_id").agg(F.sum("n").alias("n"), F.max_by(index, F.struct("n", -index)).alias("main"), *vector)
    groups = work.save(groups, "groups")
    large = F.col("n") > max(1.0, total * LARGE_SHARE)
    cell = F.concat_ws("/", "main", F.pmod(F.xxhash64("group_id", F.lit(seed)), F.lit(CELLS)))
    unit = F.when(large, F.concat(F.lit("g"), "group_id")).otherwise(cell)
    # At most 1 / LARGE_SHARE groups and (MOST_LABELS + 1) * CELLS cells.
    units = groups.groupBy(unit.alias("unit")).agg(F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in columns]).orderBy(F.desc("n"), "unit").collect()
    names = list(shares)
    weights = np.array([shares[s] for s in names], float)
    chosen = place(np.array([[r[f"n{i}"] for i in columns] for r in units], np.float64), weights / weights.sum())
    plan = spark.createDataFrame([(r["unit"], names[c]) for r, c in zip(units, chosen)], "unit string, split string")
    placed = groups.select("group_id", unit.alias("unit")).join(F.broadcast(plan), "unit").select("group_id", "split")
    return grouped.join(placed, "group_id").select("record", "group_id", "split")


def _protein_graph(pairs: DataFrame, clusters: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records (the proteins, labelled by the tables they occur in: 1 pairs, 2 clusters, 3 both), memberships and stars.

    A pair's entity is its smaller protein, whose star holds all its larger partners. Missing ends, members and cluster ids
    link nothing.
    """
    from ..functions.ids import accession

    ends = pairs.select(accession("query").alias("q"), accession("target").alias("t"))
    star = ends.select(F.least("q", "t").alias("a"), F.greatest("q", "t").alias("b")).filter(F.col("a").isNotNull())
    edges = work.save(star.distinct(), "stars")
    held = clusters.select(accession("member").alias("record"), F.concat(F.lit("c:"), F.col("cluster_id").cast("string")).alias("entity")).filter(F.col("record").isNotNull())
    held = work.save(held.distinct(), "held")
    linked = edges.filter(F.col("a") < F.col("b"))
    stars = linked.select(F.col("b").alias("record"), F.col("a").alias("entity")).unionByName(linked.select(F.col("a").alias("record"), F.col("a").alias("entity")).distinct())
    seen = edges.select(F.explode(F.array("a", "b")).alias("record"), F.lit(1).alias("bit")).unionByName(held.select("record", F.lit(2).alias("bit")))
    records = seen.groupBy("record").agg(F.bit_or("bit").cast("string").alias("label"))
    return records, held.filter(F.col("entity").isNotNull()), stars


def protein_split(pairs: DataFrame, clusters: DataFrame, shares: dict[str, float]) -> DataFrame:
    """`protein`, `group_id`, `split` of every protein in `clusters` (member) or `pairs` (query, target).

    Proteins that share a cluster_id or a pair, directly or through others, are in the same split, stratified by the
    tables in which a protein occurs.
    """
    work = Scratch(pairs.sparkSession, "proteins")
    records, memberships, stars = _protein_graph(pairs, clusters, work)
    done = split_groups(records, memberships, shares, stars=stars)
    # What is returned reads the tables of split_groups only.
    work.drop_all()
    return done.withColumnRenamed("record", "protein")


def protein_groups(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """`protein`, `group_id` (the smallest protein it is related to) of the same proteins, without the split."""
    work = Scratch(pairs.sparkSession, "proteins")
    records, memberships, stars = _protein_graph(pairs, clusters, work)
    return with_groups(records, memberships, work, stars).select(F.col("record").alias("protein"), "group_id")
