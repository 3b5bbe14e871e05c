"""Set-based novelty: clusters none of whose members were known before, and the new items among their members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_members(clusters: DataFrame) -> DataFrame:
    """`cluster_id`, `members` (array) of a table with JSON lists; malformed JSON gives null."""
    return clusters.select("cluster_id", F.from_json("members", "array<string>").alias("members"))


def exploded(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.explode("members").alias("member")).filter(F.col("member").isNotNull())


def known_members(old: DataFrame) -> DataFrame:
    """Every member of the old release once."""
    return exploded(old).select("member").distinct()


def new_cluster_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """Ids of clusters in the new release only."""
    return new.select("cluster_id").filter(F.col("cluster_id").isNotNull()).distinct().join(old.select("cluster_id"), "cluster_id", "left_anti")


def novel_clusters(new: DataFrame, known: DataFrame) -> DataFrame:
    """`cluster_id`, `n_members` of clusters with members none of which is known; an empty cluster isn't novel.

    One join on members and one aggregation per cluster; a very large cluster is combined on the map side.
    """
    rows = exploded(new).join(known.withColumn("_k", F.lit(True)), "member", "left")
    out = rows.groupBy("cluster_id").agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("_any"), F.count("*").alias("n_members"))
    return out.filter(~F.col("_any")).select("cluster_id", "n_members")


def novel_members(new: DataFrame, known: DataFrame) -> DataFrame:
    return exploded(new).join(novel_clusters(new, known).select("cluster_id"), "cluster_id", "left_semi").select("member").distinct()


def with_named_member(clusters: DataFrame, anonymous: str = "UPI") -> DataFrame:
    """Clusters with a member whose id doesn't start with `anonymous`."""
    return clusters.filter(F.exists("members", lambda m: ~m.startswith(anonymous)))


def novel_items(items: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct `entry` of items that are novel members."""
    return items.select("entry").filter(F.col("entry").isNotNull()).join(members.select(F.col("member").alias("entry")), "entry", "left_semi").distinct()


def last_sequence(items: DataFrame, order: str) -> DataFrame:
    """`entry`, `sequence`: of repeated entries the last in `order` counts."""
    return items.filter(F.col("entry").isNotNull()).groupBy("entry").agg(F.max_by("sequence", F.col(order)).alias("sequence"))


def fasta_records(items: DataFrame) -> DataFrame:
    """`record` text per entry with a sequence."""
    return items.filter(F.col("sequence").isNotNull()).select("entry", F.concat(F.lit(">"), "entry", F.lit("\n"), "sequence").alias("record"))


def novelty_report(new: DataFrame, old: DataFrame, items: DataFrame) -> DataFrame:
    """`measure`, `value` rows of the whole run."""
    known = known_members(old)
    ids = new_cluster_ids(new, old)
    fresh = new.join(ids, "cluster_id", "left_semi")
    members = novel_members(fresh, known)
    steps = [("old_members", known), ("new_cluster_ids", ids), ("novel_clusters", novel_clusters(fresh, known)), ("novel_members", members), ("items", items.select("entry").distinct()), ("novel_items", novel_items(items, members))]
    out = None
    for name, df in steps:
        row = df.agg(F.lit(name).alias("measure"), F.count("*").alias("value")).select("measure", "value")
        out = row if out is None else out.unionByName(row)
    return out
