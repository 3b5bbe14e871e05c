"""Similarity merge: clean, score and filter two hit tables, then join them on the directed pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hfsp, model_id, packed_mean

MIN_COVERAGE, MIN_FIDENT, MIN_HFSP, MIN_TM, MIN_CONFIDENCE = 0.8, 0.3, 0.0, 0.4, 70


def drop_self_matches(hits: DataFrame) -> DataFrame:
    """Rows whose query and target differ; a null end drops the row."""
    return hits.filter(F.col("query") != F.col("target"))


def with_hfsp(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hfsp", hfsp("fident", "nident", "mismatch"))


def with_min_coverage(hits: DataFrame) -> DataFrame:
    """`min_cov`: the smaller coverage, nulls ignored."""
    return hits.withColumn("min_cov", F.least("qcov", "tcov"))


def sequence_thresholds(hits: DataFrame) -> DataFrame:
    return hits.filter((F.col("min_cov") >= MIN_COVERAGE) & (F.col("fident") >= MIN_FIDENT) & (F.col("hfsp") >= MIN_HFSP))


def structure_thresholds(hits: DataFrame) -> DataFrame:
    return hits.filter((F.col("min_cov") >= MIN_COVERAGE) & (F.col("alntmscore") >= MIN_TM))


def with_model_ids(hits: DataFrame) -> DataFrame:
    """Both ends as the ids inside the names of predicted structures; null where a name holds none."""
    return hits.withColumn("query", model_id("query")).withColumn("target", model_id("target"))


def confidence(plddt: DataFrame) -> DataFrame:
    """`id`, `length`, `avg_plddt` of each row with an id; null where the list holds no number."""
    return plddt.filter(F.col("id").isNotNull()).select("id", "length", packed_mean("plddt").alias("avg_plddt"))


def low_confidence_ids(plddt: DataFrame, least: int = MIN_CONFIDENCE) -> DataFrame:
    return confidence(plddt).filter(F.col("avg_plddt") < least).select("id").distinct()


def drop_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows neither of whose ends is in `ids` (one column `id`); null ends fall out first, as null is in no set."""
    out = hits.filter(F.col("query").isNotNull() & F.col("target").isNotNull())
    return out.join(ids.select(F.col("id").alias("query")), "query", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti").select(*hits.columns)


def keep_ids(hits: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows both of whose ends are in `ids`."""
    return hits.join(ids.select(F.col("id").alias("query")), "query", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*hits.columns)


def sequence_branch(hits: DataFrame) -> DataFrame:
    return sequence_thresholds(with_min_coverage(with_hfsp(drop_self_matches(hits)))).select("query", "target", "fident", "hfsp")


def structure_branch(hits: DataFrame, low: DataFrame | None = None) -> DataFrame:
    kept = drop_self_matches(hits)
    kept = drop_ids(kept, low) if low is not None else kept
    return structure_thresholds(with_min_coverage(kept)).select("query", "target", "alntmscore")


def merge_hits(sequence: DataFrame, structure: DataFrame) -> DataFrame:
    """Full outer join on the directed pair: `query`, `target`, `fident`, `hfsp`, `alntmscore`. One shuffle per side."""
    return sequence.join(structure, ["query", "target"], "full")


def merge_stats(merged: DataFrame) -> DataFrame:
    """Pairs in both, in one only, and the overlap rate, in one pass."""
    f, t = F.col("fident").isNotNull(), F.col("alntmscore").isNotNull()
    counts = merged.agg(
        F.count("*").alias("pairs"), F.count_if(f).alias("sequence_pairs"), F.count_if(t).alias("structure_pairs"),
        F.count_if(f & t).alias("both"), F.count_if(f & ~t).alias("sequence_only"), F.count_if(~f & t).alias("structure_only"),
    )
    rate = F.try_divide(F.col("both"), F.col("sequence_pairs") + F.col("structure_pairs") - F.col("both"))
    return counts.withColumn("overlap", F.round(rate, 6))


def filter_report(hits: DataFrame, keep: F.Column, name: str) -> DataFrame:
    """Rows before and after a filter, removed and their percentage."""
    out = hits.agg(F.count("*").alias("before"), F.count_if(F.coalesce(keep, F.lit(False))).alias("after"))
    removed = F.col("before") - F.col("after")
    return out.select(F.lit(name).alias("step"), "before", "after", removed.alias("removed"), F.round(F.try_divide(removed * 100.0, F.col("before")), 6).alias("removed_pct"))


def threshold_distribution(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Quartiles of a column and the share below a threshold."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(F.count(column).alias("n"), F.count_if(F.col(column) < threshold).alias("below"), q.alias("q"))
    return out.select("n", "below", F.round(F.try_divide(F.col("below") * 100.0, F.col("n")), 6).alias("below_pct"), *[F.round(F.col("q")[i], 6).alias(f"q{p}") for i, p in enumerate((25, 50, 75))])
