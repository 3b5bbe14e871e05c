"""Scoring of search hits as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import sequence_branch
from ..sources.readers import SEQUENCE_HITS


def hit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Headered TSV files of sequence hits in a folder, each read once."""
    return spark.readStream.schema(SEQUENCE_HITS).option("sep", "\t").option("header", "true").csv(folder)


def score_stream(hits: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Self matches dropped, scored and filtered hits appended to Parquet; stateless, so restarts lose nothing."""
    scored = sequence_branch(hits)
    return scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
