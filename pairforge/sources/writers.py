"""Sinks: tables, id lists, records, incremental stores."""

from __future__ import annotations

import io
import sqlite3

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower()).csv(path)


def json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def npz_files(df: DataFrame, key: str, name: str, vector: str) -> DataFrame:
    """`path`, `content`: one NumPy archive per key with an array per `name` (strings; of repeated names one counts)."""

    def run(t: pa.Table) -> pa.Table:
        data = io.BytesIO()
        np.savez_compressed(data, **{n: np.asarray(v, np.float64) for n, v in sorted(zip(t.column("name").to_pylist(), t.column("vector").to_pylist()))})
        return pa.table({"path": t.column("path")[:1], "content": pa.array([data.getvalue()], pa.binary())})

    rows = df.select(F.col(key).cast("string").alias("path"), F.col(name).cast("string").alias("name"), F.col(vector).alias("vector")).filter("path is not null and name is not null and vector is not null")
    return rows.groupBy("path").applyInArrow(run, "path string, content binary")


def sqlite_files(df: DataFrame, shard: str, table: str, key: str) -> DataFrame:
    """`path`, `content`: one SQLite database per value of the column `shard`, which bounds what a file holds. `table` has
    the other columns and `key` as its primary key; of rows with one key the first written counts."""
    columns = [c for c in df.columns if c != shard]

    def run(t: pa.Table) -> pa.Table:
        con = sqlite3.connect(":memory:")
        con.execute(f"CREATE TABLE {table} ({', '.join(f'{c} PRIMARY KEY' if c == key else c for c in columns)})")
        rows = sorted(zip(*[t.column(c).to_pylist() for c in columns]), key=str)
        con.executemany(f"INSERT OR IGNORE INTO {table} VALUES ({', '.join('?' * len(columns))})", rows)
        con.commit()
        return pa.table({"path": t.column("_path")[:1], "content": pa.array([con.serialize()], pa.binary())})

    return df.select(F.col(shard).cast("string").alias("_path"), *columns).groupBy("_path").applyInArrow(run, "path string, content binary")


def lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line; nulls are left out."""
    df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def fasta(items: DataFrame, path: str) -> None:
    """`entry`, `sequence` as FASTA; items without a sequence are left out."""
    from ..operators.novelty import fasta_records

    lines(fasta_records(items), "record", path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the stored table doesn't have; a first run creates it, repeated keys are written once."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = df.dropDuplicates(keys)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
