"""Readers of the workflow's file formats as DataFrames."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SEQUENCE_HITS = "query string, target string, fident double, alnlen bigint, mismatch bigint, gapopen bigint, nident bigint, qcov double, tcov double, evalue double"
STRUCTURE_HITS = "query string, target string, fident double, evalue double, qcov double, tcov double, alntmscore double"
CONFIDENCE = "id string, length bigint, plddt string"
CLUSTERS = "representative string, member string"
NEW_ITEMS = "entry string, protein_existence string, sequence string"


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """Tab-separated text. Without a schema all columns are strings; types are never guessed by a second pass."""
    reader = spark.read.option("sep", "\t").option("header", str(header).lower())
    return (reader.schema(schema) if schema else reader).csv(path)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def by_extension(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, TSV or CSV by the file's extension, with only the named columns; any other extension raises an error."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif name.endswith(".tsv"):
        df = tsv(spark, path, schema)
    elif name.endswith(".csv"):
        df = csv(spark, path, schema)
    else:
        raise ValueError(f"unknown extension: {path}")
    return df.select(*columns) if columns else df


def cached(spark: SparkSession, source: str, target: str, schema: str | None = None, refresh: bool = False) -> DataFrame:
    """The Parquet copy of a text table, written if it is missing or `refresh` is set."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    if refresh or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        by_extension(spark, source, schema=schema).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fasta_rows(records: DataFrame, text: str = "value") -> DataFrame:
    """`header`, `id`, `sequence` of records that begin after a `>`; white space inside sequences is dropped, the id is
    the header's first token. Records with an empty header drop out, an empty sequence is an empty string."""
    body = F.regexp_replace(F.regexp_replace(text, r"\A\s*>", ""), "\r", "")
    header = F.trim(F.element_at(F.split(body, "\n", 2), 1))
    rest = F.when(F.instr(body, "\n") > 0, F.element_at(F.split(body, "\n", 2), -1)).otherwise(F.lit(""))
    rows = records.select(header.alias("header"), F.regexp_replace(rest, r"\s+", "").alias("sequence")).filter(F.col("header") != "")
    return rows.select("header", F.element_at(F.split("header", r"\s+"), 1).alias("id"), "sequence")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files, split at line starts with `>`, so large files are read in parallel."""
    return fasta_rows(spark.read.option("lineSep", "\n>").text(path))


def usable_sequences(records: DataFrame, longest: int = 2000) -> DataFrame:
    """Non-empty sequences of at most `longest` residues."""
    return records.filter(F.length("sequence").between(1, longest))


def pdb_confidence(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `length`, `plddt`: rounded B-factors of CA atoms per file, joined by commas; bad numbers are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return pdb_rows(lines)


def pdb_rows(lines: DataFrame) -> DataFrame:
    """As `pdb_confidence`, of `path`, `value` lines; the order is that of the atom serial numbers."""
    ca = lines.filter(F.col("value").startswith("ATOM") & (F.trim(F.substring("value", 13, 4)) == "CA"))
    atoms = ca.select("path", F.trim(F.substring("value", 7, 5)).try_cast("int").alias("serial"), F.trim(F.substring("value", 61, 6)).try_cast("double").alias("b")).filter(F.col("b").isNotNull())
    ordered = atoms.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("serial", "b"))).alias("a"))
    values = F.transform("a", lambda x: F.bround(x["b"], 0).cast("int").cast("string"))
    return ordered.select("path", F.size("a").cast("bigint").alias("length"), F.array_join(values, ",").alias("plddt"))


def xml_entries(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """`cluster_id`, `members` of cluster XML, one row per `<entry>`; gzipped files are one task each. `most` stops after
    so many entries, those without members included, without reading the rest of the file."""
    text = spark.read.option("lineSep", "</entry>").text(path)
    return xml_rows(text.limit(most) if most is not None else text)


def xml_rows(chunks: DataFrame, text: str = "value") -> DataFrame:
    """Members of `<entry id="...">` texts: UniParc ids first, then UniProtKB accessions, each once in this order.
    Entries without members drop out."""
    parc = F.regexp_extract_all(text, F.lit(r'<dbReference\s+type="UniParc ID"\s+id="([^"]+)"'), 1)
    kb = F.regexp_extract_all(text, F.lit(r'<property\s+type="UniProtKB accession"\s+value="([^"]+)"'), 1)
    rows = chunks.select(F.nullif(F.regexp_extract(text, r'<entry\s[^>]*?id="([^"]+)"', 1), F.lit("")).alias("cluster_id"), F.array_distinct(F.concat(parc, kb)).alias("members"))
    return rows.filter(F.col("cluster_id").isNotNull() & (F.size("members") > 0))


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files, one per line; a line that is no record gives nulls."""
    return spark.read.schema(schema).json(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """`path`, `content` of every file; a file is one row, so at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def npz_rows(files: DataFrame) -> DataFrame:
    """`path`, `name`, `shape`, `values` (in the order of rows) of every numeric array in NumPy archives, of `path` and
    `content`; what is no archive raises an error, as do pickled objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as arrays:
                    for name in arrays.files:
                        x = np.asarray(arrays[name], np.float64)
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int64())), pa.array([x.ravel()], pa.list_(pa.float64()))], names=["path", "name", "shape", "values"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, shape array<bigint>, values array<double>")


def sqlite_rows(files: DataFrame, query: str, schema: str) -> DataFrame:
    """The rows of `query` in every SQLite database of `path` and `content`, read in memory, as columns of `schema`.

    Each file is one task's work; filters belong into `query`, where the database's indexes serve them.
    """
    kinds = files.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                con = sqlite3.connect(":memory:")
                con.deserialize(content.as_py())
                rows = con.execute(query)
                while part := rows.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)
                con.close()

    return files.select("path", "content").mapInArrow(run, kinds)


def metric_lines(spark: SparkSession, root: str, pattern: str = "*_metrics.txt") -> DataFrame:
    """`path`, `line` of every metrics file under a folder."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def discovered_stores(spark: SparkSession, root: str) -> DataFrame:
    """`store`, `n_vectors`, `dim`, `uniform`, `readable` of every Parquet store (`id`, `embedding`) directly under a folder.

    A folder or file that is no such table is listed as not readable, with nulls; the listing is one row per store.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".parquet"))
    good, bad = [], []
    for name in names:
        try:
            store = require(spark.read.parquet(f"{root}/{name}"), "id", "embedding")
            good.append(store.select(F.lit(name.removesuffix(".parquet")).alias("embedding_name"), "embedding"))
        except (AnalysisException, SparkRuntimeException, Py4JJavaError, ValueError):
            bad.append((name.removesuffix(".parquet"),))
    kind = "store string, n_vectors bigint, dim int, uniform boolean, readable boolean"
    out = spark.createDataFrame([(n, None, None, None, False) for (n,) in bad], kind)
    for store in good:
        out = out.unionByName(store_info(store).withColumnRenamed("embedding_name", "store").withColumn("readable", F.lit(True)))
    return out


def store_info(stores: DataFrame) -> DataFrame:
    """Vectors, length and its uniformity per embedding store."""
    n = F.size("embedding")
    return stores.filter(F.col("embedding").isNotNull()).groupBy("embedding_name").agg(F.count("*").alias("n_vectors"), F.max(n).alias("dim"), (F.max(n) == F.min(n)).alias("uniform"))
