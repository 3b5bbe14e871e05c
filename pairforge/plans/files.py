"""Queries that write files and read them back, by every sink and file reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import accession
from ..operators import results
from ..session import Scratch, table
from ..sources import readers, writers
from . import surrogates as S
from .copies import acc_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _path(s, name: str) -> str:
    return Scratch(s, "files").path(name)


def _hits(s, d):
    """Hits with every column of the aligner's tables."""
    zero = F.lit(0).cast("bigint")
    return S.seq_hits(s, d).select("query", "target", "fident", zero.alias("alnlen"), F.col("mismatch").cast("bigint").alias("mismatch"), zero.alias("gapopen"), F.col("nident").cast("bigint").alias("nident"), "qcov", "tcov", F.lit(0.0).alias("evalue"))


_HITS = f"WITH {S.SEQ} SELECT query, target, fident, CAST(mismatch AS BIGINT) AS mismatch, CAST(nident AS BIGINT) AS nident, qcov, tcov FROM seq_hits"
_READ = ["query", "target", "fident", "mismatch", "nident", "qcov", "tcov"]


@query("tsv_round_trip", _HITS)
def tsv_round_trip(s, d):
    writers.tsv(_hits(s, d), path := _path(s, "hits.tsv"))
    return readers.by_extension(s, path, _READ, readers.SEQUENCE_HITS)


@query("tsv_without_header", _HITS)
def tsv_without_header(s, d):
    writers.tsv(_hits(s, d), path := _path(s, "hits.tsv"), header=False)
    return readers.tsv(s, path, readers.SEQUENCE_HITS, header=False).select(*_READ)


@query("csv_round_trip", "SELECT id, length, plddt FROM plddt WHERE id IS NOT NULL AND plddt <> '' AND length IS NOT NULL")
def csv_round_trip(s, d):
    writers.csv(table(s, d, "plddt").filter("id is not null and plddt <> '' and length is not null"), path := _path(s, "plddt.csv"))
    return readers.by_extension(s, path, schema=readers.CONFIDENCE)


@query("cached_load", f"WITH {S.STRUCT} SELECT query, target, alntmscore FROM struct_hits")
def cached_load(s, d):
    """A text table is converted once; the second load reads the copy."""
    writers.tsv(S.struct_hits(s, d).select("query", "target", "alntmscore"), path := _path(s, "hits.tsv"))
    copy, kind = _path(s, "hits.parquet"), "query string, target string, alntmscore double"
    readers.cached(s, path, copy, kind)
    writers.tsv(S.struct_hits(s, d).limit(0).select("query", "target", "alntmscore"), path)
    return readers.cached(s, path, copy, kind)


@query("parquet_partitions", "SELECT split, count(*) AS n FROM merged_protein_similarity WHERE split IN ('val', 'test') GROUP BY 1")
def parquet_partitions(s, d):
    """A table partitioned on disk; the filter reads two of its folders."""
    writers.parquet(table(s, d, "merged_protein_similarity").select("pair_id", "split"), path := _path(s, "pairs.parquet"), ["split"])
    return readers.by_extension(s, path, ["split"]).filter(F.col("split").isin("val", "test")).groupBy("split").agg(F.count("*").alias("n"))


@query("id_list_round_trip", f"SELECT DISTINCT {acc_sql('member')} AS id FROM cluster_members WHERE {acc_sql('member')} IS NOT NULL")
def id_list_round_trip(s, d):
    writers.lines(table(s, d, "cluster_members").select(accession("member").alias("id")).distinct(), "id", path := _path(s, "ids.txt"))
    return s.read.text(path).select(F.col("value").alias("id"))


@query("fasta_round_trip", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, md5(upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def fasta_round_trip(s, d):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    items = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("entry"), letters.alias("sequence"))
    writers.fasta(items, path := _path(s, "items.fasta"))
    return readers.fasta(s, path).select("id", F.md5(F.col("sequence").cast("binary")).alias("h"))


@query("append_new_keys", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'first' ELSE 'second' END AS run FROM orders")
def append_new_keys(s, d):
    """A store that a first run began and a second one, over all rows, completes."""
    o, path = table(s, d, "orders"), _path(s, "store.parquet")
    writers.append_new(o.filter(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).select("o_orderkey", F.lit("first").alias("run")), path, ["o_orderkey"])
    writers.append_new(o.select("o_orderkey", F.lit("second").alias("run")), path, ["o_orderkey"])
    return s.read.parquet(path)


@query("json_round_trip", "SELECT event_id, user_id, event_type FROM events")
def json_round_trip(s, d):
    writers.json_table(table(s, d, "events").select("event_id", "user_id", "event_type"), path := _path(s, "events.json"))
    kinds = table(s, d, "events").select("event_id", "user_id", "event_type").schema.simpleString()[7:-1].replace(":", " ")
    return readers.json_table(s, path, kinds)


@query("npz_round_trip", "SELECT 'v' || CAST(vec_id AS VARCHAR) AS name, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def npz_round_trip(s, d):
    """Archives of a few vectors each."""
    e = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("file"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")
    saved = Scratch(s, "files").save(writers.npz_files(e, "file", "name", "embedding"), "archives")
    return readers.npz_rows(saved).select("name", F.element_at("shape", 1).alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


@query("sqlite_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def sqlite_round_trip(s, d):
    """Databases of a thousand customers' orders each; the filter runs inside them."""
    o = table(s, d, "orders").select(F.floor(F.col("o_custkey") / 1000).alias("file"), "o_orderkey", "o_custkey", "o_orderstatus")
    saved = Scratch(s, "files").save(writers.sqlite_files(o.unionByName(o), "file", "orders", "o_orderkey"), "databases")
    kinds = o.drop("file").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    return readers.sqlite_rows(saved, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'", kinds)


def _xml(s, d, name: str) -> str:
    new, _ = S.releases(s, d)
    tag = F.transform("members", lambda m: F.concat(F.lit('<dbReference type="UniParc ID" id="'), m, F.lit('"/>')))
    text = new.orderBy("cluster_id").select(F.concat(F.lit('<entry id="'), "cluster_id", F.lit('" updated="x">'), F.array_join(tag, ""), F.lit("</entry>")).alias("value"))
    text.coalesce(1).write.option("compression", "gzip").text(path := _path(s, name))
    return path


@query("xml_file_members", f"WITH {S.RELEASES} SELECT cluster_id, CAST(count(*) AS BIGINT) AS n_members FROM orows GROUP BY 1")
def xml_file_members(s, d):
    """A gzipped file of all clusters, read entry by entry."""
    return readers.xml_entries(s, _xml(s, d, "clusters.xml")).select("cluster_id", F.size("members").cast("bigint").alias("n_members"))


@query("xml_first_entries", f"WITH {S.RELEASES} SELECT cluster_id, CAST(count(*) AS BIGINT) AS n_members FROM orows GROUP BY 1 ORDER BY cluster_id LIMIT 10")
def xml_first_entries(s, d):
    """The first ten entries of the file: the limit is the feature."""
    return readers.xml_entries(s, _xml(s, d, "clusters.xml"), 10).select("cluster_id", F.size("members").cast("bigint").alias("n_members"))


@query("metric_files", f"WITH {S.RESULTS} SELECT dataset, round(avg(spearman), 6) AS spearman, count(*) AS n FROM (SELECT spearman, 'd' || CAST(experiment_id AS VARCHAR) AS dataset FROM results) GROUP BY 1")
def metric_files(s, d):
    """Metrics files of all experiments, found under a folder and keyed by their paths."""
    lines = S.results(s, d).select(F.concat(F.lit("d"), F.col("experiment_id").cast("string")).alias("dataset"), F.concat(F.lit("# a note\nSpearman: "), F.col("spearman").cast("string"), F.lit("\nR2: inf")).alias("value"))
    lines.write.partitionBy("dataset").text(path := _path(s, "runs"))
    text = readers.metric_lines(s, path, "*.txt").select(F.concat(F.regexp_extract("path", "dataset=([^/]+)", 1), F.lit("/m/p/e/evaluation_results/x_metrics.txt")).alias("path"), "line")
    keyed = results.path_keys(results.parse_key_values(text, ["Spearman", "R2"]))
    return keyed.groupBy("dataset").agg(F.round(F.avg("Spearman"), 6).alias("spearman"), F.count("*").alias("n"))


@query("store_discovery", """SELECT embedding_name AS store, count(*) AS n_vectors, CAST(max(len(embedding)) AS INT) AS dim, max(len(embedding)) = min(len(embedding)) AS uniform, true AS readable
 FROM protein_embeddings WHERE embedding IS NOT NULL AND embedding_name IS NOT NULL GROUP BY 1 UNION ALL SELECT 'broken', NULL, NULL, NULL, false""")
def store_discovery(s, d):
    """A folder with one store per embedding and a file that is none."""
    root = _path(s, "stores")
    e = table(s, d, "protein_embeddings")
    for name in S.NAMES:
        writers.parquet(e.filter(F.col("embedding_name") == name).select("id", "embedding"), f"{root}/{name}.parquet")
    writers.lines(s.range(1), "id", f"{root}/broken.parquet")
    return readers.discovered_stores(s, root)
