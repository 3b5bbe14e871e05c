"""Stand-ins for the workflow's tables over the driver's tables: as DataFrames, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import accession, number_or_null
from ..session import table
from .copies import acc_sql

#: The embedding stores of the pair table's proteins, and those of the hits.
NAMES = ["foldlm_s", "plmx_base", "plmx_large", "random_96"]
HIT_NAMES = ["m1", "m2", "m3", "m4"]


def _item(c) -> F.Column:
    return F.concat(F.lit("P"), c.cast("string"))


def _hits(spark: SparkSession, sf: str, flags: tuple[str, str]) -> DataFrame:
    li = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin(*flags))
    query, target = F.col("l_partkey"), F.col("l_suppkey") * 7 + F.col("l_linenumber")
    return li.groupBy(_item(query).alias("query"), _item(target).alias("target"))


def seq_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, ("A", "R")).agg(
        (F.max("l_quantity") / 50.0).alias("fident"), (F.max("l_quantity") * 10 - 5).cast("int").alias("nident"), (F.min("l_linenumber") * 3).cast("int").alias("mismatch"),
        (1 - F.min("l_tax") * 2).alias("qcov"), (1 - F.min("l_discount") * 3).alias("tcov"))


def struct_hits(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, ("A", "N")).agg((1 - F.min("l_tax") * 2).alias("qcov"), (1 - F.min("l_discount") * 3).alias("tcov"), (F.max("l_extendedprice") / 100000.0).alias("alntmscore"))


_HIT = """SELECT 'P' || CAST(l_partkey AS VARCHAR) AS query, 'P' || CAST(l_suppkey * 7 + l_linenumber AS VARCHAR) AS target, {agg}
 FROM lineitem WHERE l_returnflag IN ({flags}) GROUP BY 1, 2"""
SEQ = "seq_hits AS (" + _HIT.format(flags="'A', 'R'", agg="max(l_quantity) / 50.0 AS fident, CAST(max(l_quantity) * 10 - 5 AS INT) AS nident, CAST(min(l_linenumber) * 3 AS INT) AS mismatch, 1 - min(l_tax) * 2 AS qcov, 1 - min(l_discount) * 3 AS tcov") + ")"
STRUCT = "struct_hits AS (" + _HIT.format(flags="'A', 'N'", agg="1 - min(l_tax) * 2 AS qcov, 1 - min(l_discount) * 3 AS tcov, max(l_extendedprice) / 100000.0 AS alntmscore") + ")"
HFSP_SQL = """CASE WHEN nident + mismatch <= 11 THEN fident * 100 - 100 WHEN nident + mismatch <= 450
 THEN fident * 100 - 770 * pow(CAST(nident + mismatch AS DOUBLE), -0.33 * (1 + exp((nident + mismatch) / 1000.0::DOUBLE))) ELSE fident * 100 - 28.4 END"""


def vector_stores(spark: SparkSession, sf: str) -> DataFrame:
    """Four stores of 16 components each of every vector; m2 lacks every tenth item."""
    e = table(spark, sf, "embeddings")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("embedding_name"), F.slice("embedding", 16 * i + 1, 16).alias("embedding")) for i, n in enumerate(HIT_NAMES)])).alias("s")
    return e.select(_item(F.col("vec_id")).alias("id"), "vec_id", each).select("id", "vec_id", "s.*").filter(~((F.col("embedding_name") == "m2") & (F.col("vec_id") % 10 == 0))).drop("vec_id")


HIT_STORES = """stores AS (SELECT 'P' || CAST(vec_id AS VARCHAR) AS id, name AS embedding_name, CAST(embedding[16 * i + 1 : 16 * i + 16] AS DOUBLE[]) AS embedding
 FROM embeddings, (VALUES ('m1', 0), ('m2', 1), ('m3', 2), ('m4', 3)) AS t(name, i) WHERE NOT (name = 'm2' AND vec_id % 10 = 0))"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every directed pair of proteins of the pair table once."""
    rows = table(spark, sf, "merged_protein_similarity").select(accession("query").alias("query"), accession("target").alias("target"))
    return rows.filter(F.col("query").isNotNull() & F.col("target").isNotNull()).distinct()


def protein_stores(spark: SparkSession, sf: str) -> DataFrame:
    """`id`, `embedding_name`, `embedding`: of each protein in each named store its first vector of finite numbers only."""
    e = table(spark, sf, "protein_embeddings").filter(F.col("id").isNotNull() & F.col("embedding_name").isNotNull() & (F.size("embedding") > 0))
    e = e.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return e.groupBy("id", "embedding_name").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The three scores of every row of the pair table, missing ones null."""
    return table(spark, sf, "merged_protein_similarity").select(*[number_or_null(c).alias(c) for c in SCORES])


SCORES = ["fident", "hfsp", "alntmscore"]
PAIR_ROWS = f"pairs AS (SELECT DISTINCT query, target FROM (SELECT {acc_sql('query')} AS query, {acc_sql('target')} AS target FROM merged_protein_similarity) WHERE query IS NOT NULL AND target IS NOT NULL)"
STORES = """stores AS (SELECT id, embedding_name, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS embedding FROM protein_embeddings WHERE id IS NOT NULL AND embedding_name IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY 1, 2)"""
_DISTANCE = """, names AS (SELECT unnest([{names}]) AS embedding_name),
dist AS (SELECT p.query, p.target, n.embedding_name, CASE WHEN len(a.embedding) = len(b.embedding) THEN round_even(list_distance(a.embedding, b.embedding), 4) END AS distance
 FROM {pairs} p CROSS JOIN names n LEFT JOIN stores a ON a.id = p.query AND a.embedding_name = n.embedding_name LEFT JOIN stores b ON b.id = p.target AND b.embedding_name = n.embedding_name)"""
_listed = lambda names: ", ".join(f"'{n}'" for n in names)
DIST = f"{PAIR_ROWS}, {STORES}" + _DISTANCE.format(names=_listed(NAMES), pairs="pairs")
HIT_DIST = f"{SEQ}, {HIT_STORES}" + _DISTANCE.format(names=_listed(HIT_NAMES), pairs="seq_hits")
WIDE = DIST + """, wide AS (SELECT query, target, """ + ", ".join(f"max(CASE WHEN embedding_name = '{n}' THEN distance END) AS dist_{n}" for n in NAMES) + " FROM dist GROUP BY 1, 2)"
# Column pairs of the three scores, over rows with both.
PAIRS = "sc AS (SELECT " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in SCORES) + " FROM merged_protein_similarity), cp AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {a} AS x, {b} AS y FROM sc WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(SCORES) for b in SCORES[i + 1 :]) + ")"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("truth"), (F.col("l_quantity") / 50.0 + (F.col("l_discount") - 0.05)).alias("prediction"))


PRED = "pred AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS truth, l_quantity / 50.0 + (l_discount - 0.05) AS prediction FROM lineitem)"


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Results per experiment: scores from the experiment's number, sizes from its embedding's name."""
    e = table(spark, sf, "experiment_paths")
    i = F.col("experiment_id")
    return e.select(
        "experiment_id", "model_type", F.col("param_name").alias("parameter"), F.col("embedding_name").alias("embedding"), F.col("embedding_name").alias("embedding_key"),
        (F.length("embedding_name").cast("long") * 1000000 * (1 + i % 7)).alias("plm_size"),
        (((i * 37) % 101 - 50) / 101.0).alias("spearman"), (((i * 53) % 97) / 97.0).alias("mae"), (((i * 29) % 89) / 89.0).alias("r2"))


RESULTS = """results AS (SELECT experiment_id, model_type, param_name AS parameter, embedding_name AS embedding, embedding_name AS embedding_key,
 CAST(length(embedding_name) AS BIGINT) * 1000000 * (1 + experiment_id % 7) AS plm_size, ((experiment_id * 37) % 101 - 50) / 101.0::DOUBLE AS spearman,
 ((experiment_id * 53) % 97) / 97.0::DOUBLE AS mae, ((experiment_id * 29) % 89) / 89.0::DOUBLE AS r2 FROM experiment_paths)"""


def releases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(new, old) releases of clusters: orders of a customer, ids UPI<n> for a quarter; old are orders before 1995."""
    o = table(spark, sf, "orders")
    member = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "UPI").otherwise("O"), F.col("o_orderkey").cast("string"))
    rows = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cluster_id"), member.alias("m"), "o_orderdate", "o_custkey")
    new = rows.groupBy("cluster_id").agg(F.collect_list("m").alias("members"))
    old = rows.filter((F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp")) & (F.col("o_custkey") % 3 != 0)).groupBy("cluster_id").agg(F.collect_list("m").alias("members"))
    return new, old


RELEASES = """orows AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS cluster_id, (CASE WHEN o_orderkey % 4 = 0 THEN 'UPI' ELSE 'O' END) || CAST(o_orderkey AS VARCHAR) AS m,
 o_orderdate < TIMESTAMP '1995-06-01' AND o_custkey % 3 <> 0 AS is_old FROM orders)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    member = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "UPI").otherwise("O"), F.col("o_orderkey").cast("string"))
    return o.select(member.alias("entry"), F.col("o_orderpriority").alias("protein_existence"), F.concat(F.lit("M"), F.col("o_orderstatus")).alias("sequence"), "o_orderkey")


ITEMS = "items AS (SELECT (CASE WHEN o_orderkey % 4 = 0 THEN 'UPI' ELSE 'O' END) || CAST(o_orderkey AS VARCHAR) AS entry, o_orderpriority AS protein_existence FROM orders)"
