"""Queries of the training-data operators by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import accession, canonical_path
from ..operators.table_diff import pair_rows
from ..plans.copies import acc_sql
from ..session import Scratch, table
from .components import connected_components
from .groupsplit import protein_groups, protein_split
from .neighbours import file_neighbours, mutual, search
from .overlap import cross_split_classes, cross_split_pairs
from .packing import fill_containers, usage
from .pieces import split_texts
from .tokens import decode, encode, token_counts


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "protein_embeddings").select("vec_id", "embedding_file", "embedding")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mutual(file_neighbours(_vectors(spark, sf_dir)))
    return pairs.select(F.col("a").alias("vec_id_a"), F.col("b").alias("vec_id_b"))


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of the same file, at any similarity, of every vector whose id is divisible by 20."""
    lists = search(_vectors(spark, sf_dir), "vec_id", canonical_path("embedding_file"), "embedding", F.col("id") % 20 == 0)
    return lists.select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


_P2 = """WITH v AS (SELECT vec_id, '/' || embedding_file AS p, embedding AS e FROM protein_embeddings WHERE embedding IS NOT NULL AND embedding_file IS NOT NULL),
w AS (SELECT vec_id, e, regexp_replace(regexp_replace(regexp_replace(p, '/(\\./)+', '/', 'g'), '/+', '/', 'g'), '[^/]+/\\.\\./', '', 'g') AS file FROM v),
l AS (SELECT file, len(e) AS n, count(*) AS c FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY file ORDER BY c DESC, n DESC) = 1),
u AS (SELECT vec_id, w.file, CAST(e AS DOUBLE[]) AS e FROM w JOIN l ON w.file = l.file AND len(w.e) = l.n
      WHERE len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM u a JOIN u b ON a.file = b.file AND a.vec_id <> b.vec_id)"""
P2_SEARCH_SQL = _P2 + """ SELECT i AS vec_id, j AS neighbour_id, round(sim, 6) AS similarity, CAST(row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS INT) AS rank FROM s WHERE i % 20 = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 10"""
P2_SQL = _P2 + """,
t AS (SELECT i, j FROM s WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) <= 10)
SELECT a.i AS vec_id_a, a.j AS vec_id_b FROM t a JOIN t b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j"""


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_rows(table(spark, sf_dir, "merged_protein_similarity"), "pair_id", "fident", "split", "source")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(_pair_rows(spark, sf_dir))
    return pairs.select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows that are in the training split too, and the training rows they meet, per split and source."""
    classes = cross_split_classes(_pair_rows(spark, sf_dir))
    return classes.groupBy("split", "source").agg(F.sum("eval_rows").alias("eval_rows"), F.sum(F.col("eval_rows") * F.col("train_rows")).alias("row_pairs"))


_P3 = f"""WITH r AS (SELECT pair_id, least(q, t) AS a, greatest(q, t) AS b, CASE WHEN isnan(fident) THEN NULL ELSE fident END AS f, split, source
  FROM (SELECT *, {acc_sql('query')} AS q, {acc_sql('target')} AS t FROM merged_protein_similarity) WHERE q IS NOT NULL AND t IS NOT NULL),
m AS (SELECT e.pair_id AS eid, t.pair_id AS tid, e.split AS split, e.source AS source FROM r e JOIN r t ON e.a = t.a AND e.b = t.b
  WHERE e.split IN ('val', 'test') AND t.split = 'train' AND (abs(e.f - t.f) <= 0.01 + 1e-9 OR (e.f IS NULL AND t.f IS NULL)))"""
P3_SQL = _P3 + " SELECT least(eid, tid) AS pair_id_a, greatest(eid, tid) AS pair_id_b FROM m"
P3_COUNTS_SQL = _P3 + " SELECT split, source, count(DISTINCT eid) AS eval_rows, count(*) AS row_pairs FROM m GROUP BY 1, 2"


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, clusters = (table(spark, sf_dir, t) for t in ("merged_protein_similarity", "cluster_members"))
    return protein_split(pairs, clusters, {"train": 0.8, "val": 0.1, "test": 0.1})


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that p4_split keeps together."""
    return protein_groups(*(table(spark, sf_dir, t) for t in ("merged_protein_similarity", "cluster_members")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "merged_protein_similarity").select("query", "target")
    return connected_components(pairs, accession("query"), accession("target")).withColumnRenamed("vertex", "protein")


_GROUPS = """c(protein, group_id) USING KEY (protein) AS (SELECT protein, protein FROM n
  UNION SELECT e.b, min(x.group_id) FROM c x JOIN e ON e.a = x.protein JOIN recurring.c y ON y.protein = e.b WHERE x.group_id < y.group_id GROUP BY e.b)"""
# Members of a cluster are linked to its smallest member.
P4_GROUPS_SQL = f"""WITH RECURSIVE r AS (SELECT {acc_sql('query')} AS q, {acc_sql('target')} AS t FROM merged_protein_similarity),
h AS (SELECT {acc_sql('member')} AS m, cluster_id FROM cluster_members),
k AS (SELECT m, min(m) OVER (PARTITION BY cluster_id) AS l FROM h WHERE m IS NOT NULL AND cluster_id IS NOT NULL),
n AS (SELECT q AS protein FROM r WHERE q IS NOT NULL UNION SELECT t FROM r WHERE t IS NOT NULL UNION SELECT m FROM h WHERE m IS NOT NULL),
e AS (SELECT q AS a, t AS b FROM r WHERE q <> t UNION SELECT t, q FROM r WHERE q <> t UNION SELECT m, l FROM k WHERE m <> l UNION SELECT l, m FROM k WHERE m <> l),
{_GROUPS}
SELECT protein, group_id FROM c"""
P5_SQL = f"""WITH RECURSIVE r AS (SELECT {acc_sql('query')} AS q, {acc_sql('target')} AS t FROM merged_protein_similarity),
n AS (SELECT q AS protein FROM r WHERE q IS NOT NULL UNION SELECT t FROM r WHERE t IS NOT NULL),
e AS (SELECT q AS a, t AS b FROM r WHERE q <> t UNION SELECT t, q FROM r WHERE q <> t),
c(protein, group_id) USING KEY (protein) AS (SELECT protein, protein FROM n
  UNION SELECT e.b, min(x.group_id) FROM c x JOIN e ON e.a = x.protein JOIN recurring.c y ON y.protein = e.b WHERE x.group_id < y.group_id GROUP BY e.b)
SELECT protein, group_id FROM c"""


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return fill_containers(token_counts(documents, "doc_id", "text"), "doc_id", "n_tokens", n_items=documents.count())


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(_packed(spark, sf_dir))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


# Invariants that SQL can state of results that it cannot compute.
def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded ids are the texts, byte by byte."""
    back = decode(p6_ids(spark, sf_dir), "doc_id", "ids")
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document lies whole in containers, none of which is overfull or has a gap between its items."""
    work = Scratch(spark, "containers")
    sizes = work.save(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "sizes")
    placed = work.save(fill_containers(sizes, "doc_id", "n_tokens", n_items=sizes.count()), "placed")
    per = placed.groupBy("doc_id").agg(F.sum("length").alias("length")).join(sizes, "doc_id", "full")
    documents = per.agg(F.count("*").alias("documents"), F.count_if(F.col("length") == F.col("n_tokens")).alias("whole"))
    full = placed.groupBy("container_id", "capacity").agg(F.sum("length").alias("filled"), F.max(F.col("place") + F.col("length")).alias("end"))
    return documents.join(full.agg(F.count_if(F.col("filled") > F.col("capacity")).alias("overfull"), F.count_if(F.col("filled") != F.col("end")).alias("gaps")))


def p8_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own parts of a text's pieces, joined, are the text; no piece exceeds the limit."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = F.expr("substring(text, cast(own_start - start as int) + 1)")
    joined = p8_pieces(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("own")))), lambda x: x["own"]), "").alias("joined"), F.max("n_tokens").alias("most"))
    both = documents.filter("text is not null").join(joined, "doc_id", "left")
    return both.select("doc_id", F.md5(F.coalesce("joined", "text").cast("binary")).alias("h"), (F.coalesce("most", F.lit(0)) <= 512).alias("fits"))


P6_ROUND_TRIP_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents"
P7_INVARIANTS_SQL = "SELECT count(*) AS documents, count(*) AS whole, 0 AS overfull, 0 AS gaps FROM documents"
P8_JOINED_SQL = "SELECT doc_id, md5(text) AS h, true AS fits FROM documents WHERE text IS NOT NULL"


def queries() -> dict:
    return {"p2_found": p2_found, "p2_search": p2_search, "p3_found": p3_found, "p3_counts": p3_counts, "p4_split": p4_split, "p4_groups": p4_groups, "p5_found": p5_found, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_usage": p7_usage, "p8_pieces": p8_pieces,
            "p6_round_trip": p6_round_trip, "p7_invariants": p7_invariants, "p8_joined": p8_joined}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_search": P2_SEARCH_SQL, "p3_found": P3_SQL, "p3_counts": P3_COUNTS_SQL, "p4_groups": P4_GROUPS_SQL, "p5_found": P5_SQL, "p6_round_trip": P6_ROUND_TRIP_SQL, "p7_invariants": P7_INVARIANTS_SQL, "p8_joined": P8_JOINED_SQL}
