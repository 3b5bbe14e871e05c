"""Queries: reading, scoring, filtering and merging hits; comparing runs; distances; splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as P
from ..functions.ids import accession, number_or_null
from ..operators import compare, distances, merge, split
from ..operators.convergence import fraction_sample
from ..session import table
from ..sources import readers
from . import surrogates as S
from .copies import acc_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = lambda c: F.round(c, 6)

query("hfsp_score", f"WITH {S.SEQ} SELECT query, target, round({S.HFSP_SQL}, 6) AS hfsp FROM seq_hits")(
    lambda s, d: merge.with_hfsp(S.seq_hits(s, d)).select("query", "target", R("hfsp").alias("hfsp")))
query("self_match_filter", f"WITH {S.SEQ} SELECT query, target FROM seq_hits WHERE query <> target")(
    lambda s, d: merge.drop_self_matches(S.seq_hits(s, d)).select("query", "target"))
query("min_coverage", f"WITH {S.SEQ} SELECT query, target, round(least(qcov, tcov), 6) AS min_cov FROM seq_hits")(
    lambda s, d: merge.with_min_coverage(S.seq_hits(s, d)).select("query", "target", R("min_cov").alias("min_cov")))
_SEQ_OK = f"SELECT query, target, fident, {S.HFSP_SQL} AS hfsp FROM seq_hits WHERE query <> target AND least(qcov, tcov) >= 0.8::DOUBLE AND fident >= 0.3::DOUBLE AND ({S.HFSP_SQL}) >= 0"
_STRUCT_OK = "SELECT query, target, alntmscore FROM struct_hits WHERE query <> target AND least(qcov, tcov) >= 0.8::DOUBLE AND alntmscore >= 0.4::DOUBLE"
query("seq_thresholds", f"WITH {S.SEQ} SELECT query, target, fident, round(hfsp, 6) AS hfsp FROM ({_SEQ_OK})")(
    lambda s, d: merge.sequence_branch(S.seq_hits(s, d)).withColumn("hfsp", R("hfsp")))
query("struct_thresholds", f"WITH {S.STRUCT} {_STRUCT_OK}")(lambda s, d: merge.structure_branch(S.struct_hits(s, d)))


@query("filter_counts", f"""WITH {S.SEQ} SELECT 'sequence' AS step, count(*) AS before, count(*) FILTER (query <> target) AS after, count(*) FILTER (query = target) AS removed,
 round(count(*) FILTER (query = target) * 100.0 / count(*), 6)::DOUBLE AS removed_pct FROM seq_hits""")
def filter_counts(s, d):
    return merge.filter_report(S.seq_hits(s, d), F.col("query") != F.col("target"), "sequence")


_AVG = """(SELECT id, length, CASE WHEN len(v) > 0 THEN CAST(floor(list_sum(v) / CAST(len(v) AS DOUBLE)) AS INT) END AS avg_plddt FROM
 (SELECT id, length, list_filter(list_transform(string_split(plddt, ','), lambda x: TRY_CAST(CASE WHEN regexp_full_match(trim(x), '[-+]?[0-9]+') THEN trim(x) END AS INT)), lambda x: x IS NOT NULL) AS v
  FROM plddt WHERE id IS NOT NULL))"""
query("plddt_avg", f"SELECT id, CAST(length AS DOUBLE) AS length, CAST(avg_plddt AS DOUBLE) AS avg_plddt FROM {_AVG}")(
    lambda s, d: merge.confidence(table(s, d, "plddt")).withColumns({c: F.col(c).cast("double") for c in ("length", "avg_plddt")}))
query("low_conf_ids", f"SELECT DISTINCT id FROM {_AVG} WHERE avg_plddt < 70")(lambda s, d: merge.low_confidence_ids(table(s, d, "plddt")))


@query("low_conf_antijoin", f"""WITH low AS (SELECT DISTINCT id FROM {_AVG} WHERE avg_plddt < 70),
 r AS (SELECT pair_id, {acc_sql('query')} AS query, {acc_sql('target')} AS target FROM merged_protein_similarity)
 SELECT pair_id, query, target FROM r WHERE query IS NOT NULL AND target IS NOT NULL AND query NOT IN (SELECT id FROM low) AND target NOT IN (SELECT id FROM low)""")
def low_conf_antijoin(s, d):
    rows = table(s, d, "merged_protein_similarity").select("pair_id", accession("query").alias("query"), accession("target").alias("target"))
    return merge.drop_ids(rows, merge.low_confidence_ids(table(s, d, "plddt")))


def merged(s, d):
    return merge.merge_hits(merge.sequence_branch(S.seq_hits(s, d)), merge.structure_branch(S.struct_hits(s, d)))


_MERGED = f"{S.SEQ}, {S.STRUCT}, merged AS (SELECT query, target, fident, hfsp, alntmscore FROM ({_SEQ_OK}) FULL JOIN ({_STRUCT_OK}) USING (query, target))"
query("merge_full_outer", f"WITH {_MERGED} SELECT query, target, fident, round(hfsp, 6) AS hfsp, alntmscore FROM merged")(lambda s, d: merged(s, d).withColumn("hfsp", R("hfsp")))
_B = "fident IS NOT NULL AND alntmscore IS NOT NULL"
query("merge_stats", f"""WITH {_MERGED}, c AS (SELECT count(*) AS pairs, count(fident) AS sequence_pairs, count(alntmscore) AS structure_pairs, count(*) FILTER ({_B}) AS "both" FROM merged)
 SELECT *, sequence_pairs - "both" AS sequence_only, structure_pairs - "both" AS structure_only, round("both" / CAST(sequence_pairs + structure_pairs - "both" AS DOUBLE), 6) AS overlap FROM c""")(lambda s, d: merge.merge_stats(merged(s, d)))
query("both_present", f"WITH {_MERGED} SELECT query, target FROM merged WHERE {_B}")(lambda s, d: merged(s, d).filter(F.col("fident").isNotNull() & F.col("alntmscore").isNotNull()).select("query", "target"))
query("threshold_distribution", f"""WITH {S.STRUCT} SELECT count(alntmscore) AS n, count(*) FILTER (alntmscore < 0.4::DOUBLE) AS below, round(count(*) FILTER (alntmscore < 0.4::DOUBLE) * 100.0::DOUBLE / count(alntmscore), 6) AS below_pct,
 round(quantile_cont(alntmscore, 0.25), 6) AS q25, round(quantile_cont(alntmscore, 0.5), 6) AS q50, round(quantile_cont(alntmscore, 0.75), 6) AS q75 FROM struct_hits""")(
    lambda s, d: merge.threshold_distribution(S.struct_hits(s, d), "alntmscore", 0.4))
query("model_id_extract", """SELECT query, CASE WHEN regexp_matches(query, 'AF-(.*?)-F1-model_v4') THEN regexp_extract(query, 'AF-(.*?)-F1-model_v4', 1) END AS id, count(*) AS n
 FROM merged_protein_similarity WHERE query LIKE '%AF%' GROUP BY ALL""")(
    lambda s, d: table(s, d, "merged_protein_similarity").filter(F.col("query").contains("AF")).groupBy("query", P.model_id("query").alias("id")).agg(F.count("*").alias("n")))
query("projected_scan", "SELECT query, target, fident FROM merged_protein_similarity WHERE fident IS NOT NULL AND NOT isnan(fident) AND split = 'test'")(
    lambda s, d: readers.by_extension(s, f"{d}/merged_protein_similarity.parquet", ["query", "target", "fident", "split"]).filter(F.col("split") == "test").filter(number_or_null("fident").isNotNull()).select("query", "target", "fident"))

# Comparison of two runs: the pair table and its copy.
_K = lambda t: f"(SELECT array_to_string(list_sort([query, target]), '|') AS pair_key, CASE WHEN NOT isnan(fident) THEN fident END AS value FROM {t} WHERE query IS NOT NULL AND target IS NOT NULL)"
_ONE = "k1 AS (SELECT pair_key, max(value) AS value FROM " + _K("merged_protein_similarity") + " GROUP BY 1), k2 AS (SELECT pair_key, max(value) AS value FROM " + _K("merged_similarity_copy") + " GROUP BY 1)"
_run = lambda s, d, t: compare.keyed(table(s, d, t), "fident")
_both = lambda s, d: (_run(s, d, "merged_protein_similarity"), _run(s, d, "merged_similarity_copy"))
query("pair_key_canonical", "SELECT pair_id, array_to_string(list_sort([query, target]), '|') AS pair_key FROM merged_protein_similarity WHERE query IS NOT NULL AND target IS NOT NULL")(
    lambda s, d: table(s, d, "merged_protein_similarity").select("pair_id", P.pair_key("query", "target").alias("pair_key")).filter("pair_key is not null"))
query("dedup_pairs", f"WITH {_ONE} SELECT pair_key, value FROM k1")(lambda s, d: compare.one_per_pair(_both(s, d)[0]))
query("run_overlap_counts", f"""WITH {_ONE} SELECT (SELECT count(*) FROM k1) AS pairs_1, (SELECT count(*) FROM k2) AS pairs_2, (SELECT count(*) FROM k1 JOIN k2 USING (pair_key)) AS common,
 (SELECT count(*) FROM k1 ANTI JOIN k2 USING (pair_key)) AS only_1, (SELECT count(*) FROM k2 ANTI JOIN k1 USING (pair_key)) AS only_2""")(lambda s, d: compare.overlap_counts(*_both(s, d)))


@query("run_common_corr", f"""WITH {_ONE}, j AS (SELECT k1.value AS a, k2.value AS b FROM k1 JOIN k2 USING (pair_key) WHERE k1.value IS NOT NULL AND k2.value IS NOT NULL AND NOT isnan(k1.value) AND NOT isnan(k2.value))
 SELECT count(*) AS n, round(corr(a, b), 6) AS pearson FROM j""")
def run_common_corr(s, d):
    from ..operators.metrics import pearson

    return pearson(compare.common_pairs(*_both(s, d)), "value", "value_2").select("n", "pearson")


# Distances of the pair table's proteins in every store.
def long(s, d):
    return distances.pair_distances(S.pairs(s, d), S.protein_stores(s, d), S.NAMES)


def wide(s, d):
    return distances.widen(long(s, d), ["query", "target"], S.NAMES)


query("embedding_distance", f"WITH {S.DIST} SELECT query, target, embedding_name, distance FROM dist")(long)
query("embedding_distance_missing", f"WITH {S.DIST} SELECT embedding_name, count(*) AS missing FROM dist WHERE distance IS NULL GROUP BY 1")(lambda s, d: long(s, d).filter("distance is null").groupBy("embedding_name").agg(F.count("*").alias("missing")))
query("distance_coverage", f"""WITH {S.DIST} SELECT embedding_name, count(*) AS pairs, count(distance) AS valid, round(count(distance) * 100.0::DOUBLE / count(*), 6) AS coverage_pct,
 round(avg(distance), 6) AS mean, round(stddev_samp(distance), 6) AS std FROM dist GROUP BY 1""")(lambda s, d: distances.coverage(long(s, d)))
query("distance_wide", f"WITH {S.WIDE} SELECT * FROM wide")(wide)
query("euclid_baseline", f"WITH {S.PAIR_ROWS}, {S.STORES} SELECT p.query, p.target, round(list_distance(a.embedding, b.embedding), 6) AS prediction FROM pairs p JOIN stores a ON a.id = p.query AND a.embedding_name = 'plmx_base' JOIN stores b ON b.id = p.target AND b.embedding_name = 'plmx_base' WHERE len(a.embedding) = len(b.embedding)")(
    lambda s, d: with_vectors(S.pairs(s, d), S.protein_stores(s, d), "plmx_base").filter(F.size("a") == F.size("b")).select("query", "target", F.round(P.euclidean("a", "b"), 6).alias("prediction")))
query("store_info", "SELECT embedding_name, count(*) AS n_vectors, CAST(max(len(embedding)) AS INT) AS dim, max(len(embedding)) = min(len(embedding)) AS uniform FROM protein_embeddings WHERE embedding IS NOT NULL GROUP BY 1")(lambda s, d: readers.store_info(table(s, d, "protein_embeddings")))
# Stores that were random or of a family left out; columns and names without prefix, lower case.
query("distance_columns", "SELECT embedding_name, lower(replace(embedding_name, '_', '-')) AS label, count(DISTINCT id) AS n FROM protein_embeddings WHERE embedding_name IS NOT NULL AND NOT starts_with(embedding_name, 'random') GROUP BY ALL")(lambda s, d: _distance_columns(s, d))


def _distance_columns(s, d):
    e = table(s, d, "protein_embeddings").filter("embedding_name is not null")
    counted = e.groupBy("id").pivot("embedding_name", S.NAMES).agg(F.count("embedding_file")).select("id", *[F.col(n).alias(f"dist_{n}") for n in S.NAMES])
    kept = distances.distance_columns(counted)
    each = F.explode(F.array(*[F.struct(F.lit(distances.store_name(c)).alias("embedding_name"), F.col(c).alias("c")) for c in kept])).alias("e")
    return counted.select("id", each).select("id", "e.*").filter("c is not null").groupBy("embedding_name", P.shown_name("embedding_name").alias("label")).agg(F.count_distinct("id").alias("n"))


def with_vectors(pairs, stores, name: str):
    """Pairs with both vectors of one store, `a` and `b`."""
    one = stores.filter(F.col("embedding_name") == name)
    side = lambda c, v: one.select(F.col("id").alias(c), F.col("embedding").alias(v))
    return pairs.join(side("query", "a"), "query").join(side("target", "b"), "target")


query("mean_pool", "SELECT vec_id, i, round((embedding[i] + embedding[i + 16] + embedding[i + 32] + embedding[i + 48]) / 4.0::DOUBLE, 5) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), (SELECT unnest(range(1, 17)) AS i)")(
    lambda s, d: distances.mean_pool(table(s, d, "embeddings").select("vec_id", F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)]).alias("m")), ["vec_id"], "m").select("vec_id", F.posexplode("embedding").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("i"), F.round("v", 5).alias("x")))
query("missing_stores", "SELECT DISTINCT embedding_name FROM experiment_paths WHERE embedding_name NOT IN (SELECT embedding_name FROM protein_embeddings WHERE embedding_name IS NOT NULL)")(
    lambda s, d: distances.unfinished(table(s, d, "experiment_paths").select("embedding_name").distinct(), table(s, d, "protein_embeddings")))

# Splits.
_MEM = f"mem AS (SELECT cluster_id, {acc_sql('member')} AS member FROM cluster_members WHERE cluster_id IS NOT NULL), sizes AS (SELECT cluster_id, count(DISTINCT member) AS size FROM mem WHERE member IS NOT NULL GROUP BY 1)"
members = lambda s, d: table(s, d, "cluster_members").select("cluster_id", accession("member").alias("member"))
_GREEDY = """, ord AS (SELECT cluster_id, size, row_number() OVER (ORDER BY size DESC, cluster_id) AS i FROM sizes),
tot AS (SELECT CAST(floor(sum(size) * 0.7::DOUBLE) AS BIGINT) AS tt, CAST(floor(sum(size) * 0.15::DOUBLE) AS BIGINT) AS tv, CAST(sum(size) AS BIGINT) AS n FROM sizes),
st AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS cluster_id, 0::BIGINT AS size, '' AS split, 0::BIGINT AS ct, 0::BIGINT AS cv, 0::BIGINT AS ce
 UNION ALL SELECT x.i, x.cluster_id, x.size, x.s, x.ct + CASE WHEN x.s = 'train' THEN x.size ELSE 0 END, x.cv + CASE WHEN x.s = 'val' THEN x.size ELSE 0 END, x.ce + CASE WHEN x.s = 'test' THEN x.size ELSE 0 END
 FROM (SELECT o.i, o.cluster_id, o.size, st.ct, st.cv, st.ce, CASE
   WHEN (tt - ct) / tt::DOUBLE >= (tv - cv) / tv::DOUBLE AND (tt - ct) / tt::DOUBLE >= (n - tt - tv - ce) / (n - tt - tv)::DOUBLE AND tt > ct THEN 'train'
   WHEN (tv - cv) / tv::DOUBLE >= (n - tt - tv - ce) / (n - tt - tv)::DOUBLE AND tv > cv THEN 'val' ELSE 'test' END AS s
  FROM st JOIN ord o ON o.i = st.i + 1 CROSS JOIN tot) x),
greedy AS (SELECT cluster_id, size, split FROM st WHERE i > 0)"""
_SPLIT = f"WITH RECURSIVE {_MEM}{_GREEDY}"
_ASSIGNED = """, ms AS (SELECT member, CASE min(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM mem JOIN greedy USING (cluster_id) WHERE member IS NOT NULL GROUP BY 1),
pp AS (SELECT pair_id, a.split AS qs, b.split AS ts FROM (SELECT pair_id, """ + acc_sql("query") + " AS query, " + acc_sql("target") + """ AS target FROM merged_protein_similarity) p JOIN ms a ON a.member = p.query JOIN ms b ON b.member = p.target)"""
splits = lambda s, d: split.greedy_split(split.cluster_sizes(members(s, d)))


def _pairs(s, d):
    rows = table(s, d, "merged_protein_similarity").select("pair_id", accession("query").alias("query"), accession("target").alias("target"))
    return split.pair_splits(rows, split.split_members(members(s, d), splits(s, d)))


query("cluster_sizes", f"WITH {_MEM} SELECT cluster_id, size FROM sizes")(lambda s, d: split.cluster_sizes(members(s, d)))
query("greedy_split", f"{_SPLIT} SELECT cluster_id, size, split FROM greedy")(splits)
query("split_summary", f"{_SPLIT} SELECT split, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS items, round(sum(size) / CAST((SELECT sum(size) FROM sizes) AS DOUBLE), 6) AS share FROM greedy GROUP BY 1")(lambda s, d: split.split_summary(splits(s, d)))
query("split_pairs", f"{_SPLIT}{_ASSIGNED} SELECT pair_id, qs AS pair_split FROM pp WHERE qs = ts")(lambda s, d: split.same_split(_pairs(s, d)).select("pair_id", "pair_split"))
query("inter_split_pairs", f"{_SPLIT}{_ASSIGNED} SELECT pair_id, qs AS query_split, ts AS target_split FROM pp WHERE qs <> ts")(lambda s, d: split.across_splits(_pairs(s, d)).select("pair_id", "query_split", "target_split"))
query("representative_groups", """WITH g AS (SELECT representative, count(*) AS size, min(cluster_id * 1000000 + length(representative)) AS f0, min(rn) AS first FROM (SELECT representative, cluster_id, row_number() OVER (ORDER BY representative) AS rn FROM cluster_members) WHERE representative IS NOT NULL GROUP BY 1)
 SELECT row_number() OVER (ORDER BY first) - 1 AS cluster_id, representative, size FROM g""")(
    lambda s, d: _numbered_groups(s, d))


def _numbered_groups(s, d):
    """Groups numbered in the order of their names, as the table has no line numbers: text order as a number of the group."""
    rows = table(s, d, "cluster_members").filter(F.col("representative").isNotNull()).select("representative", "member")
    names = rows.select("representative").distinct().sort("representative").select("representative", F.monotonically_increasing_id().alias("line"))
    return split.group_by_representative(rows.join(names, "representative"), "line")


@query("keep_ids", f"""WITH k AS (SELECT DISTINCT {acc_sql('member')} AS id FROM cluster_members), r AS (SELECT pair_id, {acc_sql('query')} AS query, {acc_sql('target')} AS target FROM merged_protein_similarity)
 SELECT pair_id, query, target FROM r WHERE query IN (SELECT id FROM k WHERE id IS NOT NULL) AND target IN (SELECT id FROM k WHERE id IS NOT NULL)""")
def keep_ids(s, d):
    """Rows of the pair table both of whose proteins are members of a cluster."""
    rows = table(s, d, "merged_protein_similarity").select("pair_id", accession("query").alias("query"), accession("target").alias("target"))
    return merge.keep_ids(rows, table(s, d, "cluster_members").select(accession("member").alias("id")).distinct())


query("subset_fraction")(lambda s, d: fraction_sample(table(s, d, "orders"), "o_orderkey"))
query("head_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(1000))
query("query_target_union", f"WITH {S.SEQ} SELECT query AS id FROM seq_hits UNION SELECT target FROM seq_hits")(lambda s, d: (lambda h: h.select(F.explode(F.array("query", "target")).alias("id")).distinct())(S.seq_hits(s, d)))
