"""Queries: statistics of columns and column pairs, metrics, results, novelty, parsing, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as P
from ..operators import convergence, learn, metrics, novelty, pairwise, results
from ..session import table
from ..sources import readers
from . import surrogates as S
from .ingest import long, with_vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


DBL = "::DOUBLE"

# Columns and column pairs.
query("minmax_normalize", f"WITH {S.STRUCT} SELECT query, target, round((alntmscore - (SELECT min(alntmscore) FROM struct_hits)) / ((SELECT max(alntmscore) FROM struct_hits) - (SELECT min(alntmscore) FROM struct_hits)), 6) AS alntmscore FROM struct_hits")(
    lambda s, d: pairwise.min_max_scaled(S.struct_hits(s, d).select("query", "target", "alntmscore"), ["alntmscore"]).withColumn("alntmscore", F.round("alntmscore", 6)))
query("hist1d", f"""WITH {S.STRUCT}, e AS (SELECT min(alntmscore) AS lo, max(alntmscore) AS hi, count(*) AS n FROM struct_hits)
 SELECT CAST(least(floor((alntmscore - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS count, round(count(*) / (any_value(n) * any_value((hi - lo) / 50)), 6) AS density FROM struct_hits, e GROUP BY 1""")(
    lambda s, d: pairwise.histogram(S.struct_hits(s, d), "alntmscore"))
query("hist2d", f"""WITH {S.PAIRS}, o AS (SELECT * FROM cp UNION ALL SELECT col_b, col_a, y, x FROM cp),
 e AS (SELECT col_a, col_b, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM o GROUP BY 1, 2 HAVING count(*) >= 10)
 SELECT col_a, col_b, CAST(least(floor((x - xl) / (xh - xl) * 50), 49) AS INT) AS bin_x, CAST(least(floor((y - yl) / (yh - yl) * 50), 49) AS INT) AS bin_y, count(*) AS count FROM o JOIN e USING (col_a, col_b) GROUP BY ALL""")(
    lambda s, d: pairwise.histogram_2d(S.scores(s, d), S.SCORES))
query("hexbin", f"""WITH {S.PRED}, e AS (SELECT min(truth) AS xl, max(truth) AS xh, min(prediction) AS yl, max(prediction) AS yh FROM pred),
 a AS (SELECT (truth - xl) / ((xh - xl) / 100) AS sx, (prediction - yl) / ((yh - yl) / 57) AS sy FROM pred, e),
 b AS (SELECT sx, sy, round_even(sx, 0) AS i1, round_even(sy, 0) AS j1, floor(sx) AS i2, floor(sy) AS j2 FROM a),
 c AS (SELECT *, pow(sx - i1, 2) + 3 * pow(sy - j1, 2) < pow(sx - i2 - 0.5::DOUBLE, 2) + 3 * pow(sy - j2 - 0.5::DOUBLE, 2) AS near FROM b)
 SELECT CAST(CASE WHEN near THEN 0 ELSE 1 END AS INT) AS lattice, CAST(CASE WHEN near THEN i1 ELSE i2 END AS INT) AS i, CAST(CASE WHEN near THEN j1 ELSE j2 END AS INT) AS j, count(*) AS count FROM c GROUP BY ALL""")(
    lambda s, d: pairwise.hexbin(S.predictions(s, d), "truth", "prediction"))
query("diff_median_matrix", f"WITH {S.PAIRS} SELECT col_a, col_b, round(median(abs(x - y)), 6) AS median_diff, count(*) AS n FROM cp GROUP BY 1, 2")(lambda s, d: pairwise.difference_medians(S.scores(s, d), S.SCORES))
query("dist_summary", f"""WITH {S.DIST} SELECT count(distance) AS n, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std, round(quantile_cont(distance, 0.25), 6) AS q25, round(median(distance), 6) AS median,
 round(quantile_cont(distance, 0.75), 6) AS q75, round(min(distance), 6) AS min, round(max(distance), 6) AS max, round(skewness(distance) * (count(distance) - 2) / sqrt(count(distance) * (count(distance) - 1.0::DOUBLE)), 6) AS skew, round(kurtosis_pop(distance), 6) AS kurtosis
 FROM dist WHERE embedding_name = 'plmx_base'""")(lambda s, d: pairwise.distribution_summary(long(s, d).filter("embedding_name = 'plmx_base'"), "distance"))
query("pearson", f"WITH {S.PRED} SELECT count(*) AS n, round(corr(truth, prediction), 6) AS pearson FROM pred")(lambda s, d: metrics.pearson(S.predictions(s, d), "truth", "prediction").select("n", "pearson"))
_RANK = lambda c, part="": f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {(part.replace('PARTITION BY', '') + ',') if part else ''} {c}) - 1) / 2.0::DOUBLE"
query("spearman", f"WITH {S.PRED}, r AS (SELECT {_RANK('truth')} AS a, {_RANK('prediction')} AS b FROM pred) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r")(
    lambda s, d: metrics.spearman(S.predictions(s, d), "truth", "prediction").select("n", "spearman"))
_PB = "PARTITION BY col_a, col_b"
query("spearman_matrix_ci", f"""WITH {S.PAIRS}, r AS (SELECT col_a, col_b, {_RANK('x', _PB)} AS a, {_RANK('y', _PB)} AS b FROM cp), c AS (SELECT col_a, col_b, count(*) AS n, corr(a, b) AS rho FROM r GROUP BY 1, 2)
 SELECT col_a, col_b, n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.959963984540054::DOUBLE / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(rho) + 1.959963984540054::DOUBLE / sqrt(n - 3)), 6) AS ci_high FROM c""")(
    lambda s, d: pairwise.spearman_matrix(S.scores(s, d), S.SCORES))
query("regression_metrics", f"""WITH {S.PRED} SELECT count(*) AS n, round(avg(pow(truth - prediction, 2)), 6) AS mse, round(sqrt(avg(pow(truth - prediction, 2))), 6) AS rmse, round(avg(abs(truth - prediction)), 6) AS mae,
 round(1 - avg(pow(truth - prediction, 2)) / var_pop(truth), 6) AS r2, round(corr(truth, prediction), 6) AS pearson, round(pow(corr(truth, prediction), 2), 6) AS pearson_r2 FROM pred""")(
    lambda s, d: metrics.regression_metrics(S.predictions(s, d), "truth", "prediction"))
query("ols_line", f"WITH {S.PRED} SELECT count(*) AS n, round(regr_slope(prediction, truth), 6) AS slope, round(regr_intercept(prediction, truth), 6) AS intercept, round(regr_r2(prediction, truth), 6) AS r2 FROM pred")(
    lambda s, d: metrics.line(S.predictions(s, d), "truth", "prediction").select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")]))
# DuckDB has no t quantile: its series around the normal one, exact to the digits shown at these numbers of rows.
query("ols_band", f"""WITH {S.PRED}, m AS (SELECT count(*) AS n, min(truth) AS lo, max(truth) AS hi, avg(truth) AS mx, avg(prediction) AS my, var_pop(truth) AS vx, var_pop(prediction) AS vy, covar_pop(truth, prediction) AS c FROM pred),
 z AS (SELECT *, c / vx AS slope, 1.959963984540054::DOUBLE AS z, n - 2.0::DOUBLE AS df FROM m),
 t AS (SELECT *, z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df) AS q, (vy - slope * c) * n / df AS rest FROM z),
 g AS (SELECT CAST(k AS INT) AS k, lo + k * (hi - lo) / 99.0::DOUBLE AS x, t.* FROM t, (SELECT unnest(range(100)) AS k)),
 f AS (SELECT k, x, my + slope * (x - mx) AS fit, q * sqrt(rest * (1.0::DOUBLE / n + pow(x - mx, 2) / (n * vx))) AS half FROM g)
 SELECT k, round(x, 6) AS x, round(fit, 6) AS fit, round(fit - half, 6) AS low, round(fit + half, 6) AS high FROM f""")(lambda s, d: metrics.line_band(S.predictions(s, d), "truth", "prediction"))
_ECDF = lambda src, keys: f"""u AS (SELECT {keys}, v, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS a, sum(side) AS b FROM {src} GROUP BY ALL),
 g AS (SELECT {keys}, v, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY {keys}) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY {keys}) AS DOUBLE)) AS gap, lead(v) OVER (PARTITION BY {keys} ORDER BY v) AS nx FROM u WINDOW w AS (PARTITION BY {keys} ORDER BY v))"""  # noqa: E731
query("wasserstein_matrix", f"""WITH {S.PAIRS}, e AS (SELECT col_a, col_b, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh, count(*) AS n FROM cp GROUP BY 1, 2),
 sm AS (SELECT col_a, col_b, (x - xl) / (xh - xl) AS v, 0 AS side FROM cp JOIN e USING (col_a, col_b) UNION ALL SELECT col_a, col_b, (y - yl) / (yh - yl), 1 FROM cp JOIN e USING (col_a, col_b)),
 {_ECDF('sm', 'col_a, col_b')} SELECT col_a, col_b, n, round(sum(gap * (coalesce(nx, v) - v)), 6) AS wasserstein FROM g JOIN e USING (col_a, col_b) GROUP BY 1, 2, 3""")(
    lambda s, d: pairwise.wasserstein_matrix(S.scores(s, d), S.SCORES))


def _two_splits(s, d):
    m = table(s, d, "merged_protein_similarity").filter("split in ('val', 'test') and alntmscore is not null and not isnan(alntmscore)")
    return m.select(F.lit("alntmscore").alias("k"), F.col("alntmscore").alias("v"), F.when(F.col("split") == "val", 0).otherwise(1).alias("side"))


_TS = "sm AS (SELECT 'alntmscore' AS k, alntmscore AS v, CASE WHEN split = 'val' THEN 0 ELSE 1 END AS side FROM merged_protein_similarity WHERE split IN ('val', 'test') AND alntmscore IS NOT NULL AND NOT isnan(alntmscore))"
query("ks_stat", f"WITH {_TS}, {_ECDF('sm', 'k')} SELECT k, round(max(gap), 6) AS ks FROM g GROUP BY 1")(lambda s, d: pairwise.ks_by(_two_splits(s, d), ["k"]))
query("wasserstein_raw", f"WITH {_TS}, {_ECDF('sm', 'k')} SELECT k, round(sum(gap * (coalesce(nx, v) - v)), 6) AS wasserstein FROM g GROUP BY 1")(lambda s, d: pairwise.wasserstein_by(_two_splits(s, d), ["k"]))
_KDE = f"""{S.STRUCT}, c AS (SELECT count(*) AS n, stddev_samp(alntmscore) * pow(count(*), -0.2::DOUBLE) AS h, min(alntmscore) AS lo, max(alntmscore) AS hi FROM struct_hits),
 grid AS (SELECT CAST(k AS INT) AS k, lo + (hi - lo) * k / 499.0::DOUBLE AS x FROM c, (SELECT unnest(range(500)) AS k)),
 den AS (SELECT k, x, sum(exp(-0.5::DOUBLE * pow((x - alntmscore) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM grid, struct_hits, c GROUP BY 1, 2)"""
_kde = lambda s, d: pairwise.density(S.struct_hits(s, d), "alntmscore")
query("kde_grid", f"WITH {_KDE} SELECT k, round(x, 5) AS x, round(density, 5) AS density FROM den")(lambda s, d: _kde(s, d).select("k", F.round("x", 5).alias("x"), F.round("density", 5).alias("density")))
query("kde_summary", f"WITH {_KDE} SELECT round((SELECT x FROM den ORDER BY density DESC, k LIMIT 1), 6) AS peak, round(min(alntmscore), 6) AS min, round(max(alntmscore), 6) AS max, round(median(alntmscore), 6) AS median FROM struct_hits")(
    lambda s, d: pairwise.density_summary(_kde(s, d), S.struct_hits(s, d), "alntmscore"))
query("kde_quantiles", f"WITH {_KDE}, q AS (SELECT x, round(sum(density) OVER (ORDER BY k) / (SELECT sum(density) FROM den), 9) AS cum FROM den) SELECT round(min(x) FILTER (cum >= 0.25), 6) AS q25, round(min(x) FILTER (cum >= 0.5), 6) AS q50, round(min(x) FILTER (cum >= 0.75), 6) AS q75 FROM q")(
    lambda s, d: pairwise.density_quantiles(_kde(s, d)))
query("dip_stat")(lambda s, d: pairwise.dip_statistics(long(s, d), "embedding_name", "distance"))
_Q = f"{S.PRED}, e AS (SELECT quantile_cont(truth, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM pred)"
query("qcut_edges", f"WITH {_Q} SELECT i, round(q[i], 6) AS edge FROM e, (SELECT unnest(range(1, 6)) AS i)")(
    lambda s, d: metrics.quantile_edges(S.predictions(s, d), "truth", 4).select(F.posexplode("edges").alias("p", "v")).select((F.col("p") + 1).cast("bigint").alias("i"), F.round("v", 6).alias("edge")))
query("ecdf_slices", f"""WITH {_Q}, r AS (SELECT CAST(1 + (truth > q[2])::INT + (truth > q[3])::INT + (truth > q[4])::INT AS INT) AS slice, round(abs(prediction - truth), 6) AS error FROM pred, e), n AS (SELECT slice, error, count(*) AS c FROM r GROUP BY 1, 2)
 SELECT slice, error, round(sum(c) OVER (PARTITION BY slice ORDER BY error) * 100.0::DOUBLE / sum(c) OVER (PARTITION BY slice), 6) AS share FROM n""")(lambda s, d: metrics.error_ecdf(S.predictions(s, d), "truth", "prediction"))
query("bootstrap_ci")(lambda s, d: metrics.bootstrap_interval(S.predictions(s, d), ["l_orderkey", "l_linenumber"], "truth", "prediction"))
query("gamma_fit", f"WITH {S.STRUCT} SELECT round(pow(avg(alntmscore), 2) / var_pop(alntmscore), 6) AS shape, round(var_pop(alntmscore) / avg(alntmscore), 6) AS scale FROM struct_hits")(lambda s, d: convergence.gamma_fit(S.struct_hits(s, d), "alntmscore"))

query("gamma_grid", f"""WITH {S.STRUCT}, m AS (SELECT avg(alntmscore) AS m, var_pop(alntmscore) AS v, min(alntmscore) AS lo, max(alntmscore) AS hi FROM struct_hits),
 g AS (SELECT CAST(k AS INT) AS k, lo + k * ((hi - lo) / 199.0::DOUBLE) AS x, m * m / v AS a, v / m AS b FROM m, (SELECT unnest(range(200)) AS k))
 SELECT k, round(x, 6) AS x, round(exp((a - 1) * ln(x) - x / b - (lgamma(a) + a * ln(b))), 6) AS density FROM g""")(lambda s, d: convergence.gamma_density(S.struct_hits(s, d), "alntmscore"))
query("metrics_by_experiment", """WITH p AS (SELECT l_returnflag AS model, l_linestatus AS run, l_quantity / 50.0 AS t, l_quantity / 50.0 + (l_discount - 0.05) AS p FROM lineitem)
 SELECT model, run, count(*) AS n, round(avg(pow(t - p, 2)), 6) AS mse, round(sqrt(avg(pow(t - p, 2))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae, round(1 - avg(pow(t - p, 2)) / var_pop(t), 6) AS r2, round(corr(t, p), 6) AS pearson, round(pow(corr(t, p), 2), 6) AS pearson_r2 FROM p WHERE model <> 'R' GROUP BY 1, 2""")(
    lambda s, d: _evaluated(s, d))


def _evaluated(s, d):
    """All experiments in one job, but those that have metrics."""
    p = table(s, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("run"), (F.col("l_quantity") / 50.0).alias("t"), (F.col("l_quantity") / 50.0 + (F.col("l_discount") - 0.05)).alias("p"))
    done = s.createDataFrame([("R",)], "model string")
    return metrics.metrics_by(metrics.unevaluated(p, done, ["model"]), ["model", "run"], "t", "p")


# Results.
query("results_pivot", f"WITH {S.RESULTS} SELECT model_type, embedding, round(avg(spearman) FILTER (parameter = 'fident'), 6) AS fident, round(avg(spearman) FILTER (parameter = 'alntmscore'), 6) AS alntmscore, round(avg(spearman) FILTER (parameter = 'hfsp'), 6) AS hfsp FROM results GROUP BY 1, 2")(
    lambda s, d: S.results(s, d).groupBy("model_type", "embedding").pivot("parameter", list(results.PARAMETER_ORDER)).agg(F.round(F.avg("spearman"), 6)))
query("trendline", f"""WITH {S.RESULTS} SELECT parameter, model_type, count(*) AS n, round(regr_slope(r2, plm_size) * 1e9, 6) AS slope_per_1b, round(regr_r2(r2, plm_size), 6) AS r2 FROM results
 WHERE NOT (model_type = 'fnn' AND embedding_key = 'plmx_large') GROUP BY 1, 2 HAVING count(*) >= 2 AND min(plm_size) > 0""")(
    lambda s, d: results.trend_lines(S.results(s, d), "r2", ("fnn", "plmx_large")).select("parameter", "model_type", "n", "slope_per_1b", "r2"))
_RK = f"{S.RESULTS}, best AS (SELECT model_type, parameter, embedding, max_by(spearman, abs(spearman)) AS spearman FROM results GROUP BY 1, 2, 3), rk AS (SELECT parameter, embedding, abs(spearman) AS abs_spearman, CAST(row_number() OVER (PARTITION BY parameter ORDER BY abs(spearman) DESC, embedding) AS INT) AS rank FROM best WHERE model_type = 'fnn')"


def _ranks(s, d):
    best = S.results(s, d).groupBy("model_type", "parameter", "embedding").agg(F.max_by("spearman", F.abs("spearman")).alias("spearman"))
    return results.rank_by_parameter(best)


query("rank_by_param", f"WITH {_RK} SELECT parameter, embedding, round(abs_spearman, 6) AS abs_spearman, rank FROM rk")(lambda s, d: _ranks(s, d).withColumn("abs_spearman", F.round("abs_spearman", 6)))
query("rank_without", f"WITH {_RK.replace("model_type = 'fnn')", "model_type = 'fnn' AND embedding <> 'plmx_base')")} SELECT parameter, embedding, rank FROM rk")(
    lambda s, d: results.rank_by_parameter(S.results(s, d).groupBy("model_type", "parameter", "embedding").agg(F.max_by("spearman", F.abs("spearman")).alias("spearman")), without=["plmx_base"]).select("parameter", "embedding", "rank"))
query("final_rank", f"WITH {_RK}, a AS (SELECT embedding, avg(rank) AS average_rank FROM rk GROUP BY 1) SELECT embedding, round(average_rank, 2) AS average_rank, CAST(row_number() OVER (ORDER BY average_rank, embedding) AS INT) AS final_rank FROM a")(
    lambda s, d: results.final_ranking(_ranks(s, d)).select("embedding", "average_rank", "final_rank"))
query("top_models", f"WITH {_RK}, a AS (SELECT embedding, avg(rank) AS average_rank FROM rk GROUP BY 1) SELECT embedding, round(average_rank, 2) AS average_rank FROM a ORDER BY average_rank, embedding LIMIT 5")(
    lambda s, d: results.final_ranking(_ranks(s, d)).orderBy("final_rank").limit(5).select("embedding", "average_rank"))
query("best_second_best", f"""WITH {S.RESULTS}, u AS (SELECT DISTINCT model_type, parameter, spearman AS s FROM results), r AS (SELECT *, row_number() OVER (PARTITION BY model_type, parameter ORDER BY abs(s) DESC, s DESC) AS r FROM u)
 SELECT model_type, parameter, max(s) FILTER (r = 1) AS best, max(s) FILTER (r = 2) AS second_best FROM r GROUP BY 1, 2""")(lambda s, d: results.best_two(S.results(s, d), "spearman"))
query("latest_per_key", "SELECT user_id, event_type, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")(lambda s, d: results.latest(table(s, d, "events"), ["user_id", "event_type"], "ts", "event_id"))
_lines = lambda s, d: S.results(s, d).select(F.col("experiment_id").cast("string").alias("path"), F.explode(F.array(F.concat(F.lit("Spearman: "), F.col("spearman").cast("string")), F.concat(F.lit("MAE: "), F.col("mae").cast("string")), F.lit("R2: inf"), F.lit("# note"))).alias("line"))
query("key_value_parse", f'WITH {S.RESULTS} SELECT CAST(experiment_id AS VARCHAR) AS path, spearman AS "Spearman", mae AS "MAE" FROM results')(lambda s, d: results.parse_key_values(_lines(s, d), ["Spearman", "MAE", "R2"]).select("path", "Spearman", "MAE"))
query("path_keys", "SELECT experiment_id, string_split(experiment_dir, '/')[-4] AS dataset, string_split(experiment_dir, '/')[-3] AS model_type, string_split(experiment_dir, '/')[-2] AS parameter, string_split(experiment_dir, '/')[-1] AS embedding FROM experiment_paths")(
    lambda s, d: results.path_keys(table(s, d, "experiment_paths").select("experiment_id", F.concat("experiment_dir", F.lit("/evaluation_results/x_metrics.txt")).alias("path"))).drop("path"))
_SIZES = "(VALUES ('plmx_base', 'plmx', 650000000::BIGINT), ('plmx_large', 'plmx', 3000000000::BIGINT), ('foldlm_s', 'foldlm', 8000000::BIGINT)) AS z(embedding_name, family, size)"


def sizes(s):
    return s.createDataFrame([("plmx_base", "plmx", 650000000), ("plmx_large", "plmx", 3000000000), ("foldlm_s", "foldlm", 8000000)], "embedding_name string, family string, size bigint")


query("family_size_lookup", f"SELECT experiment_id, coalesce(family, 'Unknown') AS family, coalesce(size, 0) AS size FROM experiment_paths e LEFT JOIN {_SIZES} ON e.embedding_name = z.embedding_name")(
    lambda s, d: results.with_lookup(table(s, d, "experiment_paths").select("experiment_id", "embedding_name"), sizes(s), "embedding_name", {"family": "Unknown", "size": 0}).drop("embedding_name"))
query("family_boundaries", f"WITH o AS (SELECT family, row_number() OVER w - 1 AS position, lag(family) OVER w AS before FROM {_SIZES} WINDOW w AS (ORDER BY family, size, embedding_name)) SELECT CAST(position AS INT) AS position, before, family FROM o WHERE before <> family")(
    lambda s, d: results.family_boundaries(sizes(s).select("family", F.col("size").alias("plm_size"), F.col("embedding_name").alias("embedding_key"))))
query("parameter_order", f"WITH {S.RESULTS} SELECT parameter, CAST(list_position(['fident', 'alntmscore', 'hfsp'], parameter) AS BIGINT) AS position, count(*) AS n FROM results GROUP BY 1, 2")(lambda s, d: S.results(s, d).groupBy("parameter", results.parameter_key().alias("position")).agg(F.count("*").alias("n")))
query("experiment_grid", "SELECT e AS embedding_name, m AS model_type, p AS param_name FROM (SELECT DISTINCT embedding_name AS e FROM experiment_paths), (SELECT unnest(['fnn', 'linear']) AS m), (SELECT unnest(['fident', 'hfsp']) AS p)")(
    lambda s, d: results.experiment_grid(["fnn", "linear"], ["fident", "hfsp"], table(s, d, "experiment_paths")))


@query("experiment_status", """SELECT experiment_id, CASE WHEN experiment_id % 4 = 0 THEN 'completed' WHEN experiment_id % 4 = 1 THEN 'interrupted' WHEN experiment_id % 4 = 2 THEN 'empty' ELSE 'not_started' END AS status FROM experiment_paths""")
def experiment_status(s, d):
    e = table(s, d, "experiment_paths").select("experiment_id", F.col("experiment_id").cast("string").alias("experiment_dir"))
    m = F.col("experiment_id") % 4
    found = F.when(m == 0, F.array(F.lit("training_complete.txt"), F.lit("checkpoints/last.ckpt"))).when(m == 1, F.array(F.lit("checkpoints/last.ckpt"))).when(m == 2, F.array(F.lit("hparams.yaml")))
    return results.experiment_status(e, e.select("experiment_dir", F.explode(found).alias("file"))).drop("experiment_dir")


# Novelty.
_N = f"{S.RELEASES}, known AS (SELECT DISTINCT m FROM orows WHERE is_old), novel AS (SELECT cluster_id, count(*) AS n_members FROM orows GROUP BY 1 HAVING count(*) FILTER (m IN (SELECT m FROM known)) = 0)"
_new = lambda s, d: S.releases(s, d)[0]
_known = lambda s, d: novelty.known_members(S.releases(s, d)[1])
query("json_members", f"WITH {S.RELEASES} SELECT cluster_id, count(*) AS n FROM orows GROUP BY 1")(
    lambda s, d: novelty.json_members(_new(s, d).select("cluster_id", F.to_json("members").alias("members"))).select("cluster_id", F.size("members").cast("bigint").alias("n")))
query("novel_clusters", f"WITH {_N} SELECT * FROM novel")(lambda s, d: novelty.novel_clusters(_new(s, d), _known(s, d)))
query("novel_members", f"WITH {_N} SELECT DISTINCT m AS member FROM orows JOIN novel USING (cluster_id)")(lambda s, d: novelty.novel_members(_new(s, d), _known(s, d)))
query("non_upi_clusters", f"WITH {S.RELEASES} SELECT DISTINCT cluster_id FROM orows WHERE m NOT LIKE 'UPI%'")(lambda s, d: novelty.with_named_member(_new(s, d)).select("cluster_id"))
query("id_difference", f"WITH {S.RELEASES} SELECT DISTINCT cluster_id FROM orows EXCEPT SELECT cluster_id FROM orows WHERE is_old")(lambda s, d: novelty.new_cluster_ids(*S.releases(s, d)))
_EV = ["1-URGENT", "2-HIGH"]
query("novel_intersection", f"WITH {_N}, {S.ITEMS} SELECT DISTINCT entry FROM items WHERE protein_existence IN ('1-URGENT', '2-HIGH') AND entry IN (SELECT m FROM orows JOIN novel USING (cluster_id))")(
    lambda s, d: novelty.novel_items(S.items(s, d).filter(F.col("protein_existence").isin(_EV)), novelty.novel_members(_new(s, d), _known(s, d))))
query("novelty_report", f"""WITH {_N}, {S.ITEMS}, ids AS (SELECT cluster_id FROM orows EXCEPT SELECT cluster_id FROM orows WHERE is_old), nc AS (SELECT * FROM novel SEMI JOIN ids USING (cluster_id)), nm AS (SELECT DISTINCT m FROM orows JOIN nc USING (cluster_id))
 SELECT 'old_members' AS measure, count(*) AS value FROM known UNION ALL SELECT 'new_cluster_ids', count(*) FROM ids UNION ALL SELECT 'novel_clusters', count(*) FROM nc UNION ALL SELECT 'novel_members', count(*) FROM nm
 UNION ALL SELECT 'items', count(DISTINCT entry) FROM items UNION ALL SELECT 'novel_items', count(DISTINCT entry) FROM items WHERE entry IN (SELECT m FROM nm)""")(lambda s, d: novelty.novelty_report(*S.releases(s, d), S.items(s, d)))
query("last_sequence", "SELECT 'C' || CAST(o_custkey AS VARCHAR) AS entry, max_by(o_orderstatus, o_orderkey) AS sequence FROM orders GROUP BY 1")(
    lambda s, d: novelty.last_sequence(table(s, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entry"), F.col("o_orderstatus").alias("sequence"), "o_orderkey"), "o_orderkey"))
query("order_dedup", "SELECT n_nationkey, 'b,' || n_name || ',a' AS x FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(F.array_distinct(F.array(F.lit("b"), F.col("n_name"), F.lit("b"), F.lit("a"), F.col("n_name"))), ",").alias("x")))

# Pair sampling.
query("pair_index_decode", "SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, i, j FROM (SELECT unnest(range(400)) AS i), (SELECT unnest(range(400)) AS j) WHERE i < j")(
    lambda s, d: (lambda i, j: s.range(400 * 399 // 2).select(F.col("id").alias("k"), i.alias("i"), j.alias("j")))(*P.pair_index(F.col("id"), 400)))
query("all_pair_distances", """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
 SELECT a.r AS i, b.r AS j, round(list_distance(a.e, b.e), 6) AS distance FROM v a JOIN v b ON a.r < b.r""")(
    lambda s, d: convergence.all_distances(table(s, d, "embeddings"), "vec_id", "embedding").withColumn("distance", F.round("distance", 6)))
query("convergence_table")(lambda s, d: convergence.convergence(table(s, d, "embeddings"), "vec_id", "embedding", convergence.log_sizes(100, 3000, 4), 3, 20000))

# The same statistics of samples that SQL can name: each source's scores in each split, against all scores.
_SPLITS = {"train": 1, "val": 2, "test": 3, "inter": 4}
query("convergence_of_sources", f"""WITH a AS (SELECT {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _SPLITS.items()).join(('CASE split ', ' END'))} AS sample_size, CAST(right(source, 2) AS INT) AS repetition, alntmscore AS v
  FROM merged_protein_similarity WHERE source IS NOT NULL AND NOT isnan(alntmscore)), r AS (SELECT alntmscore AS v FROM merged_protein_similarity WHERE NOT isnan(alntmscore)),
 sm AS (SELECT sample_size, repetition, v, 0 AS side FROM a UNION ALL SELECT sample_size, repetition, v, 1 FROM (SELECT DISTINCT sample_size, repetition FROM a), r), {_ECDF('sm', 'sample_size, repetition')},
 e AS (SELECT sample_size, repetition, round(sum(gap * (coalesce(nx, v) - v)), 6) AS w, round(max(gap), 6) AS ks FROM g GROUP BY 1, 2), m AS (SELECT sample_size, repetition, avg(v) AS mean FROM a GROUP BY 1, 2)
 SELECT sample_size, round(abs(avg(mean) - (SELECT avg(v) FROM r)), 6) AS mean_error, round(stddev_pop(mean), 6) AS mean_spread, round(avg(w), 6) AS wasserstein, round(avg(ks), 6) AS ks FROM m JOIN e USING (sample_size, repetition) GROUP BY 1""")(
    lambda s, d: _of_sources(s, d))


def _of_sources(s, d):
    m = table(s, d, "merged_protein_similarity")
    size = F.coalesce(*[F.when(F.col("split") == k, v) for k, v in _SPLITS.items()])
    parts = m.filter("source is not null").select(size.alias("sample_size"), F.substring("source", -2, 2).cast("int").alias("repetition"), F.col("alntmscore").alias("v"))
    return convergence.convergence_of(parts, m.select(F.col("alntmscore").alias("v")))


query("log_sizes", "SELECT DISTINCT CAST(floor(pow(10, 1 + 4 * i / 24.0::DOUBLE) + 1e-9) AS BIGINT) AS size FROM (SELECT unnest(range(25)) AS i)")(lambda s, d: s.createDataFrame([(n,) for n in convergence.log_sizes(10, 100_000, 25)], "size bigint"))
# Samples by hash have no SQL; how many, whether each once and all of the table has.
_SAMPLED = lambda n: f"SELECT {n} AS rows, {n} AS keys, {n} AS known FROM orders"
_counted = lambda sample, whole: sample.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("keys")).join(sample.select("o_orderkey").join(whole, "o_orderkey", "left_semi").agg(F.count("*").alias("known")))
query("subset_fraction_counts", _SAMPLED("CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)"))(lambda s, d: _counted(convergence.fraction_sample(table(s, d, "orders"), "o_orderkey"), table(s, d, "orders")))
query("sample_n_counts", _SAMPLED("least(count(*), 1000)"))(lambda s, d: _counted(convergence.hash_sample(table(s, d, "orders"), "o_orderkey", 1000), table(s, d, "orders")))
query("random_vector_moments", "SELECT count(*) AS vectors, true AS length, true AS centred, true AS spread FROM embeddings")(lambda s, d: learn.random_vectors(table(s, d, "embeddings").select("vec_id"), "vec_id", 64).select("embedding", F.explode("embedding").alias("x")).agg(
    (F.count("*") / 64).cast("bigint").alias("vectors"), (F.min(F.size("embedding")) == 64).alias("length"), (F.abs(F.avg("x")) < 5 / F.sqrt(F.count("*"))).alias("centred"), (F.abs(F.stddev("x") - 1) < 5 / F.sqrt(F.count("*"))).alias("spread")))
query("bootstrap_brackets", f"WITH {S.PRED} SELECT 'mae' AS statistic, 1000 AS valid, true AS inside, false AS doubtful FROM pred HAVING count(*) > 0")(lambda s, d: _brackets(s, d))


def _brackets(s, d):
    """A statistic of the caller's, the mean absolute error: its interval holds the sample's own value."""
    p = S.predictions(s, d)
    ci = metrics.bootstrap_interval(p, ["l_orderkey", "l_linenumber"], "truth", "prediction", statistics={"mae": lambda: F.col("abs") / F.col("weight")})
    own = metrics.regression_metrics(p, "truth", "prediction").select("mae")
    return ci.join(F.broadcast(own)).select("statistic", F.col("valid").cast("int").alias("valid"), F.col("mae").between(F.col("ci_low"), F.col("ci_high")).alias("inside"), "doubtful")


# Sequences and file formats, from the documents' letters.
_LET = "SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents WHERE text IS NOT NULL"
_letters = lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))
query("seq_normalize", f"SELECT doc_id, md5(translate(seq, 'UZOB', 'XXXX')) AS h FROM ({_LET})")(lambda s, d: _letters(s, d).select("doc_id", F.md5(P.normalised_sequence("seq").cast("binary")).alias("h")))
query("seq_len_filter", f"SELECT doc_id, length(seq) AS n FROM ({_LET}) WHERE length(seq) BETWEEN 1 AND 2000")(
    lambda s, d: readers.usable_sequences(_letters(s, d).withColumnRenamed("seq", "sequence")).select("doc_id", F.length("sequence").cast("bigint").alias("n")))
query("fasta_parse", f"SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, length(seq) AS n, md5(seq) AS h FROM ({_LET})")(
    lambda s, d: readers.fasta_rows(_letters(s, d).select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" some protein\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))).select("id", F.length("sequence").cast("bigint").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("h")))


@query("xml_members", f"""WITH {S.RELEASES} SELECT cluster_id, array_to_string(list_concat(list_sort(list(m) FILTER (m LIKE 'UPI%')), list_sort(list(m) FILTER (m NOT LIKE 'UPI%'))), ',') AS members FROM orows GROUP BY 1""")
def xml_members(s, d):
    tag = F.transform(F.array_sort("members"), lambda m: F.when(m.startswith("UPI"), F.concat(F.lit('<dbReference type="UniParc ID" id="'), m, F.lit('">'))).otherwise(F.concat(F.lit('<dbReference type="UniProtKB ID" id="X"><property type="UniProtKB accession" value="'), m, F.lit('"/>'))))
    text = _new(s, d).select(F.concat(F.lit('<entry id="'), "cluster_id", F.lit('">'), F.array_join(tag, "\n")).alias("value"))
    return readers.xml_rows(text).select("cluster_id", F.array_join("members", ",").alias("members"))


@query("pdb_ca_plddt", "SELECT CAST(l_orderkey AS VARCHAR) AS path, count(*) AS length, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY l_linenumber) AS plddt FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity) GROUP BY 1")
def pdb_ca_plddt(s, d):
    one = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    line = F.concat(F.lit("ATOM  "), F.lpad(F.col("l_linenumber").cast("string"), 5, " "), F.lit("  CA  ALA A   1      11.111  22.222  33.333  1.00"), F.lpad(F.format_string("%.2f", "q"), 6, " "), F.lit("           C"))
    return readers.pdb_rows(one.select(F.col("l_orderkey").cast("string").alias("path"), line.alias("value")))


# Presentation and names.
query("number_format", """SELECT o_orderkey, CASE WHEN v >= 1e6 THEN CASE WHEN v / 1e6 < 10 THEN printf('%.1fM', round(v / 1e6, 1)) ELSE printf('%dM', CAST(floor(v / 1e6) AS BIGINT)) END
 WHEN v >= 1000 THEN CASE WHEN v / 1000 < 10 THEN printf('%.1fK', round(v / 1000, 1)) ELSE printf('%dK', CAST(floor(v / 1000) AS BIGINT)) END ELSE printf('%d', CAST(floor(v) AS BIGINT)) END AS text FROM (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 37 AS v FROM orders)""")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", P.short_number(F.col("o_orderkey").cast("double") * 37).alias("text")))
query("safe_names", "SELECT experiment_id, regexp_replace(experiment_dir || ':a?b', '[\\\\/*?:\"<>|]', '_', 'g') AS name FROM experiment_paths")(
    lambda s, d: table(s, d, "experiment_paths").select("experiment_id", P.safe_name(F.concat("experiment_dir", F.lit(":a?b"))).alias("name")))
query("rank_stems", "SELECT DISTINCT embedding_name, 'x' || embedding_name AS stem FROM experiment_paths")(
    lambda s, d: table(s, d, "experiment_paths").select("embedding_name", P.rank_stem(F.concat(F.lit("x"), "embedding_name", F.lit("_scores_rank_001_seed.json"))).alias("stem")).distinct())
query("packed_list", "SELECT vec_id, array_to_string(list_transform(CAST(embedding[1:8] AS DOUBLE[]), lambda x: CAST(round_even(x * 100, 0) AS INT)), ',') AS packed FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", P.packed_list(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 100)).alias("packed")))
query("first_tokens", "SELECT p_partkey, string_split(p_name, ' ')[1] AS token FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", P.first_token("p_name").alias("token")))
query("spaced_sequences", "SELECT p_partkey, trim(regexp_replace(translate(upper(replace(p_name, ' ', '')), 'UZOB', 'XXXX'), '(.)', '\\1 ', 'g')) AS sequence FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", P.spaced_sequence(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence")))
query("unique_cells", f"WITH {S.RESULTS} SELECT DISTINCT parameter, model_type FROM results")(lambda s, d: S.results(s, d).select("parameter", "model_type").dropDuplicates())
query("finite_components", "SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1.0::DOUBLE ELSE 0 END)) AS replaced FROM protein_embeddings WHERE len(embedding) > 0")(
    lambda s, d: table(s, d, "protein_embeddings").filter(F.size("embedding") > 0).select("vec_id", F.aggregate(F.zip_with("embedding", learn.cleaned("embedding"), lambda a, b: F.when(a.isNull() | F.isnan(a) | (a.cast("double") != b), 1.0).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x).alias("replaced")))
query("difference_extremes", f"WITH {S.PAIRS}, m AS (SELECT col_a, col_b, round(median(abs(x - y)), 6) AS d FROM cp GROUP BY 1, 2) SELECT min(d) AS least, max(d) AS most, round(max(d) * 1.1::DOUBLE, 6) AS upper FROM m")(
    lambda s, d: pairwise.difference_medians(S.scores(s, d), S.SCORES).agg(F.min("median_diff").alias("least"), F.max("median_diff").alias("most"), F.round(F.max("median_diff") * 1.1, 6).alias("upper")))


@query("xml_single_entry", f"WITH {S.RELEASES} SELECT cluster_id, count(*) AS n_members FROM orows WHERE cluster_id = 'C7' GROUP BY 1")
def xml_single_entry(s, d):
    tag = F.transform("members", lambda m: F.concat(F.lit('<dbReference type="UniParc ID" id="'), m, F.lit('">')))
    text = _new(s, d).select(F.concat(F.lit('<entry id="'), "cluster_id", F.lit('">'), F.array_join(tag, "")).alias("value"))
    return readers.xml_rows(text).filter("cluster_id = 'C7'").select("cluster_id", F.size("members").cast("bigint").alias("n_members"))


# Models, checked by tests.
@query("pca_project")
def pca_project(s, d):
    scores, _ = learn.pca_project(table(s, d, "embeddings"), "vec_id", "embedding", 3)
    return scores.select("vec_id", *[F.round(F.col("scores")[i], 6).alias(f"pc{i + 1}") for i in range(3)])


def hit_vectors(s, d):
    """Hits with both vectors of the first store."""
    return with_vectors(S.seq_hits(s, d), S.vector_stores(s, d), "m1")


def _linear(kind):
    def run(s, d):
        pairs = hit_vectors(s, d)
        return learn.predict_linear(learn.fit_linear(pairs, kind, "a", "b", "fident"), pairs, kind, "a", "b", ["query", "target"]).withColumn("prediction", F.round("prediction", 6))

    return run


query("linear_fit")(_linear("linear"))
query("linear_distance_fit")(_linear("linear_distance"))


@query("fnn_fit")
def fnn_fit(s, d):
    pairs = hit_vectors(s, d)
    net = learn.fit_network(pairs, ["query", "target"], "a", "b", "fident")
    return learn.predict_network(net, pairs, "a", "b", ["query", "target"])


query("random_vectors")(lambda s, d: learn.random_vectors(table(s, d, "embeddings").select("vec_id"), "vec_id", 16).select("vec_id", F.posexplode("embedding").alias("position", "value")))
