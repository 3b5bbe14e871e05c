"""Hand-made cases of the core operators: nulls, NaN, ties, empty tables, edges."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import ids, scores
from pairforge.operators import compare, convergence, distances, learn, merge, metrics, novelty, pairwise, results, split
from pairforge.operators.ordered import average_ranks, running_sums
from pairforge.sources import readers, writers


def values(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_hfsp_branches(spark):
    rows = [(0.5, 0, 0), (0.5, 6, 5), (0.5, 6, 6), (0.5, 400, 50), (0.5, 400, 51), (1.0, None, 1), (None, 10, 10)]
    got = [r.h for r in spark.createDataFrame(rows, "f double, n int, m int").select(scores.hfsp("f", "n", "m").alias("h")).collect()]
    curve = lambda n: 50 - 770 * n ** (-0.33 * (1 + math.exp(n / 1000)))
    want = [-50.0, -50.0, curve(12), curve(450), 50 - 28.4, 100 - 28.4]
    assert got[:6] == pytest.approx(want) and got[6] is None


def test_packed_means(spark):
    rows = [("70",), ("69,70",), ("70,71",), (None,), ("",), ("90;91",), ("80, 90",)]
    assert [r.v for r in spark.createDataFrame(rows, "s string").select(scores.packed_mean("s").alias("v")).collect()] == [70, 69, 70, None, None, None, 85]


def test_identifiers(spark):
    rows = ["A1BCDEFG", "a1bcdefg\n", "sp|A1BCDEFG.3|1BCD_X", "AF-A1BCDEFG-2-F1-model_v4.cif", ">A1BCDEFG-3 some words", "UniRef90_A1BCDEFG", " ", None, "odd"]
    want = ["A1BCDEFG", "A1BCDEFG", "A1BCDEFG", "A1BCDEFG-2", "A1BCDEFG-3", "A1BCDEFG", None, None, "ODD"]
    assert [r.v for r in spark.createDataFrame([(x,) for x in rows], "s string").select(ids.accession("s").alias("v")).collect()] == want
    paths = [("a//b/./c.h5", "a/b/c.h5"), ("./a/x/../b", "a/b"), ("/a/../../b", "/../b"), ("../a", "../a"), (" ", None), (None, None)]
    assert [r.v for r in spark.createDataFrame(paths, "s string, w string").select(ids.canonical_path("s").alias("v")).collect()] == [w for _, w in paths]
    assert [r.v for r in spark.createDataFrame([("AF-P1-F1-model_v4",), ("P1",), ("",), (None,)], "s string").select(scores.model_id("s").alias("v")).collect()] == ["P1", None, None, None]


def test_merge_full_join_and_exclusion(spark):
    seq = spark.createDataFrame([("a", "b", 0.5, 1.0), ("a", "c", 0.6, 2.0), (None, "d", 0.6, 2.0)], "query string, target string, fident double, hfsp double")
    struct = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.8), (None, "d", 0.7)], "query string, target string, alntmscore double")
    m = merge.merge_hits(seq, struct)
    assert m.count() == 5
    s = merge.merge_stats(m).first()
    assert (s["both"], s.sequence_only, s.structure_only, s.overlap) == (1, 2, 2, 0.2)
    low = spark.createDataFrame([("c",)], "id string")
    assert values(merge.drop_ids(seq.select("query", "target"), low)) == [("a", "b")]
    empty = merge.merge_stats(merge.merge_hits(seq.limit(0), struct.limit(0))).first()
    assert empty.pairs == 0 and empty.overlap is None


def test_pair_keys_and_duplicates(spark):
    run = spark.createDataFrame([("a", "b", "0.5"), ("b", "a", "0.7"), ("a", "a", "x"), (None, "a", "1")], "query string, target string, v string")
    assert values(compare.one_per_pair(compare.keyed(run, "v"))) == [("a|a", None), ("a|b", 0.7)]


def test_nan_is_a_missing_value_of_a_run(spark):
    run = spark.createDataFrame([("a", "b", 0.5), ("b", "a", math.nan), ("c", "d", math.nan)], "query string, target string, v double")
    assert values(compare.one_per_pair(compare.keyed(run, "v"))) == [("a|b", 0.5), ("c|d", None)]


def test_distances_missing_and_pooling(spark):
    stores = spark.createDataFrame([("a", "m", [0.0, 3.0]), ("b", "m", [4.0, 0.0]), ("a", "k", [1.0])], "id string, embedding_name string, embedding array<float>")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "z", 2)], "query string, target string, distance_other int")
    assert values(distances.pair_distances(pairs, stores), "target", "embedding_name", "distance") == [("b", "k", None), ("b", "m", 5.0), ("z", "k", None), ("z", "m", None)]
    pooled = distances.mean_pool(spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 6.0]]), (2, []), (3, None)], "id int, m array<array<float>>"), ["id"], "m")
    assert values(pooled) == [(1, [2.0, 4.0]), (2, None), (3, None)]
    half = spark.createDataFrame([(0.12345,), (0.00005,)], "x double").select(F.bround("x", 4).alias("r"))
    assert [r.r for r in half.collect()] == [0.1234, 0.0]


def greedy(sizes, ratios):
    total = sum(sizes)
    t = [int(total * ratios[0]), int(total * ratios[1])]
    t.append(total - sum(t))
    c, out = [0, 0, 0], []
    for s in sizes:
        d = [(t[i] - c[i]) / t[i] if t[i] > 0 else 0 for i in range(3)]
        k = 0 if d[0] >= d[1] and d[0] >= d[2] and t[0] > c[0] else 1 if d[1] >= d[2] and t[1] > c[1] else 2
        out.append(k)
        c[k] += s
    return out


def test_blocks_equal_the_sequential_fold():
    for seed in range(500):
        rng = random.Random(seed)
        sizes = sorted((rng.choice([1, 1, 1, 2, 3, 20]) for _ in range(rng.randint(1, 50))), reverse=True)
        ratios = rng.choice([(0.7, 0.15, 0.15), (0.5, 0.25, 0.25), (1, 0, 0), (0, 0.5, 0.5), (0.9, 0, 0.1)])
        total = sum(sizes)
        t = [int(total * ratios[0]), int(total * ratios[1])]
        counts, got = (0, 0, 0), []
        for s, g in itertools.groupby(sizes):
            n = len(list(g))
            block = split.Block(s, (*t, total - sum(t)), counts)
            got += [block.split(k) for k in range(n)]
            counts = tuple(a + s * b for a, b in zip(counts, block.counts(n)))
        assert got == greedy(sizes, ratios)


def test_blocks_of_very_large_counts():
    small, large = (split.Block(1, (7 * n, 2 * n, n), (0, 0, 0)) for n in (10**3, 10**12))
    assert small.splits(np.arange(10**4)).tolist() == [small.split(k) for k in range(10**4)]
    first = np.arange(2000)
    assert large.splits(first).tolist() == [next((i for i in (0, 1) if large.given(i, k + 1) > large.given(i, k)), 2) for k in first.tolist()]


def test_greedy_split_with_a_giant_and_ties(spark):
    sizes = [(i, 1) for i in range(60)] + [(100, 50), (101, 7), (102, 7)]
    got = {r.cluster_id: r.split for r in split.greedy_split(spark.createDataFrame(sizes, "cluster_id bigint, size bigint")).collect()}
    order = sorted(sizes, key=lambda x: (-x[1], x[0]))
    assert got == {c: split.NAMES[k] for (c, _), k in zip(order, greedy([s for _, s in order], (0.7, 0.15, 0.15)))}
    assert split.greedy_split(spark.createDataFrame([], "cluster_id bigint, size bigint")).count() == 0
    with pytest.raises(ValueError):
        split.greedy_split(spark.createDataFrame([], "cluster_id bigint, size bigint"), (0.5, 0.1, 0.1))


def test_ranks_and_sums_in_many_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 300))) for _ in range(3000)]
    got = {(r.k, r.v): r.rank for r in average_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "rank").collect()}
    for k in "ab":
        x = sorted(v for g, v in rows if g == k)
        for v in set(x):
            first = x.index(v) + 1
            assert got[k, v] == first + (x.count(v) - 1) / 2
    cum = running_sums(spark.createDataFrame([(float(i), 1) for i in range(1000)], "v double, n int"), [], "v", ["n"], lead=True)
    assert all(r.cum_n == r.v + 1 and (r.next_v == r.v + 1 or r.v == 999) for r in cum.collect())


def test_ranges_follow_the_rows_of_each_key(spark):
    rng = random.Random(2)
    rows = [("many", float(i), rng.randint(1, 9)) for i in range(6000)] + [("one", 5.0, 3), ("two", -1.0, 1), ("two", 2.5, 2)] + [("many", -7.5, 2)]
    out = running_sums(spark.createDataFrame(rows, "k string, v double, n int"), ["k"], "v", ["n"], lead=True, rows_per_range=10).collect()
    got = {(r.k, r.v): (r.cum_n, r.next_v) for r in out}
    want = {}
    for k in ("many", "one", "two"):
        mine, total = sorted((v, n) for g, v, n in rows if g == k), 0
        for (v, n), after in zip(mine, [*(v for v, _ in mine[1:]), None]):
            want[k, v] = ((total := total + n), after)
    assert len(out) == len(rows) and got == want


def pair_frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double")


def test_correlations_of_odd_columns(spark):
    line = pair_frame(spark, [(float(i), 2.0 * i) for i in range(20)] + [(None, 1.0), (math.nan, 2.0)])
    assert metrics.pearson(line, "a", "b").first().pearson == 1.0 and metrics.spearman(line, "a", "b").first().n == 20
    constant = pair_frame(spark, [(1.0, float(i)) for i in range(5)])
    assert metrics.pearson(constant, "a", "b").first().pearson is None and metrics.spearman(constant, "a", "b").first().spearman is None
    m = metrics.regression_metrics(pair_frame(spark, [(1.0, 1.0), (1.0, 1.0)]), "a", "b").first()
    assert m.r2 == 1.0 and metrics.regression_metrics(pair_frame(spark, [(1.0, 2.0), (1.0, 1.0)]), "a", "b").first().r2 == 0.0
    assert metrics.regression_metrics(pair_frame(spark, [(1.0, 2.0)]), "a", "b").first().mse is None
    assert metrics.regression_metrics(pair_frame(spark, []), "a", "b").first().n == 0
    ci = pairwise.spearman_matrix(line, ["a", "b"]).first()
    assert ci.rho == ci.ci_low == ci.ci_high == 1.0


def test_p_values():
    assert metrics.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert metrics.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert metrics.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)


def test_histograms_of_edges(spark):
    df = pair_frame(spark, [(0.0, 1.0), (1.0, 1.0), (0.5, 1.0), (math.nan, 1.0), (None, 1.0)])
    assert values(pairwise.histogram(df, "a", 2), "bin", "count") == [(0, 1), (1, 2)]
    assert values(pairwise.histogram(df, "b", 2), "bin", "count") == [(1, 5)]
    assert pairwise.histogram(df.limit(0), "a").count() == 0
    assert sum(r["count"] for r in pairwise.hexbin(df, "a", "b", 10).collect()) == 3
    assert pairwise.histogram_2d(df, ["a", "b"]).count() == 0
    scaled = pairwise.min_max_scaled(df, ["a", "b"]).collect()
    assert {r.b for r in scaled} == {0.5} and sum(r.a is None for r in scaled) == 2


def test_distribution_distances(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.normal(0.5, 1, 300)
    s = spark.createDataFrame([("k", float(v), i) for i, z in enumerate((x, y)) for v in z], "k string, v double, side int")
    assert pairwise.wasserstein_by(s, ["k"]).first().wasserstein == pytest.approx(np.abs(np.sort(x) - np.sort(y)).mean(), abs=1e-5)
    grid = np.concatenate([x, y])
    ks = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    assert pairwise.ks_by(s, ["k"]).first().ks == pytest.approx(ks, abs=1e-6)


def test_density_without_spread(spark):
    assert pairwise.density(pair_frame(spark, [(1.0, 1.0)] * 5), "a").count() == 0
    assert pairwise.density(pair_frame(spark, []), "a").count() == 0
    d = pairwise.density(spark.range(1000).select((F.col("id") / 1000.0).alias("a")), "a").toPandas().sort_values("k")
    assert np.trapezoid(d.density, d.x) == pytest.approx(0.92, abs=0.06)


def test_dip():
    two = pairwise.dip(np.array([0.0, 1.0]), np.array([50, 50]))
    even = pairwise.dip(np.arange(100.0), np.ones(100))
    assert two == pytest.approx(0.25) and even == pytest.approx(1 / 200)
    assert pairwise.dip(np.array([3.0]), np.array([10])) == pytest.approx(1 / 20)
    rng = np.random.default_rng(0)
    one, both = np.sort(rng.normal(size=500)), np.sort(np.concatenate([rng.normal(-3, 1, 250), rng.normal(3, 1, 250)]))
    assert pairwise.dip(one, np.ones(500)) < 0.03 < 0.06 < pairwise.dip(both, np.ones(500))


def test_quantile_slices(spark):
    df = spark.createDataFrame([(float(i), i + 0.5) for i in range(1, 9)], "t double, p double")
    assert values(metrics.with_slices(df, "t", 4).groupBy("slice").count()) == [(1, 2), (2, 2), (3, 2), (4, 2)]
    assert max(r.share for r in metrics.error_ecdf(df, "t", "p").collect()) == 100.0
    with pytest.raises(Exception, match="unique"):
        metrics.with_slices(spark.createDataFrame([(1.0, 1.0)] * 8, "t double, p double"), "t", 4).collect()


def test_bootstrap_brackets_and_repeats(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(a + b)) for i, (a, b) in enumerate(zip(x, rng.normal(size=400)))], "id int, t double, p double")
    runs = [{r.statistic: r for r in metrics.bootstrap_interval(d, ["id"], "t", "p", 300).collect()} for d in (df, df.repartition(3))]
    r2 = metrics.regression_metrics(df, "t", "p").first().pearson_r2
    assert runs[0] == runs[1] and runs[0]["pearson_r2"].ci_low < r2 < runs[0]["pearson_r2"].ci_high

    assert 0.02 < runs[0]["spearman"].se < 0.06


def test_trend_guards_and_rankings(spark):
    rows = [("f", "fnn", "e1", 1, 0.1), ("f", "fnn", "e2", 2, 0.2), ("f", "fnn", "esm2_3b", 3, 9.0), ("f", "linear", "e1", 0, 0.1), ("f", "linear", "e2", 2, 0.3), ("h", "linear", "e1", 2, 0.3)]
    t = results.trend_lines(spark.createDataFrame(rows, "parameter string, model_type string, embedding_key string, plm_size bigint, r2 double"), "r2").collect()
    assert [(r.parameter, r.model_type, r.n) for r in t] == [("f", "fnn", 2)] and t[0].slope_per_1b == pytest.approx(1e8)
    scores_ = spark.createDataFrame([("fident", "fnn", "a", -0.9), ("fident", "fnn", "b", 0.9), ("hfsp", "fnn", "b", 0.5), ("fident", "fnn", "c", None)], "parameter string, model_type string, embedding string, spearman double")
    assert values(results.final_ranking(results.rank_by_parameter(scores_)), "embedding", "average_rank", "final_rank") == [("a", 1.0, 1), ("b", 1.5, 2), ("c", 3.0, 3)]
    b = results.best_two(scores_, "spearman").filter("parameter = 'fident'").first()
    assert (b.best, b.second_best) == (0.9, -0.9)


def test_key_values(spark):
    lines = [("p", "# R2: 5"), ("p", "R2: 0.5"), ("p", "Pearson_r2: nan"), ("p", "Pearson_r2_SE: 1e-3"), ("q", "R2: inf"), ("q", "MAE 3")]
    got = {r.path: r for r in results.parse_key_values(spark.createDataFrame(lines, "path string, line string"), ["R2", "Pearson_r2", "Pearson_r2_SE"]).collect()}
    assert got["p"].R2 == 0.5 and math.isnan(got["p"].Pearson_r2) and got["p"].Pearson_r2_SE == 0.001 and got["q"].R2 is None


def test_novelty_edges(spark):
    new = novelty.json_members(spark.createDataFrame([("c1", '["a","b"]'), ("c2", "[]"), ("c3", "oops"), ("c4", '["UPI1"]'), ("c5", '["o"]')], "cluster_id string, members string"))
    old = spark.createDataFrame([("c5", ["o"])], "cluster_id string, members array<string>")
    assert values(novelty.novel_clusters(new, novelty.known_members(old))) == [("c1", 2), ("c4", 1)]
    assert values(novelty.with_named_member(new).select("cluster_id")) == [("c1",), ("c5",)]
    assert values(novelty.new_cluster_ids(new, old)) == [("c1",), ("c2",), ("c3",), ("c4",)]


def test_pair_index_near_row_ends(spark):
    for n in (2, 3, 100_000):
        total = n * (n - 1) // 2
        ks = sorted({0, total - 1, *(k for i in (1, 2, n // 2, n - 2) if 0 < i < n for k in (i * (2 * n - 1 - i) // 2 + d for d in (-1, 0, 1)) if 0 <= k < total)})
        i, j = scores.pair_index(F.col("k"), n)
        for r in spark.createDataFrame([(k,) for k in ks], "k bigint").select("k", i.alias("i"), j.alias("j")).collect():
            assert 0 <= r.i < r.j < n and r.i * (2 * n - 1 - r.i) // 2 + r.j - r.i - 1 == r.k


def test_samples_are_distinct_and_repeat(spark):
    rows = convergence.sampled_indices(spark, 100, [(500, 0, 7), (10**6, 1, 8)]).collect()
    by = {rep: [r.k for r in rows if r.repetition == rep] for rep in (0, 1)}
    assert len(set(by[0])) == len(by[0]) == 500 and sorted(by[1]) == list(range(4950))
    assert {r.k for r in convergence.sampled_indices(spark, 100, [(500, 0, 7)]).collect()} == set(by[0])
    assert convergence.log_sizes(10, 1000, 3) == [10, 100, 1000]
    assert convergence.fraction_sample(spark.range(1005), "id", 0.1).count() == 100


def test_models_learn(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(400, 6)), rng.normal(size=(400, 6))
    y = ((a - b) ** 2) @ np.arange(1.0, 7.0)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), float(y[i])) for i in range(400)], "id int, a array<double>, b array<double>, y double")
    fit = learn.fit_linear(df, "linear_distance", "a", "b", "y")
    assert fit.coefficients.toArray() == pytest.approx(np.arange(1.0, 7.0), abs=1e-3)
    net, history = learn.train_network(a, b, y / y.std(), epochs=300, patience=300, batch=64, rate=3e-3)
    assert min(history) < 0.4 and history[0] > min(history)
    assert learn.predict_network(net, df, "a", "b", ["id"]).count() == 400
    scores_, explained = learn.pca_project(df, "id", "a", 3)
    z = np.array([r.scores for r in scores_.orderBy("id").collect()])
    c = a - a.mean(0)
    top = np.linalg.svd(c, full_matrices=False)[2][:3]
    assert np.abs(z) == pytest.approx(np.abs(c @ top.T), abs=1e-6) and 0 < explained[0] < explained[2] < 1
    assert learn.random_vectors(df.select("id"), "id", 4).collect() == learn.random_vectors(df.select("id"), "id", 4).collect()


def test_training_goes_on_after_a_break(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 5)), rng.normal(size=(200, 5))
    y = ((a - b) ** 2).sum(1)
    whole, history = learn.train_network(a, b, y, epochs=9, patience=9)
    folder = learn.Checkpoints(spark, str(tmp_path / "run"))
    assert folder.newest() is None
    learn.train_network(a, b, y, epochs=4, patience=9, checkpoints=folder)
    assert folder.epochs()[-1] == 3 and len(folder.epochs()) <= 2
    again, told = learn.train_network(a, b, y, epochs=9, patience=9, checkpoints=folder)
    assert told == history and all((p == q).all() for p, q in zip(whole.weights, again.weights))
    assert all((p == q).all() for p, q in zip(learn.checkpoint_network(folder.newest()).weights, whole.weights))


def test_batch_inference_by_the_newest_checkpoint(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 4))
    stores = spark.createDataFrame([(f"p{i}", n, v[i].tolist()) for i in range(30) for n in ("s", "t")], "id string, embedding_name string, embedding array<double>")
    pairs = spark.createDataFrame([(f"p{i}", f"p{(i * 7) % 31}", i / 30) for i in range(30)], "query string, target string, y double")
    both = pairs.join(stores.filter("embedding_name = 's'").selectExpr("id as query", "embedding as a"), "query").join(stores.filter("embedding_name = 's'").selectExpr("id as target", "embedding as b"), "target")
    net = learn.fit_network(both, ["query", "target"], "a", "b", "y", folder=str(tmp_path / "one"), epochs=3)
    runs = [("one", "s", str(tmp_path / "one")), ("other", "t", str(tmp_path / "one")), ("none", "s", str(tmp_path / "none"))]
    got = learn.predict_experiments(runs, pairs, stores).collect()
    want = {(r["query"], r["target"]): r["prediction"] for r in learn.predict_network(net, both, "a", "b", ["query", "target"]).collect()}
    assert {(r["query"], r["target"]): r["prediction"] for r in got if r["experiment"] == "one"} == want and len(want) == 29
    assert {r["experiment"] for r in got} == {"one", "other"}
    left = learn.predict_experiments(runs, pairs, stores, spark.createDataFrame([("one",)], "experiment string"))
    assert {r["experiment"] for r in left.collect()} == {"other"}


def test_dip_p_values():
    rng = np.random.default_rng(3)
    one, two = np.sort(rng.uniform(size=500)), np.sort(np.concatenate([rng.normal(-3, 1, 250), rng.normal(3, 1, 250)]))
    assert pairwise.dip_p_value(pairwise.dip(one, np.ones(500)), 500) > 0.05
    assert pairwise.dip_p_value(pairwise.dip(two, np.ones(500)), 500) < 0.01
    shares = [pairwise.dip_p_value(pairwise.dip(np.sort(rng.uniform(size=60)), np.ones(60)), 60) for _ in range(60)]
    assert 0.35 < np.mean(shares) < 0.65


def test_statistics_of_the_caller_and_doubtful_ones(spark):
    df = spark.createDataFrame([(i, float(i), i + 0.5) for i in range(50)], "id int, t double, p double")
    own = metrics.bootstrap_interval(df, ["id"], "t", "p", 60, statistics={"mae": lambda: F.col("abs") / F.col("weight"), "never": lambda: F.lit(None).cast("double")})
    got = {r.statistic: r for r in own.collect()}
    assert got["mae"].ci_low == got["mae"].ci_high == 0.5 and not got["mae"].doubtful
    assert got["never"].valid == 0 and got["never"].ci_low is None and got["never"].doubtful


def test_samples_without_spread_or_rows(spark):
    assert convergence.gamma_density(pair_frame(spark, [(1.0, 0.0)] * 4), "a").count() == 0
    assert convergence.gamma_density(pair_frame(spark, []), "a").count() == 0
    parts = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 2.0), (2, 0, None)], "sample_size int, repetition int, v double")
    got = {r.sample_size: r for r in convergence.convergence_of(parts, spark.createDataFrame([(1.0,), (3.0,), (math.nan,)], "v double")).collect()}
    assert (got[1].mean_error, got[1].mean_spread, got[1].wasserstein, got[1].ks) == (0.0, 1.0, 1.0, 0.5) and got[2].wasserstein == 1.0
    assert convergence.convergence_of(parts.limit(0), parts.select("v")).count() == 0


def test_means_of_rounded_values_round_half_up_in_any_order(spark):
    for cells in ([27263] * 6 + [27264] * 6, [1, 2], [3, 8, 2, 5, 9, 0], list(range(100, 112))):
        want = (2 * sum(cells) + len(cells)) // (2 * len(cells)) / 1e6
        rows = [(k, o, n / 1e6) for k in range(50) for o, n in enumerate(random.Random(k).sample(cells, len(cells)))]
        df = spark.createDataFrame(rows, "k int, o int, v double").repartition(1).sortWithinPartitions("k", "o")
        assert {r.m for r in df.groupBy("k").agg(convergence.mean_of_places("v").alias("m")).collect()} == {want}
    odd = {"inf": [math.inf, 0.5], "huge": [1e30, 3e30], "null": [None, 0.25], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in odd.items() for v in vs], "k string, v double")
    assert {r.k: r.m for r in df.groupBy("k").agg(convergence.mean_of_places("v").alias("m")).collect()} == {"inf": math.inf, "huge": 2e30, "null": 0.25, "none": None}


def test_convergence_of_means_between_two_places(spark):
    """Twelve samples of one value each: their distances from the reference have a mean half-way between two places."""
    rows = [(size, i, 1 + (size + i % 2) / 1e6) for size in range(27263, 27303, 3) for i in range(12)]
    parts = spark.createDataFrame(rows, "sample_size int, repetition int, v double")
    got = convergence.convergence_of(parts, spark.createDataFrame([(1.0,)], "v double")).collect()
    assert {r.sample_size: r.wasserstein for r in got} == {size: (size + 1) / 1e6 for size in range(27263, 27303, 3)}


def test_hot_values_keep_their_ranks(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i), float(i % 7)) for i in range(300)], "id int, t double, p double")
    runs = [{r.statistic: r for r in metrics.bootstrap_interval(df, ["id"], "t", "p", 40, hot_rows=h).collect()} for h in (10, 10**9)]
    assert runs[0] == runs[1] and runs[0]["spearman"].valid == 40


def test_archives_and_databases(spark, tmp_path):
    np.savez(tmp_path / "x.npz", a=np.array([[1.0, 2.0], [3.0, 4.0]]), b=np.array([], np.float32))
    got = values(readers.npz_rows(readers.binary_files(spark, str(tmp_path / "x.npz"))), "name", "shape", "values")
    assert got == [("a", [2, 2], [1.0, 2.0, 3.0, 4.0]), ("b", [0], [])]
    df = spark.createDataFrame([("f", "k1", "x", 1), ("f", "k1", "y", 2), ("g", "k2", None, None), ("g", None, "z", 3)], "file string, k string, v string, n int")
    files = writers.sqlite_files(df, "file", "t", "k")
    assert values(readers.sqlite_rows(files, "SELECT k, v, n FROM t", "k string, v string, n int")) == [("k1", "x", 1), ("k2", None, None), (None, "z", 3)]
    assert readers.sqlite_rows(files.limit(0), "SELECT 1", "k int").count() == 0
    (tmp_path / "c.json").write_text('{"a": 1, "b": "x"}\noops\n{"b": "y"}\n')
    assert values(readers.json_table(spark, str(tmp_path / "c.json"), "a int, b string")) == [(1, "x"), (None, "y"), (None, None)]


def test_stores_that_cannot_be_read(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<float>").write.parquet(str(tmp_path / "good.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    (tmp_path / "text.parquet").write_text("no table")
    (tmp_path / "notes.txt").write_text("x")
    assert values(readers.discovered_stores(spark, str(tmp_path))) == [("good", 1, 2, True, True), ("other", None, None, None, False), ("text", None, None, None, False)]


def test_file_formats(spark, tmp_path):
    fasta = ">a first\nACD\nEF\n>b\n\n>c x\nU"
    (tmp_path / "x.fasta").write_text(fasta)
    rows = readers.fasta(spark, str(tmp_path / "x.fasta"))
    assert values(rows, "id", "sequence") == [("a", "ACDEF"), ("b", ""), ("c", "U")]
    assert values(readers.usable_sequences(rows, 4), "id") == [("c",)]
    entry = lambda i, body: f'<entry id="{i}" updated="x">{body}</entry>'
    ref = '<dbReference type="UniProtKB ID" id="N"><property type="UniProtKB accession" value="{}"/></dbReference>'
    xml = "<root>" + entry("C1", ref.format("Q1") + '<dbReference type="UniParc ID" id="UPI1">' + ref.format("Q1")) + entry("C2", "") + "</root>"
    (tmp_path / "x.xml").write_text(xml)
    assert values(readers.xml_entries(spark, str(tmp_path / "x.xml"))) == [("C1", ["UPI1", "Q1"])]
    assert readers.xml_entries(spark, str(tmp_path / "x.xml"), 0).count() == 0 and readers.xml_entries(spark, str(tmp_path / "x.xml"), 1).count() == 1
    atom = "ATOM  {:>5}  CA  ALA A   1      11.111  22.222  33.333  1.00{:>6}           C"
    (tmp_path / "x.pdb").write_text("\n".join([atom.format(2, "80.50"), atom.format(1, "91.50"), atom.format(3, "oops"), atom.format(4, "7.00").replace(" CA ", " CB ")]))
    p = readers.pdb_confidence(spark, str(tmp_path / "x.pdb")).first()
    assert (p.length, p.plddt) == (2, "92,80")
    store = str(tmp_path / "store")
    writers.append_new(spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string"), store, ["id"])
    writers.append_new(spark.createDataFrame([(1, "c"), (2, "d")], "id int, v string"), store, ["id"])
    assert values(spark.read.parquet(store), "id") == [(1,), (2,)]
    (tmp_path / "t.tsv").write_text("query\ttarget\na\tb\n")
    assert values(readers.by_extension(spark, str(tmp_path / "t.tsv"), ["target"])) == [("b",)]
    assert values(readers.cached(spark, str(tmp_path / "t.tsv"), str(tmp_path / "t.parquet"))) == [("a", "b")]
    with pytest.raises(ValueError):
        readers.by_extension(spark, "x.npz")
    with pytest.raises(ValueError, match="nope"):
        readers.require(spark.range(1), "id", "nope")


def test_hit_stream(spark, tmp_path):
    from pairforge.streaming.hits import hit_stream, score_stream

    folder = tmp_path / "in"
    folder.mkdir()
    head = "query\ttarget\tfident\talnlen\tmismatch\tgapopen\tnident\tqcov\ttcov\tevalue\n"
    (folder / "1.tsv").write_text(head + "a\tb\t0.9\t100\t10\t0\t90\t0.9\t0.9\t0.0\na\ta\t1.0\t100\t0\t0\t100\t1\t1\t0\n")
    for _ in range(2):
        score_stream(hit_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        (folder / "2.tsv").write_text(head + "c\td\t0.9\t100\t10\t0\t90\t0.5\t0.9\t0.0\nc\te\t0.9\t100\t10\t0\t90\t0.9\t0.9\t0.0\n")
    assert values(spark.read.parquet(str(tmp_path / "out")), "query", "target") == [("a", "b"), ("c", "e")]
