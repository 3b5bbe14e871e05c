import random

import numpy as np
import pytest

from pairforge.llm.components import connected_components, roots
from pairforge.llm.groupsplit import place, propagate, protein_split, split_groups
from pairforge.session import Scratch

EDGE = "a string, b string, vertex string, root string, group_id int"


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is None and b is None:
            continue
        x, y = find(a if a is not None else b), find(b if b is not None else a)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def groups(spark, edges, **options):
    df = spark.createDataFrame([(a, b, "v", "r", 1) for a, b in edges], EDGE).repartition(5)
    rows = connected_components(df, "a", "b", **options).collect()
    out = {r.vertex: r.group_id for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("task_edges", [1_000_000, 20])
def test_random_graphs_in_one_and_many_rounds(spark, task_edges):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 250)}", f"n{rng.randint(0, 250)}") for _ in range(160)] + [("x", None), (None, "n7"), (None, None), ("s", "s")]
    assert groups(spark, edges, task_edges=task_edges) == brute(edges)


def test_long_chain_and_hot_vertex(spark):
    order = list(range(120))
    random.Random(1).shuffle(order)
    chain = [(f"c{order[i]}", f"c{order[i + 1]}") for i in range(119)]
    star = [("hub", f"s{i}") for i in range(400)] * 2
    edges = chain + star
    assert groups(spark, edges, task_edges=30) == brute(edges)


def test_ordered_chain_ends_in_logarithmic_rounds(spark, monkeypatch):
    """Neighbours lie in different partitions; whichever vertex became the root by its name, nothing would shrink."""
    saved = []
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, f=Scratch.save: saved.append(name) or f(self, df, name))
    n = 100_000
    df = spark.range(n).selectExpr("lpad(id, 9, '0') as a", "lpad(id + 1, 9, '0') as b").repartition(8, "a")
    out = connected_components(df, "a", "b", task_edges=2_000)
    assert [tuple(r) for r in out.groupBy("group_id").count().collect()] == [("0" * 9, n + 1)]
    assert 3 <= saved.count("forest") <= 12


def test_isolated_trees_keep_their_smallest_name(spark):
    edges = [(f"t{i}", f"t{i}-{j}") for i in range(40) for j in range(5)] + [(f"t{i}", f"t{i + 1}") for i in range(0, 20, 2)] + [("z", "a0"), ("z", "y")]
    assert groups(spark, edges, task_edges=3) == brute(edges)


def test_no_edges(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(None, None)]) == {}


def test_roots():
    assert roots(np.array([3, 2, 5]), np.array([2, 1, 5]), 6).tolist() == [0, 1, 1, 1, 4, 5]


@pytest.mark.parametrize("task_rows", [1_000_000, 0])
def test_propagation_in_rounds_and_in_one_task(spark, task_rows):
    rng = random.Random(5)
    rows = [(f"r{rng.randint(0, 90):02}", f"e{rng.randint(0, 60)}") for _ in range(130)] + [(f"r{i:02}", "hot") for i in range(30, 60)]
    want = {k: v for k, v in brute([(r, "~" + e) for r, e in rows]).items() if k[0] == "r"}
    got = propagate(spark.createDataFrame(rows, "record string, entity string"), Scratch(spark, "test"), task_rows)
    got = {r.record: r.group_id for r in got.collect()}
    assert all(got.get(r, r) == g for r, g in want.items())


def test_hot_entities_and_records(spark):
    rng = random.Random(8)
    rows = [(f"r{i:03}", "hot") for i in range(0, 200, 2)] + [("r007", f"e{i}") for i in range(80)] + [(f"r{rng.randint(200, 320)}", f"e{rng.randint(0, 150)}") for _ in range(150)]
    want = {k: v for k, v in brute([(r, "~" + e) for r, e in rows]).items() if k[0] == "r"}
    df = spark.createDataFrame(rows, "record string, entity string")
    for hot in (20, 10**9):
        got = {r.record: r.group_id for r in propagate(df, Scratch(spark, "test"), 0, hot).collect()}
        assert all(got.get(r, r) == g for r, g in want.items())


def test_groups_stay_whole_and_shares_hold(spark):
    records = spark.createDataFrame([(f"r{i:04}", "ab"[i % 2] if i % 7 else None) for i in range(3000)], "record string, label string")
    members = spark.createDataFrame([(f"r{i:04}", f"e{i // 3}") for i in range(2400)] + [(None, "e1"), ("r0001", None)], "record string, entity string")
    done = split_groups(records, members, {"train": 8, "val": 1, "test": 1}).toPandas()
    assert len(done) == 3000 and done.groupby("group_id").split.nunique().max() == 1
    assert done.split.value_counts(normalize=True)["train"] == pytest.approx(0.8, abs=0.02)
    a = done[done.record.map(lambda r: int(r[1:]) % 2 == 1)]
    assert a.split.value_counts(normalize=True)["val"] == pytest.approx(0.1, abs=0.02)


def test_rare_labels_are_balanced_together(spark):
    # 64 labels of two records have columns of their own, 1,000 labels of one share one.
    labels = [f"m{i % 64:02}" for i in range(128)] + [f"r{i:03}" for i in range(1000)]
    records = spark.createDataFrame([(f"r{i:04}", x) for i, x in enumerate(labels)], "record string, label string")
    members = spark.createDataFrame([(f"r{i:04}", f"e{i // 2}") for i in range(128, 1128)], "record string, entity string")
    done = split_groups(records, members, {"train": 8, "val": 1, "test": 1}).toPandas()
    assert len(done) == 1128 and done.groupby("group_id").split.nunique().max() == 1
    rare = done[done.record >= "r0128"].split.value_counts(normalize=True)
    # Groups of two are placed before the rest and towards the shares of all records too, hence the margin.
    assert [rare.get(s, 0) for s in ("train", "val", "test")] == pytest.approx([0.8, 0.1, 0.1], abs=0.04)


def test_placement_minimises_deviation():
    out = place(np.array([[60.0, 0], [0, 60], [20, 0], [0, 20], [20, 0], [0, 20]]), [0.6, 0.2, 0.2])
    sums = {s: sum(np.array([[60.0, 0], [0, 60], [20, 0], [0, 20], [20, 0], [0, 20]])[out == s]) for s in range(3)}
    assert [sums[s].tolist() for s in range(3)] == [[60, 60], [20, 20], [20, 20]]


def test_proteins_of_clusters_and_pairs(spark):
    p = [f"{c}1BCDEFG" for c in "ABCDEFGH"]
    pairs = spark.createDataFrame([(p[0], p[1], "x"), (p[1].lower(), " ", "x"), (None, p[5], "x"), (p[6], p[6], "x")], "query string, target string, split string")
    clusters = spark.createDataFrame([(1, p[1], 0), (1, "sp|" + p[2] + "|X_Y", 0), (2, p[3], 0), (None, p[4], 0), (2, None, 0)], "cluster_id bigint, member string, cluster_size bigint")
    got = {r.protein: (r.group_id, r.split) for r in protein_split(pairs, clusters, {"train": 1, "test": 1}).collect()}
    assert {k: g for k, (g, _) in got.items()} == {p[0]: p[0], p[1]: p[0], p[2]: p[0], p[3]: p[3], p[4]: p[4], p[5]: p[5], p[6]: p[6]}
    assert protein_split(pairs.limit(0), clusters.limit(0), {"train": 1}).count() == 0
