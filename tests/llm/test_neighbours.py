import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.llm.neighbours import RECALL, buckets, codes, file_neighbours, functions_per_table, mutual, nearest, plan, probe_sets

SCHEMA = "vec_id bigint, embedding_file string, embedding array<float>, id int, a int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, f, None if v is None else [float(x) for x in v], 1, 2, 3) for i, f, v in rows], SCHEMA)


def brute(rows, k, least):
    x = {i: np.asarray(v, np.float32).astype(np.float64) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    out = {}
    for i in unit:
        near = sorted(((-round(float(unit[i] @ unit[j]), 9), j) for j in unit if j != i))
        out[i] = [j for s, j in near if -s >= least][:k]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def clustered(n, dim, seed, size=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // size, dim))
    v = np.repeat(base, size, 0) + 0.12 * rng.normal(size=(n // size * size, dim))
    return v * rng.uniform(0.1, 20, (len(v), 1))


def test_recall_against_brute_force(spark):
    v = clustered(2400, 24, 0)
    rows = [(i, "f", x) for i, x in enumerate(v)]
    want = brute([(i, x) for i, _, x in rows], 10, 0.9)
    got = lists(nearest(frame(spark, rows), "vec_id", F.col("embedding_file"), "embedding", 10, 0.9))
    pairs = {(i, j) for i, js in want.items() for j in js}
    found = {(i, j) for i, js in got.items() for j in js}
    assert len(pairs) > 3000 and len(found & pairs) / len(pairs) >= 0.98 and len(found - pairs) <= 0.02 * len(pairs)


def test_full_buckets_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=12) + 0.05 * rng.normal(size=(150, 12)), clustered(300, 12, 3)])
    rows = [(i, "f", x) for i, x in enumerate(v)]
    args = ("vec_id", F.col("embedding_file"), "embedding", 10, 0.9)
    assert lists(nearest(frame(spark, rows), *args, block_rows=20)) == lists(nearest(frame(spark, rows), *args))


def test_copies_share_one_list(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, "f", v) for i in range(40, 0, -1)] + [(100, "f", [1.0, 2.0, 3.01]), (101, "g", v)]
    got = lists(nearest(frame(spark, rows), "vec_id", F.col("embedding_file"), "embedding", 3, 0.9))
    assert got == brute([(i, x) for i, f, x in rows if f == "f"], 3, 0.9)


def test_unusable_vectors_paths_and_empty(spark):
    good, near = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    rows = [
        (1, "d/a.h5", good), (2, "./d//a.h5", near), (3, "d/x/../a.h5", [0.0, 0.0, 0.0]), (4, "d/a.h5", None), (5, "d/a.h5", []), (6, "d/a.h5", [1.0, 0.0]),
        (7, "d/a.h5", [float("nan"), 1.0, 1.0]), (8, "d/a.h5", [float("inf"), 1.0, 1.0]), (9, "e/a.h5", good), (10, None, good), (11, "d/a.h5", [-1.0, 0.0, -0.5]),
    ]
    df = frame(spark, rows)
    assert [(r.a, r.b) for r in mutual(file_neighbours(df)).collect()] == [(1, 2)]
    assert file_neighbours(df.limit(0)).count() == 0


def test_codes_bound_their_error():
    x = np.random.default_rng(0).normal(size=(50, 30))
    unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    code, step, error = codes(unit)
    back = code * step[:, None]
    slack = error[:, None] + error + error[:, None] * error
    assert (np.abs(back @ back.T - unit @ unit.T) <= slack).all()


def test_probe_order_and_sizes():
    sets = probe_sets(4, 12)
    assert sets[0] == (0,) and len(set(sets)) == 12 and all(len({min(j, 7 - j) for j in s}) == len(s) for s in sets)
    assert functions_per_table(10) == 2 and functions_per_table(10**9) > functions_per_table(10**5) > 2
    assert pytest.approx(21, abs=1) == functions_per_table(10**9)


@pytest.mark.parametrize("rows", [1_500, 15_000, 5_000_000, 10**8, 10**9])
def test_plan_keeps_recall_at_every_size(rows):
    """Pairs at the least similarity, hashed with the package's own buckets."""
    k = functions_per_table(rows)
    probes, tables = plan(k, 0.9, RECALL)
    rng = np.random.default_rng(rows)
    a, b = rng.normal(size=(2, 600, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    file, met = np.zeros(600, np.int64), np.zeros(600, bool)
    for t in range(tables):
        x, y = (buckets(v.astype(np.float32), file, t, k, probes) for v in (a, b))
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
    assert met.mean() >= 0.98


def test_files_of_very_different_sizes(spark):
    big, small = clustered(1600, 16, 7), clustered(40, 16, 8)
    rows = [(i, "big", v) for i, v in enumerate(big)] + [(5000 + i, "small", v) for i, v in enumerate(small)]
    got = lists(nearest(frame(spark, rows), "vec_id", F.col("embedding_file"), "embedding", 10, 0.9))
    want = brute([(i, v) for i, f, v in rows if f == "small"], 10, 0.9)
    assert {i: js for i, js in got.items() if i >= 5000} == {i: js for i, js in want.items() if js}


def test_search_in_many_lanes(spark):
    from pairforge.llm.neighbours import search

    v = np.round(np.random.default_rng(11).normal(size=(260, 4)), 1) + 0.05
    rows = [(i, "f", x) for i, x in enumerate(v)]
    got = lists(search(frame(spark, rows), "vec_id", F.col("embedding_file"), "embedding", F.col("id") % 3 == 0, 5, lane_values=120))
    assert got == {i: js for i, js in brute([(i, x) for i, _, x in rows], 5, -1.0).items() if i % 3 == 0}


def test_search_is_exact_at_any_similarity(spark):
    from pairforge.llm.neighbours import search

    v = np.concatenate([clustered(200, 8, 5, 20), np.random.default_rng(6).normal(size=(100, 8))])
    rows = [(i, "f", x) for i, x in enumerate(v)] + [(i, "f", v[0]) for i in range(400, 405)] + [(500, "g", v[0]), (501, "g", [0.0] * 8)]
    got = lists(search(frame(spark, rows), "vec_id", F.col("embedding_file"), "embedding", F.col("id") % 5 == 0, 6))
    want = {i: js for i, js in brute([(i, x) for i, f, x in rows if f == "f"], 6, -1.0).items() if i % 5 == 0}
    assert got == want
