import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pairforge.operators.table_diff import similarity_copy_diff, table_diff

PAIRS = "query string, target string, fident double, hfsp double, alntmscore double, split string, loaded_at timestamp"
A, B, C = "A1BCDEFG", "B2BCDEFG", "C3BCDEFG-2"


def at(day):
    import datetime

    return None if day is None else datetime.datetime(2024, 1, day)


def found(spark, original, copy):
    rows = similarity_copy_diff(*(spark.createDataFrame([(*r[:6], at(r[6])) for r in x], PAIRS) for x in (original, copy)))
    return sorted((r.protein_a, r.protein_b, r.split, r.finding) for r in rows.collect())


def test_notations_directions_and_missing_ends(spark):
    original = [(A, B, 0.5, 1.0, 0.7, "train", 1), (None, B, 0.1, 1.0, 0.7, "train", 1), ("  ", B, 0.1, 1.0, 0.7, "train", 1)]
    copy = [("UniProtKB:" + B + ".2", "AF-" + A + "-F1-model_v4.pdb.gz", 0.5, 1.0, 0.7, "train", 1)]
    assert found(spark, original, copy) == []


def test_latest_row_alone_counts(spark):
    original = [(A, B, 0.9, None, None, "val", 1), (B, A, 0.5, None, None, "val", 2), (A, B, 0.7, None, None, "val", None)]
    copy = [("sp|" + A + "|X_Y", B.lower() + "\n", 0.5, math.nan, None, "val", 1)]
    assert found(spark, original, copy) == []


def test_each_finding(spark):
    original = [(A, B, 0.5, None, 1.0, "train", 1), (A, C, 0.5, 1.0, 1.0, "train", 1), (A, A, 0.5, 1.0, 1.0, "test", 1)]
    copy = [(A, B, 0.5002, 3.0, math.nan, "train", 1), (A, C, 0.50004, 1.0, 1.0, "val", 1), (A, A, 0.50004, 1.0, 1.0, "test", 1)]
    assert found(spark, original, copy) == sorted([
        (A, B, "train", "fident"), (A, B, "train", "hfsp"), (A, B, "train", "alntmscore"), (A, C, "train", "missing_in_copy"), (A, C, "val", "missing_in_original"),
    ])


def test_empty_tables(spark):
    row = [(A, B, 0.5, None, 1.0, "train", 1)]
    assert found(spark, [], []) == []
    assert found(spark, row, []) == [(A, B, "train", "missing_in_copy")]
    assert found(spark, [], row) == [(A, B, "train", "missing_in_original")]


def test_null_keys_text_fields_and_clashing_columns(spark):
    schema = "k string, v string, n int, ver int, finding string, _bucket int, original_value string"
    a = spark.createDataFrame([(None, "x", 1, 1, "f", 1, "o"), ("b", None, 2, 1, "f", 1, "o"), ("c", "s", 3, 1, "f", 1, "o")], schema)
    b = spark.createDataFrame([(None, "y", 1, 1, "f", 1, "o"), ("b", "z", 2, 1, "f", 1, "o"), ("c", "s", 4, 1, "f", 1, "o")], schema)
    got = sorted((str(r.k), r.finding, r.original_value, r.copy_value) for r in table_diff(a, b, ["k"], ["v", "n"], "ver").collect())
    assert got == [("None", "v", "x", "y"), ("b", "v", None, "z"), ("c", "n", "3", "4")]


def test_one_hot_key_in_many_buckets(spark):
    a = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as k", "cast(id as double) as v", "id as ver")
    b = a.selectExpr("k", "case when k = 'hot' then v + 1 else v end as v", "ver")
    got = table_diff(a, b, ["k"], ["v"], "ver", rows_per_bucket=1000).collect()
    assert [(r.k, r.finding) for r in got] == [("hot", "v")]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 2)), max_size=12), st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 2)), max_size=12))
def test_against_brute_force(spark, x, y):
    def newest(rows):
        out = {}
        for k, v, t in rows:
            if k not in out or (t, v is not None, v or 0) > out[k][0]:
                out[k] = ((t, v is not None, v or 0), v)
        return {k: v for k, (_, v) in out.items()}

    p, q = newest(x), newest(y)
    want = sorted([(k, "missing_in_copy") for k in p.keys() - q.keys()] + [(k, "missing_in_original") for k in q.keys() - p.keys()] + [(k, "v") for k in p.keys() & q.keys() if p[k] != q[k]])
    dfs = [spark.createDataFrame(r, "k int, v int, t int") for r in (x, y)]
    assert sorted((r.k, r.finding) for r in table_diff(*dfs, ["k"], ["v"], "t", rows_per_bucket=4).collect()) == want


def test_nan_and_large_whole_numbers(spark):
    nan = math.nan
    a = [("a", nan, 2**53), ("b", nan, -(2**63)), ("c", 0.0, 5), ("d", None, None), ("e", math.inf, 7)]
    b = [("a", 0.0, 2**53 + 1), ("b", nan, 2**63 - 1), ("c", nan, 6), ("d", nan, 1), ("e", math.inf, 7)]
    dfs = [spark.createDataFrame([(*r, 1) for r in x], "k string, v double, n bigint, t int") for x in (a, b)]
    got = sorted((r.k, r.finding) for r in table_diff(*dfs, ["k"], ["v", "n"], "t").collect())
    assert got == [("a", "n"), ("a", "v"), ("b", "n"), ("c", "n"), ("c", "v"), ("d", "n"), ("d", "v")]
    near = sorted((r.k, r.finding) for r in table_diff(*dfs, ["k"], ["n"], "t", {"n": 1}).collect())
    assert near == [("b", "n"), ("d", "n")]


def test_lists_and_times_as_fields(spark):
    rows = [[("a", [1, 2], at(1)), ("b", None, at(2)), ("c", [3], None)], [("a", [1, 3], at(1)), ("b", [1], at(3)), ("c", [3], None)]]
    dfs = [spark.createDataFrame([(*r, 1) for r in x], "k string, v array<int>, s timestamp, t int") for x in rows]
    got = sorted((r.k, r.finding, r.original_value) for r in table_diff(*dfs, ["k"], ["v", "s"], "t").collect())
    assert [g[:2] for g in got] == [("a", "v"), ("b", "s"), ("b", "v")] and got[0][2] == "[1, 2]" and got[2][2] is None
