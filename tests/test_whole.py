import duckdb
import numpy as np
import pytest

from pairforge.operators import learn
from pairforge.operators.convergence import all_distances
from pairforge.plans import catalogue

from .oracle import FOLDER, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Ids far beyond 200, and rows of suppliers divisible by 5."""
    at = tmp_path_factory.mktemp("whole")
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT CAST(i AS BIGINT) AS l_orderkey, CAST(i * 37 % 450 AS BIGINT) AS l_partkey, CAST(i * 11 % 60 AS BIGINT) AS l_suppkey, CAST(i % 7 + 1 AS INT) AS l_linenumber,
     CAST(i % 50 + 1 AS DOUBLE) AS l_quantity, 1000.0::DOUBLE + i AS l_extendedprice, 0.01::DOUBLE AS l_tax, 0.02::DOUBLE AS l_discount, ['A', 'N', 'R'][i % 3 + 1] AS l_returnflag FROM range(900) t(i)""")
    con.execute("CREATE TABLE embeddings AS SELECT CAST(i AS BIGINT) AS vec_id, CAST(list_transform(range(64), lambda k: sin(i * 64 + k)) AS FLOAT[]) AS embedding FROM range(420) t(i)")
    for t in ("lineitem", "embeddings"):
        con.execute(f"COPY {t} TO '{at}/{t}.parquet' (FORMAT parquet)")
    return str(at), con


def test_distances_of_all_rows_against_brute_force(spark, folder):
    path, con = folder
    vectors = {f"P{i}": np.array(v, np.float64) for i, v in con.execute("SELECT * FROM embeddings").fetchall()}
    pairs = {(f"P{p}", f"P{s * 7 + n}") for p, s, n in con.execute("SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')").fetchall()}
    want = {}
    for q, t in pairs:
        for k, name in enumerate(["m1", "m2", "m3", "m4"]):
            gone = q not in vectors or t not in vectors or name == "m2" and (q.endswith("0") or t.endswith("0"))
            want[q, t, name] = None if gone else float(np.linalg.norm(vectors[q][16 * k : 16 * k + 16] - vectors[t][16 * k : 16 * k + 16]))
    rows = QUERIES["embedding_distance_whole"](spark, path).collect()
    got = {(r.query, r.target, r.embedding_name): r.distance for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(g is None if (w := want[k]) is None else abs(g - w) <= 5.1e-5 for k, g in got.items())
    assert any(int(q[1:]) >= 200 and int(t[1:]) >= 200 and d is not None for (q, t, _), d in got.items())


def test_no_row_or_vector_is_dropped(spark):
    con = connect(FOLDER)
    for name, flags in (("hfsp_score_whole", "'A', 'R'"), ("minmax_normalize_whole", "'A', 'N'")):
        want = con.execute(f"SELECT count(DISTINCT (l_partkey, l_suppkey * 7 + l_linenumber)) FROM lineitem WHERE l_returnflag IN ({flags})").fetchone()[0]
        assert QUERIES[name](spark, FOLDER).count() == want
    n = con.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    assert {r.embedding_name: r.n_vectors for r in QUERIES["store_info_whole"](spark, FOLDER).collect()}["m1"] == n


def test_sql_of_whole_queries_has_no_cut():
    assert not [k for k, s in SQL.items() if k.endswith("_whole") and any(x in s for x in ("% 200", "< 200", "l_suppkey % 5"))]


def test_all_pairs_of_all_vectors(spark, folder):
    path, con = folder
    v = np.array([r[0] for r in con.execute("SELECT embedding FROM embeddings ORDER BY vec_id").fetchall()], np.float64)
    rows = QUERIES["all_pair_distances_whole"](spark, path).collect()
    got = {(r.i, r.j): r.distance for r in rows}
    assert len(rows) == len(got) == 420 * 419 // 2
    assert all(abs(d - np.linalg.norm(v[i] - v[j])) <= 1e-6 for (i, j), d in got.items())


def test_all_pairs_of_small_blocks(spark):
    for n in (0, 1, 2, 7, 9):
        df = spark.createDataFrame([(3 * i, [float(i), 0.0]) for i in range(n)], "vec_id bigint, embedding array<double>")
        got = sorted((r.i, r.j, r.distance) for r in all_distances(df, "vec_id", "embedding", block=3).collect())
        assert got == [(i, j, float(j - i)) for i in range(n) for j in range(i + 1, n)]


def test_keep_list_is_every_cluster_member(spark, tmp_path):
    names = [f"A{i:07d}" for i in range(300)]
    con = duckdb.connect()
    con.execute("CREATE TABLE m AS SELECT unnest(?) AS member", [[*names[:250], names[0], None, f"sp|{names[250]}|X"]])
    con.execute("CREATE TABLE p AS SELECT unnest(range(303)) AS pair_id, unnest(?) AS query, unnest(?) AS target", [[*names, None, "", names[0]], [*names[::-1], names[0], names[0], names[0]]])
    con.execute(f"COPY m TO '{tmp_path}/cluster_members.parquet' (FORMAT parquet)")
    con.execute(f"COPY p TO '{tmp_path}/merged_protein_similarity.parquet' (FORMAT parquet)")
    got = sorted((r.pair_id, r.query, r.target) for r in QUERIES["keep_ids_whole"](spark, str(tmp_path)).collect())
    assert got == [*((i, names[i], names[299 - i]) for i in range(49, 251)), (302, names[0], names[0])]


def test_network_trains_to_its_stop(spark, monkeypatch):
    seen = []

    def train(*args, **options):
        seen.append(train_network(*args, **options))
        return seen[-1]

    train_network = learn.train_network
    monkeypatch.setattr(learn, "train_network", train)
    QUERIES["fnn_fit"](spark, FOLDER)
    losses = seen[0][1]
    assert len(losses) == 60 or len(losses) > 5 and min(losses[-5:]) >= min(losses[:-5]) - 1e-6
