import types

import pytest

from pairforge.session import Scratch, scratch_root


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(cluster)
    local = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="local[2]"))
    assert scratch_root(local).startswith("file:")
    named = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: "hdfs://x/y/"), sparkContext=cluster.sparkContext)
    assert scratch_root(named) == "hdfs://x/y"


def test_scratch_tables_go_when_dropped(spark):
    work = Scratch(spark, "test")
    one, two = work.save(spark.range(3), "a"), work.save(spark.range(4), "b")
    assert two.count() == 4
    fs, base = work._at(work.base)
    work.drop(one)
    assert fs.exists(work._at(two._scratch_path)[1]) and not fs.exists(work._at(one._scratch_path)[1])
    work.drop_all()
    assert not fs.exists(base)
