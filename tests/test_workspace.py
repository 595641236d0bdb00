from types import SimpleNamespace

import pytest

from quillgate.workspace import clear_workspace, fresh_dir, materialize, shared_root


def _session(master, root=None):
    conf = SimpleNamespace(get=lambda name, default=None: root or default, set=lambda name, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, setCheckpointDir=lambda path: None))


def test_a_cluster_needs_a_shared_folder():
    assert shared_root(_session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_root(_session("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_root(_session(master))


def test_what_is_written_is_cleared(spark):
    df = materialize(spark.range(5), "numbers")
    assert df.count() == 5 and fresh_dir(spark, "a") != fresh_dir(spark, "a")
    assert clear_workspace(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
