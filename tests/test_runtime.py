import os
from types import SimpleNamespace

import pytest

from bibflow import runtime


def test_shuffle_partitions():
    assert runtime.shuffle_partitions(1, 8) == 8
    assert runtime.shuffle_partitions(1 << 40, 8) == 4096
    assert runtime.shuffle_partitions(100 << 40, 4000) == 200_000


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    folder = runtime.shared_folder(spark)
    set_by_session = spark.conf.get("spark.checkpoint.dir", None)
    assert set_by_session is None or folder == set_by_session.rstrip("/")
    df = runtime.materialise(spark.range(10), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    assert path.startswith(folder.removeprefix("file:")) and os.path.exists(path)
    assert sorted(r["id"] for r in df.collect()) == list(range(10))


def test_only_small_inputs_are_spread(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert runtime.spread_small(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert runtime.spread_small(spark.range(3)).rdd.getNumPartitions() == spark.range(3).rdd.getNumPartitions()


def test_a_cluster_must_name_its_shared_folder():
    def fake(master, setting=None, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: setting), sparkContext=context)

    assert runtime.shared_folder(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert runtime.shared_folder(fake("yarn", None, "hdfs:///set/here")) == "hdfs:///set/here"
    assert os.path.isdir(runtime.shared_folder(fake("local[2]")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(fake("yarn"))
