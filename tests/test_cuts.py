import os
from types import SimpleNamespace

import pytest

from seamline import cuts


def test_cut_and_drop(spark):
    df = spark.range(5).selectExpr("id", "id % 2 = 0 AS even")
    kept = cuts.cut(df, "t")
    assert kept.columns == df.columns and kept.dtypes == df.dtypes and kept.count() == 5
    assert cuts.cut(df.limit(0), "empty").count() == 0


def test_folder_follows_the_session(spark):
    assert cuts.shared_folder(spark).startswith("file://") or spark.conf.get("spark.checkpoint.dir", None)


def test_drop_removes_own_files_only(spark, tmp_path):
    df = cuts.cut(spark.range(3).toDF("id"), "gone")
    other = tmp_path / "other"
    spark.range(2).write.parquet(str(other))
    files = df.inputFiles()
    cuts.drop_cuts(spark)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files) and spark.read.parquet(str(other)).count() == 2


def test_no_machine_local_folder_on_a_cluster():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,4,6144]"):
        with pytest.raises(cuts.NoSharedFolder):
            cuts.shared_folder(session(master))
        assert cuts.shared_folder(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert cuts.shared_folder(session("local[8]")).startswith("file://")


def test_dropped_when_done(spark):
    with cuts.dropped(spark):
        files = cuts.cut(spark.range(3).toDF("id"), "short").inputFiles()
        assert all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
