"""Where staged data goes."""

import os

import pytest

from tideframe import session


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(master, None)
        assert session.shared_folder(master, "hdfs:///shared") == "hdfs:///shared"


def test_local_folder_exists_and_staged_data_goes(spark):
    assert os.path.isdir(session.shared_folder("local[4]", None))
    df = session.staged(spark.range(10))
    assert df.count() == 10
    path = session.STAGED[-1][1].removeprefix("file:")
    assert os.path.isdir(path)
    session.drop_staged()
    assert not os.path.exists(path) and not session.STAGED
