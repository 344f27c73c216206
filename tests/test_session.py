import os
import threading
from types import SimpleNamespace

import pytest

from gridloom import session


def test_tables_are_dropped(spark):
    df, path = session.written(spark.range(5), "five")
    other: list[str] = []
    t = threading.Thread(target=lambda: other.append(session.written(spark.range(2), "two")[1]))
    t.start()
    t.join()
    assert df.count() == 5 and path in session.tables_written() and other[0] not in session.tables_written()
    _, more = session.written(spark.range(3), "three")
    session.drop_written(spark, [p for p in session.tables_written() if p != more])
    assert os.path.isdir(path.removeprefix("file:")) and not os.path.isdir(more.removeprefix("file:")) and os.path.isdir(other[0].removeprefix("file:"))
    session.drop(spark, path, other[0])
    assert path not in session.tables_written() and not os.path.isdir(path.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    cluster = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]", setCheckpointDir=print))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)
    cluster.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert session.shared_dir(cluster) == "hdfs://x/y"
