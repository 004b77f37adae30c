from types import SimpleNamespace

import pytest

from rows import table
from salesflow import session


def stub(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default),
                           sparkContext=SimpleNamespace(master=master))


def test_the_folder_of_the_cluster_is_used():
    assert session.shared_dir(stub("spark://host", "hdfs://shared")) == "hdfs://shared"


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("spark://host", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(stub(master))


def test_a_local_session_gets_one_folder_of_its_own():
    assert session.shared_dir(stub("local[2]")) == session.shared_dir(stub("local[4]"))


def test_written_intermediates_read_back(spark):
    rows = spark.range(5).selectExpr("id", "cast(null as string) as s", "array(id) as a")
    back = session.materialize(rows, "t")
    assert table(back) == table(rows) and back.schema.simpleString() == rows.schema.simpleString()


def test_written_intermediates_can_be_removed(spark):
    kept, gone = (session.materialize(spark.range(3), "t") for _ in range(2))
    session.discard(gone, spark.range(1))
    assert kept.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone.scratch_path)
