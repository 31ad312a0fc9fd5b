"""Where written tables go: the cluster's folder first, a local one only locally."""

import pytest

from treatlens import session as S


class Context:
    def __init__(self, master, current=None):
        self.master, self.current = master, current

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = f"{path}/run"


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Session:
    def __init__(self, master, named=None, current=None):
        self.sparkContext, self.conf = Context(master, current), Conf(named)


def test_named_folder_is_used():
    assert S._shared_folder(Session("yarn", "hdfs:///shared")) == "hdfs:///shared/run"
    assert S._shared_folder(Session("yarn", "hdfs:///shared", "hdfs:///set/1")) == "hdfs:///set/1"


def test_a_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S._shared_folder(Session("spark://host:7077"))
    assert S._shared_folder(Session("local[2]")).startswith("/tmp/spark-")


def test_broadcast_only_after_a_count(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(S.broadcast_if_small(spark.range(10), 10)).lower()
    assert "broadcast" not in plan(S.broadcast_if_small(spark.range(11), 10)).lower()


def test_cut_tables_keep_schema_and_rows(spark):
    df = spark.range(5).selectExpr("id", "array(id, id + 1) as a", "cast(null as double) as x")
    again = S.cut_lineage(df)
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())
    assert S.cut_lineage(df.where("id > 9")).count() == 0
