import pytest
from pyspark.sql import functions as F

from lumenq.util import broadcast_if_small, distinct_projection, materialize, shared_dir, spread


def test_distinct_projection(spark):
    rows = [("hot", i % 7, None if i % 3 else "x", float("nan")) for i in range(200)] + [(f"k{i}", i, "y", 1.0) for i in range(50)]
    rows += [(None, 1, "y", 1.0), (None, 1, None, 1.0), ("z", None, "1", 1.0), ("z", None, None, 1.0)]
    df = spark.createDataFrame(rows * 2, "a string, b int, c string, d double")
    got = distinct_projection(df, ["a", "b"], ["a"]).groupBy("a", "b").count()
    want = df.dropDuplicates().groupBy("a", "b").count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert distinct_projection(df.limit(0), ["a", "b"], ["a"]).count() == 0


def test_helpers(spark):
    df = spark.range(10)
    assert materialize(df, "t").count() == 10 and shared_dir(spark)
    small = broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString()
    large = broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()
    assert spread(df.coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert spread(df.groupBy("id").agg(F.count("*"))).count() == 10


def test_shared_folder_off_local_masters():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d: d)}))
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Context.getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k, d: "hdfs://n/x/")}))
    assert shared_dir(Session) == "hdfs://n/x"
