import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.bounded import broadcast_if_bounded, is_bounded, lookup_join, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}" if i % 11 else None, i % 5) for i in range(600)], "id int, k string, v int")
    small = spark.createDataFrame([("hot", 2), ("k1", 3), ("k2", 1), ("k2", 4), ("none", 0), (None, 1)], "k string, w int")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_and_broadcast_joins_are_the_plain_join(sides, how):
    big, small = sides
    want = sorted(map(str, big.join(small, "k", how).collect()))
    assert sorted(map(str, salted_join(big, small, ["k"], how, ["id"]).collect())) == want
    assert sorted(map(str, salted_join(big, small, ["k"], how).collect())) == want
    assert sorted(map(str, lookup_join(big, small, ["k"], how).collect())) == want
    assert sorted(map(str, lookup_join(big, small, ["k"], how, max_rows=2).collect())) == want


def test_further_condition(sides):
    big, small = sides
    want = sorted(r.id for r in big.join(small.withColumnRenamed("k", "x"), (F.col("k") == F.col("x")) & (F.col("v") < F.col("w")), "left_anti").collect())
    assert sorted(r.id for r in salted_join(big, small, ["k"], "left_anti", ["id"], F.col("v") < F.col("w")).collect()) == want


def test_a_hot_key_is_spread(sides):
    big, small = sides
    parts = salted_join(big.where("k = 'hot'"), small.hint("merge"), ["k"], "inner", ["id"]).select(F.spark_partition_id().alias("p"), "id")
    plan = parts._jdf.queryExecution().toString()
    assert "__salt" in plan and parts.count() == 200


def test_bounds(spark):
    df = spark.range(10)
    assert is_bounded(df, 10) and not is_bounded(df, 9)
    assert "broadcast" in broadcast_if_bounded(df, 10)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_if_bounded(df, 9)._jdf.queryExecution().toString().lower()


def test_written_tables_can_be_cleared(spark):
    import os

    from ledgerloom import session

    df = session.written(spark.range(5).withColumn("x", F.lit(None).cast("string")), "test")
    path = session._written[-1]
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    assert session.clear_written(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from ledgerloom.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_bytes_are_bounded_too(spark):
    df = spark.range(3).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y")).alias("a"), F.struct(F.lit(1).alias("z")).alias("s"))
    assert is_bounded(df, 3, 4000) and not is_bounded(df, 3, 3000) and is_bounded(df.limit(0), 0, 0)
