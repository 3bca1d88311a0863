from docengine.llm import common
from pyspark.sql import functions as F


def test_attach_by_broadcast_and_by_salt(spark):
    big = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}") for i in range(200)], "i int, k string")
    small = spark.createDataFrame([(None, 0), ("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    want = sorted(map(tuple, common.attach(big, small, "k").collect()), key=repr)
    assert want == sorted(map(tuple, common.attach(big, small, "k", most=1, salts=4).collect()), key=repr)
    assert len(want) == 200 and (0, None, 0) in want and (9, "k4", None) in want


def test_ascii_lower_and_words(spark):
    got = spark.createDataFrame([("ÀB c\x0bD",), ("AB",), ("",), (None,)], "t string").select(common.ascii_lower(F.col("t")).alias("l"), common.n_words(F.col("t")).alias("n")).collect()
    assert [(r.l, r.n) for r in got] == [("Àb c\x0bd", 3), ("ab", 1), ("", 0), (None, 0)]


def test_written_tables_outlive_their_source(spark):
    t = common.written(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert t.count() == 5 and t.columns == ["id", "x"]
    common.drop_written(t)
