"""Rows of a fit are dealt over tasks by their number, not by the files they stand in."""

from pyspark.sql import functions as F

from colsense.operators import ml
from colsense.plans import learning


def test_parts_of_one_small_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ml, "ROWS_OF_A_TASK", 100)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    copies = part.crossJoin(spark.range(10).toDF("k")).withColumn("p_partkey", F.col("p_partkey") * 10 + F.col("k")).drop("k")
    copies.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = learning.words(spark, str(tmp_path))
    n = copies.count()
    assert rows.rdd.getNumPartitions() == max(4, -(-n // 100)) > 4
    assert rows.count() == n
    assert ml.spread(rows.limit(0), "id").count() == 0


def test_triggers_by_the_number_of_events(spark, monkeypatch):
    """Events are dealt over as many tasks as their number asks for, whatever the session's setting."""
    from colsense.plans import movement
    from colsense.streaming import events as X

    monkeypatch.setattr(X, "ROWS_OF_A_TASK", 100, raising=False)
    d = "/root/testdata/sf0.001"
    n = -(-movement.read(spark, d, "events").count() // 100)
    out = movement.x02c(spark, d)
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
