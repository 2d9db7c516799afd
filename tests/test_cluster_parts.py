"""The rows of one clustering task are bounded."""

from pyspark.sql import functions as F

from tidebook.operators import models


def test_large_partitions_are_split(spark):
    rows = spark.range(0, 1000, 1, 1)
    parts = models.in_parts(rows, 100)
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert parts.rdd.getNumPartitions() == 10 and sum(sizes) == 1000 and max(sizes) <= 110
    assert models.in_parts(rows, 1000) is rows and models.in_parts(rows.limit(0), 10).count() == 0


def test_clusters_read_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(models, "CLUSTER_ROWS", 20)
    made = []
    inner = models.in_parts
    monkeypatch.setattr(models, "in_parts", lambda df, rows: made.append(inner(df, rows)) or made[-1])
    factors = spark.range(600).select(*[(F.col("id") % 6 * 1000 + F.col("id") % (7 + i)).cast("double").alias(c) for i, c in enumerate(models.FACTORS)])
    found = models.misplaced(models.order_clusters(factors)).first()
    assert found["rows"] == 600 and found["misplaced"] == 0
    assert made[0].rdd.getNumPartitions() == -(-made[0].count() // 20)
