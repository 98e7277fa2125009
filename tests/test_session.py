"""Session settings the operators rely on."""

import pytest
from pyspark.sql import functions as F

from cohortry import session as S


@pytest.mark.parametrize(("given", "left"), [("10m", 262144), ("64k", 65536), ("-1", -1), ("10485760b", 262144)])
def test_planner_broadcasts_are_lowered_never_raised(spark, given, left):
    before = spark.conf.get(S.BROADCAST_KEY)
    try:
        spark.conf.set(S.BROADCAST_KEY, given)
        S.tune(spark)
        assert S._bytes(spark.conf.get(S.BROADCAST_KEY)) == left
    finally:
        spark.conf.set(S.BROADCAST_KEY, before)


def test_a_table_of_many_ids_is_not_sent_to_the_driver(spark):
    """50,000 ids, a megabyte as the planner sees it, are shuffled; a few rows are still broadcast."""
    before = spark.conf.get(S.BROADCAST_KEY)
    try:
        spark.conf.set(S.BROADCAST_KEY, "10m")
        S.tune(spark)
        rows, ids = spark.range(200_000), spark.range(50_000).withColumn("x", F.col("id") + 1)
        joined, small = rows.join(ids, "id"), rows.join(spark.range(10), "id")
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50_000
    finally:
        spark.conf.set(S.BROADCAST_KEY, before)
