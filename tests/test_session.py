"""Written rounds do not send tables through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.session import materialise


def test_a_written_join_is_not_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    left = materialise(spark.range(20000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("a")), "left")
    right = materialise(spark.range(0, 20000, 2).select(F.col("id").cast("string").alias("k"), F.lit(2).alias("b")), "right")
    assert materialise(left.join(right, "k"), "joined").count() == 10000
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    joined = [p for p in plans if "SortMergeJoin" in p or "BroadcastHashJoin" in p][-1]
    assert "BroadcastHashJoin" not in joined
    assert [spark.conf.get(n, None) for n in names] == before
