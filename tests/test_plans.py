"""Plan-shape checks: column pruning and filter pushdown reach the scan, and
the operators that must not funnel rows into one task do not."""

import re

from conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan):
    return re.findall(r"FileScan parquet [^\n]*", plan)


def test_projection_is_pruned(spark):
    import __spark_entry__ as E

    scans = _scans(_plan(E.queries()["select_required"](spark, SMALL)))
    assert scans and all("ReadSchema: struct<l_quantity:double,l_discount:double,l_returnflag:string>" in s
                         for s in scans)


def test_time_filter_is_pushed(spark):
    import __spark_entry__ as E

    scans = _scans(_plan(E.queries()["drift_report"](spark, SMALL)))
    assert any("LessThan(ts," in s for s in scans) and any("GreaterThanOrEqual(ts," in s for s in scans)
    assert all("props" not in s for s in scans)       # unused column never read


def test_ranking_has_no_single_partition_exchange_over_rows(spark):
    from pyspark.sql import functions as F

    from assaygraph.plans.ranking import with_index

    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = _plan(with_index(df, ["id"], ["g"]))
    # range partitioning of the rows; a single-partition exchange may only
    # feed the per-partition statistics (at most one row per partition)
    assert "rangepartitioning" in plan.lower() or "checkpoint" in plan.lower() or "Scan ExistingRDD" in plan
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0] or "Window" in plan


def test_block_kernel_is_cogrouped(spark):
    import __spark_entry__ as E

    plan = _plan(E.queries()["knn_self_join"](spark, SMALL))
    assert "FlatMapCoGroupsInPandas" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
