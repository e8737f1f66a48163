"""What the physical plans may and may not hold."""

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.catalog import adherence as CA
from cohortry.sources import views as V

FOLDER = "/root/testdata/sf0.001"
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_ratio_shuffles_twice(spark):
    text = plan(CA._ratios(spark, FOLDER))
    hashed = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(hashed) == 2
    assert "class_id" in hashed[1] and "class_id" not in hashed[0]  # printed from the top down
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = CA._ratios(spark, FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in text.splitlines() if "ReadSchema" in x and "l_shipdate" in x)
    assert "l_comment" not in line and "l_tax" not in line and "l_discount" not in line
    assert any("PushedFilters" in x and "GreaterThanOrEqual(l_extendedprice,0.0)" in x for x in text.splitlines())


# a window without partition keys prints its order as the first thing in the definition
ONE_TASK_WINDOW = re.compile(r"windowspecdefinition\([^,()]* (?:ASC|DESC) NULLS")


def check_plan(df):
    """No Cartesian product, no Python per row, no window in a single task."""
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert not ONE_TASK_WINDOW.search(text)


def test_the_check_finds_a_single_task_window(spark):
    bad = spark.range(5).withColumn("r", F.row_number().over(Window.orderBy("id")))
    good = spark.range(5).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("id")))
    assert ONE_TASK_WINDOW.search(plan(bad)) and not ONE_TASK_WINDOW.search(plan(good))


def test_claims_view_reads_only_what_it_needs(spark):
    assert "l_tax" not in plan(V.claims(spark, FOLDER).select("member_id", "service_date"))
