"""What the plans must and must not contain."""

import os
import re

import pytest
from helpers import observations
from pyspark.sql import functions as F

from sitegrade.operators import scoring
from sitegrade.operators.keyed import attach
from sitegrade.operators.scanlog import fold_scan_log
from sitegrade.operators.statistics import country_overview
from sitegrade.operators.summary import summary_columns
from sitegrade.testbed.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_no_python_no_cross_join(spark, name):
    plan = physical(QUERIES[name](spark, SF_DIR))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def stored(spark, tmp_path):
    path = str(tmp_path / "obs")
    observations(spark, [{}, {"platform": "mobile"}]).withColumn("raw_headers", F.lit("{}")).write.parquet(path)
    return spark.read.parquet(path)


def test_worst_scores_reads_once_and_shuffles_once(spark, tmp_path):
    df = scoring.worst_scores(stored(spark, tmp_path), summary_columns(), n_platforms=2)
    plan = physical(df)
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(ETER_ID") == 1
    assert "Join" not in plan and "Window" not in plan
    assert "raw_headers" not in plan  # pruned from the scan


def test_final_scores_has_no_window(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(scoring.final_scores(stored(spark, tmp_path), n_platforms=2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan and plan.count("SortMergeJoin") == 1
    narrow = [line for line in plan.split("\n") if "FileScan" in line][-1]
    assert "raw_headers" not in narrow  # the aggregate side reads only what it needs


def test_hot_key_is_split(spark):
    """One key with a third of all rows: adaptive execution splits the joined partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 400_000, 1, 16).selectExpr("if(id % 3 = 0, 7, id) as k", "id as v")
        joined = attach(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"])
        total = joined.agg(F.sum("n"), F.count("*"), F.sum("v"))
        hot, others = 133_334 + 1, 400_000 - 133_334 - 1
        assert tuple(total.collect()[0]) == (hot * hot + others, 400_000, sum(range(400_000)))
        assert re.search(r"skew", physical(total), re.IGNORECASE)
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_platform_count_is_a_read_of_one_column(spark, tmp_path):
    """The platforms are counted by a read of their own; institutions aggregate by hash."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = scoring.header_scores(stored(spark, tmp_path))
        plan = physical(df)
        worst = physical(scoring.worst_scores(spark.read.parquet(str(tmp_path / "obs")), summary_columns()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    for text, scans in ((plan, 3), (worst, 2)):
        assert text.count("FileScan") == scans
        assert "ReadSchema: struct<platform:string>" in text


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", ["header_classify", "result_error_split", "redirect_score", "header_score", "worst_scores"])
def test_max_age_is_evaluated_once_per_stage(spark, name):
    """Filters on ``header_error`` are not pushed below the helper, so its text isn't copied."""
    text = "max-age="
    stages = re.split(r"Exchange|Subquery", physical(QUERIES[name](spark, SF_DIR)))
    # One test for the text and one split at it, beside the header value itself.
    used = [len(re.findall(r"split_part\([^()]*, max-age=", stage)) for stage in stages]
    assert text in "".join(stages) and max(used) <= 1, used


def test_overview_copies_no_rows(spark, tmp_path):
    plan = physical(country_overview(stored(spark, tmp_path)))
    assert "Expand" not in plan


def test_fold_hashes_all_events(spark, tmp_path):
    """What runs over all events is a hash aggregation; sorting is left to its result."""
    path = str(tmp_path / "logs")
    columns = "ETER_ID string, platform string, attempt int, seq long, final_url string, message string"
    spark.createDataFrame([("A", "desktop", 1, 1, "http://a/", "{}")], columns).write.parquet(path)
    plan = physical(fold_scan_log(spark.read.parquet(path)))
    over_events = re.split("Exchange", plan)[-1]
    assert "HashAggregate" in over_events and "SortAggregate" not in over_events and "FileScan" in over_events
