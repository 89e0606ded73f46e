"""Tests for ids stay with the rows that are joined."""

from pyspark.sql import functions as F

from test_plans import FOLDER, plan
from tidepanel.sources import canonical as cn
from workloads import registered


def test_no_pattern_is_tested_on_rows_before_grouping(spark):
    text = plan(registered()["merge_hf_foreign_ids"].run(spark, FOLDER))
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert filters and not any("RLIKE" in line for line in filters)


def test_ids_of_every_spelling(spark):
    df = spark.createDataFrame([("sz.000001",), ("12",), ("a1b2",), ("",), ("x",), (None,), ("1234567",)], "c string")
    got = [r[0] for r in df.select(cn.instrument_id(F.col("c"))).collect()]
    assert got == ["000001", "000012", "000012", "", "", "", "123456"]
