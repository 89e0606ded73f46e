"""Physical plans: what must not be in them, and what must."""

import re

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import cross_section as cs
from tidepanel.operators import evaluation as ev
from tidepanel.operators import ordering as od
from tidepanel.operators import portfolio as pf
from tidepanel.plans import tables
from workloads import registered

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries whose plans can be built without running anything first.
LAZY = ("alpha158", "tech39", "canonical_daily", "canonical_macro", "intraday_day_features", "intraday_variants_outer_join",
        "intraday_user_aggregates", "asof_macro_columns", "asof_macro_true_cap", "sliding_sequences", "rolling_folds", "holdout_last_months",
        "merge_hf_features", "dataset_build", "universe_restriction", "universe_membership_dates", "factor_quality_summary",
        "industry_degree", "similarity_knn", "histogram", "global_scaling", "benchmark_lookup_with_fallback", "quality_daily_coverage",
        "portfolio_industry_cap", "rank_ic", "loss_lambda_ndcg", "strategy_reselection", "fold_membership", "cs_normalize_rank")


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, name):
    text = plan(registered()[name].run(spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("trade_date"), F.col("id").cast("string").alias("instrument_id"),
                                  F.rand(1).alias("score"), F.col("id").alias("position"), F.lit("x").alias("industry"), F.rand(2).alias("ret"))
    for made in (pf.select_names(df, 5), pf.select_names(df, 5, max_per_industry=1), ev.oracle_top_return(df),
                 ev.strategy_returns(df, ev.strategy_grid((5,))), od.top_rows(df, ["trade_date"], [F.desc("score")], 3)):
        text = plan(made)
        assert "WindowGroupLimit" in text and ", Partial" in text


def test_cross_sections_are_not_windows_over_a_date(spark):
    bars = tables.bars(spark, FOLDER)
    for made in (cs.cs_zscore(bars, {"z": "close"}), cs.normalize(bars, ["close"]), cs.cs_rank(bars, {"r": "close"}),
                 cs.winsorize_mad(bars, ["close"]), cs.market_context(bars, ["close"])):
        for window in re.findall(r"Window \[.*?\], \[trade_date#\d+\](?:, \[(\w+)#\d+L? ASC)?", plan(made)):
            assert window in ("_b", "")  # only the table of bucket counts is ordered per date
        assert "close" not in "".join(re.findall(r"Window \[sum\(close", plan(made)))


def test_scan_reads_only_what_is_needed(spark):
    text = plan(tables.bars(spark, FOLDER).select("instrument_id", "trade_date", "turnover"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_tax" not in schema and "l_extendedprice" not in schema and "l_discount" in schema
    kept = tables.read(spark, FOLDER, "lineitem").where("l_quantity > 10").select("l_suppkey")
    assert "GreaterThan(l_quantity,10.0)" in plan(kept)


def test_factor_layers_share_one_shuffle(spark):
    text = plan(registered()["alpha158"].run(spark, FOLDER))
    # the bars' own aggregation, then one exchange by instrument for every window layer
    assert text.count("Exchange hashpartitioning(instrument_id") == 2


def test_long_frames_hold_values_only(spark):
    """A frame is aggregated anew for every row, so sums and moments of long windows are joined from shorter ones."""
    spark.conf.set("spark.sql.debug.maxToStringFields", 100000)
    try:
        text = plan(registered()["alpha158"].run(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    frames = re.findall(r"(\w+)\([^()]*(?:\([^()]*\)[^()]*)*\) windowspecdefinition\([^()]*specifiedwindowframe\(RowFrame, -(\d+), currentrow", text)
    assert {name for name, before in frames if int(before) >= 9} == {"collect_list", "count"}
    assert "InArrow" not in text and "InPandas" not in text
