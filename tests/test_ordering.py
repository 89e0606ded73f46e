"""Order statistics of hot groups, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import cross_section as cs
from tidepanel.operators import ordering as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One day holds most rows, and one value (0) a third of them; some values are missing."""
    rng = np.random.default_rng(11)
    n = 6000
    pdf = pd.DataFrame({
        "trade_date": np.where(rng.random(n) < 0.7, "2024-01-02", np.where(rng.random(n) < 0.5, "2024-01-03", "2024-01-04")),
        "instrument_id": [f"{i:06d}" for i in range(n)], "x": rng.normal(scale=0.01, size=n)})
    pdf.loc[rng.random(n) < 0.33, "x"] = 0.0
    pdf.loc[rng.random(n) < 0.05, "x"] = 100.0 + rng.normal(scale=1e-7, size=(n,))[0]
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("trade_date", F.to_date("trade_date")).withColumn("x", F.nanvl("x", F.lit(None)))
    return df, pdf


def test_average_ranks(skewed):
    df, pdf = skewed
    got = cs.cs_rank(df, {"r": "x"}).toPandas().set_index("instrument_id")["r"].astype(float)
    want = pdf.set_index("instrument_id").groupby("trade_date")["x"].rank(pct=True)
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_quantiles_by_group_and_overall(skewed):
    df, pdf = skewed
    got = od.group_quantiles(df, ["trade_date"], "x", {"a": 0.5, "b": 0.98, "c": 0.03, "low": "lower_median"}).toPandas()
    got.index = got["trade_date"].astype(str)
    for col, q in (("a", 0.5), ("b", 0.98), ("c", 0.03)):
        want = pdf.groupby("trade_date")["x"].quantile(q)
        np.testing.assert_allclose(got[col].sort_index(), want.sort_index(), atol=1e-15)
    lower = pdf.groupby("trade_date")["x"].quantile(0.5, interpolation="lower")
    np.testing.assert_allclose(got["low"].sort_index(), lower.sort_index())
    assert od.group_quantiles(df, [], "x", {"m": 0.25}).first()["m"] == pytest.approx(pdf["x"].quantile(0.25))


def test_ordinal_positions_break_ties_by_id(skewed):
    df, pdf = skewed
    for descending in (False, True):
        got = od.ordinal_positions(df, ["trade_date"], "x", "instrument_id", "p", descending).toPandas()
        ordered = pdf.dropna().sort_values(["trade_date", "x", "instrument_id"], ascending=[True, not descending, True])
        want = ordered.groupby("trade_date").cumcount()
        want.index = ordered["instrument_id"]
        have = got.set_index("instrument_id")["p"].dropna().astype(int)
        assert (have.sort_index() == want.sort_index()).all()
        assert got["p"].isna().sum() == pdf["x"].isna().sum()


def test_value_bucket_never_decreases(spark):
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-12, 12, 2000), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]]))
    b = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "x": x})).select("i", od.value_bucket(F.col("x")).alias("b")).orderBy("i").toPandas()["b"].to_numpy()
    assert (np.diff(b) >= 0).all()


def test_dense_index_and_keep_last(spark):
    ids = spark.createDataFrame([("600001",), ("000010",), ("000002",), ("000010",), (None,)], "instrument_id string")
    got = {r["instrument_id"]: r["k"] for r in od.dense_index(ids, "instrument_id", "k").collect()}
    assert got == {"000002": 0, "000010": 1, "600001": 2}
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in od.keep_last(df, ["k"], ["o"]).collect()} == {("a", "z"), ("b", None)}
    assert {(r["k"], r["v"]) for r in od.keep_last(df, ["k"], ["o"], first=True).collect()} == {("a", "x"), ("b", None)}


def test_winsorize_matches_pandas(skewed):
    df, pdf = skewed
    got = cs.winsorize_mad(df, ["x"], n=2.0).toPandas().set_index("instrument_id")["x"].astype(float).sort_index()
    g = pdf.groupby("trade_date")["x"]
    med = g.transform("median")
    mad = (pdf["x"] - med).abs().groupby(pdf["trade_date"]).transform("median")
    reach = 2.0 * (mad * 1.4826).clip(lower=1e-6)
    want = pdf["x"].clip(med - reach, med + reach)
    want.index = pdf["instrument_id"]
    np.testing.assert_allclose(got, want.sort_index())


def test_zero_spread_options(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-01", "b", 1.0), ("2024-01-02", "a", 1.0), ("2024-01-02", "b", 3.0)],
                               "trade_date string, instrument_id string, x double").withColumn("trade_date", F.to_date("trade_date"))
    null = cs.cs_zscore(df, {"z": "x"}).orderBy("trade_date", "instrument_id").collect()
    zero = cs.cs_zscore(df, {"z": "x"}, zero_std="zero").orderBy("trade_date", "instrument_id").collect()
    assert [r["z"] for r in null[:2]] == [None, None] and [r["z"] for r in zero[:2]] == [0.0, 0.0]
    assert null[3]["z"] == pytest.approx(0.7071067811, abs=1e-9)


def test_feature_names():
    assert cs.rank_feature_names(["rsi", "换手率", "成交额", "5day Ret!"], "cs_rank_") == ["cs_rank_rsi", "cs_rank_f__dup1", "cs_rank_f", "cs_rank_f_5day_ret"]
