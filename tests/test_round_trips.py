"""Hashes that don't depend on the order of rows, logs in blocks, checked day tables, sliding order statistics, numbering."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.recursive import recursive, with_recursive
from tidepanel.operators import cross_section as cs
from tidepanel.operators import evaluation as ev
from tidepanel.operators import joins
from tidepanel.operators import ordering as od
from tidepanel.operators import portfolio as pf
from tidepanel.sources import logs, manifest

DAY = dt.date(2024, 1, 2)


def test_data_hash_is_of_the_multiset(spark):
    rows = [(1, "a", 0.1, DAY), (2, None, -3.75, None), (2, None, -3.75, None), (3, "", float("nan"), DAY), (4, "b", 1e300, DAY), (5, "b", None, DAY)]
    schema = "k long, s string, x double, d date"
    df = spark.createDataFrame(rows, schema)
    one = manifest.data_hash(df).first()
    assert manifest.data_hash(df.repartition(3).orderBy(F.desc("k"))).first() == one
    assert manifest.data_hash(spark.createDataFrame(rows[1:], schema)).first() != one
    assert manifest.data_hash(spark.createDataFrame([*rows[:-1], (5, "b", 0.0, DAY)], schema)).first() != one
    text = f"{DAY}|1|a|0:{math.floor(0.1 * 2 ** 52)}"
    digest = hashlib.md5(text.encode()).hexdigest()
    assert manifest.data_hash(df.where("k = 1")).first()["content_sum"] == f"{int(digest[:15], 16)}:{int(digest[15:30], 16)}"
    assert manifest.data_hash(df.where("k > 9")).first()["row_count"] == 0


def test_lineage_issues(spark):
    built = spark.createDataFrame([("a", "f1", 3), ("b", "f2", 4), ("c", None, 5)], "name string, f string, n int")
    active = spark.createDataFrame([("a", "f1", 3), ("b", "f9", 4)], "name string, f string, n int")
    got = {(r["name"], r["field"]): (r["dataset_value"], r["active_value"]) for r in manifest.lineage_issues(built, active, "name", ["f", "n"]).collect()}
    assert got == {("b", "f"): ("f2", "f9"), ("c", "n"): ("5", None)}


def test_log_state_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK_LINES", 3)
    text = ["noise", "=== Epoch 1/9 ===", "Train loss: 1.5", "x", "x", "x", "x", "x", "Eval ic: 0.25", "=== Epoch 2/9 ===", "x", "x", "x",
            "触发早停: monitor=m, mode=max, patience=4, best=0.5", "=== Epoch 3/9 ==="]
    df = spark.createDataFrame([(f, i, line) for f in ("a", "b") for i, line in enumerate(text)], "file string, line_no int, line string")
    out = logs.parse_training_log(df)
    assert {(r["file"], r["epoch"], r["total_epochs"], r["metric_lines"], r["triggered"]) for r in out["epochs"].collect()} == {
        (f, e, 9, n, e == 2) for f in "ab" for e, n in ((1, 2), (2, 0), (3, 0))}
    assert {(r["epoch"], r["name"], r["value"]) for r in out["metrics"].where("file = 'a'").collect()} == {(1, "train_loss", 1.5), (1, "eval_ic", 0.25)}
    stop = out["early_stop"].where("file = 'b'").first()
    assert (stop["epoch"], stop["mode"], stop["patience"], stop["best"], stop["value"]) == (2, "max", 4, 0.5, None)


def test_repeated_benchmark_days(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 3.0)], "instrument_id string, trade_date date, v double")
    same = spark.createDataFrame([(DAY, 0.5), (DAY, 0.5)], "trade_date date, benchmark_return double")
    assert [r["benchmark"] for r in joins.with_benchmark(df, same, "v").collect()] == [0.5, 0.5]
    other = same.unionByName(spark.createDataFrame([(DAY, 0.75)], same.schema))
    with pytest.raises(Exception, match="different rows of one day"):
        joins.with_benchmark(df, other, "v").collect()


def test_last_order_statistics(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=60), 1)
    x[rng.random(60) < 0.05] = np.nan
    pdf = pd.DataFrame({"instrument_id": "a", "trade_date": pd.date_range("2024-01-01", periods=60).date, "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))).repartition(4)
    out = with_recursive(df, {"q": recursive("last_quantile", "x", n=7, q=0.8), "r": recursive("last_rank", "x", n=7), "hi": recursive(
        "last_argmax", "x", n=7), "lo": recursive("last_argmin", "x", n=7), "long": recursive("last_rank", "x", n=99)}).orderBy("trade_date").toPandas()
    s = pdf["x"].rolling(7)
    np.testing.assert_allclose(out["q"].astype(float), s.quantile(0.8), atol=1e-12)
    np.testing.assert_allclose(out["r"].astype(float), s.rank(pct=True), atol=1e-12)
    np.testing.assert_allclose(out["hi"].astype(float), s.apply(np.argmax, raw=True).where(s.count() == 7) / 7, atol=1e-12)
    np.testing.assert_allclose(out["lo"].astype(float), s.apply(np.argmin, raw=True).where(s.count() == 7) / 7, atol=1e-12)
    assert out["long"].isna().all()


def test_numbering_spreads_equal_values(spark):
    """A third of the rows are equal and all ids share a prefix: ranges of the whole order still cut them."""
    rng = random.Random(3)
    rows = [(f"shared-prefix-{i:06d}", DAY, 0.0 if i % 3 == 0 else rng.random()) for i in range(9000)]
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, x double")
    placed = od.numbered(df, [F.col("trade_date"), F.col("x"), F.col("instrument_id")], "at")
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r["instrument_id"]: r["at"] for r in placed.collect()} == want
    files = df.repartitionByRange(8, "trade_date", "x", "instrument_id").groupBy(F.spark_partition_id()).count()
    assert files.agg(F.max("count")).first()[0] < 2 * 9000 / 8


def test_limits_of_many_columns_read_the_rows_twice(spark, tmp_path):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)), columns=list("wxyz"))
    pdf["instrument_id"], pdf["trade_date"] = [f"{i:06d}" for i in range(400)], [dt.date(2024, 1, 2 + i % 3) for i in range(400)]
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tally = spark.sparkContext.accumulator(0)
    watched = df.mapInPandas(lambda it: (tally.add(len(p)) or p for p in it), df.schema)
    out = cs.winsorize_mad(watched, list("wxyz"), n=1.0, min_group=5).toPandas()
    assert tally.value <= 3 * 400
    for c in "wxyz":
        g = pdf.groupby("trade_date")[c]
        med = g.transform("median")
        mad = (pdf[c] - med).abs().groupby(pdf["trade_date"]).transform("median")
        want = pdf[c].clip(med - 1.4826 * mad, med + 1.4826 * mad)
        np.testing.assert_allclose(out.sort_values("instrument_id")[c], want, atol=1e-12)


def test_fold_comparison_lists_every_candidate(spark):
    metrics = spark.createDataFrame([("f1", 0, "a", 0.2, 0.1, 0.1), ("f1", 1, "b", 0.3, 0.5, -0.2), ("f2", 0, "a", 0.1, 0.0, None)],
                                    "fold string, position int, strategy string, mean_return double, return_std double, risk_adjusted double")
    every = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position int, strategy string")
    got = {(r["fold"], r["strategy"]): (r["score"], r["place"]) for r in ev.fold_comparison(metrics, every).collect()}
    assert got == {("f1", "a"): (0.1, 1), ("f1", "b"): (-0.2, 3), ("f1", "c"): (0.0, 2), ("f2", "a"): (0.1, 1), ("f2", "b"): (0.0, 2), ("f2", "c"): (0.0, 3)}
    assert {r["strategy"]: r["wins"] for r in ev.win_counts(metrics, every).collect()} == {"a": 2, "b": 0, "c": 0}
    assert {r["strategy"]: r["wins"] for r in ev.win_counts(metrics, every, "mean_return").collect()} == {"a": 1, "b": 1, "c": 0}
    with pytest.raises(ValueError):
        ev.win_counts(metrics, every, "best")


def test_days_without_a_name(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0), ("a", DAY + dt.timedelta(days=1), 1.0)], "instrument_id string, trade_date date, score double")
    rows = rows.withColumn("position", F.lit(0))
    chosen = pf.select_names(rows.where("score > 1"), 2)
    assert {(r["trade_date"], r["names"], r["missing"], r["empty"]) for r in pf.filled_days(chosen, rows, 2).collect()} == {
        (DAY, 1, 1, False), (DAY + dt.timedelta(days=1), 0, 2, True)}
