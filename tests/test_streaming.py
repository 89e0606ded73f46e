"""Streams over parquet files that arrive one by one."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import intraday
from tidepanel.streaming import minute_bars as mb

SCHEMA = "instrument_id string, ts timestamp, price double, volume double, amount double"
START = dt.datetime(2024, 1, 2, 9, 30)


@pytest.fixture()
def feed(spark, tmp_path):
    rows = [("000001", START + dt.timedelta(minutes=k), 10.0 + k, 100.0, 1000.0) for k in range(40)]
    rows.insert(7, rows[6])
    folder = tmp_path / "in"
    for n, part in enumerate((rows[:15], rows[15:30], rows[30:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"p{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return stream, spark.createDataFrame(rows, SCHEMA)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def deliver(spark, tmp_path, parts, make, end=True, schema=SCHEMA):
    """Deliveries one after the other, each taken up where the query stopped; then the closing row."""
    folder, every = str(tmp_path / "in"), [r for p in parts for r in p]
    for n, part in enumerate([*parts, None] if end else parts):
        rows = spark.createDataFrame(part, schema) if part is not None else mb.closing_row(spark.createDataFrame(every, schema))
        rows.write.mode("append").parquet(folder)
        made = make(spark.readStream.schema(schema).parquet(folder))
        made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(
            availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def scattered(names=("000001", "000002"), n=60):
    """Rows up to eight minutes out of order, some repeated, with and without a price."""
    rng, rows = random.Random(5), []
    for k in range(n):
        for name in names:
            at = START + dt.timedelta(minutes=2 * k, seconds=rng.randrange(60), microseconds=rng.randrange(10**6))
            rows.append((name, at, None if rng.random() < 0.1 else 10 + rng.random(), 100.0 + k, float(k)))
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(480)))
    return rows


@pytest.mark.parametrize("minutes", [5, 7])
def test_resample_equals_batch(spark, tmp_path, minutes):
    rows = scattered()
    got = deliver(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], lambda s: mb.resample_stream(s, minutes))
    batch = intraday.resample(spark.createDataFrame(rows, SCHEMA).withColumns({"trade_date": F.to_date("ts"), "ts": F.col("ts").cast("timestamp_ntz")}), minutes)
    def key(df):
        return sorted((r["instrument_id"], str(r["ts"]), r["price"], r["volume"], r["amount"]) for r in df.collect())
    assert key(got) == key(batch) and len(key(got)) > 20


def test_open_buckets_stay_open(spark, tmp_path):
    rows = scattered()
    got = deliver(spark, tmp_path, [rows], lambda s: mb.resample_stream(s, 5), end=False)
    assert 0 < got.count() and got.agg(F.max("ts")).first()[0] <= max(r[1] for r in rows) - dt.timedelta(minutes=15)


def test_keep_last_waits_for_the_last(spark, tmp_path):
    """Corrections in later deliveries win by their order, not by their arrival."""
    schema = "instrument_id string, ts timestamp, seq long, price double"
    at = [START + dt.timedelta(minutes=k) for k in range(6)]
    first = [("a", t, 5, 1.0) for t in at[:4]]
    second = [("a", at[1], 9, 2.0), ("a", at[2], 3, 3.0), ("b", at[2], 1, 4.0), ("a", at[3], 5, None), ("a", at[4], 1, 6.0), ("a", at[4], 1, 5.0)]
    got = deliver(spark, tmp_path, [first, second], lambda s: mb.keep_last_bars(s, ["seq"]), schema=schema)
    assert {(r["instrument_id"], r["ts"]): (r["seq"], r["price"]) for r in got.collect() if r["instrument_id"]} == {
        ("a", at[0]): (5, 1.0), ("a", at[1]): (9, 2.0), ("a", at[2]): (5, 1.0), ("a", at[3]): (5, 1.0), ("a", at[4]): (1, 6.0), ("b", at[2]): (1, 4.0)}


def test_closing_row_of_nothing(spark):
    assert mb.closing_row(spark.createDataFrame([], SCHEMA)).count() == 0


def test_duplicates_are_dropped(spark, feed):
    stream, rows = feed
    assert drain(mb.distinct_bars(stream), "once").count() == rows.distinct().count()


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get(mb.ROCKS[0])
    spark.conf.set(*mb.ROCKS)
    yield
    spark.conf.set(mb.ROCKS[0], before)


def test_ema_takes_late_rows_in_order(spark, tmp_path, rocks):
    """Rows within the delay count at their time; one that comes after the watermark doesn't."""
    rows = scattered()
    cut = 60
    too_late = [("000001", START - dt.timedelta(minutes=1), 999.0, 1.0, 1.0)]
    got = deliver(spark, tmp_path, [rows[:cut], rows[cut:100], rows[100:] + too_late], lambda s: mb.running_ema(s, 5)).toPandas()
    want = pd.DataFrame(rows, columns=["instrument_id", "ts", "value", "v", "a"]).dropna(subset=["value"]).sort_values(["instrument_id", "ts"])
    assert len(got) == len(want)
    for name, g in want.groupby("instrument_id"):
        mine = got[got["instrument_id"] == name].sort_values("ts")
        assert mine["value"].tolist() == g["value"].tolist()
        assert mine["ema"].tolist() == pytest.approx(g["value"].ewm(span=5, adjust=False).mean().tolist())


def test_quality_sink(spark, feed, tmp_path):
    stream, rows = feed
    sink = mb.quality_sink([{"type": "market_session_check", "name": "hours"}, {"type": "expression", "expr": "price > 12", "name": "floor"}], str(tmp_path / "d"), str(tmp_path / "r"))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "d")).count() == rows.count()
    report = spark.read.parquet(str(tmp_path / "r"))
    assert report.where("rule = 'floor'").agg(F.sum("failed_rows")).first()[0] == 3
    assert report.where("rule = 'hours' AND passed").count() == report.select("batch_id").distinct().count()
