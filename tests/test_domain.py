"""Exact cases: ids, minute bars, joins, quality rules, folds, portfolios, diagnostics, the catalog, logs."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidepanel import session
from tidepanel.functions import recursive as rec
from tidepanel.operators import edges as eg
from tidepanel.operators import evaluation as ev
from tidepanel.operators import intraday as i
from tidepanel.operators import joins
from tidepanel.operators import labels as lb
from tidepanel.operators import portfolio as pf
from tidepanel.operators import quality as q
from tidepanel.operators import sequences as sq
from tidepanel.operators import splits as sp
from tidepanel.operators import stats
from tidepanel.plans import catalog as ct
from tidepanel.plans import featuresets as fs
from tidepanel.plans.factor_graph import EXPRESSIONS, factor_graph
from tidepanel.sources import canonical as cn
from tidepanel.sources import files, logs, manifest, providers


def days(df, *columns):
    return df.withColumns({c: F.to_date(c) for c in columns or ("trade_date",)})


def ids(df, column="instrument_id"):
    return [r[column] for r in df.collect()]


# ---- ids, dates, provider files --------------------------------------------------------------------------------

def test_instrument_ids(spark):
    texts = ["sz300750", "688981.SH", " 2594 ", "id-83-0799-7", "20240102#600036", None, "", "none"]

    def expected(t):
        digits = re.sub(r"\D", "", t or "")
        run = re.search(r"\d{6}", t or "")
        return run[0] if run else digits[-6:].rjust(6, "0") if digits else ""

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    got = df.select(cn.instrument_id(F.col("t")).alias("i"), cn.exchange_symbol(F.col("t")).alias("s"), cn.key_id(F.col("t"), False).alias("w")).collect()
    assert [r["i"] for r in got] == [expected(t) if t is not None else "" for t in texts]
    assert [r["s"] for r in got][:4] == ["sz.300750", "sh.688981", "sz.002594", "sz.307997"]
    assert [r["w"] for r in got] == [t.strip() if t is not None else None for t in texts]


def test_ids_of_any_length_stay_apart(spark):
    bars = days(spark.createDataFrame([("2024-01-02", "1234567", 1.0), ("2024-01-02", "1234568", 2.0)], "trade_date string, instrument_id string, close double"))
    assert ids(joins.restrict_universe(bars, bars.where("close = 1"), normalize_ids=False)) == ["1234567"]
    features = bars.select("instrument_id", "trade_date", (F.col("close") * 10).alias("ten"), F.lit(1).alias("n"))
    merged = joins.merge_features(bars, features, ["n"], normalize_ids=False)[0]
    assert {(r["instrument_id"], r["ten"]) for r in merged.collect()} == {("1234567", 10.0), ("1234568", 20.0)}


def test_upsert_keeps_stored_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    stored = days(spark.createDataFrame([("a", "2024-01-02", 1.0, 5), ("b", "2024-01-02", 2.0, 6), ("a", "2024-01-03", 3.0, 7)],
                                        "instrument_id string, trade_date string, close double, volume long"))
    files.replace_build(stored, path)
    change = days(spark.createDataFrame([("a", "2024-01-02", 9.0), ("c", "2024-01-02", 8.0)], "instrument_id string, trade_date string, close double"))
    files.upsert_on_key(change, path, ["instrument_id", "trade_date"])
    got = {(r["instrument_id"], r["trade_date"].day, r["close"], r["volume"]) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2, 9.0, 5), ("b", 2, 2.0, 6), ("c", 2, 8.0, None), ("a", 3, 3.0, 7)}
    for wrong in (change.drop("instrument_id"), change.drop("trade_date"), change.withColumn("other", F.lit(1))):
        with pytest.raises(ValueError):
            files.upsert_on_key(wrong, path, ["instrument_id", "trade_date"])


def test_correlation_edges_of_any_scale(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=40)
    series = {"p": base, "q": -2 * base, "r": base + 5, "s": rng.normal(size=40), "flat": np.full(40, 0.1)}
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", n, float(v)) for n, x in series.items() for d, v in enumerate(x)]
    found = []
    for scale in (1.0, 1e-10, 1e10):
        df = days(spark.createDataFrame([(d, n, v * scale) for d, n, v in rows], "trade_date string, instrument_id string, x double"))
        found.append({(r["src"], r["dst"]) for r in eg.correlation_edges(df, "x", 20, 0.9, 0).collect()})
    assert found[0] == {(a, b) for a in "pqr" for b in "pqr" if a != b} and found[0] == found[1] == found[2]


def test_no_machine_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None

    class Session:
        sparkContext = Context()
        class conf:
            get = staticmethod(lambda key, default: default)
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_folder(Session())


def test_provider_and_legacy_layouts(spark):
    raw = spark.createDataFrame([("2024-01-02", "sh.600000", "10", "11", "9", "10.5", "10", "1000", "1e4", "0.5", "5.0", "1"),
                                 ("2024-01-02", "none", "1", "1", "1", "1", "1", "1", "1", "1", "1", "x")],
                                "date string, code string, open string, high string, low string, close string, preclose string, volume string, amount string, turn string, pctChg string, tradestatus string")
    rows = providers.provider_daily(raw)
    assert rows.columns == [f.name for f in cn.DAILY_SCHEMA.fields]
    assert [f.dataType for f in rows.schema.fields] == [f.dataType for f in cn.DAILY_SCHEMA.fields]
    row = rows.collect()
    assert len(row) == 1 and row[0]["instrument_id"] == "600000" and row[0]["trade_status"] == 1
    legacy = providers.legacy_daily(rows).first()
    assert legacy["日期"] == "2024/1/2" and legacy["涨跌额"] == pytest.approx(0.5) and legacy["振幅"] == pytest.approx(20.0)
    zero = providers.legacy_daily(rows.withColumn("preclose", F.lit(0.0))).first()
    assert zero["涨跌额"] == 0.0 and zero["振幅"] == 0.0


def test_provider_minutes_and_macro(spark):
    minutes = spark.createDataFrame([("2024-01-02 09:31:00", "1", "2"), ("bad", "1", "2")], "`时间` string, `开盘` string, `收盘` string")
    row = providers.provider_minutes(minutes, F.lit("000001")).collect()
    assert len(row) == 1 and row[0]["close"] == 2.0 and row[0]["volume"] is None and row[0]["trade_date"] == dt.date(2024, 1, 2)
    macro = spark.createDataFrame([("2024-01", "2024-02-01 09:30:00", "2024-02-01 09:31:00", "0.7")], "`月份` string, `发布时间` string, `可用时间` string, `全国-同比增长` string")
    m = providers.provider_macro(macro, "cpi_yoy").first()
    assert (m["observation_date"], m["frequency"], m["vintage"], m["value"]) == (dt.date(2024, 1, 1), "monthly", "latest", 0.7)
    assert m["release_time"] == dt.datetime(2024, 2, 1, 9, 30) and m["available_time"] == dt.datetime(2024, 2, 1, 9, 31)
    fx = spark.createDataFrame([("2024-01-02", "710"), ("2024-01-03", "712"), ("2024-01-04", None)], "date string, `美元` string")
    assert [r["value"] for r in providers.provider_macro(fx, "usdcny").orderBy("observation_date").collect()] == [7.1, 7.12, None]
    mixed = spark.createDataFrame([("2024-01-02", "7.1"), ("2024-01-03", "712")], "date string, `美元` string")
    assert [r["value"] for r in providers.provider_macro(mixed, "usdcny").orderBy("observation_date").collect()] == [7.1, 712.0]
    other = spark.createDataFrame([("2024-01-02", "a", "3.5", "z")], "date string, note string, figure string, tail string")
    assert providers.provider_macro(other, "new_series").first()["value"] == 3.5


def test_canonical_daily_keeps_last_and_coerces(spark):
    raw = spark.createDataFrame([(1, "000001.SZ", "2024/1/2", "10", "n/a"), (2, "SZ000001", "2024-01-02", "11", "5"), (3, "000002", "2024-01-02", "x", "5"), (4, "", "2024-01-02", "3", "5")],
                                "n int, `股票代码` string, `日期` string, `收盘` string, `成交量` string")
    rows = cn.canonical_daily(raw, ["n"]).collect()
    assert [(r["instrument_id"], r["close"], r["volume"], r["open"]) for r in rows] == [("000001", 11.0, 5.0, None)]
    with pytest.raises(ValueError):
        cn.canonical_daily(raw.drop("收盘"), ["n"])
    nan = spark.createDataFrame([(1, "000001", "2024-01-02", float("nan"))], "n int, code string, date string, close double")
    assert cn.canonical_daily(nan, ["n"]).count() == 0


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_text("﻿股票代码,日期,收盘\n000001,2026/3/2,10.5\n", encoding="utf-8")
    one = files.read_table(spark, str(path))
    assert one.columns == ["股票代码", "日期", "收盘"]
    assert cn.canonical_daily(one, []).first()["trade_date"] == dt.date(2026, 3, 2)
    (tmp_path / "more.csv").write_text("股票代码,日期,收盘,成交量\n000002,2026/3/2,1,9\n", encoding="utf-8")
    both = files.read_many(spark, [f"{tmp_path}/b*.csv", f"{tmp_path}/more.csv", f"{tmp_path}/more.csv"])
    assert both.count() == 2 and {r["source_file"] for r in both.collect()} == {"bom.csv", "more.csv"}
    with pytest.raises(AnalysisException):
        files.read_many(spark, f"{tmp_path}/none*.csv")
    with pytest.raises(FileNotFoundError):
        files.read_many(spark, " , ")


# ---- minute bars -------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def parts(spark):
    rows = [(c, dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=k), start + 0.1 * k, 100.0, 1000.0) for c, start in (("000001.SZ", 10.0), ("000002.SZ", 20.0)) for k in range(15)]
    rows += [("000001.SZ", dt.datetime(2024, 1, 3, 9, 30) + dt.timedelta(minutes=k), 11.0 + 0.05 * k, 100.0, 1000.0) for k in range(15)]
    df = spark.createDataFrame([(a, b.strftime("%Y-%m-%d %H:%M:%S"), c, d, e) for a, b, c, d, e in rows], "`股票代码` string, datetime string, close double, volume double, amount double")
    return cn.canonical_minutes(df, ["datetime"]).withColumn("price", F.col("close"))


def test_variants_of_minute_features(parts):
    out = i.day_feature_variants(parts.select("instrument_id", "trade_date", "ts", "price", "volume", "amount"), [5], min_bars=2)
    rows = out.collect()
    assert len(rows) == 3 and {"hf_realized_vol_raw", "hf_realized_vol_m05"} <= set(out.columns)
    assert {r["hf_bar_count_raw"] for r in rows} == {15} and {r["hf_bar_count_m05"] for r in rows} == {3}


@pytest.mark.parametrize("slot", [1, 60, 86400])
def test_day_features_do_not_depend_on_the_slot(parts, slot):
    bars = parts.select("instrument_id", "trade_date", "ts", "price", "volume", "amount")
    key = ["instrument_id", "trade_date"]
    a = i.day_features(bars, 5, slot_seconds=slot).orderBy(*key).toPandas()
    price = 10.0 + 0.1 * np.arange(15)
    step = np.diff(np.log(price + 1e-12))
    first = a.iloc[0]
    assert first["hf_realized_var"] == pytest.approx((step ** 2).sum())
    assert first["hf_logret_std"] == pytest.approx(step.std())
    assert first["hf_up_bar_ratio"] == 1.0
    assert first["hf_last_tail_ret"] == pytest.approx((price[-1] - price[-6]) / price[-6])   # six bars: both ends count
    assert first["hf_last_tail_volume_share"] == pytest.approx(6 / 15)


def test_gaps_and_short_days(spark):
    rows = [("a", dt.datetime(2024, 1, 2, 10, k), p, v) for k, p, v in ((0, 1.0, 1.0), (1, None, 5.0), (2, 2.0, -3.0), (3, float("nan"), None))] + [("b", dt.datetime(2024, 1, 2, 10, 0), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "instrument_id string, ts timestamp_ntz, price double, volume double").withColumns({"trade_date": F.to_date("ts"), "amount": F.lit(None).cast("double")})
    got = {r["instrument_id"]: r for r in i.day_features(df, 1).collect()}
    assert got["a"]["hf_bar_count"] == 2
    assert got["a"]["hf_realized_var"] == pytest.approx(np.log(2.0) ** 2)
    assert got["a"]["hf_last_tail_ret"] is None           # one price in the last minute
    assert got["a"]["hf_last_tail_volume_share"] == 0.0   # negatives count as 0
    assert got["a"]["hf_last_tail_amount_share"] is None
    assert got["b"]["hf_open_close_ret"] is None and got["b"]["hf_last_tail_volume_share"] is None
    assert i.day_features(df, 1, min_bars=2).count() == 1


def test_user_aggregates(spark):
    rows = [("a", dt.datetime(2024, 1, 2, 14, 0) + dt.timedelta(minutes=k), 10.0 + k, None if k == 38 else float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "instrument_id string, ts timestamp_ntz, close double, volume double").withColumn("trade_date", F.to_date("ts"))
    out = i.day_aggregates(df, {"tail": i.day_agg("sum", "close", "15m"), "all": i.day_agg("sum", "close"), "step": i.day_agg("sum", i.diff("volume")),
                                "last3": i.day_agg("mean", "volume", 3), "none": i.day_agg("first", i.series(F.lit(None).cast("double"), "null"))}, 5).first()
    close = 10.0 + np.arange(40)
    assert out["tail"] / out["all"] == pytest.approx(close[-16:].sum() / close.sum())
    assert out["step"] == pytest.approx(37.0)              # the steps into and out of the gap are missing
    assert out["last3"] == pytest.approx((36 + 37 + 39) / 3)
    assert out["none"] is None
    assert i.day_aggregates(df, {"s": i.day_agg("sum", "close")}, 41).first()["s"] is None
    with pytest.raises(ValueError):
        i.day_agg("bad_func", "close")
    with pytest.raises(ValueError):
        i._minutes("3h")


# ---- joins -------------------------------------------------------------------------------------------------------

def test_unique_key_is_enforced_at_run_time(spark):
    left = spark.createDataFrame([("a", 1)], "k string, v int")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    with pytest.raises(Exception, match="more than one row"):
        joins.join_many_to_one(left, twice, ["k"]).collect()
    assert joins.join_many_to_one(left, twice.where("w = 2"), ["k"]).first()["w"] == 2


def test_merge_features_values_coverage_and_names(spark):
    """Three names over four days, each table spelling them its own way; every third feature row is missing, some come up to three times."""
    codes, dates = (7, 430017, 688981), [f"2025-05-{d:02d}" for d in (6, 7, 8, 9)]
    base_rows = [(f"bj{c:06d}" if c > 400000 else f"{c}.SZ", d, float(c % 11)) for c in codes for d in dates]
    base = days(spark.createDataFrame(base_rows, "instrument_id string, trade_date string, weight double"))
    feature_rows, last, first = [], {}, {}
    for i, (c, d) in enumerate((c, d) for c in codes for d in dates):
        for version in range(i % 3 + (i % 3 == 2)):
            row = (f"x.{c:06d}", d, 100.0 * i + version, -float(version) - i, version)
            feature_rows.append(row)
            first.setdefault((c, d), row)
            last[c, d] = row
    features = days(spark.createDataFrame(feature_rows[::-1], "instrument_id string, trade_date string, spread double, weight double, version int"))
    merged, cover = joins.merge_features(base, features, ["version"])
    digits = lambda text: int("".join(x for x in text if x.isdigit()))
    got = {(digits(r["instrument_id"]), str(r["trade_date"])): (r["weight"], r["spread"], r["hf_weight"]) for r in merged.collect()}
    assert got == {(c, d): (float(c % 11), *(last[c, d][2:4] if (c, d) in last else (None, None))) for c in codes for d in dates}
    assert cover.first()["coverage"] == pytest.approx(len(last) / len(base_rows))
    over, _ = joins.merge_features(base, features, ["version"], overwrite=True, keep="first")
    assert sorted(r["weight"] for r in over.where("weight IS NOT NULL").collect()) == sorted(r[3] for r in first.values())
    pre, _ = joins.merge_features(base, features, ["version"], columns=["spread"], prefix="p_", how="inner")
    assert pre.count() == len(last) and "p_spread" in pre.columns and "hf_weight" not in pre.columns


def test_asof_published_null_staleness_and_fill(spark):
    dates = days(spark.createDataFrame([(f"2024-01-0{d}",) for d in range(1, 7)], "trade_date string"))
    pts = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 16), 1.0), ("s", dt.datetime(2024, 1, 3, 15), None), ("s", dt.datetime(2024, 1, 4, 15, 0, 1), 3.0), ("s", dt.datetime(2024, 1, 4, 18), 4.0)],
                                "series_id string, available_time timestamp_ntz, value double")

    def values(**kw):
        return [r["value"] for r in joins.asof_series(dates, pts, **kw).orderBy("trade_date").collect()]
    assert values(fill_forward=False) == [None, 1.0, None, None, 4.0, 4.0]
    assert values(fill_forward=True) == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert values(fill_forward=False, max_staleness_days=1.0) == [None, 1.0, None, None, 4.0, None]


def test_dataset_names_and_membership(spark):
    base = days(spark.createDataFrame([("a", "2024-01-02", 1.0), ("a", "2024-03-02", 2.0)], "instrument_id string, trade_date string, close double"))
    wide = days(spark.createDataFrame([("a", "2024-01-02", 7.0, 0.1)], "instrument_id string, trade_date string, close double, f_ret double"))
    out, cover = joins.build_dataset(base, wide)
    assert set(out.columns) == {"instrument_id", "trade_date", "close", "f_ext_close", "f_ret"} and cover.first()["coverage"] == 0.5
    assert joins.between_dates(out, "2024-03-01", "2024-03-31").count() == 1
    members = days(spark.createDataFrame([("a", "2024-01-01", "2024-03-02")], "instrument_id string, in_date string, out_date string"), "in_date", "out_date")
    assert joins.member_on_date(base, members).count() == 1
    with pytest.raises(ValueError):
        joins.dataset_product(base, wide, base.select("instrument_id").distinct(), ["nope"])


# ---- quality -----------------------------------------------------------------------------------------------------

def test_quality_rules(spark):
    rows = [(f"{k:06d}", f"2024-01-0{d}", 1.0) for d, n in ((1, 10), (2, 9), (3, 7)) for k in range(n)]
    df = days(spark.createDataFrame(rows, "instrument_id string, trade_date string, close double"))
    rules = [{"type": "unique_key", "key": ["instrument_id", "trade_date"]}, {"type": "expression", "expr": "close > 0"},
             {"type": "stock_coverage_vs_trade_days", "min_ratio_p50": 0.85, "min_ratio_p10": 0.65}]
    report = q.validate(df, rules, ["close"], ["instrument_id", "trade_date"]).collect()
    assert len(report) == 4 and all(r["passed"] for r in report)
    assert q.enforce(df, rules).count() == 26
    with pytest.raises(ValueError, match="coverage|stock_coverage"):
        q.enforce(df, [{"type": "stock_coverage_vs_trade_days", "min_ratio_p10": 0.9}])
    with pytest.raises(ValueError):
        q.validate(df, [], ["volume"])
    late = spark.createDataFrame([(dt.datetime(2024, 1, 2, 12, 5),), (dt.datetime(2024, 1, 2, 11, 30, 59),), (None,)], "ts timestamp_ntz")
    assert q.session(late).first()["failed_rows"] == 2


# ---- folds and splits --------------------------------------------------------------------------------------------

def test_fold_gaps(spark):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    df = spark.createDataFrame([("a", d) for d in dates], "instrument_id string, trade_date date")
    folds = sp.rolling_folds(df, folds=2, window=4, step=4, purge=3, embargo=2, horizon=3, sequence_length=3).orderBy("fold").collect()
    pos = {d: k for k, d in enumerate(dates)}
    assert pos[folds[1]["end_date"]] == 26 and pos[folds[1]["start_date"]] - pos[folds[0]["end_date"]] - 1 == 2
    start = pos[folds[0]["start_date"]]
    assert pos[folds[0]["train_end"]] == start - 3 and pos[folds[0]["context_start"]] == start - 2
    with pytest.raises(Exception, match="labelled days"):
        sp.rolling_folds(df, folds=9, window=4).collect()
    with pytest.raises(ValueError):
        sp.rolling_folds(df, folds=0)
    auto = sp.auto_split(df, last_days=5).first()
    assert (auto["train_end"], auto["test_start"]) == (dates[24], dates[25])


def test_label_and_sequences(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(o)) for k, o in enumerate([1, 2, 4, 8, 16, 32, 64])] + [("b", dt.date(2024, 1, 1), 5.0)]
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, open double")
    from tidepanel.functions.factor import with_factors
    out = with_factors(df, {"y": lb.forward_return(), "v": lb.forward_volatility()}).where("instrument_id = 'a'").orderBy("trade_date").collect()
    assert out[0]["y"] == pytest.approx(15.0) and out[0]["v"] == pytest.approx(0.0, abs=1e-9) and out[3]["y"] is None and out[6]["v"] is None
    seq = sq.sequences(df, ["open"], 3, min_names=1).orderBy("trade_date").collect()
    assert len(seq) == 5 and [s["features"][0] for s in seq[0]["sequence"]] == [1.0, 2.0, 4.0]
    assert sq.sequences(df, ["open"], 3, min_names=2).count() == 0
    last = sq.latest_sequences(df, ["open"], 3).collect()
    assert len(last) == 1 and [s["features"][0] for s in last[0]["sequence"]] == [16.0, 32.0, 64.0]


# ---- portfolios and strategies -----------------------------------------------------------------------------------

def book(spark, scores, industries=None):
    rows = [("d", n, float(s), k, (industries or {}).get(n)) for k, (n, s) in enumerate(scores)]
    return spark.createDataFrame(rows, "trade_date string, instrument_id string, score double, position int, industry string")


def test_portfolio_cases(spark):
    scores = {"kiwi": 3.1, "lime": 2.9, "pear": 2.95, "plum": 0.4, "fig": 2.0, "date": -1.5}
    table = book(spark, list(scores.items()), {"kiwi": "tart", "lime": "tart", "pear": "sweet", "plum": "tart", "date": "sweet"})
    by_score = sorted(scores, key=lambda n: -scores[n])
    for k in (1, 4, 6):
        got = pf.portfolio(table, k).orderBy("rank").collect()
        assert [(r["instrument_id"], r["weight"]) for r in got] == [(n, 1 / k) for n in by_score[:k]]
    assert ids(pf.select_names(table, 5, max_per_industry=1).orderBy("rank")) == ["kiwi", "pear", "fig"]
    assert ids(pf.select_names(table, 3, max_per_industry=2).orderBy("rank")) == by_score[:3]
    held = spark.createDataFrame([("lime",), ("gone",)], "instrument_id string")
    turned = pf.select_names(table, 3, previous=held, penalty=0.3)
    assert ids(turned.orderBy("rank")) == sorted(scores, key=lambda n: -(scores[n] - 0.3 * (n != "lime")))[:3]
    ties = pf.rank_candidates(book(spark, [("one", 7.0), ("two", 7.0), ("three", 8.0)]), 3)
    assert ids(ties.orderBy("rank")) == ["three", "two", "one"]
    soft = {r["instrument_id"]: r["weight"] for r in pf.portfolio(table, 3, "softmax", 0.5).collect()}
    total = sum(np.exp(scores[n] / 0.5) for n in by_score[:3])
    assert soft == {n: pytest.approx(np.exp(scores[n] / 0.5) / total) for n in by_score[:3]}
    assert pf.select_names(book(spark, [(f"N{k}", k) for k in range(9)]), 8).count() == 8
    with pytest.raises(ValueError, match="8 names"):
        pf.select_names(table, 8, max_names=5)
    with pytest.raises(ValueError):
        pf.select_names(book(spark, []), 0)


def metrics(spark, rows, key):
    return spark.createDataFrame([(f, p, s, m, d, m - 0.2 * d) for f, p, s, m, d in rows], f"{key} string, position int, strategy string, mean_return double, return_std double, risk_adjusted double")


def test_diagnostics_and_ensemble(spark):
    grid = ev.strategy_grid((4, 1), ("softmax", "equal"))
    assert [s.name for s in grid] == ["equal_top1", "softmax_top4", "equal_top4"]
    assert [s.name for s in ev.strategy_grid((9,))] == ["equal_top9"]
    for wrong in (((), ("equal",)), ((0, 3), ("equal",)), ((3,), ("odd",)), ((3,), ())):
        with pytest.raises(ValueError):
            ev.strategy_grid(*wrong)
    means = {"spring": (0.5, 0.2, 0.1), "summer": (-0.4, -0.1, -0.3), "autumn": (0.05, 0.3, 0.2)}
    rows = [(fold, i, s.name, m, 0.01 * i) for fold, values in means.items() for i, (s, m) in enumerate(zip(grid, values))]
    scored = {fold: [m - 0.2 * 0.01 * i for i, m in enumerate(values)] for fold, values in means.items()}
    per, summary = ev.fold_diagnostics(metrics(spark, rows, "fold"))
    best = {fold: max(range(3), key=lambda i: v[i]) for fold, v in scored.items()}
    wins = [grid[i].name for i in best.values()]
    s = summary.first()
    assert {r["strategy"] for r in per.collect()} == set(wins)
    assert s["dominant_strategy"] == max(set(wins), key=wins.count) and s["dominant_wins"] == max(map(wins.count, wins))
    assert (s["folds"], s["best_fold"], s["worst_fold"]) == (3, "spring", "summer")
    assert s["positive_folds"] == sum(scored[f][best[f]] > 0 for f in scored)
    mean, chosen = ev.ensemble(metrics(spark, [("run-" + r[0], *r[1:]) for r in rows], "run"))
    assert {r["strategy"]: r["mean_return"] for r in mean.collect()} == {
        g.name: pytest.approx(np.mean([v[i] for v in means.values()])) for i, g in enumerate(grid)}
    assert chosen.first()["run"] == "run-spring"
    tie = ev.best_strategy(metrics(spark, [("f", 3, "listed_last", 0.4, 0.0), ("f", 2, "listed_first", 0.4, 0.0)], "fold")).first()
    assert tie["strategy"] == "listed_first"


def test_short_days_have_no_strategy_return_and_no_rank_ic(spark):
    rows = [("d1", f"{k}", float(k), float(-k)) for k in range(6)] + [("d2", "0", 1.0, 1.0), ("d2", "1", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "trade_date string, instrument_id string, score double, ret double")
    assert {r["trade_date"] for r in ev.strategy_returns(df, ev.strategy_grid((3,))).collect()} == {"d1"}
    ic = {r["trade_date"]: r["rank_ic"] for r in ev.rank_ic(df).collect()}
    assert ic["d1"] == pytest.approx(-1.0) and ic["d2"] is None


# ---- factors -----------------------------------------------------------------------------------------------------

def mini(spark):
    return days(spark.createDataFrame([("2024-01-01", "1", 10.0, 1.0), ("2024-01-01", "2", 20.0, 1.0), ("2024-01-02", "1", 11.0, 1.0), ("2024-01-02", "2", 18.0, 1.0)],
                                      "trade_date string, instrument_id string, close double, volume double"))


def test_factor_order_stages_and_errors(spark):
    paths = {"up": (4.0, 5.0, 7.0), "down": (9.0, 6.0, 3.0), "flat": (2.0, 2.0, 2.0)}
    bars = days(spark.createDataFrame([(f"2023-06-0{d + 1}", n, v) for n, x in paths.items() for d, v in enumerate(x)],
                                      "trade_date string, instrument_id string, close double"))
    specs = [ct.CrossSpec("place", lambda z, k: k("move"), ranks=("move",)), ct.FactorSpec("move", "diff", {"x": "twice"}),
             ct.FactorSpec("twice", "sql", {"text": "close * 2.0D", "reads": ("close",)}), ct.FactorSpec("mean3", "sma", {"x": "close", "w": 3})]
    order = ct.evaluation_order(specs)
    assert sorted(("twice", "move", "place"), key=order.index) == ["twice", "move", "place"]
    frame = ct.run_factors(bars, specs).frame
    last = {r["instrument_id"]: r for r in frame.where("trade_date = '2023-06-03'").collect()}
    moves = sorted(2 * (x[2] - x[1]) for x in paths.values())
    for n, x in paths.items():
        assert last[n]["place"] == pytest.approx((moves.index(2 * (x[2] - x[1])) + 1) / 3) and last[n]["mean3"] == pytest.approx(np.mean(x))
    assert {r["mean3"] for r in frame.where("trade_date < '2023-06-03'").collect()} == {0.0}
    ring = [ct.FactorSpec(a, "diff", {"x": b}) for a, b in ("pq", "qr", "rp")]
    with pytest.raises(ValueError, match="depend on each other"):
        ct.evaluation_order(ring)
    with pytest.raises(ValueError, match="time series over cross-section"):
        ct.evaluation_order([*specs, ct.FactorSpec("late", "diff", {"x": "place"})])
    with pytest.raises(ValueError, match="unknown factor function"):
        ct.run_factors(bars, [ct.FactorSpec("q", "eval", {"x": "close"})])
    made = ct.run_factors(bars, [ct.FactorSpec("q", "eval", {"x": "close"}), ct.FactorSpec("s", "sma", {"x": "q", "w": 2}), specs[3]], strict=False)
    status = {s[0]: s[1] for s in made.status}
    assert status["q"] == status["s"] == "error" and status["mean3"] != "error" and made.report(spark).count() == 3


def test_catalog(spark):
    builtin = [ct.FactorSpec("a", "sma", {"x": "close", "w": 5}, source="builtin"), ct.FactorSpec("b", "sma", {"x": "close", "w": 9}, source="builtin")]
    live = ct.resolve(builtin, {"a": ct.FactorSpec("a", "sma", {"x": "close", "w": 7})}, [ct.FactorSpec("c", "bbi", {"close": "close"})], ["b"])
    assert [(s.name, s.overridden) for s in live] == [("a", True), ("c", False)]
    assert ct.reload(json.loads(json.dumps(ct.definitions(live)))) == live
    assert ct.catalog_fingerprint(live) == ct.catalog_fingerprint(list(live)) != ct.catalog_fingerprint(live[::-1]) and len(ct.catalog_fingerprint(live)) == 16
    with pytest.raises(ValueError, match="occur twice"):
        ct.resolve(builtin, custom=[builtin[0]])
    with pytest.raises(ValueError, match="unknown factors"):
        ct.resolve(builtin, {"zz": builtin[0]})
    assert {(r["group"], r["factors"]) for r in ct.group_counts(ct.as_table(spark, live)).collect()} == {("custom", 2)}
    assert manifest.check_lineage({"factor_fingerprint": "x"}, {"factor_fingerprint": "x"}) == []
    assert len(manifest.check_lineage({"factor_fingerprint": "x"}, {"factor_fingerprint": "y"})) == 1
    with pytest.raises(ValueError):
        manifest.check_lineage({"factor_fingerprint": "x"}, {"factor_fingerprint": "y"}, strict=True)


def test_feature_set_sizes():
    assert len(fs.alpha158()) == 158
    assert set(fs.tech39_windowed()) | set(fs.tech39_recursive()) == set(fs.TECH39) and len(fs.TECH39) == 31
    assert len(fs.custom_windowed()) + len(fs.custom_recursive()) == 21
    assert set(rec.FUNCTIONS) >= {"ema", "rsi", "adx", "tema"}


def test_factor_graph_small_panel(spark):
    rows = []
    for code, base in (("000001.SZ", 10.0), ("000002.SZ", 20.0)):
        for k in range(25):
            close = base + 0.2 * k
            rows.append((code, (dt.date(2024, 1, 1) + dt.timedelta(days=k)).isoformat(), close - 0.1, close, close + 0.2, close - 0.2, 1000.0 + 5 * k, 0.8 + 0.01 * k, 0.002 + 0.0001 * k))
    raw = spark.createDataFrame(rows, "`股票代码` string, `日期` string, `开盘` double, `收盘` double, `最高` double, `最低` double, `成交量` double, `换手率` double, hf_last_tail_ret double")
    daily = cn.canonical_daily(raw.drop("hf_last_tail_ret"), ["日期"])
    hf = cn.canonical_hf_daily(raw.select("股票代码", "日期", "hf_last_tail_ret"), ["日期"])
    macro = spark.createDataFrame([(s, dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=k), v + 0.01 * k) for s, v in (("m2_yoy", 8.0), ("shibor_3m", 2.5), ("usdcny", 7.1)) for k in range(25)],
                                  "series_id string, available_time timestamp_ntz, value double")
    made = factor_graph(daily, hf_daily=hf, macro=macro)
    out = made.frame
    assert out.count() == 50 and all(s[1] == "ok" for s in made.status) and len(made.status) == len(EXPRESSIONS) + 3
    last = out.where("trade_date = '2024-01-25' AND instrument_id = '000001'").first()
    assert last["f_macro_m2_yoy"] == pytest.approx(8.24) and last["f_hf_tail_ret_30m"] == pytest.approx(0.0044)
    assert last["f_regime_risk_on"] == 0.0 and last["f_turnover_20d_mean"] == pytest.approx(0.8 + 0.01 * 14.5)


def test_stats_and_sampling(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("instrument_id"), F.lit("d").alias("trade_date"), (F.col("id") % 10).cast("double").alias("x"))
    a, b = stats.sample_rows(df, 50), stats.sample_rows(df.repartition(7), 50)
    assert sorted(ids(a)) == sorted(ids(b)) and a.count() == 50
    h = stats.histogram(df, "x", 3).orderBy("bin").collect()
    assert [r["n"] for r in h] == [150, 150, 200]
    assert stats.feature_stats(df, ["x"]).first()["mean"] == pytest.approx(4.5)
    one, two = manifest.data_hash(df).first(), manifest.data_hash(df.repartition(3)).first()
    assert one == two and manifest.data_hash(df.withColumn("x", F.col("x") + 1)).first() != one


def test_training_log(spark, tmp_path):
    text = """Train loss: 9.0
=== Epoch 1/2 ===
Train loss: 0.5
Eval loss: 0.4
Eval loss: 0.3
当前最优持仓策略: equal_top3 | 验证目标值: 0.01 | 策略收益均值: 0.02 | RankIC: -0.05
早停状态: monitor=loss, value=0.3, best=0.2, bad_epochs=1/5
=== Epoch 2/2 ===
  - price: features=12, return=0.011, delta=-0.002
触发早停: monitor=loss, mode=min, patience=5, best=0.2
"""
    (tmp_path / "run.log").write_text(text, encoding="utf-8")
    out = logs.parse_training_log(logs.read_log_lines(spark, str(tmp_path / "run.log")))
    assert {(r["epoch"], r["name"], r["value"]) for r in out["metrics"].collect()} == {(1, "train_loss", 0.5), (1, "eval_loss", 0.3)}
    b = out["best"].first()
    assert (b["strategy"], b["objective"], b["rank_ic"]) == ("equal_top3", 0.01, -0.05)
    assert [(r["epoch"], r["factor_group"], r["num_features"]) for r in out["ablation"].collect()] == [(2, "price", 12)]
    assert {(r["epoch"], r["triggered"], r["patience"]) for r in out["early_stop"].collect()} == {(1, False, 5), (2, True, 5)}
