"""Recursive indicators against step-by-step definitions written out here."""

import numpy as np
import pandas as pd

from tidepanel.functions import recursive as rec

RNG = np.random.default_rng(3)
N = 90
CLOSE = 50 + np.cumsum(RNG.normal(size=N))
HIGH, LOW = CLOSE + RNG.uniform(0, 2, N), CLOSE - RNG.uniform(0, 2, N)
VOLUME = RNG.uniform(1, 100, N)


def seeded(values, n, alpha):
    out = [np.nan] * (n - 1) + [float(np.mean(values[:n]))]
    for v in values[n:]:
        out.append(out[-1] + alpha * (v - out[-1]))
    return np.array(out)


def test_pandas_ema_starts_at_first_value():
    x = np.concatenate([[np.nan, np.nan], CLOSE])
    got = rec.ema(x, span=5)
    assert np.isnan(got[:2]).all() and got[2] == CLOSE[0]
    np.testing.assert_allclose(got[3], CLOSE[0] + (CLOSE[1] - CLOSE[0]) / 3)


def test_seeded_ema_and_macd():
    np.testing.assert_allclose(rec.seeded_ema(CLOSE, n=12), seeded(CLOSE, 12, 2 / 13))
    slow = seeded(CLOSE, 26, 2 / 27)
    fast = np.concatenate([[np.nan] * 14, seeded(CLOSE[14:], 12, 2 / 13)])
    line = fast - slow
    signal = np.concatenate([[np.nan] * 25, seeded(line[25:], 9, 2 / 10)])
    np.testing.assert_allclose(rec.macd_signal(CLOSE), signal)
    got = rec.macd_line(CLOSE)
    assert np.isnan(got[:33]).all()
    np.testing.assert_allclose(got[33:], line[33:])


def test_rsi_cmo_and_their_flat_case():
    step = np.diff(CLOSE)
    gain, loss = np.maximum(step, 0), np.maximum(-step, 0)
    g, l = seeded(gain, 14, 1 / 14), seeded(loss, 14, 1 / 14)
    np.testing.assert_allclose(rec.rsi(CLOSE, n=14)[1:], 100 * g / (g + l))
    np.testing.assert_allclose(rec.cmo(CLOSE, n=14)[1:], 100 * (g - l) / (g + l))
    flat = rec.rsi(np.full(20, 3.0), n=14)
    assert np.isnan(flat[:14]).all() and (flat[14:] == 0).all()


def test_atr_adx():
    n = 14
    tr = np.array([max(HIGH[i] - LOW[i], abs(HIGH[i] - CLOSE[i - 1]), abs(LOW[i] - CLOSE[i - 1])) for i in range(1, N)])
    np.testing.assert_allclose(rec.atr(HIGH, LOW, CLOSE, n=n)[1:], seeded(tr, n, 1 / n))
    up, down = np.diff(HIGH), -np.diff(LOW)
    plus = np.where((up > 0) & (up > down), up, 0)
    minus = np.where((down > 0) & (down > up), down, 0)
    sums = [plus[:n - 1].sum(), minus[:n - 1].sum(), tr[:n - 1].sum()]
    dx = []
    for i in range(n - 1, N - 1):
        sums = [s - s / n + v for s, v in zip(sums, (plus[i], minus[i], tr[i]))]
        p, m = sums[0] / sums[2], sums[1] / sums[2]
        dx.append(100 * abs(p - m) / (p + m))
    want = seeded(np.array(dx), n, 1 / n)
    got = rec.adx(HIGH, LOW, CLOSE, n=n)
    assert np.isnan(got[:2 * n - 1]).all()
    np.testing.assert_allclose(got[2 * n - 1:], want[n - 1:])


def test_tema_and_chaikin():
    n = 10
    e1 = seeded(CLOSE, n, 2 / 11)
    e2 = np.concatenate([[np.nan] * 9, seeded(e1[9:], n, 2 / 11)])
    e3 = np.concatenate([[np.nan] * 18, seeded(e2[18:], n, 2 / 11)])
    np.testing.assert_allclose(rec.tema(CLOSE, n=n), 3 * e1 - 3 * e2 + e3)
    ad = np.cumsum(((CLOSE - LOW) - (HIGH - CLOSE)) / (HIGH - LOW) * VOLUME)
    want = pd.Series(ad).ewm(span=3, adjust=False).mean() - pd.Series(ad).ewm(span=10, adjust=False).mean()
    got = rec.chaikin_osc(HIGH, LOW, CLOSE, VOLUME)
    assert np.isnan(got[:9]).all()
    np.testing.assert_allclose(got[9:], want[9:])


def test_one_pass_over_instruments(spark):
    rows = [(k, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=i), float(CLOSE[i] * f)) for k, f in (("a", 1), ("b", 2)) for i in range(N)]
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, close double")
    out = rec.with_recursive(df.repartition(5), {"e": rec.recursive("seeded_ema", "close", n=12), "r": rec.recursive("rsi", "close", n=14)})
    got = out.where("instrument_id = 'b'").orderBy("trade_date").toPandas()
    np.testing.assert_allclose(got["e"].to_numpy(dtype=float), seeded(CLOSE * 2, 12, 2 / 13))
    assert out.where("e IS NULL").count() == 22  # a missing value is NULL, not NaN


def test_a_table_of_histories_is_evaluated_like_each_of_them():
    rng = np.random.default_rng(4)
    lengths = [1, 2, 30, 59, 60, *rng.integers(20, 60, 25)]
    table = np.full((4, len(lengths), 60), np.nan)
    for i, n in enumerate(lengths):
        table[:, i, :n] = 3.0 if i % 9 == 2 else rng.lognormal(0, 1, (4, n))
        table[:, i, 12] = np.nan if i % 5 == 0 else table[:, i, 12]
    calls = {"ema": (1, dict(span=5)), "seeded_ema": (1, dict(n=6)), "macd_line": (1, {}), "macd_signal": (1, {}), "rsi": (1, dict(n=5)), "cmo": (1, dict(n=5)),
             "atr": (3, dict(n=5)), "adx": (3, dict(n=5)), "tema": (1, dict(n=5)), "chaikin_osc": (4, {}), "chaikin_volatility": (2, dict(n=4)),
             "last_quantile": (1, dict(n=7, q=0.8)), "last_rank": (1, dict(n=7)), "last_argmax": (1, dict(n=7)), "last_argmin": (1, dict(n=7))}
    assert calls.keys() == rec.FUNCTIONS.keys()
    with np.errstate(all="ignore"):
        for name, (k, params) in calls.items():
            got = rec.FUNCTIONS[name](*table[:k], **params)
            for i, n in enumerate(lengths):
                np.testing.assert_allclose(got[i, :n], rec.FUNCTIONS[name](*table[:k, i, :n], **params), rtol=1e-9, atol=1e-9, err_msg=name)


def test_histories_are_not_passed_one_by_one(spark):
    n = 300
    df = spark.range(n * 700).selectExpr(f"IF(id % {n} = 7, NULL, CAST(id % {n} AS STRING)) AS instrument_id", f"CAST(id DIV {n} AS INT) AS trade_date",
                                         "CAST(hash(id) AS DOUBLE) / 1e6 AS x").where(f"hash(instrument_id) % 3 <> 0 OR trade_date < 40")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # more rows than are evaluated together
    try:
        out = rec.with_recursive(df, {"e": rec.recursive("ema", "x", span=9)})
        assert "InArrow" in out._jdf.queryExecution().executedPlan().toString() and "Groups" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.toPandas().sort_values(["instrument_id", "trade_date"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == df.count() > rec.PASS_ROWS
    want = got.groupby("instrument_id", dropna=False)["x"].transform(lambda x: x.ewm(span=9, adjust=False).mean())
    np.testing.assert_allclose(got["e"].to_numpy(dtype=float), want.to_numpy())
