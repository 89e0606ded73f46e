"""Factor functions against pandas, on series with gaps, ties, constants and short histories."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import rolling as r
from tidepanel.functions import scalar as s
from tidepanel.functions.factor import factor, with_factors

W = 6


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for name, n in (("a", 60), ("b", 40), ("c", 4), ("flat", 30), ("ties", 50)):
        x = np.full(n, 5.0) if name == "flat" else rng.integers(1, 5, n).astype(float) if name == "ties" else rng.lognormal(1, 0.5, n)
        y = rng.lognormal(0, 1, n)
        for i in range(n):
            gap = name == "b" and i % 9 == 4
            rows.append((name, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i), None if gap else float(x[i]), float(y[i])))
    pdf = pd.DataFrame(rows, columns=["instrument_id", "trade_date", "x", "y"])
    pdf["x"] = pdf["x"].astype(float)
    df = spark.createDataFrame([(a, b.date(), None if np.isnan(c) else c, d) for a, b, c, d in pdf.itertuples(index=False)],
                               "instrument_id string, trade_date date, x double, y double")
    return df, pdf


def _each(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.groupby("instrument_id", sort=True)]).to_numpy(dtype=float)


def _fit(values, pick):
    slope, at0 = np.polyfit(np.arange(len(values)), values, 1)
    return pick(slope, at0)


CASES = {
    "shift": (lambda: r.shift("x", 2), lambda g: g.x.shift(2)),
    "lead": (lambda: r.shift("x", -2), lambda g: g.x.shift(-2)),
    "diff": (lambda: r.diff("x", 3), lambda g: g.x.diff(3)),
    "pct": (lambda: r.pct_change("x", 2), lambda g: g.x.pct_change(2, fill_method=None)),
    "sma": (lambda: r.sma("x", W), lambda g: g.x.rolling(W).mean()),
    "std": (lambda: r.rolling_std("x", W), lambda g: g.x.rolling(W).std()),
    "min": (lambda: r.rolling_min("x", W), lambda g: g.x.rolling(W).min()),
    "sum": (lambda: r.rolling_sum("x", W), lambda g: g.x.rolling(W).sum()),
    "skew": (lambda: r.rolling_skew("y", W), lambda g: g.y.rolling(W).skew()),
    "q": (lambda: r.rolling_quantile("x", W, 0.3), lambda g: g.x.rolling(W).quantile(0.3)),
    "rank": (lambda: r.rank_pct("x", W), lambda g: g.x.rolling(W).rank(pct=True)),
    "z": (lambda: r.zscore("y", W), lambda g: (g.y - g.y.rolling(W).mean()) / (g.y.rolling(W).std() + 1e-12)),
    "argmax": (lambda: r.argmax_ratio("x", W), lambda g: g.x.rolling(W).apply(np.argmax, raw=True) / W),
    "argmin": (lambda: r.argmin_ratio("x", W), lambda g: g.x.rolling(W).apply(np.argmin, raw=True) / W),
    "corr": (lambda: r.rolling_corr("x", "y", W), lambda g: g.x.rolling(W).corr(g.y).where(g.x.rolling(W).std() > 1e-9)),
    "slope": (lambda: r.linearreg_slope("y", W), lambda g: g.y.rolling(W).apply(lambda a: _fit(a, lambda k, c: k), raw=True)),
    "resid": (lambda: r.linearreg_residual("y", W), lambda g: g.y.rolling(W).apply(lambda a: a[-1] - _fit(a, lambda k, c: c + k * (W - 1)), raw=True)),
    "up": (lambda: r.direction_up_rate("y", W), lambda g: (g.y > g.y.shift(1)).astype(float).rolling(W).mean()),
    "gain": (lambda: r.diff_up_ratio("y", W), lambda g: g.y.diff().clip(lower=0).rolling(W).sum() / (g.y.diff().abs().rolling(W).sum() + 1e-12)),
    "nested": (lambda: r.rolling_std(r.pct_change("y"), W), lambda g: g.y.pct_change(fill_method=None).rolling(W).std()),
    "rank_of_sma": (lambda: r.rank_pct(r.sma("y", 3), W), lambda g: g.y.rolling(3).mean().rolling(W).rank(pct=True)),
}


def test_against_pandas(panel):
    df, pdf = panel
    made = with_factors(df, {k: make() for k, (make, _) in CASES.items()})
    got = made.orderBy("instrument_id", "trade_date").toPandas()
    for name, (_, want) in CASES.items():
        expected = _each(pdf, want)
        actual = got[name].to_numpy(dtype=float)
        assert (np.isnan(actual) == np.isnan(expected)).all(), name
        np.testing.assert_allclose(actual, expected, rtol=1e-8, atol=1e-9, err_msg=name)


def test_constant_window_has_zero_skew_and_no_correlation(panel):
    df, _ = panel
    rows = with_factors(df.where("instrument_id = 'flat'"), {"s": r.rolling_skew("x", W), "c": r.rolling_corr("x", "y", W)}).collect()
    assert [x["s"] for x in rows[W - 1:]] == [0.0] * (len(rows) - W + 1)
    assert all(x["c"] is None for x in rows)


def test_equal_helpers_are_made_once(panel):
    df, _ = panel
    step = r.pct_change("y")
    made = with_factors(df, {"a": r.sma(step, 5), "b": r.rolling_std(step, 5) / r.sma(step, 5)})
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(") == 1
    assert made.columns == [*df.columns, "a", "b"]


def test_clip_and_minmax_keep_missing_values(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (9.0, None)], "a double, b double")
    got = with_factors(df, {"c": s.clip("a", 2.0, 5.0), "m": s.maximum("a", "b"), "rm": s.row_max("a", "b"),
                            "l": s.log(factor("a") - 9.0), "q": s.sqrt(factor("a") - 2.0)}).collect()
    assert [x["c"] for x in got] == [2.0, None, 5.0]
    assert [x["m"] for x in got] == [3.0, None, None]
    assert [x["rm"] for x in got] == [3.0, 3.0, 9.0]
    assert got[0]["l"] is None and got[0]["q"] is None and got[2]["l"] is None


@pytest.mark.parametrize("w", [9, 10, 13, 14, 15, 26, 30])
def test_windows_joined_from_shorter_ones(spark, w):
    rng = np.random.default_rng(w)
    rows = []
    for name, n in (("a", 90), ("b", 90), ("flat", 60), ("short", w - 1), ("steps", 90)):
        x = np.full(n, 0.1) if name == "flat" else np.repeat(rng.lognormal(0, 3, n // 30 + 1), 30)[:n] if name == "steps" else rng.integers(1, 9, n) / 10
        rows += [(name, i, None if name == "b" and i == 40 else float(x[i]), float(rng.lognormal(0, 1))) for i in range(n)]
    df = spark.createDataFrame(rows, "instrument_id string, trade_date int, x double, y double")
    made = {"sum": (r.rolling_sum("x", w), F.sum("x")), "avg": (r.sma("x", w), F.avg("x")), "low": (r.rolling_min("x", w), F.min("x")),
            "high": (r.rolling_max("x", w), F.max("x")), "std": (r.rolling_std("x", w), F.stddev_samp("x")),
            "pstd": (r.population_std("x", w), F.stddev_pop("x")), "slope": (r.linearreg_slope("x", w), F.regr_slope("x", F.col("trade_date").cast("double")))}
    last = Window.partitionBy("instrument_id").orderBy("trade_date").rowsBetween(1 - w, 0)
    full = F.count("x").over(last) == w
    plain = {f"{n}_": F.when(full, agg.over(last)) for n, (_, agg) in made.items()}
    covar, both = F.covar_samp("x", "y").over(last), F.stddev_samp("x").over(last) * F.stddev_samp("y").over(last)
    plain["corr_"] = F.when(full, F.try_divide(covar, both))
    values = F.collect_list("x").over(last)
    plain["top_"] = F.when(full, (F.array_position(values, F.array_max(values)) - 1) / w)
    plain["bottom_"] = F.when(full, (F.array_position(values, F.array_min(values)) - 1) / w)
    factors = {n: f for n, (f, _) in made.items()} | {"corr": r.rolling_corr("x", "y", w), "top": r.argmax_ratio("x", w), "bottom": r.argmin_ratio("x", w)}
    got = with_factors(df.withColumns(plain), factors).orderBy("instrument_id", "trade_date").toPandas()
    for n in factors:
        mine, want = got[n].to_numpy(dtype=float), got[f"{n}_"].to_numpy(dtype=float)
        assert (np.isnan(mine) == np.isnan(want)).all(), n
        np.testing.assert_allclose(mine, want, rtol=1e-9, atol=1e-12, err_msg=n)
    still = got[got["pstd_"] == 0.0]
    assert len(still) and (still["pstd"] == 0.0).all() and still["corr"].isna().all()
