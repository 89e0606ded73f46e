"""Steps between the rows of a day against pandas, with slots of one row and of many."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import intraday as i


def days(seed):
    rng, rows = random.Random(seed), []
    for name, n in (("000001", 1), ("000002", 2), ("000003", 90), ("000004", 40)):
        for day in (2, 3):
            at = dt.datetime(2024, 1, day, 9, 30)
            for _ in range(n):
                at += dt.timedelta(seconds=rng.choice((1, 7, 59, 61, 400)))
                rows.append((name, at.date(), at, rng.choice((None, 10 + rng.random() * 5)), float(rng.randint(0, 9)) if rng.random() < 0.9 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slot", [60, 3600])
def test_nested_steps(spark, slot):
    rows = days(4)
    df = spark.createDataFrame(rows, "instrument_id string, trade_date date, ts timestamp_ntz, close double, volume double")
    move = i.diff(i.log("close"))
    out = i.day_aggregates(df, {
        "path": i.day_agg("sum", i.absolute(move)), "bend": i.day_agg("mean", i.diff(i.diff("volume"))),
        "third": i.day_agg("last", i.diff(i.diff(i.diff("close")))), "root": i.day_agg("max", i.sqrt(i.diff("volume"))),
        "mixed": i.day_agg("sum", (2.0 - i.diff("volume")) * "close" / (i.series("close") + 1.0)),
        "ratio": i.day_agg("mean", 1.0 / i.series("volume"))}, 1, slot)
    got = {(r["instrument_id"], r["trade_date"]): r for r in out.collect()}
    frame = pd.DataFrame(rows, columns=["id", "day", "ts", "close", "volume"]).astype({"close": float, "volume": float}).dropna(subset=["close"])
    assert len(got) == frame.groupby(["id", "day"]).ngroups
    with np.errstate(invalid="ignore", divide="ignore"):
        for key, g in frame.sort_values("ts").groupby(["id", "day"]):
            c, v = g["close"], g["volume"]
            third = c.diff().diff().diff().dropna()
            want = {"path": np.log(c + 1e-12).diff().abs().sum(), "bend": v.diff().diff().mean(), "third": third.iloc[-1] if len(third) else np.nan,
                    "root": np.sqrt(v.diff()).max(), "mixed": ((2 - v.diff()) * c / (c + 1)).sum(), "ratio": (1 / v.where(v != 0)).mean()}
            for name, value in want.items():
                assert (got[key][name] is None) if np.isnan(value) else got[key][name] == pytest.approx(value, rel=1e-9), (key, name)
