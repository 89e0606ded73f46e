"""Block-wise pair work equals brute force, whatever the block size."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import edges as eg
from tidepanel.operators import evaluation as ev


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i < 70 else "cold", int(i), [float(v) for v in rng.normal(size=8)]) for i in range(90)]
    return spark.createDataFrame(rows, "grp string, vid bigint, vec array<double>"), rows


@pytest.mark.parametrize("block", [7, 33, 1000])
def test_similarity_knn(vectors, block):
    df, rows = vectors
    got = {(r["grp"], r["src"], r["dst"]) for r in eg.similarity_knn(df, ["grp"], "vid", "vec", 4, block_rows=block).collect()}
    want = set()
    for g in ("hot", "cold"):
        part = [(i, np.array(v)) for grp, i, v in rows if grp == g]
        for i, v in part:
            scored = sorted(((-round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 9), j) for j, u in part))
            want |= {(g, i, j) for _, j in scored[:4]} | {(g, i, i)}
    assert got == want


@pytest.mark.parametrize("block", [5, 1000])
def test_correlation_edges(spark, block):
    rng = np.random.default_rng(4)
    days = pd.date_range("2024-01-01", periods=30)
    base = rng.normal(size=30)
    table = pd.DataFrame({f"{i:06d}": base * (i % 3) + rng.normal(size=30) for i in range(17)}, index=days)
    table.iloc[:15, 3] = np.nan
    table.iloc[5:, 9] = np.nan   # too few common days with anything
    table.iloc[:, 12] = 1.0      # constant
    long = table.rename_axis("trade_date").reset_index().melt("trade_date", var_name="instrument_id", value_name="x").dropna()
    df = spark.createDataFrame([(a, b.date(), float(c)) for b, a, c in long.itertuples(index=False)], "instrument_id string, trade_date date, x double")
    got = {(r["src"], r["dst"]): r["weight"] for r in eg.correlation_edges(df, "x", min_periods=10, threshold=0.4, k=2, block_rows=block).collect()}
    size = table.corr(min_periods=10).abs().fillna(0.0).round(9)
    want = set()
    for a in size.index:
        others = sorted((-size.loc[a, b], b) for b in size.columns if b != a)
        want |= {(a, b) for _, b in others[:2]} | {(a, b) for v, b in others if -v >= 0.4}
    want |= {(b, a) for a, b in want}
    assert set(got) == want
    for (a, b), w in got.items():
        assert w == pytest.approx(size.loc[a, b], abs=1e-8)


@pytest.mark.parametrize("block", [6, 1000])
def test_pairwise_loss(spark, block):
    rng = np.random.default_rng(8)
    rows = [("d1", f"{i:06d}", float(rng.normal()), float(rng.integers(0, 5))) for i in range(50)] + [("d2", "000001", 0.3, 1.0)]
    df = spark.createDataFrame(rows, "trade_date string, instrument_id string, score double, target double")
    got = {r["trade_date"]: r["pairwise_logistic"] for r in ev.pairwise_logistic(df, block_rows=block).collect()}
    day = sorted([r for r in rows if r[0] == "d1"], key=lambda r: (-r[3], r[1]))
    pairs = [(a, b) for a in day[:5] for b in day if a[3] > b[3]]
    want = sum(np.log1p(np.exp(-(a[2] - b[2]))) * (a[3] - b[3]) for a, b in pairs) / (len(pairs) + 1e-8)
    assert got["d1"] == pytest.approx(want)
    assert got["d2"] == 0.0


def test_prior_graph_counts_without_clique_rows(spark):
    dim = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", None)], "instrument_id string, industry string")
    corr = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("d", "e", 1.0), ("e", "d", 1.0)], "src string, dst string, weight double")
    got = eg.prior_graph_stats(dim, corr).first()
    # 9 clique entries; 6 + 2 new + 5 loops after merging
    assert (got["nodes"], got["industry_edges"], got["corr_edges"], got["merged_edges"]) == (5, 9, 4, 13)
    assert got["density"] == pytest.approx(13 / 25)
    degree = {r["instrument_id"]: r["degree"] for r in eg.industry_degree(dim).collect()}
    assert degree == {"a": 2, "b": 2, "c": 2, "d": 0, "e": 0}
    with pytest.raises(ValueError):
        eg.combine_edges(corr, corr, "xor")


def test_rows_are_sent_to_few_cells(spark):
    from pyspark.sql import functions as F

    from tidepanel.operators import pairs
    df = spark.range(400).select("id", F.array(F.rand(1)).alias("v"))
    sent = pairs._cells(df, [], "id", F.size("v"), 2).count().agg(F.sum("count"), F.count(F.lit(1))).first()
    assert tuple(sent) == (400 * pairs.GRID, pairs.GRID * (pairs.GRID + 1) // 2)  # not 400 rows in 200 blocks


@pytest.mark.parametrize("block", [2, 16, 1000])
def test_correlations_over_gaps(spark, block):
    """Whole histories, few kinds of gaps, many, copies, constants and infinities, whatever lies in one piece."""
    rng = np.random.default_rng(6)
    days = pd.date_range("2024-01-01", periods=24)
    table = pd.DataFrame(rng.normal(size=(24, 90)), index=days, columns=[f"{i:06d}" for i in range(90)])
    table.iloc[-1, 30:60] = np.nan
    table.iloc[:, 60:75] = table.iloc[:, 60:75].mask(rng.random((24, 15)) < 0.3)
    table.iloc[:, 80], table.iloc[:, 81], table.iloc[:, 82] = table.iloc[:, 3], table.iloc[:, 40], 2.0
    table.iloc[:20, 83] = np.nan
    size = table.corr(min_periods=12).abs().fillna(0.0).round(9)
    table.iloc[4, 84] = np.inf
    size.loc["000084"] = size["000084"] = 0.0
    long = table.rename_axis("trade_date").reset_index().melt("trade_date", var_name="instrument_id", value_name="x").dropna()
    df = spark.createDataFrame([(a, b.date(), float(c)) for b, a, c in long.itertuples(index=False)], "instrument_id string, trade_date date, x double")
    off = size.where(~np.eye(len(size), dtype=bool), 0.0)
    got = {r["instrument_id"]: (r["degree"], r["weight"]) for r in eg.correlation_degrees(df, "x", 12, 0.2, block).collect()}
    assert {a: n for a, (n, _) in got.items()} == (off >= 0.2).sum(axis=1).to_dict()
    assert {a: w for a, (_, w) in got.items()} == pytest.approx(off.where(off >= 0.2, 0.0).sum(axis=1).to_dict(), abs=1e-6)
    edges = [(r["src"], r["dst"], r["weight"]) for r in eg.correlation_edges(df, "x", 12, 0.5, 3, block).collect()]
    want = set()
    for a in size.index:
        others = sorted((-size.loc[a, b], b) for b in size.columns if b != a)
        want |= {(a, b) for _, b in others[:3]} | {(a, b) for v, b in others if -v >= 0.5}
    want |= {(b, a) for a, b in want}
    assert len(edges) == len(want) and {(a, b) for a, b, _ in edges} == want
    assert all(w == pytest.approx(size.loc[a, b], abs=1e-8) for a, b, w in edges)
