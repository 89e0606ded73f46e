"""What the pair work emits and what its users read."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidepanel.operators import edges as eg
from tidepanel.operators import pairs
from test_plans import plan


def test_qualified_pairs_come_once_and_are_not_compared_again(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=30)
    rows = [(f"{i:06d}", f"2024-01-{d + 1:02d}", float(base[d] * (1 + i) + 0.01 * rng.normal())) for i in range(12) for d in range(30)]
    df = spark.createDataFrame(rows, "instrument_id string, day string, x double").select("instrument_id", F.to_date("day").alias("trade_date"), "x")
    found = pairs.similar_pairs(eg._histories(df, "x"), [], "instrument_id", eg._Correlation(10), "history", F.size("history.day"), 2, 0.9, block_rows=5)
    assert found.where("not candidate").count() == 12 * 11 // 2  # each way of each pair before
    edges = eg.correlation_edges(df, "x", 10, 0.9, 0)
    assert edges.count() == 12 * 11 and "Exchange" not in plan(edges)


def test_industries_of_edges_are_looked_up_where_the_edges_are(spark):
    from workloads import registered
    text = plan(registered()["edges_within_industry"].run(spark, "/root/testdata/sf0.001"))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_few_copies_of_the_best_names(spark):
    rows = spark.range(2000).select(F.lit("d").alias("trade_date"), F.col("id"), F.rand(1).alias("x"))
    cells = pairs.rectangular_cells(rows.where("id < 200"), rows, ["trade_date"], "id", F.lit(1), 4)
    assert cells.count() == 200 * pairs.GRID + 2000  # 200 * 500 + 2000 * 50 before


def test_pairwise_loss_of_any_scale(spark):
    from tidepanel.operators import evaluation as ev
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 50.0, 1e4):
        p, q = rng.normal(size=300) * scale, rng.normal(size=700) * scale
        y, z = rng.integers(0, 9, 300).astype(float), rng.integers(-3, 9, 700).astype(float)
        gap = y[:, None] - z[None, :]
        want = (np.logaddexp(0.0, q[None, :] - p[:, None]) * gap)[gap > 0].sum()
        total, n = ev.pairwise_loss_sum((p, y), (q, z), 64)
        assert n == (gap > 0).sum() and abs(total - want) <= 1e-10 * abs(want)


def test_best_partners_come_from_the_pairs_that_reached_the_threshold():
    """Once every row has k partners at the threshold, the rest of a table is not searched for better ones."""
    rng = np.random.default_rng(8)
    score = np.rint(rng.normal(size=(40, 600)) * 4)
    k, least = 3, 6.0
    ids = pa.array([f"{i:03d}" for i in rng.permutation(600)])
    best = pairs._Best(40, k, ids)
    searched = []
    for s in range(0, 600, 60):
        table, to = score[:, s:s + 60], np.arange(s, s + 60)
        line, column = np.nonzero(table >= least)
        full = best.score[:, -1].min() >= least
        if full:  # what did not reach the threshold must not be looked at
            table = np.where(table >= least, table, np.inf)
        searched.append(not full)
        best.add(np.arange(40), to, table, (least, line, column))
    assert searched[0] and not searched[-1]
    row, other, value = best.found()
    names = ids.to_pylist()
    for i in range(40):
        want = sorted(range(600), key=lambda j: (-score[i, j], names[j]))[:k]
        assert other[row == i].tolist() == want and value[row == i].tolist() == score[i, want].tolist()
