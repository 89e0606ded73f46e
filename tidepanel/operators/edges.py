"""Instrument graphs as edge tables.

An industry is a clique.  Its edges are never written out (a hot industry would have quadratically many): it is
kept as membership, from which edge counts, degrees and "is this pair in the same industry" follow by aggregation
and equi joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .ordering import dense_index, top_rows
from .pairs import BLOCK_ROWS, Scores, pair_degrees, similar_pairs


def industry_groups(dim: DataFrame, industry: str = "industry") -> DataFrame:
    """Industries of at least two members with their number of directed edges, self loops included."""
    sizes = dim.where(F.col(industry).isNotNull() & (F.trim(industry) != "")).groupBy(industry).agg(
        F.count_distinct("instrument_id").alias("members"))
    return sizes.where(F.col("members") > 1).withColumn("edges", F.col("members") * F.col("members"))


def industry_degree(dim: DataFrame, industry: str = "industry") -> DataFrame:
    """(instrument_id, degree): other members of the instrument's industry."""
    sizes = industry_groups(dim, industry).select(industry, (F.col("members") - 1).alias("degree"))
    joined = dim.select("instrument_id", industry).distinct().join(sizes, industry, "left")
    return joined.select("instrument_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def within_industry(edges: DataFrame, dim: DataFrame, industry: str = "industry") -> DataFrame:
    """Edges with ``same_industry``: the intersection with the industry graph without writing that graph out."""
    a = dim.select(F.col("instrument_id").alias("src"), F.col(industry).alias("_ia"))
    b = dim.select(F.col("instrument_id").alias("dst"), F.col(industry).alias("_ib"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    return joined.select(*edges.columns, F.coalesce(F.col("_ia") == F.col("_ib"), F.lit(False)).alias("same_industry"))


class _Correlation(Scores):
    """|Pearson| over the days both have; 0 where there are too few or one side is constant.

    Rows with the same days lie together.  A sum over common days takes the days that all of the other side's rows have from
    one sum per row; only days that some have and some lack need a product, and two pieces without such days need one
    product for everything.
    """

    def __init__(self, min_periods: int):
        self.least = max(2, min_periods)

    def sides(self, *vectors: pa.Array) -> list:
        days = [v.field("day").flatten().to_numpy(zero_copy_only=False) for v in vectors]
        calendar = np.unique(np.concatenate(days))
        out = []
        for v, day in zip(vectors, days):
            values = np.full((len(v), len(calendar)), np.nan)
            values[np.repeat(np.arange(len(v)), pc.list_value_length(v.field("day")).to_numpy()), np.searchsorted(calendar, day)] = \
                v.field("value").flatten().to_numpy(zero_copy_only=False)
            known = ~np.isnan(values)
            raw = np.where(known, values, 0.0)
            with np.errstate(all="ignore"):
                x = np.where(known, raw - raw.sum(axis=1, keepdims=True) / np.maximum(known.sum(axis=1, keepdims=True), 1), 0.0)
            x[~np.isfinite(x).all(axis=1)] = 0.0  # holds an infinity: correlates with nothing
            out.append((x, known, raw))
        return out

    def order(self, side) -> tuple[np.ndarray, np.ndarray]:
        packed = np.packbits(~side[1], axis=1)
        if not packed.shape[1]:
            return np.arange(len(packed)), np.zeros(1, np.int64)
        order = np.lexsort(packed.T[::-1])
        step = (packed[order[1:]] != packed[order[:-1]]).any(axis=1)
        return order, np.concatenate([[0], np.flatnonzero(step) + 1])

    def part(self, side, rows: np.ndarray):
        x, known, raw = (c[rows] for c in side)
        every = known.all(axis=0)
        return x, x * x, raw * raw, known.astype(float), every, known.any(axis=0) & ~every

    @staticmethod
    def _sum(values: np.ndarray, other) -> np.ndarray:
        """Per row and row of ``other`` the sum of the values on the other's days; one column if they are alike."""
        known, every, mixed = other[3:]
        whole = values[:, every].sum(axis=1, keepdims=True)
        return whole + values[:, mixed] @ known[:, mixed].T if mixed.any() else whole

    def matrix(self, a, b) -> np.ndarray:
        n = self._sum(a[3], b) if b[5].any() or a[5].any() else float((a[4] & b[4]).sum())
        sa, sb = self._sum(a[0], b), self._sum(b[0], a).T
        with np.errstate(all="ignore"):
            va = self._sum(a[1], b) - sa * sa / n
            vb = self._sum(b[1], a).T - sb * sb / n
            # constant is what varies by no more than rounding, whatever the unit of the values
            fa = np.where((va > 1e-14 * self._sum(a[2], b)) & np.isfinite(va) & (n >= self.least), 1.0 / np.sqrt(va), 0.0)
            fb = np.where((vb > 1e-14 * self._sum(b[2], a).T) & np.isfinite(vb), 1.0 / np.sqrt(vb), 0.0)
            if isinstance(n, float):
                shift = np.sqrt(n) if n else 1.0
                table = np.hstack([a[0] * fa, -sa * fa / shift]) @ np.vstack([b[0].T * fb, sb * fb / shift])
            else:
                table = a[0] @ b[0].T
                table -= sa * sb / n
                table *= fa
                table *= fb
        np.abs(table, out=table)
        if not np.isfinite(table.sum()):
            table[~np.isfinite(table)] = 0.0
        return table


def _histories(df: DataFrame, value: str) -> DataFrame:
    """(instrument_id, history): each instrument's daily means with the numbers of their days, one calendar long at most."""
    daily = df.where(F.col(value).isNotNull() & F.col("trade_date").isNotNull()).groupBy("instrument_id", "trade_date").agg(F.avg(value).alias("value"))
    rows = daily.groupBy("instrument_id").agg(F.collect_list(F.struct(F.unix_date(F.to_date("trade_date")).alias("day"), "value")).alias("_h"))
    return rows.select("instrument_id", F.struct(F.col("_h.day").alias("day"), F.col("_h.value").alias("value")).alias("history"))


def correlation_degrees(df: DataFrame, value: str, min_periods: int = 20, threshold: float = 0.2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(instrument_id, degree, weight): with how many others the |correlation| reaches the threshold, and their sum.

    What :func:`correlation_edges` would list, where a low threshold admits most pairs.
    """
    found = pair_degrees(_histories(df, value), [], "instrument_id", _Correlation(min_periods), "history", F.size("history.day"), threshold, block_rows)
    return found.select(F.col("id").alias("instrument_id"), "degree", F.col("total").alias("weight"))


def correlation_edges(df: DataFrame, value: str, min_periods: int = 20, threshold: float = 0.2, k: int = 20,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, weight) in both directions: |correlation| at or above the threshold, or among a row's ``k`` largest.

    Correlations are over the days both instruments have; one that is missing counts as 0 in a row's order.
    """
    found = durable(similar_pairs(_histories(df, value), [], "instrument_id", _Correlation(min_periods), "history", F.size("history.day"), k,
                                  threshold if threshold > 0 else None, block_rows=block_rows))
    # each qualified pair is there once, so neither they nor their mirror images need to be compared
    edges = _both_ways(found.where("not candidate"))
    if k > 0:
        best = top_rows(found.where("candidate"), ["src"], [F.desc("score"), F.asc("dst")], k, "_rn")
        rest = _both_ways(best.where("not qualified"))
        edges = edges.unionByName(rest.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    return edges


def _both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs.select(F.explode(ways).alias("_e"), F.col("score").alias("weight")).select("_e.src", "_e.dst", "weight")


def prior_graph_stats(dim: DataFrame, correlation: DataFrame) -> DataFrame:
    """One row of edge counts and density of industry cliques, correlation edges and self loops merged."""
    nodes = dim.agg(F.count_distinct("instrument_id")).scalar()
    cliques = industry_groups(dim).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("i"),
                                       F.coalesce(F.sum(F.col("edges") - F.col("members")), F.lit(0)).alias("p"))
    marked = within_industry(correlation, dim)
    counts = marked.agg(F.count(F.lit(1)).alias("corr_edges"), F.count_if(~F.col("same_industry")).alias("_extra"))
    spot = cliques.select(F.struct("i", "p")).scalar()
    out = counts.withColumn("_c", spot).withColumn("nodes", nodes)
    merged = F.col("_c.p") + F.col("_extra") + F.col("nodes")
    return out.select("nodes", F.col("_c.i").alias("industry_edges"), "corr_edges", merged.alias("merged_edges"),
                      (merged / (F.col("nodes") * F.col("nodes"))).alias("density"))


class _Cosine(Scores):
    def sides(self, *vectors: pa.Array) -> list:
        def unit(v):
            m = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(v), -1)
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return [unit(v) for v in vectors]

    def order(self, side) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(side)), np.zeros(1, np.int64)

    def part(self, side, rows: np.ndarray):
        return side[rows]

    def matrix(self, a, b) -> np.ndarray:
        return a @ b.T


def similarity_knn(df: DataFrame, keys: Sequence[str], row_id: str, vector: str, k: int,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, src, dst, score): each row's ``k`` most similar rows of its group by cosine, itself among them."""
    found = similar_pairs(df, keys, row_id, _Cosine(), vector, F.size(vector), k, itself=True, block_rows=block_rows)
    found = found.select(*keys, "src", "dst", "score")
    best = top_rows(found, [*keys, "src"], [F.desc("score"), F.asc("dst")], k, "_rn").drop("_rn")
    loops = df.select(*keys, F.col(row_id).alias("src"), F.col(row_id).alias("dst"), F.lit(1.0).alias("score"))
    return best.unionByName(loops).groupBy(*keys, "src", "dst").agg(F.max("score").alias("score"))


def combine_edges(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Intersection or union of two edge sets."""
    left, right = a.select("src", "dst"), b.select("src", "dst")
    if how in ("intersection", "and"):
        return left.intersect(right)
    if how in ("union", "or"):
        return left.union(right).distinct()
    raise ValueError(f"unknown combination: {how}")


def industry_index(dim: DataFrame, industry: str = "industry") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(instrument_id, industry, industry_index) with -1 where unknown, the vocabulary, and one row of coverage."""
    named = dim.where(F.col(industry).isNotNull() & (F.trim(industry) != ""))
    vocabulary = dense_index(named, industry, "industry_index")
    indexed = dim.join(vocabulary, industry, "left").select(
        "instrument_id", industry, F.coalesce("industry_index", F.lit(-1)).cast("bigint").alias("industry_index"))
    coverage = indexed.agg(F.count(F.lit(1)).alias("instruments"),
                           F.count_if(F.col("industry_index") >= 0).alias("matched")).withColumn(
        "coverage", F.col("matched") / F.greatest(F.col("instruments"), F.lit(1)))
    return indexed, vocabulary, coverage
