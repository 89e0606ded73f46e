"""Instrument graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import rolling as r
from tidepanel.functions.factor import by_instrument, with_factors
from tidepanel.operators import edges as eg
from tidepanel.plans import tables

from .common import BARS, DIM, ORDERED, kept, query

QUERIES = {}
ARGS = dict(min_periods=40, threshold=0.35, k=3)


def dim(spark, folder):
    return tables.dimension(spark, folder)


QUERIES["industry_edge_counts"] = query(
    lambda spark, folder: eg.industry_groups(dim(spark, folder)),
    "SELECT industry, count(*) AS members, count(*) * count(*) AS edges FROM dim WHERE industry IS NOT NULL GROUP BY 1 HAVING count(*) > 1", ("industry",), ["members", "edges"], ctes=(DIM,))
QUERIES["industry_degree"] = query(
    lambda spark, folder: eg.industry_degree(dim(spark, folder)),
    """SELECT a.instrument_id, count(b.instrument_id) AS degree FROM dim a LEFT JOIN dim b ON a.industry = b.industry AND a.instrument_id <> b.instrument_id GROUP BY 1""",
    ("instrument_id",), ["degree"], ctes=(DIM,))


def correlation(spark, folder):
    panel = with_factors(by_instrument(tables.bars(spark, folder)), {"x": r.diff(r.sma("turnover", 2))})
    return eg.correlation_edges(panel.select("instrument_id", "trade_date", "x"), "x", **ARGS)


CORR = f"""
x0 AS (SELECT instrument_id, trade_date, CASE WHEN count(turnover) OVER w = 2 THEN avg(turnover) OVER w END AS m FROM bars
       WINDOW w AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
x1 AS (SELECT instrument_id, trade_date, m - lag(m) OVER {ORDERED} AS x FROM x0),
ids AS (SELECT DISTINCT instrument_id FROM x1 WHERE x IS NOT NULL),
pr AS (SELECT a.instrument_id AS src, b.instrument_id AS dst, round(abs(covar_samp(a.x, b.x) / nullif(stddev_samp(a.x) * stddev_samp(b.x), 0)), 9) AS c, count(*) AS n
       FROM x1 a JOIN x1 b ON a.trade_date = b.trade_date WHERE a.x IS NOT NULL AND b.x IS NOT NULL AND a.instrument_id <> b.instrument_id GROUP BY 1, 2),
al AS (SELECT i.instrument_id AS src, j.instrument_id AS dst, CASE WHEN n >= 40 THEN coalesce(c, 0) ELSE 0 END AS score
       FROM ids i JOIN ids j ON i.instrument_id <> j.instrument_id LEFT JOIN pr ON src = i.instrument_id AND dst = j.instrument_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM al),
hit AS (SELECT src, dst, score FROM rk WHERE k <= 3 OR score >= 0.35),
cedge AS (SELECT src, dst, max(score) AS weight FROM (SELECT * FROM hit UNION ALL SELECT dst, src, score FROM hit) GROUP BY 1, 2)"""
QUERIES["correlation_edges"] = query(correlation, f"{CORR} => SELECT * FROM cedge", ("src", "dst"), ["weight"])


def _small_correlation(spark, folder):
    """The same series in a unit ten orders of magnitude larger."""
    panel = with_factors(by_instrument(tables.bars(spark, folder)), {"x": r.diff(r.sma("turnover", 2))})
    return eg.correlation_edges(panel.select("instrument_id", "trade_date", (F.col("x") * 1e-10).alias("x")), "x", **ARGS)


QUERIES["correlation_edges_small_scale"] = query(_small_correlation, f"{CORR} => SELECT * FROM cedge", ("src", "dst"), ["weight"])


def _degrees(spark, folder):
    """A threshold that admits most pairs: numbers and sums, not edges."""
    panel = with_factors(by_instrument(tables.bars(spark, folder)), {"x": r.diff(r.sma("turnover", 2))})
    return eg.correlation_degrees(panel.select("instrument_id", "trade_date", "x"), "x", min_periods=40, threshold=0.05, block_rows=40)


QUERIES["correlation_degrees"] = query(
    _degrees, f"{CORR} => SELECT src AS instrument_id, count(CASE WHEN score >= 0.05 THEN 1 END) AS degree, sum(CASE WHEN score >= 0.05 THEN score ELSE 0 END) AS weight FROM al GROUP BY 1",
    ("instrument_id",), ["degree", "weight"])
QUERIES["edges_within_industry"] = query(
    lambda spark, folder: eg.within_industry(correlation(spark, folder), kept(dim(spark, folder))),
    f"{CORR} => SELECT src, dst, weight, coalesce(a.industry = b.industry, FALSE) AS same_industry FROM cedge LEFT JOIN dim a ON src = a.instrument_id LEFT JOIN dim b ON dst = b.instrument_id",
    ("src", "dst", "same_industry"), ["weight"], ctes=(BARS, DIM))
QUERIES["prior_graph_stats"] = query(
    lambda spark, folder: eg.prior_graph_stats(kept(dim(spark, folder)), correlation(spark, folder)),
    f"""{CORR}, ind AS (SELECT a.instrument_id AS src, b.instrument_id AS dst FROM dim a JOIN dim b ON a.industry = b.industry
         WHERE a.industry IN (SELECT industry FROM dim GROUP BY 1 HAVING count(*) > 1)),
    merged AS (SELECT src, dst FROM ind UNION SELECT src, dst FROM cedge UNION SELECT instrument_id, instrument_id FROM dim) =>
    SELECT (SELECT count(*) FROM dim) AS nodes, (SELECT count(*) FROM ind) AS industry_edges, (SELECT count(*) FROM cedge) AS corr_edges, count(*) AS merged_edges,
           count(*) / pow((SELECT count(*) FROM dim), 2) AS density FROM merged""", (), ["nodes", "industry_edges", "corr_edges", "merged_edges", "density"], ctes=(BARS, DIM))


def _vectors(spark, folder):
    return tables.read(spark, folder, "embeddings").select("label", "vec_id", "embedding")


_KNN = """
un AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
cs AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS score
       FROM un a JOIN un b ON a.label = b.label),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, src ORDER BY score DESC, dst) AS k FROM cs) WHERE k <= {k} OR src = dst)"""
QUERIES["similarity_knn"] = query(
    lambda spark, folder: eg.similarity_knn(_vectors(spark, folder), ["label"], "vec_id", "embedding", 6),
    f"{_KNN.format(k=6)} => SELECT * FROM kn", ("label", "src", "dst"), ["score"], ctes=())


def _edge_sets(spark, folder, how):
    wide = kept(eg.similarity_knn(_vectors(spark, folder), ["label"], "vec_id", "embedding", 8))
    short = wide.where("score >= 0.3")
    other = wide.where("score <= 0.5")
    return eg.combine_edges(short, other, how)


for _how, _op in (("intersection", "INTERSECT"), ("union", "UNION")):
    QUERIES[f"edge_set_{_how}"] = query(
        lambda spark, folder, h=_how: _edge_sets(spark, folder, h),
        f"{_KNN.format(k=8)} => SELECT src, dst FROM kn WHERE score >= 0.3 {_op} SELECT src, dst FROM kn WHERE score <= 0.5", ("src", "dst"), ctes=())

QUERIES["industry_index"] = query(
    lambda spark, folder: eg.industry_index(dim(spark, folder))[0],
    "SELECT instrument_id, industry, coalesce(CASE WHEN industry IS NOT NULL THEN dense_rank() OVER (ORDER BY industry) - 1 END, -1) AS industry_index FROM dim",
    ("instrument_id", "industry"), ["industry_index"], ctes=(DIM,))
QUERIES["industry_index_coverage"] = query(
    lambda spark, folder: eg.industry_index(dim(spark, folder).withColumn("industry", F.when(F.col("cap") > 1000, F.col("industry"))))[2],
    "SELECT count(*) AS instruments, count(CASE WHEN cap > 1000 THEN industry END) AS matched, count(CASE WHEN cap > 1000 THEN industry END) * 1.0 / count(*) AS coverage FROM dim",
    (), ["instruments", "matched", "coverage"], ctes=(DIM,))
