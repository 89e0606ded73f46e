"""Scores to portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import rolling as r
from tidepanel.functions.factor import by_instrument, with_factors
from tidepanel.operators import cross_section as cs
from tidepanel.operators import joins
from tidepanel.operators import labels as lb
from tidepanel.operators import portfolio as pf
from tidepanel.plans import tables

from .common import BARS, DIM, ORDERED, PK, kept, query, std
from .cross_section import z

QUERIES = {}


def scores(spark, folder):
    """(instrument_id, trade_date, score, position, ret) per bar, stored once."""
    panel = with_factors(by_instrument(tables.bars(spark, folder)), {
        "f_ret_1d": r.pct_change("close"), "f_ret_5d": r.pct_change("close", 5),
        "f_vol_20d": r.rolling_std(r.pct_change("close"), 20), "ret": lb.forward_return()})
    panel = kept(cs.null_policy(panel, ["f_ret_5d", "f_vol_20d"], 0.0))
    scored = cs.cs_zscore(panel, {"z5": "f_ret_5d", "zv": "f_vol_20d"})
    score = F.coalesce(F.col("z5") * 0.5 - F.col("zv") * 0.3, F.lit(0.0))
    return kept(scored.select("instrument_id", "trade_date", score.alias("score"), F.col("instrument_id").cast("bigint").alias("position"), "ret", "turnover", "volume"))


# months before the twentieth bar have no deviation and so score 0 throughout: ties are part of the check
SCORES = f"""
sc0 AS (SELECT *, close / lag(close) OVER {ORDERED} - 1 AS r1, coalesce(close / lag(close, 5) OVER {ORDERED} - 1, 0) AS r5,
               (lead(open, 5) OVER {ORDERED} - lead(open, 1) OVER {ORDERED}) / (lead(open, 1) OVER {ORDERED} + 1e-12) AS ret FROM bars),
sc1 AS (SELECT *, coalesce({std('r1', 20)}, 0) AS v20 FROM sc0),
scores AS (SELECT instrument_id, trade_date, coalesce(0.5 * {z('r5')} - 0.3 * {z('v20')}, 0) AS score, CAST(instrument_id AS BIGINT) AS position, ret, turnover, volume FROM sc1)"""

QUERIES["flagship_portfolio"] = query(
    lambda spark, folder: pf.portfolio(scores(spark, folder), 5, "equal"),
    f"""{SCORES} => SELECT *, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM (
        SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rank FROM scores) WHERE rank <= 5""",
    ("trade_date", "instrument_id"), ["rank", "score", "weight"])

QUERIES["momentum_quality_score"] = query(
    scores, f"{SCORES} => SELECT * FROM scores", PK, ["score"])

QUERIES["portfolio_softmax"] = query(
    lambda spark, folder: pf.portfolio(scores(spark, folder), 3, "softmax", 0.5),
    f"""{SCORES}, pk AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rank FROM scores),
    pe AS (SELECT *, exp((score - max(score) OVER (PARTITION BY trade_date)) / 0.5) AS e FROM pk WHERE rank <= 3) =>
    SELECT *, e / sum(e) OVER (PARTITION BY trade_date) AS weight FROM pe""", ("trade_date", "instrument_id"), ["rank", "weight"])

QUERIES["candidate_order"] = query(
    lambda spark, folder: pf.rank_candidates(scores(spark, folder), 20),
    f"{SCORES} => SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rank FROM scores) WHERE rank <= 20",
    ("trade_date", "instrument_id"), ["rank"])


def _previous(spark, folder):
    """Names of each month's plain top five, as held in the following month."""
    top = pf.rank_candidates(scores(spark, folder), 5).select("instrument_id", F.add_months("trade_date", 1).alias("trade_date"))
    return top


QUERIES["portfolio_turnover_penalty"] = query(
    lambda spark, folder: pf.select_names(scores(spark, folder), 5, previous=_previous(spark, folder), penalty=0.4),
    f"""{SCORES}, held AS (SELECT instrument_id, CAST(trade_date + INTERVAL 1 MONTH AS DATE) AS trade_date FROM (
      SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rn FROM scores) WHERE rn <= 5),
    adj AS (SELECT s.*, score - CASE WHEN h.instrument_id IS NOT NULL THEN 0 ELSE 0.4 END AS a FROM scores s LEFT JOIN held h USING (instrument_id, trade_date)) =>
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY a DESC, score DESC, position DESC) AS rank FROM adj) WHERE rank <= 5""",
    ("trade_date", "instrument_id"), ["rank", "score"])

QUERIES["portfolio_industry_cap"] = query(
    lambda spark, folder: pf.select_names(
        scores(spark, folder).join(tables.dimension(spark, folder).select("instrument_id", F.when(F.col("cap") > 0, F.col("industry")).alias("industry")), "instrument_id", "left"),
        5, max_per_industry=1),
    f"""{SCORES}, si AS (SELECT scores.*, CASE WHEN cap > 0 THEN industry END AS industry FROM scores LEFT JOIN dim USING (instrument_id)),
    ci AS (SELECT *, row_number() OVER (PARTITION BY trade_date, coalesce(industry, '#' || instrument_id) ORDER BY score DESC, position DESC) AS g FROM si) =>
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rank FROM ci WHERE g <= 1) WHERE rank <= 5""",
    ("trade_date", "instrument_id"), ["rank", "score"], ctes=(BARS, DIM))


def _sparse(spark, folder):
    """Candidates of high scores only, so that on some days few or none are left."""
    every = scores(spark, folder)
    return pf.filled_days(pf.select_names(every.where("score > 3"), 5), every, 5)


QUERIES["portfolio_filled_days"] = query(
    _sparse,
    f"""{SCORES}, fd AS (SELECT trade_date, least(count(CASE WHEN score > 3 THEN 1 END), 5) AS names FROM scores GROUP BY 1) =>
    SELECT trade_date, names, 5 - names AS missing, CASE WHEN names = 0 THEN 1 ELSE 0 END AS empty FROM fd""",
    ("trade_date",), ["names", "missing", "empty"])

_HOLD = """hold AS (SELECT instrument_id, rank, 0.2 AS weight FROM (SELECT *, row_number() OVER (ORDER BY score DESC, position DESC) AS rank FROM scores
  WHERE trade_date = (SELECT max(trade_date) FROM scores WHERE ret IS NOT NULL)) WHERE rank <= 4)"""


def _holdings(spark, folder):
    s = scores(spark, folder)
    last = s.where("ret IS NOT NULL").agg(F.max("trade_date")).scalar()
    return pf.rank_candidates(s.where(F.col("trade_date") == last), 4).select("instrument_id", F.lit(0.2).alias("weight"))


QUERIES["portfolio_realized_score"] = query(
    lambda spark, folder: pf.realized_score(kept(_holdings(spark, folder)), tables.bars(spark, folder)),
    f"""{SCORES}, {_HOLD}, lastr AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS b FROM bars WHERE instrument_id IN (SELECT instrument_id FROM hold)),
    rr AS (SELECT instrument_id, (arg_max(open, trade_date) - arg_min(open, trade_date)) / arg_min(open, trade_date) AS ret FROM lastr WHERE b <= 5 GROUP BY 1) =>
    SELECT (SELECT count(*) FROM hold) AS names, (SELECT sum(weight) FROM hold) AS weight_sum, sum(ret * weight) AS score FROM hold JOIN rr USING (instrument_id)""",
    (), ["names", "weight_sum", "score"])
QUERIES["portfolio_invalid_score"] = query(
    lambda spark, folder: pf.realized_score(kept(_holdings(spark, folder).withColumn("weight", F.lit(0.4))), tables.bars(spark, folder)),
    f"{SCORES}, {_HOLD} => SELECT count(*) AS names, sum(2 * weight) AS weight_sum, -999 AS score FROM hold", (), ["names", "weight_sum", "score"])
QUERIES["portfolio_semi_join"] = query(
    lambda spark, folder: tables.bars(spark, folder).join(_holdings(spark, folder), "instrument_id", "left_semi"),
    f"{SCORES}, {_HOLD} => SELECT * FROM bars WHERE instrument_id IN (SELECT instrument_id FROM hold)", PK, ["close"], 3)


def _coverage(spark, folder):
    weights = pf.portfolio(scores(spark, folder), 5).select("trade_date", "instrument_id", "weight")
    returns = scores(spark, folder).where("ret IS NOT NULL").select("trade_date", "instrument_id", "ret")
    return joins.matched_returns(weights, returns, ["trade_date", "instrument_id"])


_TOP5 = "t5 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, position DESC) AS rank FROM scores)"
QUERIES["weights_with_missing_returns"] = query(
    lambda spark, folder: _coverage(spark, folder)[0],
    f"{SCORES}, {_TOP5} => SELECT trade_date, instrument_id, 0.2 AS weight, coalesce(ret, 0) AS ret FROM t5 WHERE rank <= 5", ("trade_date", "instrument_id"), ["weight", "ret"], 5)
QUERIES["weights_return_coverage"] = query(
    lambda spark, folder: _coverage(spark, folder)[1],
    f"{SCORES}, {_TOP5} => SELECT count(*) AS names, count(ret) AS covered FROM t5 WHERE rank <= 5", (), ["names", "covered"])
