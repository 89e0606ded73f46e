"""Strategies, rank correlation, losses and folds over stored scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import evaluation as ev
from tidepanel.operators import splits as sp
from tidepanel.plans import tables
from tidepanel.sources import files

from .common import PK, kept, query, scratch
from .labels import FOLD_ARGS, FOLDS_SQL
from .portfolios import SCORES, scores

QUERIES = {}
GRID = ev.strategy_grid((1, 3, 5), ("equal", "softmax"))
NAMES = ("mean_return", "return_std", "risk_adjusted")


def _returns_sql(source: str = "scores", out: str = "sr", by: str = "trade_date", grid=None) -> str:
    """CTE ``out`` (by, position, strategy, value)."""
    parts = []
    for i, s in enumerate(grid or GRID):
        value = f"sum(ret) / {s.top_k}" if s.weighting == "equal" else "sum(exp(score - peak) * ret) / sum(exp(score - peak))"
        parts.append(f"SELECT {by}, {i} AS position, '{s.name}' AS strategy, {value} AS value FROM {out}_t WHERE n >= 5 AND rank <= {s.top_k} GROUP BY {by}")
    return f"""
{out}_t AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, instrument_id) AS rank, count(*) OVER (PARTITION BY {by}) AS n,
                   max(score) OVER (PARTITION BY {by}) AS peak FROM {source} WHERE ret IS NOT NULL),
{out} AS ({' UNION ALL '.join(parts)})"""


QUERIES["strategy_returns"] = query(
    lambda spark, folder: ev.strategy_returns(scores(spark, folder), GRID),
    f"{SCORES}, {_returns_sql()} => SELECT * FROM sr", ("trade_date", "strategy"), ["position", "value"], 5)


def _metrics_sql(source="sr", group="position, strategy"):
    return (f"SELECT {group}, count(*) AS days, avg(value) AS mean_return, stddev_pop(value) AS return_std, "
            f"avg(value) - 0.2 * stddev_pop(value) AS risk_adjusted FROM {source} GROUP BY {group}")


QUERIES["strategy_metrics"] = query(
    lambda spark, folder: ev.strategy_metrics(ev.strategy_returns(scores(spark, folder), GRID)),
    f"{SCORES}, {_returns_sql()} => {_metrics_sql()}", ("strategy",), ["position", "days", *NAMES], 5)
QUERIES["oracle_top_return"] = query(
    lambda spark, folder: ev.oracle_top_return(scores(spark, folder)),
    f"""{SCORES} => SELECT trade_date, avg(ret) AS oracle_return FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ret DESC, instrument_id) AS k
        FROM scores WHERE ret IS NOT NULL) WHERE k <= 5 GROUP BY 1 HAVING count(*) >= 5""", ("trade_date",), ["oracle_return"], 5)

IC = """
ic0 AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score, instrument_id) - 1.0 AS a, row_number() OVER (PARTITION BY trade_date ORDER BY ret, instrument_id) - 1.0 AS b
        FROM scores WHERE ret IS NOT NULL),
ic AS (SELECT trade_date, count(*) AS names, CASE WHEN count(*) > 2 THEN covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END AS rank_ic FROM ic0 GROUP BY 1)"""
QUERIES["rank_ic"] = query(lambda spark, folder: ev.rank_ic(scores(spark, folder)), f"{SCORES}, {IC} => SELECT * FROM ic", ("trade_date",), ["names", "rank_ic"])
QUERIES["rank_ic_summary"] = query(
    lambda spark, folder: ev.rank_ic_summary(ev.rank_ic(scores(spark, folder))),
    f"{SCORES}, {IC} => SELECT avg(rank_ic) AS rank_ic_mean, stddev_pop(rank_ic) AS rank_ic_std, avg(rank_ic) / (stddev_pop(rank_ic) + 1e-12) AS rank_ic_ir FROM ic",
    (), ["rank_ic_mean", "rank_ic_std", "rank_ic_ir"], 5)

# ---- folds ------------------------------------------------------------------------------------------------------


def in_folds(spark, folder):
    s = scores(spark, folder)
    return kept(sp.with_fold(s, sp.rolling_folds(s, **FOLD_ARGS)))


_FOLDED = f"{SCORES}, {FOLDS_SQL}, sf AS (SELECT scores.*, fold FROM scores JOIN folds ON trade_date BETWEEN start_date AND end_date), {_returns_sql('sf', 'sr', 'fold, trade_date')}"


def _fold_metrics(spark, folder):
    return ev.strategy_metrics(ev.strategy_returns(in_folds(spark, folder), GRID, by=["fold", "trade_date"]), group=["fold"])


_FM = f"{_FOLDED}, fm AS ({_metrics_sql('sr', 'fold, position, strategy')})"
QUERIES["fold_metrics"] = query(_fold_metrics, f"{_FM} => SELECT * FROM fm", ("fold", "strategy"), NAMES, 5)

_BATCHED = f"""{_FOLDED}, bd AS (SELECT fold, trade_date, floor((row_number() OVER (PARTITION BY fold ORDER BY trade_date) - 1) / 4) AS batch FROM (SELECT DISTINCT fold, trade_date FROM sr)),
bm AS ({_metrics_sql('(SELECT * FROM sr JOIN bd USING (fold, trade_date))', 'fold, batch, position, strategy')}),
bf AS (SELECT fold, position, strategy, avg(mean_return) AS mean_return, avg(return_std) AS return_std, avg(risk_adjusted) AS risk_adjusted FROM bm GROUP BY 1, 2, 3),
ba AS (SELECT position, strategy, avg(mean_return) AS mean_return, avg(return_std) AS return_std, avg(risk_adjusted) AS risk_adjusted FROM bf GROUP BY 1, 2)"""


def _batched(spark, folder):
    rows = in_folds(spark, folder)
    return ev.batched_metrics(ev.strategy_returns(rows, GRID), rows.select("trade_date", "fold").distinct())


QUERIES["batched_fold_metrics"] = query(_batched, f"{_BATCHED} => SELECT * FROM ba", ("strategy",), NAMES, 5)
_BEST = "(SELECT *, row_number() OVER (ORDER BY {by} DESC, position) AS k FROM {src})"
for _by in ("risk_adjusted", "mean_return"):
    QUERIES[f"best_strategy_by_{_by}"] = query(
        lambda spark, folder, b=_by: ev.best_strategy(_batched(spark, folder), b),
        f"{_BATCHED} => SELECT *, {_by} AS objective FROM {_BEST.format(by=_by, src='ba')} WHERE k = 1", ("strategy",), [*NAMES, "objective"], 5)

_DIAG = f"""{_FM}, fk AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY risk_adjusted DESC, position) AS k,
    risk_adjusted - lead(risk_adjusted) OVER (PARTITION BY fold ORDER BY risk_adjusted DESC, position) AS score_spread FROM fm),
fw AS (SELECT *, risk_adjusted AS objective FROM fk WHERE k = 1)"""
QUERIES["fold_diagnostics"] = query(
    lambda spark, folder: ev.fold_diagnostics(kept(_fold_metrics(spark, folder)))[0],
    f"{_DIAG} => SELECT * FROM fw", ("fold", "strategy"), [*NAMES, "objective", "score_spread"], 5)
QUERIES["fold_regime_summary"] = query(
    lambda spark, folder: ev.fold_diagnostics(kept(_fold_metrics(spark, folder)))[1],
    f"""{_DIAG}, wn AS (SELECT strategy, position, count(*) AS wins FROM fw GROUP BY 1, 2 ORDER BY wins DESC, position LIMIT 1) =>
    SELECT count(*) AS folds, count(CASE WHEN mean_return > 0 THEN 1 END) AS positive_folds, count(CASE WHEN mean_return < 0 THEN 1 END) AS negative_folds,
           count(CASE WHEN mean_return = 0 THEN 1 END) AS flat_folds, avg(objective) AS mean_best_score, avg(mean_return) AS mean_best_return,
           avg(score_spread) AS mean_score_spread, arg_max(fold, objective) AS best_fold, arg_min(fold, objective) AS worst_fold,
           (SELECT strategy FROM wn) AS dominant_strategy, (SELECT wins FROM wn) AS dominant_wins FROM fw""",
    ("best_fold", "worst_fold", "dominant_strategy"),
    ["folds", "positive_folds", "negative_folds", "flat_folds", "mean_best_score", "mean_best_return", "mean_score_spread", "dominant_wins"], 5)


def _candidates(spark):
    """The grid and a candidate that no fold has values for."""
    return spark.createDataFrame([(i, g.name) for i, g in enumerate(GRID)] + [(len(GRID), "never_run")], "position int, strategy string")


_CAND = "ca AS (SELECT DISTINCT position, strategy FROM fm UNION ALL SELECT max(position) + 1, 'never_run' FROM fm)"
for _mode in ("risk_adjusted", "mean_return"):
    QUERIES[f"fold_comparison_{_mode}"] = query(
        lambda spark, folder, m=_mode: ev.fold_comparison(kept(_fold_metrics(spark, folder)), _candidates(spark), m),
        f"""{_FM}, {_CAND}, fg AS (SELECT f.fold, ca.position, ca.strategy, coalesce(fm.mean_return, 0) AS mean_return, coalesce(fm.return_std, 0) AS return_std,
             coalesce(fm.risk_adjusted, fm.mean_return, 0) AS risk_adjusted FROM (SELECT DISTINCT fold FROM fm) f CROSS JOIN ca LEFT JOIN fm ON fm.fold = f.fold AND fm.strategy = ca.strategy) =>
        SELECT *, {_mode} AS score, row_number() OVER (PARTITION BY fold ORDER BY {_mode} DESC, position) AS place FROM fg""",
        ("fold", "strategy"), [*NAMES, "score", "place"], 5)
    QUERIES[f"fold_win_counts_{_mode}"] = query(
        lambda spark, folder, m=_mode: ev.win_counts(kept(_fold_metrics(spark, folder)), _candidates(spark), m),
        f"""{_FM}, {_CAND}, fp AS (SELECT fold, strategy, row_number() OVER (PARTITION BY fold ORDER BY {_mode} DESC, position) AS k FROM fm) =>
        SELECT ca.position, ca.strategy, count(fp.fold) AS wins FROM ca LEFT JOIN fp ON fp.strategy = ca.strategy AND fp.k = 1 GROUP BY 1, 2""",
        ("strategy",), ["position", "wins"])


def _runs(spark, folder):
    """Folds taken as runs of one experiment."""
    return kept(_fold_metrics(spark, folder).withColumnRenamed("fold", "run"))


QUERIES["run_ensemble_means"] = query(
    lambda spark, folder: ev.ensemble(_runs(spark, folder))[0],
    f"{_FM} => SELECT position, strategy, count(DISTINCT fold) AS runs, avg(mean_return) AS mean_return, avg(return_std) AS return_std, avg(risk_adjusted) AS risk_adjusted FROM fm GROUP BY 1, 2",
    ("strategy",), ["runs", *NAMES], 5)
QUERIES["run_ensemble_best_run"] = query(
    lambda spark, folder: ev.ensemble(_runs(spark, folder))[1],
    f"{_DIAG} => SELECT fold AS run, strategy, objective FROM fw ORDER BY objective DESC, fold LIMIT 1", ("run", "strategy"), ["objective"], 5)
QUERIES["strategy_reselection"] = query(
    lambda spark, folder: (lambda s: ev.reselect(s, sp.rolling_folds(s, **FOLD_ARGS), GRID))(scores(spark, folder)),
    f"{_BATCHED}, {IC.replace('FROM scores', 'FROM sf')} => SELECT *, risk_adjusted AS objective, (SELECT avg(rank_ic) FROM ic) AS rank_ic_mean, "
    f"(SELECT avg(rank_ic) / (stddev_pop(rank_ic) + 1e-12) FROM ic) AS rank_ic_ir FROM {_BEST.format(by='risk_adjusted', src='ba')} WHERE k = 1",
    ("strategy",), [*NAMES, "objective", "rank_ic_mean", "rank_ic_ir"], 5)


def _board(spark, folder):
    s = scores(spark, folder)
    last = s.where("ret IS NOT NULL").agg(F.max("trade_date")).scalar()
    day = s.where(F.col("trade_date") == last)
    return ev.strategy_board(day.select("instrument_id", "score"), day.where("volume > 100").select("instrument_id", "ret"))


_BOARD = "bo AS (SELECT *, row_number() OVER (ORDER BY score DESC, instrument_id) AS k, CASE WHEN volume > 100 THEN ret END AS r, max(score) OVER () AS peak FROM scores WHERE trade_date = (SELECT max(trade_date) FROM scores WHERE ret IS NOT NULL))"
QUERIES["strategy_board"] = query(
    _board,
    f"{SCORES}, {_BOARD} => " + " UNION ALL ".join(
        f"SELECT 'top{k}_{w}' AS strategy, {k} AS top_k, '{w}' AS weighting, sum(coalesce(r, 0) * {'1' if w == 'equal' else 'exp(score - peak)'}) / sum({'1' if w == 'equal' else 'exp(score - peak)'}) AS expected_return, "
        f"count(r) AS covered_names FROM bo WHERE k <= {k}" for k in range(1, 6) for w in ("equal", "softmax")),
    ("strategy", "weighting"), ["top_k", "expected_return", "covered_names"])
QUERIES["top_list_last_date"] = query(
    lambda spark, folder: ev.top_list(scores(spark, folder), 10),
    f"{SCORES} => SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, instrument_id) AS rank FROM scores WHERE trade_date = (SELECT max(trade_date) FROM scores)) WHERE rank <= 10",
    ("trade_date", "instrument_id"), ["rank", "score"])


def _board(spark, folder):
    """A board on disk to which the strategies of a backtest and then the teams are added."""
    path = scratch(spark, "board")
    files.leaderboard_append(ev.strategy_metrics(ev.strategy_returns(scores(spark, folder), GRID)).select("strategy", "mean_return"), path)
    files.leaderboard_append(tables.read(spark, folder, "region").select(
        F.concat(F.lit("team_"), "r_name").alias("strategy"), (F.col("r_regionkey") / 10).alias("mean_return")), path)
    return spark.read.parquet(path)


QUERIES["leaderboard_append"] = query(
    _board,
    f"{SCORES}, {_returns_sql()} => SELECT strategy, avg(value) AS mean_return FROM sr GROUP BY 1 UNION ALL SELECT 'team_' || r_name, r_regionkey / 10.0 FROM region",
    ("strategy",), ["mean_return"], 5)

# ---- losses -----------------------------------------------------------------------------------------------------


def _targets(spark, folder):
    """The realised return limited to +-3 as target; rows without one are left out."""
    s = scores(spark, folder).where("ret IS NOT NULL")
    return kept(s.withColumn("target", F.greatest(F.least(F.col("ret"), F.lit(3.0)), F.lit(-3.0))))


_TG = "tg AS (SELECT *, greatest(least(ret, 3), -3) AS target FROM scores WHERE ret IS NOT NULL)"
QUERIES["loss_listnet"] = query(
    lambda spark, folder: ev.listnet(_targets(spark, folder)),
    f"""{SCORES}, {_TG}, lp AS (SELECT *, max(target) OVER (PARTITION BY trade_date) AS my, max(score) OVER (PARTITION BY trade_date) AS mp FROM tg) =>
    SELECT trade_date, ln(sum(exp(score - mp))) - sum(exp(10 * (target - my)) * (score - mp)) / sum(exp(10 * (target - my))) AS listnet FROM lp GROUP BY 1""",
    ("trade_date",), ["listnet"])
_SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
QUERIES["loss_pairwise_top_fraction"] = query(
    lambda spark, folder: ev.pairwise_logistic(_targets(spark, folder)),
    f"""{SCORES}, {_TG}, pw AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY target DESC, instrument_id) AS k, count(*) OVER (PARTITION BY trade_date) AS n FROM tg),
    pp AS (SELECT a.trade_date, sum({_SOFTPLUS.format(x='(b.score - a.score)')} * (a.target - b.target)) AS s, count(*) AS c FROM pw a JOIN pw b ON a.trade_date = b.trade_date AND a.target > b.target
           WHERE a.k <= greatest(floor(a.n * 0.1), 1) GROUP BY 1) =>
    SELECT trade_date, CASE WHEN n > 1 THEN coalesce(s, 0) / (coalesce(c, 0) + 1e-8) ELSE 0 END AS pairwise_logistic FROM (SELECT DISTINCT trade_date, n FROM pw) LEFT JOIN pp USING (trade_date)""",
    ("trade_date",), ["pairwise_logistic"])
QUERIES["loss_lambda_ndcg"] = query(
    lambda spark, folder: ev.lambda_ndcg(_targets(spark, folder), k=20),
    f"""{SCORES}, {_TG}, g0 AS (SELECT *, (target - min(target) OVER w) / (max(target) OVER w - min(target) OVER w + 1e-8) AS g,
      1 / log2(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, instrument_id) + 1.0) AS dc,
      row_number() OVER (PARTITION BY trade_date ORDER BY target DESC, instrument_id) AS k FROM tg WINDOW w AS (PARTITION BY trade_date)),
    g1 AS (SELECT *, sum(g / log2(k + 1.0)) OVER (PARTITION BY trade_date) + 1e-8 AS ideal FROM g0) =>
    SELECT a.trade_date, avg({_SOFTPLUS.format(x='(b.score - a.score)')} * abs((a.g - b.g) * (a.dc - b.dc)) / a.ideal) AS lambda_ndcg
    FROM g1 a JOIN g1 b ON a.trade_date = b.trade_date AND a.target > b.target WHERE a.k <= 20 GROUP BY 1""",
    ("trade_date",), ["lambda_ndcg"], 7)
QUERIES["loss_information_coefficient"] = query(
    lambda spark, folder: ev.information_coefficient(_targets(spark, folder)),
    f"{SCORES}, {_TG} => SELECT trade_date, coalesce(covar_pop(score, target) / (sqrt(var_pop(score) + 1e-12) * sqrt(var_pop(target) + 1e-12) + 1e-12), 0) AS ic FROM tg GROUP BY 1",
    ("trade_date",), ["ic"])
QUERIES["loss_information_coefficient_rank"] = query(
    lambda spark, folder: ev.information_coefficient(_targets(spark, folder), mode="rank"),
    f"""{SCORES}, {_TG}, ir AS (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY score, instrument_id) - 1.0::DOUBLE AS a,
        row_number() OVER (PARTITION BY trade_date ORDER BY target, instrument_id) - 1.0::DOUBLE AS b FROM tg) =>
    SELECT trade_date, coalesce(covar_pop(a, b) / (sqrt(var_pop(a) + 1e-12) * sqrt(var_pop(b) + 1e-12) + 1e-12), 0) AS ic FROM ir GROUP BY 1""",
    ("trade_date",), ["ic"])
QUERIES["volatility_head_error"] = query(
    lambda spark, folder: ev.volatility_error(_targets(spark, folder), "score", "target"),
    f"{SCORES}, {_TG} => SELECT trade_date, avg(CASE WHEN abs(score - target) < 1 THEN pow(score - target, 2) / 2 ELSE abs(score - target) - 0.5 END) AS huber, "
    "avg(pow(score - target, 2)) AS mse, avg(abs(score - target)) AS mae FROM tg GROUP BY 1", ("trade_date",), ["huber", "mse", "mae"])

# ---- linear scores ----------------------------------------------------------------------------------------------

_WEIGHTS = {"score": 1.0, "turnover": 5.0, "volume": -0.002}
_GROUPS = {"base": ("score",), "liquidity": ("turnover", "volume")}
_ONE = ev.Strategy("equal_top5", 5, "equal")
_BASE = "score + 5 * turnover - 0.002 * volume"


def _variant(expr, out):
    one = [_ONE]
    return f"{out}_s AS (SELECT instrument_id, trade_date, ret, {expr} AS score FROM scores), {_returns_sql(out + '_s', out, grid=one)}"


QUERIES["factor_group_ablation"] = query(
    lambda spark, folder: ev.group_ablation(scores(spark, folder), _WEIGHTS, _GROUPS, _ONE),
    f"""{SCORES}, {_variant(_BASE, 'v0')}, {_variant('5 * turnover - 0.002 * volume', 'v1')}, {_variant('score', 'v2')},
    rb AS (SELECT avg(value) - 0.2 * stddev_pop(value) AS b FROM v0) =>
    SELECT 'base' AS factor_group, 1 AS num_features, avg(value) - 0.2 * stddev_pop(value) AS value, avg(value) - 0.2 * stddev_pop(value) - (SELECT b FROM rb) AS delta FROM v1
    UNION ALL SELECT 'liquidity', 2, avg(value) - 0.2 * stddev_pop(value), avg(value) - 0.2 * stddev_pop(value) - (SELECT b FROM rb) FROM v2""",
    ('factor_group',), ["num_features", "value", "delta"], 5)


def _ranker(spark, folder):
    s = _targets(spark, folder)
    model = ev.fit_ranker(s.where("trade_date < '1999-01-01'"), ["turnover", "volume"], "target", solver="normal")
    return ev.score_with(model, s.select("instrument_id", "trade_date", "turnover", "volume"), ["turnover", "volume"])


QUERIES["baseline_ranker_scores"] = query(
    _ranker,
    f"""{SCORES}, {_TG}, mo AS (SELECT avg(target) AS my, avg(turnover) AS ma, avg(volume) AS mb, var_pop(turnover) AS aa, var_pop(volume) AS bb, covar_pop(turnover, volume) AS ab,
      covar_pop(turnover, target) AS ay, covar_pop(volume, target) AS by_ FROM tg WHERE trade_date < DATE '1999-01-01'),
    co AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM mo) =>
    SELECT instrument_id, trade_date, my + wa * (turnover - ma) + wb * (volume - mb) AS score FROM tg, co""", PK, ["score"])
