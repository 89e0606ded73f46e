"""Scores against realised returns: strategies, rank correlation, losses, folds."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rolling import safe_corr
from ..session import durable
from .cross_section import one_per_day, DATE, attach
from .ordering import ordinal_positions, top_rows
from .pairs import BLOCK_ROWS, GRID, rectangular_cells

RISK_LAMBDA = 0.2


@dataclass(frozen=True)
class Strategy:
    name: str
    top_k: int
    weighting: str


def strategy_grid(top_ks: Sequence[int] = (5,), weightings: Sequence[str] = ("equal",)) -> list[Strategy]:
    """The strategies of a backtest, by number of names, then in the order of ``weightings``.

    Weightings are equal and softmax; with one name both hold the same, so it is listed once, as equal. A number
    below one, another weighting, or nothing to list is an error.
    """
    sizes, kinds = sorted(set(map(int, top_ks))), list(dict.fromkeys(weightings))
    wrong = [k for k in sizes if k < 1] + [w for w in kinds if w not in ("equal", "softmax")]
    if wrong or not sizes or not kinds:
        raise ValueError(f"no strategies can be made of sizes {sizes} and weightings {kinds}")
    named = []
    for size in sizes:
        for kind in ["equal"] if size == 1 else kinds:
            named.append(Strategy(f"{kind}_top{size}", size, kind))
    return named


def strategy_table(spark: SparkSession, grid: Sequence[Strategy]) -> DataFrame:
    return spark.createDataFrame([(i, s.name, s.top_k, s.weighting) for i, s in enumerate(grid)],
                                 "position int, strategy string, top_k int, weighting string")


def strategy_returns(df: DataFrame, grid: Sequence[Strategy], score: str = "score", ret: str = "ret",
                     temperature: float = 1.0, by: Sequence[str] = DATE, tie: str = "instrument_id") -> DataFrame:
    """(day, position, strategy, value): each strategy's weighted return; days with too few names are left out."""
    most = max(s.top_k for s in grid)
    valid = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    best = top_rows(valid, by, [F.desc(score), F.asc(tie)], most)
    top = best.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(score).alias("s"), F.col(ret).alias("r")))).alias("t"))
    top = top.where(F.size("t") >= most)
    scale = max(float(temperature), 1e-6)

    def value(s: Strategy) -> Column:
        head = F.slice("t", 1, s.top_k)
        if s.weighting == "equal" or s.top_k == 1:
            return F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x["r"]) / s.top_k
        peak = F.element_at(head, 1)["s"]
        lift = lambda x: F.exp((x["s"] - peak) / scale)
        return (F.aggregate(head, F.lit(0.0), lambda acc, x: acc + lift(x) * x["r"])
                / F.aggregate(head, F.lit(0.0), lambda acc, x: acc + lift(x)))

    parts = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s.name).alias("strategy"), value(s).alias("value"))
                      for i, s in enumerate(grid)])
    return top.select(*by, F.explode(parts).alias("v")).select(*by, "v.*")


def strategy_metrics(returns: DataFrame, risk_lambda: float = RISK_LAMBDA, group: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation and mean - lambda * deviation per strategy (and group)."""
    out = returns.groupBy(*group, "position", "strategy").agg(
        F.count(F.lit(1)).alias("days"), F.avg("value").alias("mean_return"), F.stddev_pop("value").alias("return_std"))
    return out.withColumn("risk_adjusted", F.col("mean_return") - risk_lambda * F.col("return_std"))


def oracle_top_return(df: DataFrame, ret: str = "ret", k: int = 5, by: Sequence[str] = DATE, min_names: int = 5) -> DataFrame:
    """Per day the mean of the ``k`` best realised returns."""
    best = top_rows(df.where(F.col(ret).isNotNull()), by, [F.desc(ret), F.asc("instrument_id")], k)
    return best.groupBy(*by).agg(F.avg(ret).alias("oracle_return"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") >= min(k, min_names)).drop("_n")


def rank_ic(df: DataFrame, score: str = "score", ret: str = "ret", by: Sequence[str] = DATE,
            tie: str = "instrument_id") -> DataFrame:
    """Per day the correlation of the two ordinal ranks; NULL for two names or fewer.  Ties are ordered by id."""
    valid = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(*by, tie, score, ret)
    placed = ordinal_positions(valid, by, score, tie, "_ps")
    placed = ordinal_positions(placed, by, ret, tie, "_pr")
    return placed.groupBy(*by).agg(F.count(F.lit(1)).alias("names"),
                                   safe_corr(F.col("_ps").cast("double"), F.col("_pr").cast("double")).alias("rank_ic")
                                   ).withColumn("rank_ic", F.when(F.col("names") > 2, F.col("rank_ic")))


def rank_ic_summary(ic: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    out = ic.groupBy(*group).agg(F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_pop("rank_ic").alias("rank_ic_std"))
    return out.withColumn("rank_ic_ir", F.col("rank_ic_mean") / (F.col("rank_ic_std") + 1e-12))


def batched_metrics(returns: DataFrame, folds: DataFrame | None = None, batch: int = 4,
                    risk_lambda: float = RISK_LAMBDA) -> DataFrame:
    """Metrics per batch of consecutive days, averaged over the batches of a fold, then over the folds.

    ``returns`` is the output of :func:`strategy_returns`; ``folds`` names each day's fold.
    """
    rows = returns.withColumn("fold", F.lit("all")) if folds is None else returns.join(F.broadcast(one_per_day(folds, ("trade_date",))), "trade_date")
    # days of a fold in order: one calendar long at most
    days = rows.select("fold", "trade_date").distinct()
    order = Window.partitionBy("fold").orderBy("trade_date")
    days = days.withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch))
    tagged = rows.join(F.broadcast(days), ["fold", "trade_date"])
    per_batch = strategy_metrics(tagged, risk_lambda, ["fold", "batch"])
    names = ("mean_return", "return_std", "risk_adjusted")
    per_fold = per_batch.groupBy("fold", "position", "strategy").agg(*[F.avg(c).alias(c) for c in names])
    return per_fold.groupBy("position", "strategy").agg(*[F.avg(c).alias(c) for c in names])


def best_strategy(metrics: DataFrame, by: str = "risk_adjusted", group: Sequence[str] = ()) -> DataFrame:
    """The strategy with the largest metric (per group); the earlier one wins a tie."""
    order = F.struct(F.col(by), -F.col("position"))
    names = ("strategy", "mean_return", "return_std", "risk_adjusted")
    out = metrics.where(F.col(by).isNotNull()).groupBy(*group).agg(
        F.max_by(F.struct(*dict.fromkeys([*names, by, "position"])), order).alias("b"))
    return out.select(*group, *[F.col(f"b.{c}").alias(c) for c in names], F.col(f"b.{by}").alias("objective"),
                      F.col("b.position").alias("position"))


def fold_diagnostics(metrics: DataFrame, by: str = "risk_adjusted", flat: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Per fold the winner and its lead over the runner-up; one row of counts over all folds.

    ``metrics`` has (fold, position, strategy, mean_return, return_std, risk_adjusted).
    """
    winners = best_strategy(metrics, by, ["fold"])
    # a fold has one row per candidate strategy, nine at most
    ranked = metrics.groupBy("fold").agg(F.sort_array(F.collect_list(by), asc=False).alias("l"))
    lead = ranked.select("fold", F.when(F.size("l") >= 2, F.element_at("l", 1) - F.element_at("l", 2)).alias("score_spread"))
    per_fold = winners.join(lead, "fold")
    wins = per_fold.groupBy("strategy", "position").agg(F.count(F.lit(1)).alias("wins"))
    dominant = wins.agg(F.max_by(F.struct("strategy", "wins"), F.struct("wins", -F.col("position"))).alias("d"))
    fold_number = F.regexp_extract("fold", r"(\d+)$", 1).try_cast("int")
    summary = per_fold.agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("mean_return") > flat).alias("positive_folds"),
        F.count_if(F.col("mean_return") < -flat).alias("negative_folds"),
        F.count_if(F.abs("mean_return") <= flat).alias("flat_folds"),
        F.avg("objective").alias("mean_best_score"), F.avg("mean_return").alias("mean_best_return"),
        F.coalesce(F.avg("score_spread"), F.lit(0.0)).alias("mean_score_spread"),
        F.max_by("fold", F.struct("objective", -fold_number)).alias("best_fold"),
        F.min_by("fold", F.struct(F.col("objective"), fold_number)).alias("worst_fold"))
    summary = summary.withColumn("_d", dominant.scalar()).select(
        "*", F.col("_d.strategy").alias("dominant_strategy"), F.col("_d.wins").alias("dominant_wins")).drop("_d")
    return per_fold, summary


SELECTION = {"risk_adjusted": "risk_adjusted", "mean_return": "mean_return"}


def win_counts(metrics: DataFrame, candidates: DataFrame, mode: str = "risk_adjusted") -> DataFrame:
    """(position, strategy, wins): in how many folds each candidate (position, strategy) is chosen, 0 included.

    ``mode`` says by which metric; a candidate without a risk-adjusted value in a fold counts with its mean return.
    """
    wins = best_strategy(selection_scores(metrics, mode), "score", ["fold"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("wins"))
    return candidates.select("position", "strategy").join(wins, "strategy", "left").select(
        "position", "strategy", F.coalesce("wins", F.lit(0)).alias("wins"))


def selection_scores(metrics: DataFrame, mode: str = "risk_adjusted") -> DataFrame:
    """The metrics with the ``score`` that candidates are chosen by: risk-adjusted, else the mean return."""
    if mode not in SELECTION:
        raise ValueError(f"unknown selection mode: {mode}")
    score = F.coalesce("risk_adjusted", "mean_return") if mode == "risk_adjusted" else F.col("mean_return")
    return metrics.withColumn("score", score)


def fold_comparison(metrics: DataFrame, candidates: DataFrame, mode: str = "risk_adjusted") -> DataFrame:
    """(fold, position, strategy, mean_return, return_std, risk_adjusted, score, place, chosen): every candidate in every fold.

    What a fold has no value for is 0; a missing risk-adjusted return is the mean return. Places go by score, then by position.
    """
    listed = candidates.agg(F.collect_list(F.struct("position", "strategy")).alias("l")).scalar()  # a few candidates
    grid = metrics.select("fold").distinct().select("fold", listed.alias("l")).select("fold", F.inline("l"))
    values = metrics.select("fold", "strategy", "mean_return", "return_std", "risk_adjusted")
    filled = grid.join(values, ["fold", "strategy"], "left").withColumn("mean_return", F.coalesce("mean_return", F.lit(0.0))).withColumn(
        "return_std", F.coalesce("return_std", F.lit(0.0))).withColumn("risk_adjusted", F.coalesce("risk_adjusted", "mean_return"))
    scored = selection_scores(filled, mode)
    place = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score"), "position"))  # one row per candidate
    return scored.withColumn("place", place).withColumn("chosen", F.col("place") == 1).select(
        "fold", "position", "strategy", "mean_return", "return_std", "risk_adjusted", "score", "place", "chosen")


def ensemble(runs: DataFrame, by: str = "risk_adjusted") -> tuple[DataFrame, DataFrame]:
    """Metrics averaged over runs per strategy, and the run whose best strategy is best (the first of equals).

    ``runs`` has (run, position, strategy, mean_return, return_std, risk_adjusted).
    """
    names = ("mean_return", "return_std", "risk_adjusted")
    mean = runs.groupBy("position", "strategy").agg(F.count_distinct("run").alias("runs"), *[F.avg(c).alias(c) for c in names])
    per_run = best_strategy(runs, by, ["run"])
    best = per_run.orderBy(F.desc("objective"), "run").limit(1).select("run", "strategy", "objective")
    return mean, best


def strategy_board(scores: DataFrame, returns: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Top 1 to 5 names with both weightings: expected return (missing: 0) and how many names have one."""
    best = scores.where(F.col("score").isNotNull()).orderBy(F.desc("score"), "instrument_id").limit(5)
    joined = best.join(returns, "instrument_id", "left")
    top = joined.agg(F.sort_array(F.collect_list(F.struct(
        F.col("score").alias("s"), F.col("instrument_id").alias("i"), F.coalesce("ret", F.lit(0.0)).alias("r"),
        F.col("ret").isNotNull().cast("int").alias("c"))), asc=False).alias("t"))
    # equal scores: the smaller id first
    ordered = F.array_sort(F.col("t"), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1)
                           .when(a["i"] < b["i"], -1).otherwise(1))
    top = top.select(ordered.alias("t"))
    scale = max(float(temperature), 1e-6)
    cells = []
    for k in range(1, 6):
        head = F.slice("t", 1, k)
        size = F.size(head)
        covered = F.aggregate(head, F.lit(0), lambda acc, x: acc + x["c"])
        even = F.aggregate(head, F.lit(0.0), lambda acc, x: acc + x["r"]) / size
        peak = F.element_at(head, 1)["s"]
        soft = (F.aggregate(head, F.lit(0.0), lambda acc, x: acc + F.exp((x["s"] - peak) / scale) * x["r"])
                / F.aggregate(head, F.lit(0.0), lambda acc, x: acc + F.exp((x["s"] - peak) / scale)))
        for weighting, value in (("equal", even), ("softmax", soft)):
            cells.append(F.struct(F.lit(f"top{k}_{weighting}").alias("strategy"), F.lit(k).alias("top_k"),
                                  F.lit(weighting).alias("weighting"), value.alias("expected_return"),
                                  covered.alias("covered_names")))
    return top.where(F.size("t") > 0).select(F.explode(F.array(*cells)).alias("v")).select("v.*").orderBy(F.desc("expected_return"))


# ---- losses as metrics ---------------------------------------------------------------------------------------

def listnet(df: DataFrame, score: str = "score", target: str = "target", temperature: float = 10.0,
            by: Sequence[str] = DATE) -> DataFrame:
    """Cross entropy between softmax(target * temperature) and softmax(score) per day."""
    valid = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(score).alias("_p"), F.col(target).alias("_y"))
    peaks = valid.groupBy(*by).agg(F.max("_p").alias("_mp"), F.max("_y").alias("_my"))
    rows = attach(valid, peaks, by)
    ey, lp = F.exp((F.col("_y") - F.col("_my")) * temperature), F.col("_p") - F.col("_mp")
    sums = rows.groupBy(*by).agg(F.sum(ey).alias("sy"), F.sum(F.exp(lp)).alias("sp"), F.sum(ey * lp).alias("syp"))
    return sums.select(*by, (F.ln("sp") - F.col("syp") / F.col("sy")).alias("listnet"))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def lambda_ndcg(df: DataFrame, score: str = "score", target: str = "target", k: int = 50, by: Sequence[str] = DATE,
                tie: str = "instrument_id") -> DataFrame:
    """Mean logistic loss over pairs (one of the day's ``k`` best targets, a worse name), weighted by the change in
    discounted gain that swapping them would cause.  Each name meets a list of ``k``; no pair becomes a row."""
    by = list(by)
    valid = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(
        *by, tie, F.col(score).cast("double").alias("_p"), F.col(target).cast("double").alias("_y"))
    span = valid.groupBy(*by).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    rows = ordinal_positions(valid, by, "_p", tie, "_pos", descending=True)
    rows = ordinal_positions(rows, by, "_y", tie, "_best", descending=True)
    rows = attach(rows, span, by)
    gain = (F.col("_y") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    rows = rows.select(*by, tie, "_p", "_y", "_best", gain.alias("_g"), (1.0 / F.log2(F.col("_pos") + 2.0)).alias("_d"))
    ideal = rows.groupBy(*by).agg((F.sum(F.col("_g") / F.log2(F.col("_best") + 2.0)) + 1e-8).alias("_ideal"))
    head = rows.where(F.col("_best") < k).groupBy(*by).agg(
        F.collect_list(F.struct("_p", "_y", "_g", "_d")).alias("_head"))  # k entries per day
    joined = attach(attach(rows, ideal, by), head, by)

    def pair(t):
        change = F.abs((t["_g"] - F.col("_g")) * (t["_d"] - F.col("_d"))) / F.col("_ideal")
        return F.when(t["_y"] > F.col("_y"), _softplus(-(t["_p"] - F.col("_p"))) * change)

    terms = F.array_compact(F.transform("_head", pair))
    each = joined.select(*by, F.size(terms).alias("_n"), F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v).alias("_s"))
    sums = each.groupBy(*by).agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"))
    return sums.select(*by, F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("lambda_ndcg"))


def pairwise_loss_sum(better: tuple, worse: tuple, most: int) -> tuple[float, int]:
    """Sum of softplus(worse score - better score) * (better target - worse target) over pairs of a larger and a smaller
    target, and their number. Both sides are (scores, targets); ``most`` of each are looked at together."""
    (pa_, ya), (pb, yb) = ((p[o], y[o]) for p, y in (better, worse) for o in (np.argsort(y, kind="stable"),))
    ends = np.searchsorted(yb, ya)  # those before have a smaller target
    total = 0.0
    for s in range(0, len(ya), most):
        p, y, end = pa_[s:s + most], ya[s:s + most], ends[s:s + most]
        for t in range(0, int(end[-1]) if len(end) else 0, most):
            q, z = pb[t:t + most], yb[t:t + most]
            middle = (p.min() + p.max()) / 2
            with np.errstate(all="ignore"):
                loss = np.multiply.outer(np.exp(middle - p), np.exp(q - middle))
                if max(np.abs(p - middle).max(), np.abs(q - middle).max()) < 300:  # no product leaves the doubles
                    loss = np.log1p(loss, out=loss)
                else:
                    loss = np.logaddexp(0.0, q[None, :] - p[:, None])
            if end[0] < t + len(q):  # some of these are not worse than all of the others
                loss[np.arange(t, t + len(q))[None, :] >= end[:, None]] = 0.0
            total += float(y @ loss.sum(axis=1) - loss.sum(axis=0) @ z)
    return total, int(ends.sum())


def pairwise_logistic(df: DataFrame, score: str = "score", target: str = "target", fraction: float = 0.1,
                      by: Sequence[str] = DATE, tie: str = "instrument_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Logistic loss over pairs (one of the day's best fraction, a worse name), weighted by the target difference.

    Pairs are summed inside cells of two blocks of names, a few hundred of each at a time; a cell emits one row.
    """
    by = list(by)
    valid = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(
        *by, tie, F.col(score).cast("double").alias("_p"), F.col(target).cast("double").alias("_y"))
    sizes = valid.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = durable(attach(ordinal_positions(valid, by, "_y", tie, "_pos", descending=True), sizes, by))
    top = placed.where(F.col("_pos") < F.greatest(F.floor(F.col("_n") * fraction), F.lit(1))).select(*by, tie, "_p", "_y")
    cells = rectangular_cells(top, placed.select(*by, tie, "_p", "_y"), by, tie, F.lit(2), block_rows).drop(tie)
    kinds = {f.name: f.dataType.simpleString() for f in valid.schema.fields}

    def one_cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b.select(["_left", "_p", "_y"]) for b in batches]
        left, p, y = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("_left", "_p", "_y"))
        total, pairs = pairwise_loss_sum((p[left], y[left]), (p[~left], y[~left]), min(block_rows, 512))
        yield pa.record_batch([*[pa.array([k.as_py()], k.type) for k in key[:len(by)]], pa.array([total]), pa.array([pairs])], names=[*by, "s", "n"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "s double", "n bigint"])
    # cells cost far more than their rows weigh, so they aren't left to be merged into few tasks
    summed = cells.repartition(GRID * (GRID + 1) // 2, *by, "_i", "_j").groupBy(*by, "_i", "_j").applyInArrow(one_cell, schema).groupBy(*by).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = attach(placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), summed, by)
    value = F.when(F.col("_n") > 1, F.col("s") / (F.col("n") + 1e-8)).otherwise(0.0)
    return out.select(*by, value.alias("pairwise_logistic"))


def information_coefficient(df: DataFrame, score: str = "score", target: str = "target", by: Sequence[str] = DATE,
                            mode: str = "pearson", tie: str = "instrument_id") -> DataFrame:
    """Correlation per day; 0 for a single name or a constant side.

    ``mode`` "rank" correlates the places of both sides (equal values in the order of ``tie``) instead of the values.
    """
    if mode not in ("pearson", "rank"):
        raise ValueError(f"unknown mode: {mode}")
    valid = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    s, t = F.col(score), F.col(target)
    if mode == "rank":
        valid = ordinal_positions(valid.select(*by, tie, score, target), by, score, tie, "_ps")
        valid = ordinal_positions(valid, by, target, tie, "_pt")
        s, t = F.col("_ps").cast("double"), F.col("_pt").cast("double")
    value = F.coalesce(F.covar_pop(s, t) / (F.sqrt(F.var_pop(s) + 1e-12) * F.sqrt(F.var_pop(t) + 1e-12) + 1e-12), F.lit(0.0))
    return valid.groupBy(*by).agg(F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)).alias("ic"))


def volatility_error(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = DATE) -> DataFrame:
    """Huber (unit threshold), squared and absolute error of a volatility forecast per day."""
    valid = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    e = F.col(predicted) - F.col(actual)
    huber = F.when(F.abs(e) < 1.0, e * e * 0.5).otherwise(F.abs(e) - 0.5)
    return valid.groupBy(*by).agg(F.avg(huber).alias("huber"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


# ---- linear scores --------------------------------------------------------------------------------------------

def linear_score(df: DataFrame, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    """Weighted sum of feature columns, a NULL feature counting as 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * float(w)
    return df.withColumn(out, total)


def group_ablation(df: DataFrame, weights: Mapping[str, float], groups: Mapping[str, Sequence[str]],
                   strategy: Strategy, ret: str = "ret", by_metric: str = "risk_adjusted",
                   risk_lambda: float = RISK_LAMBDA) -> DataFrame:
    """(factor_group, num_features, value, delta): the strategy's metric with each feature group left out of a linear score."""
    variants = {"": dict(weights), **{g: {c: w for c, w in weights.items() if c not in set(cols)} for g, cols in groups.items()}}

    def total(w):
        parts = F.lit(0.0)
        for c, v in w.items():
            parts = parts + F.coalesce(F.col(c), F.lit(0.0)) * float(v)
        return parts

    scored = df.select("instrument_id", "trade_date", ret, F.explode(F.array(*[
        F.struct(F.lit(g).alias("g"), total(w).alias("s")) for g, w in variants.items()])).alias("v")).select(
        "instrument_id", "trade_date", ret, F.col("v.g").alias("variant"), F.col("v.s").alias("score"))
    returns = strategy_returns(scored, [strategy], ret=ret, by=["trade_date", "variant"])
    metrics = strategy_metrics(returns, risk_lambda, ["variant"])
    base = metrics.where(F.col("variant") == "").agg(F.max(by_metric)).scalar()
    size = F.coalesce(*[F.when(F.col("variant") == g, F.lit(len(cols))) for g, cols in groups.items()])
    return metrics.where(F.col("variant") != "").select(
        F.col("variant").alias("factor_group"), size.alias("num_features"), F.col(by_metric).alias("value"),
        (F.col(by_metric) - base).alias("delta"))


def fit_ranker(df: DataFrame, features: Sequence[str], target: str, kind: str = "linear", **params):
    """A Spark ML pipeline that scores rows from feature columns; NULL features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression
    maker = {"linear": LinearRegression, "gbt": GBTRegressor}[kind]
    rows = df.where(F.col(target).isNotNull()).select(*features, target).fillna(0.0, list(features))
    model = maker(featuresCol="_features", labelCol=target, predictionCol="score", **params)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(rows)


def score_with(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(df.fillna(0.0, list(features))).drop("_features")


def top_list(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best names of the last day with their rank."""
    last = df.agg(F.max("trade_date")).scalar()
    rows = df.where(F.col("trade_date") == last).select("trade_date", "instrument_id", "score")
    return top_rows(rows, ["trade_date"], [F.desc("score"), F.asc("instrument_id")], k)


def reselect(scores: DataFrame, folds: DataFrame, grid: Sequence[Strategy], by: str = "risk_adjusted", batch: int = 4,
             risk_lambda: float = RISK_LAMBDA) -> DataFrame:
    """The best strategy over the folds from stored (day, instrument, score, ret) rows, with its rank correlation."""
    from .splits import with_fold
    in_folds = with_fold(scores, folds)
    named = in_folds.select("trade_date", "fold").distinct()
    metrics = batched_metrics(strategy_returns(in_folds, grid), named, batch, risk_lambda)
    ic = rank_ic_summary(rank_ic(in_folds))
    spot = ic.select(F.struct("rank_ic_mean", "rank_ic_std", "rank_ic_ir")).scalar()
    best = best_strategy(metrics, by)
    return best.withColumn("_i", spot).select("strategy", "mean_return", "return_std", "risk_adjusted", "objective",
                                              F.col("_i.rank_ic_mean").alias("rank_ic_mean"), F.col("_i.rank_ic_ir").alias("rank_ic_ir"))
