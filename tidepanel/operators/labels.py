"""Forward-looking labels and the targets made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factor import EPS, PANEL, Axis, Factor, factor, windowed
from ..functions.rolling import shift
from ..session import durable
from .cross_section import DATE, attach, cs_rank, cs_zscore, one_per_day, winsorize_mad
from .ordering import group_quantiles, mapped_counts, medians_and_spreads, ordinal_positions, quantiles_of, value_counts


def forward_return(open_: str = "open", horizon: int = 5, axis: Axis = PANEL) -> Factor:
    """Return from the next day's open to the open ``horizon`` days ahead."""
    price = factor(open_, axis)
    entry, exit_ = shift(price, -1), shift(price, -horizon)
    return (exit_ - entry) / (entry + EPS)


def forward_volatility(open_: str = "open", horizon: int = 5, axis: Axis = PANEL) -> Factor:
    """Population deviation of the open-to-open returns of the next ``horizon`` days, missing ones skipped."""
    horizon = max(3, int(horizon))

    def build(ax, c):
        ahead = [F.lead(c, k).over(ax.ordered()) for k in range(1, horizon + 1)]
        steps = F.array_compact(F.array(*[(b - a) / (a + EPS) for a, b in zip(ahead, ahead[1:])]))
        n = F.size(steps)
        mean = F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v) / n
        square = F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) / n
        return F.when(n > 0, F.sqrt(square))
    return windowed(f"forward_volatility{horizon}", build, factor(open_, axis))


def neutralize(df: DataFrame, label: str, method: str = "cross_mean", benchmark: DataFrame | None = None,
               industry: str = "industry", by: Sequence[str] = DATE) -> DataFrame:
    """Subtracts the day's mean, its benchmark return, or the industry's mean of the day from a label.

    ``benchmark`` has (trade_date, benchmark_return).  Without an industry, or without a benchmark value of the
    day, the day's mean is taken.  ``none`` leaves the label as it is.
    """
    steps = {"none": [], "cross_mean": ["mean"], "benchmark": ["benchmark"], "industry": ["industry"],
             "benchmark_then_industry": ["benchmark", "industry"],
             "industry_then_benchmark": ["industry", "benchmark"]}
    if method not in steps:
        raise ValueError(f"unknown neutralisation: {method}")
    out = df
    for step in steps[method]:
        means = out.groupBy(*by).agg(F.avg(label).alias("_mean"))
        joined = attach(out, means, by)
        base = F.col("_mean")
        if step == "benchmark" and benchmark is not None:
            joined = attach(joined, one_per_day(benchmark.select(*by, "benchmark_return"), by), by)
            base = F.coalesce(F.col("benchmark_return"), base)
        if step == "industry":
            groups = out.where(F.col(industry).isNotNull()).groupBy(*by, industry).agg(F.avg(label).alias("_group"))
            joined = attach(joined, groups, [*by, industry])
            base = F.coalesce(F.col("_group"), base)
        out = joined.select(*[(F.col(label) - base).alias(c) if c == label else F.col(c) for c in df.columns])
    return out


def benchmark_returns(bench: DataFrame, order: Sequence[str] = (), return_column: str | None = "pct_chg",
                      open_column: str = "open", horizon: int = 5) -> DataFrame:
    """(trade_date, benchmark_return) of one index series: its return column, scaled down when it is in percent,
    else the forward open-to-open return; the last row of a repeated day counts."""
    if return_column and return_column in bench.columns:
        size = group_quantiles(bench.select(F.abs(F.col(return_column)).alias("_a")), [], "_a", {"m": 0.5}).scalar()
        value = F.col(return_column) / F.when(size > 1.0, 100.0).otherwise(1.0)
        rows = bench.withColumn("benchmark_return", value)
    else:
        # one index: its history is one calendar long
        spec = Window.partitionBy(F.lit(1)).orderBy("trade_date", *order)
        entry, exit_ = F.lead(open_column, 1).over(spec), F.lead(open_column, horizon).over(spec)
        rows = bench.withColumn("benchmark_return", (exit_ - entry) / (entry + EPS))
    rows = rows.where(F.col("benchmark_return").isNotNull())
    rank = F.struct(*order) if order else F.lit(0)
    return rows.groupBy("trade_date").agg(F.max_by("benchmark_return", rank).alias("benchmark_return"))


def process_volatility(df: DataFrame, label: str = "vol_label", method: str = "zscore", log: bool = True,
                       mad_n: float | None = 5.0, clip_at: float | None = 5.0, by: Sequence[str] = DATE) -> DataFrame:
    """log1p, median limits, cross-sectional z-score (or 2 * rank - 1) and symmetric limits, in this order."""
    value = F.when(F.col(label).isNotNull(), F.greatest(F.col(label), F.lit(0.0)))
    out = df.withColumn(label, F.log1p(value) if log else value)
    if mad_n is not None:
        out = winsorize_mad(out, [label], n=mad_n, by=by)
    if method == "zscore":
        return cs_zscore(out, {label: label}, by, eps=1e-6, clip_at=clip_at).select(*df.columns)
    if method != "rank":
        raise ValueError(f"unknown method: {method}")
    ranked = cs_rank(out, {label: label}, by=by)
    value = F.col(label) * 2.0 - 1.0
    if clip_at is not None:
        value = F.greatest(F.least(value, F.lit(clip_at)), F.lit(-clip_at))
    return ranked.withColumn(label, F.when(F.col(label).isNotNull(), value)).select(*df.columns)


def _bounds(counts: DataFrame, by: Sequence[str], kind: str, lower_q: float, upper_q: float, mad_n: float, min_scale: float) -> DataFrame:
    """(by, _lower, _upper) from the counts (by, _x, _n) of the targets."""
    if kind == "quantile":
        return quantiles_of(counts, by, {"_lower": lower_q, "_upper": upper_q})
    reach = F.greatest(F.col("_mad") * 1.4826, F.lit(min_scale)) * mad_n
    return medians_and_spreads(counts, by, "lower_median").select(
        *by, (F.col("_med") - reach).alias("_lower"), (F.col("_med") + reach).alias("_upper"))


def transform_targets(df: DataFrame, target: str, mode: str = "none", norm: str | None = "zscore",
                      lower_q: float = 0.05, upper_q: float = 0.95, mad_n: float = 5.0, min_scale: float = 1e-6,
                      clip_at: float | None = None, by: Sequence[str] = DATE, tie: str = "instrument_id") -> DataFrame:
    """Targets of a ranking loss: rows outside the day's limits dropped and/or limited, then normalised per day.

    ``mode``: none, drop, clip, drop_clip, mad_drop, mad_clip, mad_drop_clip.  Days of five names or fewer drop
    nothing, days of two or fewer are not limited, and a day keeps all rows when fewer than two would remain.
    """
    if mode not in ("none", "drop", "clip", "drop_clip", "mad_drop", "mad_clip", "mad_drop_clip"):
        raise ValueError(f"unknown mode: {mode}")
    if norm not in ("zscore", "rank", None):
        raise ValueError(f"unknown normalisation: {norm}")
    by = list(by)
    kind = "mad" if mode.startswith("mad") else "quantile"
    x, n = F.col("_x"), F.col("_n")
    out = df.where(F.col(target).isNotNull())
    # limits and moments come from these counts, in one pass over the rows; limits, one row per day, are stored
    counts = value_counts(out, by, [target]).select(*by, "_x", "_n")
    if "drop" in mode:
        bounds = _bounds(counts, by, kind, lower_q, upper_q, mad_n, min_scale)
        within = x.between(F.col("_lower"), F.col("_upper"))
        sizes = counts.join(bounds, by).groupBy(*by, "_lower", "_upper").agg(F.sum("_n").alias("_all"), F.sum(F.when(within, n).otherwise(0)).alias("_kept"))
        cut = durable(sizes.where((F.col("_all") > 5) & (F.col("_kept") >= 2)).select(*by, F.col("_lower").alias("_from"), F.col("_upper").alias("_to")))
        free = F.col("_from").isNull()
        counts = durable(counts.join(cut, by, "left").where(free | x.between(F.col("_from"), F.col("_to"))).select(*by, "_x", "_n"))
        out = attach(out, cut, by).where(free | F.col(target).between(F.col("_from"), F.col("_to"))).select(*df.columns)
    if "clip" in mode:
        bounds = _bounds(counts, by, kind, lower_q, upper_q, mad_n, min_scale)
        limits = durable(bounds.join(counts.groupBy(*by).agg(F.sum("_n").alias("_all")).where(F.col("_all") > 2), by))
        limited = lambda c: F.when(F.col("_lower").isNull(), c).otherwise(F.greatest(F.least(c, F.col("_upper")), F.col("_lower")))
        counts = mapped_counts(counts.join(limits, by, "left"), by, limited(x))
        out = attach(out, limits, by).select(*[limited(F.col(c)).alias(c) if c == target else F.col(c) for c in df.columns])
    value = F.col(target)
    if norm == "zscore":
        means = counts.groupBy(*by).agg((F.sum(x * n) / F.sum("_n")).alias("_mean"))
        spread = F.sqrt(F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))) / F.sum("_n"))
        stats = counts.join(means, by).groupBy(*by, "_mean").agg(spread.alias("_sd"))
        value = (value - F.col("_mean")) / (F.col("_sd") + 1e-6)
        out = attach(out, stats, by)
    elif norm == "rank":
        sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
        out = attach(ordinal_positions(out, by, target, tie, "_pos"), sizes, by)
        value = F.when(F.col("_all") > 1, F.try_divide(F.col("_pos"), F.col("_all") - 1) * 2.0 - 1.0).otherwise(0.0)
    if norm and clip_at is not None:
        value = F.greatest(F.least(value, F.lit(clip_at)), F.lit(-clip_at))
    return out.select(*[value.alias(c) if c == target else F.col(c) for c in df.columns])


def relevance(df: DataFrame, target: str, q: float = 0.98, by: Sequence[str] = DATE) -> DataFrame:
    """1 for names at or above the day's upper quantile of the target, else 0."""
    edge = group_quantiles(df, by, target, {"_edge": q})
    flag = F.when(F.col(target) >= F.col("_edge"), 1.0).otherwise(0.0)
    return attach(df, edge, by).select(*df.columns, flag.alias("relevance"))


def rank_relevance(df: DataFrame, target: str, tie: str = "instrument_id", by: Sequence[str] = DATE) -> DataFrame:
    """Names of the day minus the place in descending order: the best name gets the largest number."""
    sizes = df.groupBy(*by).agg(F.count(target).alias("_n"))
    placed = attach(ordinal_positions(df, by, target, tie, "_pos", descending=True), sizes, by)
    return placed.select(*df.columns, (F.col("_n") - F.col("_pos")).alias("relevance"))
