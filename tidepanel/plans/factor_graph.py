"""The shipped factor graph: daily, minute and macro inputs to thirteen factor columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intraday as i
from ..operators.cross_section import null_policy
from ..operators.joins import asof_columns, join_backfill, join_many_to_one
from ..operators.stats import add_missing
from .catalog import CrossSpec, FactorSpec, GraphResult, run_factors

EXPRESSIONS = (
    FactorSpec("f_ret_1d", "pct_change", {"x": "close", "n": 1}, group="price"),
    FactorSpec("f_ret_5d", "pct_change", {"x": "close", "n": 5}, group="price"),
    FactorSpec("f_vol_20d", "rolling_std", {"x": "f_ret_1d", "w": 20}, group="price"),
    FactorSpec("f_turnover_20d_mean", "rolling_mean", {"x": "turnover", "w": 20}, group="liquidity"),
)

# Which series each macro column follows, and after how many days it is stale.
MACRO = {"f_macro_m2_yoy": ("m2_yoy", 120.0), "f_macro_shibor_3m": ("shibor_3m", 20.0), "f_macro_usdcny": ("usdcny", 10.0)}

META = (
    CrossSpec("f_momentum_quality_score",
              lambda z, k: 0.5 * z("f_ret_5d") - 0.3 * z("f_vol_20d") + 0.2 * z("f_hf_tail_ret_30m"),
              zscores=("f_ret_5d", "f_vol_20d", "f_hf_tail_ret_30m")),
    CrossSpec("f_liquidity_stress_score",
              lambda z, k: 0.4 * z("f_turnover_20d_mean") + 0.3 * z("f_hf_tail_amount_share_30m") + 0.3 * z("f_macro_shibor_3m"),
              zscores=("f_turnover_20d_mean", "f_hf_tail_amount_share_30m", "f_macro_shibor_3m")),
    CrossSpec("f_regime_risk_on",
              lambda z, k: 0.4 * z("f_macro_m2_yoy") - 0.3 * z("f_macro_usdcny") + 0.3 * F.col("f_momentum_quality_score"),
              zscores=("f_macro_m2_yoy", "f_macro_usdcny"), columns=("f_momentum_quality_score",)),
)


HF_COLUMNS = ("f_hf_realized_vol_1d", "f_hf_tail_ret_30m", "f_hf_tail_amount_share_30m")


def minute_factors(minutes: DataFrame, min_bars: int = 20, tail: str = "30m") -> DataFrame:
    """The three intraday factor columns from canonical minute bars."""
    step = i.diff(i.log("close"))
    parts = i.day_aggregates(minutes, {
        "_var": i.day_agg("sum", step, power=2.0),
        "_first": i.day_agg("first", "close", tail), "_last": i.day_agg("last", "close", tail),
        "_tail": i.day_agg("sum", "amount", tail), "_all": i.day_agg("sum", "amount"),
    }, min_bars)
    return parts.select("instrument_id", "trade_date", F.sqrt("_var").alias(HF_COLUMNS[0]),
                        F.try_divide(F.col("_last") - F.col("_first"), F.col("_first")).alias(HF_COLUMNS[1]),
                        F.try_divide("_tail", "_all").alias(HF_COLUMNS[2]))


def factor_graph(daily: DataFrame, hf_daily: DataFrame | None = None, minutes: DataFrame | None = None,
                 macro: DataFrame | None = None, series: Mapping[str, tuple[str, float | None]] = MACRO,
                 min_bars: int = 20, strict: bool = True, zero_std: str = "null",
                 default: float | None = 0.0) -> GraphResult:
    """Daily panel to the wide factor table, row for row.

    Minute-derived values fill only what the daily intraday table leaves open; macro values are as of 15:00.
    """
    out = daily
    if hf_daily is not None:
        out = join_many_to_one(out, hf_daily)
    if minutes is not None:
        out = join_backfill(out, minute_factors(minutes, min_bars))
    if macro is not None:
        out = asof_columns(out, macro, series)
    out = add_missing(out, [*HF_COLUMNS, *series])
    made = run_factors(out, [*EXPRESSIONS, *META], strict=strict, zero_std=zero_std)
    wide = [*HF_COLUMNS, *series, *[s.name for s in EXPRESSIONS], *[s.name for s in META]]
    frame = null_policy(made.frame, [c for c in wide if c in made.frame.columns], default)
    return GraphResult(frame.select(*daily.columns, *[c for c in wide if c not in daily.columns]), made.status)
