"""The fixed factor sets over a daily panel (open, high, low, close, volume, amount, turnover)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as r
from ..functions.factor import EPS, PANEL, Axis, Factor, by_instrument, combine, factor, with_factors
from ..functions.recursive import Recursive, recursive, with_recursive
from ..functions.scalar import row_max, row_min, vwap
from ..operators.cross_section import null_policy

WINDOWS = (5, 10, 20, 30, 60)


def _or_zero(x: Factor) -> Factor:
    return combine("or0", lambda c: F.coalesce(c, F.lit(0.0)), x)


def alpha158(axis: Axis = PANEL, windows: Sequence[int] = WINDOWS) -> dict[str, Factor]:
    """158 price and volume factors: 13 of the day itself and 29 per window."""
    o, h, l, c, v, a = (factor(x, axis) for x in ("open", "high", "low", "close", "volume", "amount"))
    upper, lower = row_max(o, c), row_min(o, c)
    span, base = h - l + EPS, o + EPS
    out = {
        "KMID": (c - o) / base, "KLEN": (h - l) / base, "KMID2": (c - o) / span,
        "KUP": (h - upper) / base, "KUP2": (h - upper) / span,
        "KLOW": (lower - l) / base, "KLOW2": (lower - l) / span,
        "KSFT": (c * 2.0 - h - l) / base, "KSFT2": (c * 2.0 - h - l) / span,
    }
    price = c + EPS
    out |= {"OPEN0": o / price, "HIGH0": h / price, "LOW0": l / price, "VWAP0": vwap(a, v) / price}
    per_volume = v + EPS
    log_volume = combine("ln1", lambda x: F.ln(x + 1.0), v)
    price_step = _or_zero(c / (r.shift(c) + EPS))
    volume_step = _or_zero(combine("ln1", lambda x: F.ln(x + 1.0), v / (r.shift(v) + EPS)))

    def corr_or_zero(x: Factor, y: Factor, w: int) -> Factor:
        """Correlation; 0 where the window is full and one side constant."""
        full = r.sma(x, w) * 0.0 + r.sma(y, w) * 0.0
        return combine("corr_or_zero", F.coalesce, r.rolling_corr(x, y, w), full)

    for w in windows:
        highest, lowest = r.rolling_max(h, w), r.rolling_min(l, w)
        out[f"ROC{w}"] = r.shift(c, w) / price
        out[f"MA{w}"] = r.sma(c, w) / price
        out[f"STD{w}"] = r.population_std(c, w) / price
        out[f"BETA{w}"] = r.linearreg_slope(c, w) / price
        out[f"RSQR{w}"] = r.linearreg_rsquare(c, w)
        out[f"RESI{w}"] = r.linearreg_residual(c, w) / price
        out[f"MAX{w}"] = highest / price
        out[f"MIN{w}"] = lowest / price
        at_top, at_bottom = r.argmax_ratio(h, w), r.argmin_ratio(l, w)
        out[f"QTLU{w}"] = r.rolling_quantile(c, w, 0.8) / price
        out[f"QTLD{w}"] = r.rolling_quantile(c, w, 0.2) / price
        out[f"RANK{w}"] = r.rank_pct(c, w)
        out[f"RSV{w}"] = (c - lowest) / (highest - lowest + EPS)
        out[f"IMAX{w}"] = at_top
        out[f"IMIN{w}"] = at_bottom
        out[f"IMXD{w}"] = at_top - at_bottom
        out[f"CORR{w}"] = corr_or_zero(c, log_volume, w)
        out[f"CORD{w}"] = corr_or_zero(price_step, volume_step, w)
        out[f"CNTP{w}"] = r.direction_up_rate(c, w)
        out[f"CNTN{w}"] = r.direction_down_rate(c, w)
        out[f"CNTD{w}"] = r.direction_balance_rate(c, w)
        out[f"SUMP{w}"] = r.diff_up_ratio(c, w)
        out[f"SUMN{w}"] = r.diff_down_ratio(c, w)
        out[f"SUMD{w}"] = r.diff_balance_ratio(c, w)
        out[f"VMA{w}"] = r.sma(v, w) / per_volume
        out[f"VSTD{w}"] = r.population_std(v, w) / per_volume
        out[f"WVMA{w}"] = r.vol_weighted_volatility(c, v, w, eps=0.0)
        out[f"VSUMP{w}"] = r.diff_up_ratio(v, w)
        out[f"VSUMN{w}"] = r.diff_down_ratio(v, w)
        out[f"VSUMD{w}"] = r.diff_balance_ratio(v, w)
    return out


def tech39_windowed(axis: Axis = PANEL) -> dict[str, Factor]:
    """The technical columns that need no recursion."""
    o, h, l, c, v = (factor(x, axis) for x in ("open", "high", "low", "close", "volume"))
    step = r.pct_change(c)
    rising = combine("rising", lambda a, b: F.when(a > b, 1.0).otherwise(0.0), c, o)
    return {
        "sma_5": r.sma(c, 5), "sma_20": r.sma(c, 20), "kdj_k": r.kdj_k(h, l, c), "kdj_d": r.kdj_d(h, l, c),
        "kdj_j": r.kdj_j(h, l, c), "boll_mid": r.boll_mid(c, 20), "boll_std": r.boll_std(c, 20), "obv": r.obv(c, v),
        "volume_change": r.pct_change(v), "volume_ma_5": r.sma(v, 5), "volume_ma_20": r.sma(v, 20),
        "volume_ratio": r.sma(v, 5) / r.sma(v, 20),
        "return_1": step, "return_5": r.pct_change(c, 5), "return_10": r.pct_change(c, 10),
        "volatility_10": r.rolling_std(step, 10), "volatility_20": r.rolling_std(step, 20),
        "high_low_spread": h - l, "open_close_spread": o - c, "high_close_spread": h - c, "low_close_spread": l - c,
        "mom_acc": r.pct_change(c, 3) - r.pct_change(c, 10), "pv_div": (h - o) / (v + EPS),
        "consecutive_pos": r.rolling_sum(rising, 5),
    }


def tech39_recursive() -> dict[str, Recursive]:
    return {
        "ema_12": recursive("seeded_ema", "close", n=12), "ema_26": recursive("seeded_ema", "close", n=26),
        "ema_60": recursive("seeded_ema", "close", n=60), "macd": recursive("macd_line", "close"),
        "macd_signal": recursive("macd_signal", "close"), "rsi": recursive("rsi", "close", n=14),
        "atr_14": recursive("atr", "high", "low", "close", n=14),
    }


# Order in which the technical columns are listed.
TECH39 = ("sma_5", "sma_20", "ema_12", "ema_26", "ema_60", "macd", "macd_signal", "rsi", "kdj_k", "kdj_d", "kdj_j",
          "boll_mid", "boll_std", "atr_14", "obv", "volume_change", "volume_ma_5", "volume_ma_20", "volume_ratio",
          "return_1", "return_5", "return_10", "volatility_10", "volatility_20", "high_low_spread",
          "open_close_spread", "high_close_spread", "low_close_spread", "mom_acc", "pv_div", "consecutive_pos")


def custom_windowed(axis: Axis = PANEL) -> dict[str, Factor]:
    """The shipped custom factors that need no recursion."""
    o, h, l, c, v, t = (factor(x, axis) for x in ("open", "high", "low", "close", "volume", "turnover"))
    return {
        "return_20": r.pct_change(c, 20), "turnover_mean_20": r.sma(t, 20), "pvt_factor": r.pvt(c, v),
        "emv_14": r.emv(h, l, v, 14), "bbi_factor": r.bbi(c), "cci_20": r.cci(h, l, c, 20), "psy_12": r.psy(c, 12),
        "mfi_14": r.mfi(h, l, c, v, 14), "ad_line_factor": r.ad_line(h, l, c, v), "imi_14": r.imi(o, c, 14),
        "aroon_osc_25": r.aroon_osc(h, l, 25), "vhf_28": r.vhf(h, l, c, 28),
        "price_dev_ma20": r.price_deviation(c, 20), "max_daily_return_20": r.max_daily_return(c, 20),
        "return_skew_20": r.rolling_skew(r.pct_change(c, 1), 20),
        "multi_ma_momentum": r.normalized_ma_momentum(c, 5, 10, 20, 60),
    }


def custom_recursive() -> dict[str, Recursive]:
    return {
        "adx_14": recursive("adx", "high", "low", "close", n=14), "tema_20": recursive("tema", "close", n=20),
        "chaikin_osc_3_10": recursive("chaikin_osc", "high", "low", "close", "volume", fast=3, slow=10),
        "chaikin_volatility_10": recursive("chaikin_volatility", "high", "low", n=10),
        "cmo_14": recursive("cmo", "close", n=14),
    }


def engineer(df: DataFrame, feature_set: str = "158+39", default: float | None = 0.0, axis: Axis = PANEL) -> DataFrame:
    """``df`` with the named set ("158", "39", "158+39" or "custom"); what is undefined becomes ``default``.

    The recursive columns come first, in a pass of their own; all windows share one shuffle by instrument.
    """
    sets = {"158": lambda: (alpha158(axis), {}),
            "39": lambda: (tech39_windowed(axis), tech39_recursive()),
            "158+39": lambda: (alpha158(axis) | tech39_windowed(axis), tech39_recursive()),
            "custom": lambda: (custom_windowed(axis), custom_recursive())}
    if feature_set not in sets:
        raise ValueError(f"unknown feature set: {feature_set}")
    windowed, recursed = sets[feature_set]()
    out = by_instrument(df, axis)
    if recursed:
        out = with_recursive(out, recursed, axis)
    return null_policy(with_factors(out, windowed), [*recursed, *windowed], default)
