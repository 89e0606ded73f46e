"""Time-series factor functions over one instrument's history.

Every argument is a column name, a number or a :class:`Factor`.  A window of ``w`` rows yields NULL until ``w``
non-NULL values are in it.

Spark aggregates every row's frame anew, so a long frame costs its length for every row.  Sums, extremes, variances and
covariances of a long window are therefore joined from two shorter ones, the newer ending at the row itself and the older
being that of an earlier row; what isn't in the window never takes part, so nothing cancels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .factor import EPS, Axis, Factor, combine, factor, staged, windowed
from .scalar import absolute, clip, row_max


def over_last(name: str, agg, w: int, *args) -> Factor:
    """An aggregate over the last ``w`` rows, however few values they hold."""
    return windowed(f"{name}{w}", lambda ax, *c: agg(*c).over(ax.last(w)), *args)


def full(x, w: int, value: Factor) -> Factor:
    """``value`` where the last ``w`` rows all have an ``x``."""
    return combine(f"full{w}", lambda n, v: F.when(n == w, v), over_last("count", F.count, w, x), value)


def _rolling(name: str, agg, x, w: int) -> Factor:
    return full(x, w, over_last(name, agg, w, x))


def _values(x, w: int) -> Factor:
    """The window's values, oldest first: ``w`` numbers, ``w`` being a constant."""
    return _rolling("values", F.collect_list, x, w)


def shift(x, n: int = 1) -> Factor:
    n = int(n)
    if n >= 0:
        return windowed(f"lag{n}", lambda ax, c: F.lag(c, n).over(ax.ordered()), x)
    return windowed(f"lead{-n}", lambda ax, c: F.lead(c, -n).over(ax.ordered()), x)


def diff(x, n: int = 1) -> Factor:
    x = factor(x)
    return x - shift(x, n)


delta = diff


def pct_change(x, n: int = 1) -> Factor:
    x = factor(x)
    return x / shift(x, n) - 1.0


def _parts(w: int) -> tuple[int, int] | None:
    """How many newer and older rows a long window is joined from; None where its frame is aggregated.

    The parts are alike or one is two of the other, so equal values have the very same mean in both.
    """
    if w < 10 or w % 2 and w % 3:
        return None
    return (w // 2, w // 2) if w % 2 == 0 else (w // 3 * 2, w // 3)


def _both(make, w: int) -> tuple[Factor, Factor]:
    """``make`` of the newer and of the older part of a long window."""
    new, old = _parts(w)
    newer = make(new)
    return newer, shift(newer if new == old else make(old), new)


def _joined(name: str, agg, join, x, w: int) -> Factor:
    """An aggregate over the last ``w`` rows where ``join`` makes one of two of them."""
    if _parts(w) is None:
        return _rolling(name, agg, x, w)
    return staged(f"{name}{w}", join, *_both(lambda n: _joined(name, agg, join, x, n), w))


def _total(x, w: int) -> Factor:
    return _joined("total", lambda c: F.sum(c.cast("double")), lambda a, b: a + b, x, w)


def _centred(name: str, agg, w: int, apart, *args) -> Factor:
    """A second moment, divided by ``w``; ``apart`` are the factors by which the means of the parts differ."""
    if _parts(w) is None:
        out = over_last(name, agg, w, *args)
        for x in args:
            out = full(x, w, out)
        return out
    new, old = _parts(w)

    def join(a, b, *gaps):
        between = gaps[0] * gaps[-1] * (new * old / (w * w))
        return a * (new / w) + b * (old / w) + between
    return staged(f"{name}{w}", join, *_both(lambda n: _centred(name, agg, n, apart, *args), w), *apart(w))


def _gap(x, w: int) -> Factor:
    """By how much the mean of a long window's newer part exceeds that of the older part."""
    new, old = _parts(w)
    return combine(f"gap{w}", lambda a, b: a / float(new) - b / float(old), *_both(lambda n: _total(x, n), w))


def _variance(x, w: int) -> Factor:
    """Population variance; exactly 0 on a constant window."""
    return _centred("var", F.var_pop, w, lambda n: (_gap(x, n),), x)


def _covariance(x, y, w: int) -> Factor:
    return _centred("covar", F.covar_pop, w, lambda n: (_gap(x, n), _gap(y, n)), x, y)


def _root(name: str, scale: float, x, w: int) -> Factor:
    return combine(name, lambda v: F.sqrt(v * scale), _variance(x, w))


def sma(x, w: int) -> Factor: return _total(x, w) / float(w)


def rolling_std(x, w: int) -> Factor:
    return _root("std", w / (w - 1), x, w) if w > 1 else _rolling("std", F.stddev_samp, x, w)


def population_std(x, w: int) -> Factor: return _root("pstd", 1.0, x, w)
def rolling_min(x, w: int) -> Factor: return _joined("min", F.min, _and_null(F.least), x, w)
def rolling_max(x, w: int) -> Factor: return _joined("max", F.max, _and_null(F.greatest), x, w)
def rolling_sum(x, w: int) -> Factor: return _joined("sum", F.sum, lambda a, b: a + b, x, w)


def _and_null(pick):
    return lambda a, b: F.when(a.isNotNull() & b.isNotNull(), pick(a, b))


rolling_mean = sma


def rolling_skew(x, w: int) -> Factor:
    """Bias-corrected skewness; 0 on a constant window."""
    scale = math.sqrt(w * (w - 1)) / (w - 2)
    raw = over_last("skew", F.skewness, w, x)
    return full(x, w, combine("skew", lambda c: F.coalesce(F.nanvl(c, F.lit(None)) * scale, F.lit(0.0)), raw))


def _sorted(x, w: int) -> Factor:
    return staged(f"sorted{w}", F.sort_array, _values(x, w))


def rolling_quantile(x, w: int, q: float) -> Factor:
    """Linear between neighbours."""
    at = q * (w - 1)
    low, high = math.floor(at), math.ceil(at)

    def pick(ordered):
        a, b = F.element_at(ordered, low + 1), F.element_at(ordered, high + 1)
        return a + (b - a) * (at - low)
    return staged(f"quantile{q}", pick, _sorted(x, w))


def rank_pct(x, w: int) -> Factor:
    """Rank of the newest value within its window, ties averaged, divided by ``w``."""
    def rank(ordered, newest):
        # two points for a smaller value, one for an equal one (the newest itself included)
        smaller = F.array_position(ordered, newest) - 1
        greater = F.array_position(F.reverse(ordered), newest) - 1
        return (smaller + w - greater + 1) / (2.0 * w)
    return staged(f"rank_pct{w}", rank, _sorted(x, w), x)


rolling_rank = rank_pct


def zscore(x, w: int) -> Factor:
    x = factor(x)
    return (x - sma(x, w)) / (rolling_std(x, w) + EPS)


def _place(x, w: int, extreme, pick, before) -> Factor:
    """Position of the row with the first of the window's extremes; ``before`` tells whether an older one comes first."""
    name = extreme.__name__
    if _parts(w) is None:
        return staged(f"place_{name}{w}", lambda v, at: at - float(w) + F.array_position(v, pick(v)), _values(x, w), position(factor(x).axis))

    def join(new, old, newer, older):
        return F.when(before(older, newer), old).when(~before(older, newer), new)
    return staged(f"place_{name}{w}", join, *_both(lambda n: _place(x, n, extreme, pick, before), w), *_both(lambda n: extreme(x, n), w))


def _place_ratio(place: Factor, w: int) -> Factor:
    return (place - position(place.axis) + (w - 1.0)) / float(w)


def argmax_ratio(x, w: int) -> Factor:
    """Place of the first largest value in the window, counted from 0, over ``w``."""
    return _place_ratio(_place(x, w, rolling_max, F.array_max, lambda older, newer: older >= newer), w)


def argmin_ratio(x, w: int) -> Factor:
    return _place_ratio(_place(x, w, rolling_min, F.array_min, lambda older, newer: older <= newer), w)


def argmax_minus_argmin_ratio(x, y, w: int) -> Factor:
    return argmax_ratio(x, w) - argmin_ratio(y, w)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL, never an error, when one side is constant (``corr`` divides by zero there)."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def rolling_corr(x, y, w: int) -> Factor:
    """NULL until ``w`` rows have both values, and when one side is constant."""
    x, y = factor(x), factor(y)
    return combine("corr", lambda c, a, b: F.try_divide(c, a * b), _covariance(x, y, w), population_std(x, w), population_std(y, w))


def position(axis: Axis) -> Factor:
    return windowed("position", lambda ax: F.row_number().over(ax.ordered()).cast("double"), axis=axis)


def _with_time(x, w: int) -> Factor:
    """Covariance with the position; the means of the parts' positions are half a window apart."""
    x = factor(x)

    def covar(c, at):
        return F.covar_pop(c, at)
    return _centred("timecov", covar, w, lambda n: (_gap(x, n), factor(n / 2)), x, position(x.axis))


def linearreg_slope(x, w: int) -> Factor:
    return _with_time(x, w) / ((w * w - 1) / 12)


def linearreg_rsquare(x, w: int) -> Factor:
    scale = math.sqrt((w * w - 1) / 12)
    return combine("rsquare", lambda c, s: F.pow(F.try_divide(c, s * scale), F.lit(2.0)), _with_time(x, w), population_std(x, w))


def linearreg_residual(x, w: int) -> Factor:
    """Newest value minus the value of the fitted line there."""
    x = factor(x)
    return x - (sma(x, w) + linearreg_slope(x, w) * ((w - 1) / 2))


def _share(name: str, test, x, w: int) -> Factor:
    x = factor(x)
    hit = combine(name, lambda a, b: F.when(test(a, b), 1.0).otherwise(0.0), x, shift(x, 1))
    return sma(hit, w)


def direction_up_rate(x, w: int) -> Factor: return _share("up", lambda a, b: a > b, x, w)
def direction_down_rate(x, w: int) -> Factor: return _share("down", lambda a, b: a < b, x, w)


def direction_balance_rate(x, w: int) -> Factor:
    return direction_up_rate(x, w) - direction_down_rate(x, w)


def _gains(x, w: int) -> Factor: return rolling_sum(clip(diff(x), lower=0.0), w)
def _losses(x, w: int) -> Factor: return rolling_sum(clip(-diff(x), lower=0.0), w)
def _moves(x, w: int) -> Factor: return rolling_sum(absolute(diff(x)), w)


def diff_up_ratio(x, w: int) -> Factor: return _gains(x, w) / (_moves(x, w) + EPS)
def diff_down_ratio(x, w: int) -> Factor: return _losses(x, w) / (_moves(x, w) + EPS)
def diff_balance_ratio(x, w: int) -> Factor: return (_gains(x, w) - _losses(x, w)) / (_moves(x, w) + EPS)


def vol_weighted_volatility(close, volume, w: int, eps: float = EPS) -> Factor:
    close, volume = factor(close), factor(volume)
    weighted = absolute(close / (shift(close) + eps) - 1.0) * volume
    return rolling_std(weighted, w) / (sma(weighted, w) + EPS)


def psy(close, w: int) -> Factor: return direction_up_rate(close, w) * 100.0


def bbi(close) -> Factor:
    return (sma(close, 3) + sma(close, 6) + sma(close, 12) + sma(close, 24)) / 4.0


def running_sum(x) -> Factor:
    return windowed("running", lambda ax, c: F.sum(c).over(ax.running()), x)


def pvt(close, volume) -> Factor:
    move = combine("or0", lambda c: F.coalesce(c, F.lit(0.0)), pct_change(close))
    return running_sum(move * factor(volume))


def emv(high, low, volume, w: int) -> Factor:
    high, low, volume = factor(high), factor(low), factor(volume)
    box = volume / (high - low + EPS)
    return sma(diff((high + low) / 2.0) / (box + EPS), w)


def imi(open_, close, w: int) -> Factor:
    move = factor(close) - factor(open_)
    return rolling_sum(clip(move, lower=0.0), w) / (rolling_sum(absolute(move), w) + EPS) * 100.0


def vhf(high, low, close, w: int) -> Factor:
    return (rolling_max(high, w) - rolling_min(low, w)) / (_moves(close, w) + EPS)


def price_deviation(close, w: int) -> Factor:
    close = factor(close)
    return close / (sma(close, w) + EPS) - 1.0


def max_daily_return(close, w: int) -> Factor:
    return rolling_max(pct_change(close), w)


def normalized_ma_momentum(close, *windows: int) -> Factor:
    total = price_deviation(close, windows[0])
    for w in windows[1:]:
        total = total + price_deviation(close, w)
    return total / float(len(windows))


# ---- technical indicators that need no recursion -------------------------------------------------------------

def obv(close, volume) -> Factor:
    """Running signed volume; the first row counts with its own volume."""
    def signed(c, p, v):
        return F.when(p.isNull() | (c > p), v).when(c < p, -v).otherwise(F.lit(0.0))
    close = factor(close)
    return running_sum(combine("signed", signed, close, shift(close), volume))


def money_flow_volume(high, low, close, volume) -> Factor:
    def flow(h, l, c, v):
        return F.when(h > l, ((c - l) - (h - c)) / (h - l) * v).otherwise(F.lit(0.0))
    return combine("mfv", flow, high, low, close, volume)


def ad_line(high, low, close, volume) -> Factor:
    return running_sum(money_flow_volume(high, low, close, volume))


def boll_mid(close, w: int) -> Factor: return sma(close, w)


def boll_std(close, w: int, nbdev: float = 2.0) -> Factor:
    return population_std(close, w) * (nbdev / 2.0)


def kdj_k(high, low, close, fastk: int = 9, slowk: int = 3, slowd: int = 3) -> Factor:
    return _stochastic(high, low, close, fastk, slowk, slowd)[0]


def kdj_d(high, low, close, fastk: int = 9, slowk: int = 3, slowd: int = 3) -> Factor:
    return _stochastic(high, low, close, fastk, slowk, slowd)[1]


def kdj_j(high, low, close, fastk: int = 9, slowk: int = 3, slowd: int = 3) -> Factor:
    k, d = _stochastic(high, low, close, fastk, slowk, slowd)
    return k * 3.0 - d * 2.0


def _stochastic(high, low, close, fastk, slowk, slowd) -> tuple[Factor, Factor]:
    close = factor(close)
    top, bottom = rolling_max(high, fastk), rolling_min(low, fastk)
    raw = combine("stoch", lambda c, t, b: F.when(t > b, (c - b) / (t - b) * 100.0).when(t.isNotNull(), F.lit(0.0)),
                  close, top, bottom)
    slow = sma(raw, slowk)
    signal = sma(slow, slowd)
    # both lines start together, when the slower one does
    k = combine("with_signal", lambda a, b: F.when(b.isNotNull(), a), slow, signal)
    return k, signal


def cci(high, low, close, w: int) -> Factor:
    typical = (factor(high) + factor(low) + factor(close)) / 3.0

    def build(c, mean, values):
        spread = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - mean)) / w
        return F.when(spread != 0, (c - mean) / (spread * 0.015)).when(spread == 0, 0.0)
    return combine("cci", build, typical, sma(typical, w), _values(typical, w))


def mfi(high, low, close, volume, w: int) -> Factor:
    typical = (factor(high) + factor(low) + factor(close)) / 3.0
    before = shift(typical)
    flow = typical * factor(volume)
    inflow = combine("inflow", lambda t, p, m: F.when(p.isNotNull(), F.when(t > p, m).otherwise(0.0)), typical, before, flow)
    outflow = combine("outflow", lambda t, p, m: F.when(p.isNotNull(), F.when(t < p, m).otherwise(0.0)), typical, before, flow)
    up, down = rolling_sum(inflow, w), rolling_sum(outflow, w)
    return combine("mfi", lambda a, b: F.when(a + b < 1.0, F.lit(0.0)).otherwise(F.lit(100.0) * F.try_divide(a, a + b)), up, down)


def aroon_osc(high, low, w: int) -> Factor:
    """100/w * (bars since the lowest low - bars since the highest high) over w + 1 bars, the latest of ties."""
    def since(pick):
        return lambda v: F.array_position(F.reverse(v), pick(v))
    newest_high = combine("since_high", since(F.array_max), _values(high, w + 1))
    newest_low = combine("since_low", since(F.array_min), _values(low, w + 1))
    return (newest_low - newest_high) * (100.0 / w)


def true_range(high, low, close) -> Factor:
    high, low = factor(high), factor(low)
    before = shift(close)
    return row_max(row_max(absolute(high - low), absolute(high - before)), absolute(low - before))
