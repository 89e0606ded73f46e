"""Row-wise helpers (no window)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .factor import EPS, Factor, combine, factor

PI = math.pi
E = math.e


def absolute(x) -> Factor: return combine("abs", F.abs, x)
def exp(x) -> Factor: return combine("exp", F.exp, x)
def sign(x) -> Factor: return combine("sign", F.signum, x)
def power(x, y) -> Factor: return combine("pow", F.pow, x, y)


def log(x) -> Factor:
    """Natural logarithm; NULL where the argument is not positive."""
    return combine("ln", F.ln, x)


def log1p(x) -> Factor:
    return combine("log1p", F.log1p, x)


def sqrt(x) -> Factor:
    """Square root; NULL where the argument is negative."""
    return combine("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)), x)


def clip(x, lower=None, upper=None) -> Factor:
    """Limit to [lower, upper]; NULL stays NULL (``greatest`` alone would drop it)."""
    out = factor(x)
    if lower is not None:
        out = combine("clip_lo", lambda c, lo: F.when(c.isNotNull(), F.greatest(c, lo)), out, lower)
    if upper is not None:
        out = combine("clip_hi", lambda c, hi: F.when(c.isNotNull(), F.least(c, hi)), out, upper)
    return out


def where(condition, x, y) -> Factor:
    """``x`` where the condition holds, ``y`` where it is false or NULL."""
    return combine("where", lambda c, a, b: F.when(c, a).otherwise(b), condition, x, y)


def row_max(x, y) -> Factor:
    """The larger value of a row; a NULL on one side is skipped."""
    return combine("row_max", F.greatest, x, y)


def row_min(x, y) -> Factor:
    return combine("row_min", F.least, x, y)


def maximum(x, y) -> Factor:
    """The larger value of a row; NULL as soon as one side is NULL."""
    return combine("maximum", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)), x, y)


def minimum(x, y) -> Factor:
    return combine("minimum", lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), x, y)


def nan_to_num(x, default: float = 0.0) -> Factor:
    return combine("nan_to_num", lambda c: F.coalesce(finite(c), F.lit(default)), x)


def to_float(x) -> Factor: return combine("float", lambda c: c.try_cast("double"), x)
def to_int(x) -> Factor: return combine("int", lambda c: c.try_cast("bigint"), x)
def to_bool(x) -> Factor: return combine("bool", lambda c: c.try_cast("boolean"), x)


def vwap(amount, volume) -> Factor:
    return factor(amount) / (factor(volume) + EPS)


def finite(c):
    """A Column with NaN and the infinities turned into NULL."""
    c = c.cast("double")
    # NaN counts as larger than every number, so one comparison excludes all three
    return F.when(F.abs(c) < F.lit(float("inf")), c)
