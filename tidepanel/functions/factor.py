"""The value type the factor functions take and return.

Spark refuses a window function inside another one, so ``sma(pct_change(close), 20)`` has to become two
projections.  A :class:`Factor` carries a Column together with the helper columns it reads, grouped in the order
in which they have to exist.  :func:`with_factors` then adds the helpers of *all* requested factors layer by
layer, one ``select`` per layer.  A helper is named after what it computes, so two factors that need the same
lagged close share one column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12

# Window specifications already made while one select is being put together.
_specs: ContextVar[dict | None] = ContextVar("tidepanel_specs", default=None)


def _spec(key, make: Callable[[], WindowSpec]) -> WindowSpec:
    known = _specs.get()
    if known is None:
        return make()
    if key not in known:
        known[key] = make()
    return known[key]


@dataclass(frozen=True)
class Axis:
    """What a time series is: one row per ``key`` and ``order``.

    A daily panel holds one row per instrument and trading day, so a partition of these windows is at most as
    long as the calendar, however many rows the panel has.  Minute bars have no such bound: the intraday
    operators use time slots instead of this class.
    """

    key: tuple[str, ...] = ("instrument_id",)
    order: tuple[str, ...] = ("trade_date",)

    def ordered(self) -> WindowSpec:
        return _spec((self, None), lambda: Window.partitionBy(*self.key).orderBy(*self.order))

    def last(self, rows: int) -> WindowSpec:
        return _spec((self, rows), lambda: self.ordered().rowsBetween(-(int(rows) - 1), Window.currentRow))

    def running(self) -> WindowSpec:
        return _spec((self, "all"), lambda: self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow))


PANEL = Axis()


Make = Callable[[], Column]


def _merge(*steps: tuple[Mapping[str, Make], ...]) -> tuple[dict[str, Make], ...]:
    depth = max((len(s) for s in steps), default=0)
    merged: list[dict[str, Make]] = [{} for _ in range(depth)]
    for chain in steps:
        for layer, columns in enumerate(chain):
            merged[layer].update(columns)
    return tuple(merged)


@dataclass(frozen=True)
class Factor:
    """What a value is called, how its Column is made, and which helper columns must exist before."""

    label: str
    make: Make
    steps: tuple[Mapping[str, Make], ...] = ()
    axis: Axis = field(default=PANEL)

    @property
    def column(self) -> Column:
        return self.make()

    def map(self, label: str, fn) -> "Factor":
        """Row-wise function of this value."""
        return Factor(label, lambda: fn(self.make()), self.steps, self.axis)

    def __add__(self, other): return combine("+", lambda a, b: a + b, self, other)
    def __radd__(self, other): return combine("+", lambda a, b: a + b, other, self)
    def __sub__(self, other): return combine("-", lambda a, b: a - b, self, other)
    def __rsub__(self, other): return combine("-", lambda a, b: a - b, other, self)
    def __mul__(self, other): return combine("*", lambda a, b: a * b, self, other)
    def __rmul__(self, other): return combine("*", lambda a, b: a * b, other, self)
    def __truediv__(self, other): return combine("/", F.try_divide, self, other)
    def __rtruediv__(self, other): return combine("/", F.try_divide, other, self)
    def __floordiv__(self, other): return combine("//", lambda a, b: F.floor(F.try_divide(a, b)).cast("double"), self, other)
    def __mod__(self, other):
        # the sign of the divisor, as in Python
        return combine("%", lambda a, b: a - b * F.floor(F.try_divide(a, b)), self, other)
    def __pow__(self, other): return combine("**", F.pow, self, other)
    def __neg__(self): return self.map(f"-({self.label})", lambda c: -c)
    def __pos__(self): return self
    def __invert__(self): return self.map(f"not({self.label})", lambda c: ~c)
    def __gt__(self, other): return combine(">", lambda a, b: a > b, self, other)
    def __ge__(self, other): return combine(">=", lambda a, b: a >= b, self, other)
    def __lt__(self, other): return combine("<", lambda a, b: a < b, self, other)
    def __le__(self, other): return combine("<=", lambda a, b: a <= b, self, other)
    def __and__(self, other): return combine("and", lambda a, b: a & b, self, other)
    def __or__(self, other): return combine("or", lambda a, b: a | b, self, other)

    def equals(self, other) -> "Factor": return combine("==", lambda a, b: a == b, self, other)
    def differs(self, other) -> "Factor": return combine("!=", lambda a, b: a != b, self, other)

    def isin(self, *values) -> "Factor":
        return self.map(f"in({self.label},{values!r})", lambda c: c.isin(*values))


def factor(value, axis: Axis = PANEL) -> Factor:
    """A column name, a number or a Factor, as a Factor."""
    if isinstance(value, Factor):
        return value
    if isinstance(value, str):
        return Factor(f"`{value}`", lambda: F.col(value), axis=axis)
    if isinstance(value, Column):
        return Factor(str(value), lambda: value, axis=axis)
    return Factor(repr(value), lambda: F.lit(value), axis=axis)


def sql(text: str, axis: Axis = PANEL) -> Factor:
    """A row-wise Spark SQL expression as a Factor."""
    return Factor(f"sql({text})", lambda: F.expr(text), axis=axis)


def combine(name: str, fn, *args) -> Factor:
    """A row-wise function of several values."""
    axis = next((a.axis for a in args if isinstance(a, Factor)), PANEL)
    parts = [factor(a, axis) for a in args]
    label = f"{name}({','.join(p.label for p in parts)})"
    return Factor(label, lambda: fn(*[p.make() for p in parts]), _merge(*[p.steps for p in parts]), axis)


def windowed(name: str, fn, *args, axis: Axis | None = None) -> Factor:
    """A window function of several values; ``fn`` gets the axis and the values' columns.

    The result is a helper column of its own: Spark does not evaluate equal window expressions of one projection
    once, but two factors that ask for the same helper share it.
    """
    axis = axis or next((a.axis for a in args if isinstance(a, Factor)), PANEL)
    parts = [factor(a, axis) for a in args]
    label = f"{name}({','.join(p.label for p in parts)};{axis.key}{axis.order})"
    helper = "_" + hashlib.md5(label.encode()).hexdigest()[:16]
    steps = _merge(*[p.steps for p in parts])
    steps = _merge(steps, ({},) * len(steps) + ({helper: lambda: fn(axis, *[p.make() for p in parts])},))
    return Factor(helper, lambda: F.col(helper), steps, axis)


def staged(name: str, fn, *args) -> Factor:
    """A row-wise function of several values, as a helper column of its own: for what several factors or windows read."""
    made = combine(name, fn, *args)
    helper = "_" + hashlib.md5(made.label.encode()).hexdigest()[:16]
    return Factor(helper, lambda: F.col(helper), _merge(made.steps, ({},) * len(made.steps) + ({helper: made.make},)), made.axis)


def by_instrument(df: DataFrame, axis: Axis = PANEL) -> DataFrame:
    """Rows of one instrument in one partition, in as many partitions as the session shuffles into.

    Rolling factors cost far more than their rows weigh; without this the optimizer would merge light partitions
    into few tasks.  All windows and the recursive pass that follow reuse this partitioning.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *axis.key)


def with_factors(df: DataFrame, factors: Mapping[str, Factor | Column], keep: list[str] | None = None) -> DataFrame:
    """``df`` with one column per factor; ``keep`` narrows which of its own columns stay."""
    wanted = {name: factor(value) for name, value in factors.items()}
    token = _specs.set({})
    try:
        out, present = df, set(df.columns)
        for layer in _merge(*[f.steps for f in wanted.values()]):
            fresh = {name: make for name, make in layer.items() if name not in present}
            if fresh:
                out = out.select("*", *[make().alias(name) for name, make in fresh.items()])
                present |= fresh.keys()
        base = [c for c in (keep if keep is not None else df.columns) if c not in wanted]
        return out.select(*base, *[f.make().alias(name) for name, f in wanted.items()])
    finally:
        _specs.reset(token)
