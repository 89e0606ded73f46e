"""Indicators whose value depends on their own previous value, and order statistics of sliding windows.

Catalyst has no window function that carries state from row to row, and none that keeps a sliding window sorted, so these
are computed in one pass over Arrow tables: :func:`with_recursive` evaluates every requested indicator of an instrument in
the same pass.  A history is at most as long as the calendar, and many short ones are evaluated together, one line of a
table each: every function takes one history or such a table, whose lines end in NaN where a history is shorter.

Warm-up conventions: ``ema`` starts at its first value; the other recurrences start from the mean of their first ``n``
inputs; ``last_*`` are missing until the last ``n`` rows all have a value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .factor import EPS, PANEL, Axis, by_instrument

PASS_ROWS = 1 << 17  # rows evaluated together


def _smooth(values: np.ndarray, alpha: float, ignore_na: bool = True) -> np.ndarray:
    """Exponential mean along the last axis; a gap leaves it as it is."""
    lines, length = math.prod(values.shape[:-1]), values.shape[-1]
    if length >= 20 * lines:  # few long histories: each by itself
        each = [pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=ignore_na).mean().to_numpy() for x in values.reshape(lines, length)]
        return np.array(each, dtype=float).reshape(values.shape)
    steps = np.ascontiguousarray(np.moveaxis(values, -1, 0))
    out = np.empty_like(steps)
    mean, weight = np.full(steps.shape[1:], np.nan), np.ones(steps.shape[1:])
    for at, x in enumerate(steps):
        if not ignore_na:
            weight = weight * (1.0 - alpha)
        old = 1.0 - alpha if ignore_na else weight
        there, begun = ~np.isnan(x), ~np.isnan(mean)
        moved = np.where(mean == x, mean, (old * mean + alpha * x) / (old + alpha))
        mean = np.where(there, np.where(begun, moved, x), mean)
        weight = np.where(there | ~begun, 1.0, weight)
        out[at] = mean
    return np.moveaxis(out, 0, -1)


def _started(values: np.ndarray, start, first: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that is ``first`` at place ``start`` of its line and missing before."""
    at = np.arange(values.shape[-1])
    start, first = np.asarray(start)[..., None], np.asarray(first)[..., None]
    return _smooth(np.where(at < start, np.nan, np.where(at == start, first, values)), alpha)


def _seeded(values: np.ndarray, n: int, alpha: float, skip: int = 0) -> np.ndarray:
    """Exponential mean whose first value is the plain mean of the first ``n`` inputs after ``skip`` more."""
    if not values.shape[-1]:
        return np.full(values.shape, np.nan)
    first = (~np.isnan(values)).argmax(axis=-1) + skip
    at = np.arange(values.shape[-1])
    inside = (at >= first[..., None]) & (at < first[..., None] + n)
    return _started(values, first + n - 1, np.where(inside, values, 0.0).sum(axis=-1) / n, alpha)


def _ema(values: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    return _seeded(values, n, 2.0 / (n + 1), skip)


def _wilder(values: np.ndarray, n: int) -> np.ndarray:
    return _seeded(values, n, 1.0 / n)


def _previous(values: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.full(values.shape, np.nan)
    out[..., n:] = values[..., :-n]
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0, NaN where b is NaN."""
    return np.where(np.isnan(b), np.nan, np.divide(a, b, out=np.zeros_like(b), where=b != 0))


def ema(x, *, span):
    return _smooth(x, 2.0 / (span + 1), ignore_na=False)


def seeded_ema(x, *, n):
    return _ema(x, n)


def _macd(close, fast, slow, signal):
    # the fast line starts together with the slow one
    line = _ema(close, fast, skip=slow - fast) - _ema(close, slow)
    trigger = _ema(line, signal)
    return np.where(np.isnan(trigger), np.nan, line), trigger


def macd_line(close, *, fast=12, slow=26, signal=9):
    return _macd(close, fast, slow, signal)[0]


def macd_signal(close, *, fast=12, slow=26, signal=9):
    return _macd(close, fast, slow, signal)[1]


def _gain_loss(close, n):
    step = close - _previous(close)
    return _wilder(np.maximum(step, 0.0), n), _wilder(np.maximum(-step, 0.0), n)


def rsi(close, *, n):
    gain, loss = _gain_loss(close, n)
    return 100.0 * _ratio(gain, gain + loss)


def cmo(close, *, n):
    gain, loss = _gain_loss(close, n)
    return 100.0 * _ratio(gain - loss, gain + loss)


def _true_range(high, low, close):
    before = _previous(close)
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def atr(high, low, close, *, n):
    return _wilder(_true_range(high, low, close), n)


def adx(high, low, close, *, n):
    up, down = high - _previous(high), _previous(low) - low
    known = np.isnan(up) | np.isnan(down)
    plus = np.where(known, np.nan, np.where((up > 0) & (up > down), up, 0.0))
    minus = np.where(known, np.nan, np.where((down > 0) & (up < down), down, 0.0))

    at = np.arange(close.shape[-1])

    def accumulate(values):
        # Wilder's running total over n-1 moves, then S - S/n + x; kept here divided by n
        return np.where(at >= n, _started(values, n - 1, values[..., 1:n].sum(axis=-1) / n, 1.0 / n), np.nan)

    ranges, plus, minus = accumulate(_true_range(high, low, close)), accumulate(plus), accumulate(minus)
    total = plus + minus
    usable = (ranges > 0) & (total > 0)
    dx = np.full(total.shape, np.nan)
    dx[usable] = 100.0 * np.abs(plus[usable] - minus[usable]) / total[usable]
    return _started(dx, 2 * n - 1, np.nansum(dx[..., n:2 * n], axis=-1) / n, 1.0 / n)


def tema(close, *, n):
    first = _ema(close, n)
    second = _ema(first, n)
    third = _ema(second, n)
    return 3.0 * first - 3.0 * second + third


def chaikin_osc(high, low, close, volume, *, fast=3, slow=10):
    spread = high - low
    flow = _ratio((close - low) - (high - close), spread) * volume
    line = np.cumsum(flow, axis=-1)
    out = _smooth(line, 2.0 / (fast + 1)) - _smooth(line, 2.0 / (slow + 1))
    out[..., :max(fast, slow) - 1] = np.nan
    return out


def chaikin_volatility(high, low, *, n):
    level = ema(high - low, span=n)
    before = _previous(level, n)
    return (level - before) / (before + EPS)


def _windows(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``n`` values of each row from the n-th on, and which of them are complete."""
    if x.shape[-1] < n:
        return np.empty((*x.shape[:-1], 0, n)), np.empty((*x.shape[:-1], 0), bool)
    view = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)
    return view, ~np.isnan(view).any(axis=-1)


def _placed(x: np.ndarray, n: int, complete: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[..., n - 1:][complete] = value
    return out


def last_quantile(x, *, n, q):
    """Quantile of the last n values, linear between neighbours."""
    view, complete = _windows(x, int(n))
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    ordered = np.partition(view[complete], (low, high), axis=1)
    a, b = ordered[:, low], ordered[:, high]
    return _placed(x, int(n), complete, a + (b - a) * (at - low))


def last_rank(x, *, n):
    """Rank of the newest of the last n values, ties averaged, divided by n."""
    view, complete = _windows(x, int(n))
    view = view[complete]
    points = 2 * (view < view[:, -1:]).sum(axis=1) + (view == view[:, -1:]).sum(axis=1)
    return _placed(x, int(n), complete, (points + 1) / (2.0 * n))


def last_argmax(x, *, n):
    """Place of the first largest of the last n values, counted from 0, over n."""
    view, complete = _windows(x, int(n))
    return _placed(x, int(n), complete, view[complete].argmax(axis=1) / float(n))


def last_argmin(x, *, n):
    view, complete = _windows(x, int(n))
    return _placed(x, int(n), complete, view[complete].argmin(axis=1) / float(n))


@dataclass(frozen=True)
class Recursive:
    """One requested indicator: the function above, its input columns and its parameters."""

    function: str
    inputs: tuple[str, ...]
    params: tuple[tuple[str, float], ...] = ()


def recursive(function: str, *inputs: str, **params) -> Recursive:
    if function not in FUNCTIONS:
        raise ValueError(f"unknown recursive function: {function}")
    return Recursive(function, inputs, tuple(sorted(params.items())))


FUNCTIONS = {f.__name__: f for f in (
    ema, seeded_ema, macd_line, macd_signal, rsi, cmo, atr, adx, tema, chaikin_osc, chaikin_volatility,
    last_quantile, last_rank, last_argmax, last_argmin)}


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the history of another instrument begins."""
    step = np.zeros(max(len(rows) - 1, 0), bool)
    for c in keys:
        code = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        step |= code[1:] != code[:-1]
    return np.concatenate([[0], np.flatnonzero(step) + 1])


def _evaluated(rows: pa.Table, starts: np.ndarray, specs: Mapping[str, Recursive], inputs: list[str]) -> pa.Table:
    """``rows`` with the indicators; histories of like length are lines of one table, padded to at most twice their rows."""
    arrays = {c: rows.column(c).cast(pa.float64(), safe=False).to_numpy() for c in inputs}
    lengths = np.diff(np.append(starts, len(rows)))
    classes = np.frexp(lengths)[1]
    made = {name: np.full(len(rows), np.nan) for name in specs}
    for kind in np.unique(classes):
        mine = classes == kind
        at = np.arange(lengths[mine].max())
        there = at < lengths[mine][:, None]
        places = (starts[mine][:, None] + at)[there]
        lines = {}
        for c in inputs:
            lines[c] = np.full(there.shape, np.nan)
            lines[c][there] = arrays[c][places]
        for name, spec in specs.items():
            with np.errstate(all="ignore"):
                made[name][places] = FUNCTIONS[spec.function](*[lines[c] for c in spec.inputs], **dict(spec.params))[there]
    for name, values in made.items():
        # what isn't a finite number is missing
        rows = rows.append_column(name, pa.array(values, pa.float64(), mask=~np.isfinite(values)))
    return rows


def with_recursive(df: DataFrame, wanted: Mapping[str, Recursive], axis: Axis = PANEL) -> DataFrame:
    """``df`` with one column per requested indicator; the other columns pass as they are.

    Histories come one after the other, in order, and are evaluated as soon as ``PASS_ROWS`` rows are there; the last one
    waits for the rows that may follow, so a task holds those rows and one history.
    """
    specs = dict(wanted)
    keys = list(axis.key)
    kept = [f for f in df.schema.fields if f.name not in specs]
    schema = T.StructType(kept + [T.StructField(name, T.DoubleType()) for name in specs])
    inputs = list(dict.fromkeys(c for spec in specs.values() for c in spec.inputs))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count, goal = [], 0, PASS_ROWS
        for batch in batches:
            waiting.append(batch)
            count += len(batch)
            if count < goal:
                continue
            rows = pa.Table.from_batches(waiting)
            starts = _starts(rows, keys)
            last = int(starts[-1])
            if last:
                yield from _evaluated(rows.slice(0, last), starts[:-1], specs, inputs).combine_chunks().to_batches(max_chunksize=1 << 14)
            waiting = rows.slice(last).to_batches()
            count = len(rows) - last
            goal = max(PASS_ROWS, 2 * count)
        if count:
            rows = pa.Table.from_batches(waiting)
            yield from _evaluated(rows, _starts(rows, keys), specs, inputs).combine_chunks().to_batches(max_chunksize=1 << 14)

    rows = by_instrument(df.select(*[f.name for f in kept]), axis).sortWithinPartitions(*axis.key, *axis.order)
    return rows.mapInArrow(evaluate, schema)
