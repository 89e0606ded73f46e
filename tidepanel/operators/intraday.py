"""Minute bars to daily features.

An (instrument, day) group of trades has no size limit, so nothing here sorts a day in one task.  Trades are cut
into time slots; only trades of one slot are ordered together, and what has to cross a slot boundary (the last
price before it) travels through a table with one row per slot, at most 1440 per day for slots of a minute.
Everything else is a partially aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factor import EPS
from ..functions.scalar import finite

KEYS = ("instrument_id", "trade_date")
SLOT_SECONDS = 60


def _slot(seconds: int) -> Column:
    """Number of the time slot counted from a fixed instant."""
    return F.window("ts", f"{int(seconds)} seconds")["start"]


def with_previous(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str] = KEYS,
                  slot_seconds: int = SLOT_SECONDS, skip_nulls: bool = True,
                  day: Mapping[str, tuple[Column, Callable]] | None = None) -> DataFrame:
    """Adds ``out: source``, the source's value in the day's previous row by ``ts`` (``lag`` without one big sort).

    With ``skip_nulls`` rows whose source is NULL are passed over: they neither get nor give a previous value.
    ``day`` adds values of the whole day, each as the aggregate per slot and the function that combines slots
    (``{"end": (F.max("ts"), F.max)}``).  Slots and rows meet in one join on (keys, slot), so that a busy day is
    spread over its slots throughout.
    """
    keys, day = list(keys), dict(day or {})
    work = df.withColumn("_slot", _slot(slot_seconds))
    inside = Window.partitionBy(*keys, "_slot").orderBy("ts")
    whole = Window.partitionBy(*keys)
    slots = whole.orderBy("_slot")
    ends, priors, within = {}, {}, {}
    for out, source in columns.items():
        present = F.when(F.col(source).isNotNull(), F.col("ts"))
        if skip_nulls:
            ends[out] = F.max_by(source, present)
            priors[out] = F.last(f"_end_{out}", ignorenulls=True).over(slots.rowsBetween(Window.unboundedPreceding, -1))
            within[out] = F.last(source, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        else:
            ends[out] = F.max_by(source, "ts")
            priors[out] = F.lag(f"_end_{out}").over(slots)
            within[out] = F.lag(source).over(inside)
    boundary = work.groupBy(*keys, "_slot").agg(
        *[c.alias(f"_end_{out}") for out, c in ends.items()], *[c.alias(f"_day_{out}") for out, (c, _) in day.items()])
    boundary = boundary.select(
        *keys, "_slot", *[c.alias(f"_prior_{out}") for out, c in priors.items()],
        *[combine(f"_day_{out}").over(whole).alias(out) for out, (_, combine) in day.items()])
    if columns:
        work = work.select("*", F.row_number().over(inside).alias("_at"), *[c.alias(f"_in_{out}") for out, c in within.items()])
    joined = work.join(boundary, [*keys, "_slot"], "left")

    def value(out, source):
        if skip_nulls:
            return F.when(F.col(source).isNotNull(), F.coalesce(f"_in_{out}", f"_prior_{out}"))
        return F.when(F.col("_at") == 1, F.col(f"_prior_{out}")).otherwise(F.col(f"_in_{out}"))

    return joined.select(*df.columns, *[value(out, source).alias(out) for out, source in columns.items()], *day)


def resample(df: DataFrame, minutes: int) -> DataFrame:
    """n-minute bars counted from each day's midnight: last price, summed volume and amount; empty ones are absent."""
    midnight = F.date_trunc("day", F.col("ts"))
    seconds = F.timestamp_diff("SECOND", midnight, F.col("ts"))
    start = F.floor(seconds / (minutes * 60)) * minutes
    bucket = F.timestamp_add("MINUTE", start.cast("int"), midnight).cast("timestamp_ntz")
    priced = F.when(F.col("price").isNotNull(), F.col("ts"))
    bars = df.groupBy("instrument_id", "trade_date", bucket.alias("ts")).agg(
        F.max_by("price", priced).alias("price"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))
    return bars.where(F.col("price").isNotNull())


def day_features(df: DataFrame, tail_minutes: int = 30, min_bars: int = 1, suffix: str | None = None,
                 slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Ten features per (instrument, day) from rows (instrument_id, trade_date, ts, price, volume, amount).

    The tail holds the rows no older than ``tail_minutes`` before the day's last row, that instant included.
    """
    rows = df.select(*KEYS, "ts", finite(F.col("price")).alias("price"), "volume", "amount")
    rows = rows.withColumn("_lp", F.ln(F.col("price") + EPS))
    rows = with_previous(rows, {"_prev": "_lp"}, KEYS, slot_seconds, day={"_end": (F.max("ts"), F.max)})
    tail = F.col("ts") >= F.timestamp_add("MINUTE", F.lit(-max(1, int(tail_minutes))), F.col("_end"))
    ret = F.col("_lp") - F.col("_prev")
    price = F.col("price")
    when_priced = F.when(price.isNotNull(), F.col("ts"))
    tail_priced = F.when(tail & price.isNotNull(), F.col("ts"))
    volume = F.greatest(F.coalesce("volume", F.lit(0.0)), F.lit(0.0))
    amount = F.greatest(F.coalesce("amount", F.lit(0.0)), F.lit(0.0))
    agg = rows.groupBy(*KEYS).agg(
        F.count("price").alias("n"), F.min_by("price", when_priced).alias("first"),
        F.max_by("price", when_priced).alias("last"), F.max("price").alias("top"), F.min("price").alias("bottom"),
        F.stddev_pop(ret).alias("rstd"), F.sum(ret * ret).alias("rvar"), F.max(F.abs(ret)).alias("rmax"),
        F.avg(F.when(ret.isNotNull(), F.when(ret > 0, 1.0).otherwise(0.0))).alias("rup"),
        F.count(tail_priced).alias("tn"), F.min_by("price", tail_priced).alias("tfirst"),
        F.max_by("price", tail_priced).alias("tlast"),
        F.sum(volume).alias("v"), F.sum(F.when(tail, volume).otherwise(0.0)).alias("tv"),
        F.sum(amount).alias("a"), F.sum(F.when(tail, amount).otherwise(0.0)).alias("ta"))
    c = F.col
    enough = c("n") >= 2
    values = {
        "hf_open_close_ret": (c("last") - c("first")) / (c("first") + EPS),
        "hf_intraday_range_pct": (c("top") - c("bottom")) / (c("first") + EPS),
        "hf_logret_std": c("rstd"), "hf_realized_var": c("rvar"), "hf_realized_vol": F.sqrt(c("rvar")),
        "hf_max_abs_logret": c("rmax"), "hf_up_bar_ratio": c("rup"),
        "hf_last_tail_ret": F.when(c("tn") >= 2, (c("tlast") - c("tfirst")) / (c("tfirst") + EPS)),
        "hf_last_tail_volume_share": F.when(c("v") > 0, c("tv") / (c("v") + EPS)),
        "hf_last_tail_amount_share": F.when(c("a") > 0, c("ta") / (c("a") + EPS)),
    }
    tagged = f"_{suffix}" if suffix else ""
    return agg.where(c("n") >= max(1, int(min_bars))).select(
        *KEYS, c("n").alias(f"hf_bar_count{tagged}"),
        *[F.when(enough, v).alias(name + tagged) for name, v in values.items()])


def day_feature_variants(df: DataFrame, periods: Sequence[int], tail_minutes: int = 30, min_bars: int = 1,
                         raw: bool = True, force_suffix: bool = False) -> DataFrame:
    """Day features of the raw bars and of each resampling, side by side (full outer join on the day)."""
    variants = ([("raw", df)] if raw else []) + [(f"m{p:02d}", resample(df, p)) for p in periods]
    suffixed = force_suffix or len(variants) > 1
    out = None
    for name, bars in variants:
        daily = day_features(bars, tail_minutes, min_bars, name if suffixed else None)
        out = daily if out is None else out.join(daily, list(KEYS), "full")
    return out


# ---- user-defined day aggregates ------------------------------------------------------------------------------

FULL_DAY = "full_day"
AGGREGATES = ("sum", "mean", "std", "min", "max", "first", "last")


@dataclass(frozen=True)
class Series:
    """A row-level value of a day: a Column of the row, a step from the row before, or an expression over other series.

    ``value`` takes the function that gives a source column as it was k rows earlier, and k.  Steps can be nested and
    combined: ``steps`` says how many rows back the value looks.
    """

    label: str
    value: Callable[[Callable[[Column, int], Column], int], Column]
    steps: int = 0

    def __add__(self, other): return _combined("+", lambda a, b: a + b, self, other)
    def __radd__(self, other): return _combined("+", lambda a, b: a + b, other, self)
    def __sub__(self, other): return _combined("-", lambda a, b: a - b, self, other)
    def __rsub__(self, other): return _combined("-", lambda a, b: a - b, other, self)
    def __mul__(self, other): return _combined("*", lambda a, b: a * b, self, other)
    def __rmul__(self, other): return _combined("*", lambda a, b: a * b, other, self)
    def __truediv__(self, other): return _combined("/", F.try_divide, self, other)
    def __rtruediv__(self, other): return _combined("/", F.try_divide, other, self)
    def __neg__(self): return _combined("neg", lambda a: -a, self)


def _combined(name: str, function: Callable[..., Column], *parts: str | float | Series) -> Series:
    """``function`` of series or numbers, row by row."""
    inner = [p if isinstance(p, Series) else series(F.lit(float(p)), repr(float(p))) if isinstance(p, (int, float)) else series(p) for p in parts]
    return Series(f"{name}({', '.join(p.label for p in inner)})", lambda at, k: function(*[p.value(at, k) for p in inner]),
                  max(p.steps for p in inner))


def series(value: str | Column, label: str | None = None) -> Series:
    """Any Column over the bar's columns, e.g. ``series("close")`` or ``series(F.ln(F.col("close") + 1e-12), "logc")``."""
    column = F.col(value) if isinstance(value, str) else value
    return Series(label or (value if isinstance(value, str) else str(value)), lambda at, k: at(column, k))


def log(x: str | Series) -> Series:
    return _combined("log", lambda c: F.ln(c + EPS), x)


def absolute(x: str | Series) -> Series:
    return _combined("abs", F.abs, x)


def sqrt(x: str | Series) -> Series:
    """Square root; NULL where the argument is negative."""
    return _combined("sqrt", lambda c: F.when(c >= 0, F.sqrt(c)), x)


def diff(x: str | Series) -> Series:
    """The step from the day's previous row, whether or not that has a value; NULL in the first one."""
    x = series(x) if isinstance(x, str) else x
    return Series(f"diff({x.label})", lambda at, k: x.value(at, k) - x.value(at, k + 1), x.steps + 1)


@dataclass(frozen=True)
class DayAggregate:
    function: str
    x: Series
    window: str | int | None = None
    power: float = 1.0

    @property
    def label(self) -> str:
        return f"{self.function}({self.x.label}^{self.power},{self.window})"


def day_agg(function: str, x: str | Series, window: str | int | None = None, power: float = 1.0) -> DayAggregate:
    """``function`` of the day's values; ``window`` is None or "full_day", "30m", or a number of rows."""
    if function not in AGGREGATES:
        raise ValueError(f"unknown intraday aggregate: {function}")
    return DayAggregate(function, series(x) if isinstance(x, str) else x, window, power)


def _minutes(window) -> int | None:
    if isinstance(window, str) and window != FULL_DAY:
        if not (window.endswith("m") and window[:-1].isdigit()):
            raise ValueError(f"unknown window: {window}")
        return int(window[:-1])
    return None


def _apply(function: str, value: Column, ts: Column) -> Column:
    """The aggregate over the rows whose ``value`` is not NULL."""
    if function == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    plain = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}.get(function)
    if plain is not None:
        return plain(value)
    present = F.when(value.isNotNull(), ts)
    return F.min_by(value, present) if function == "first" else F.max_by(value, present)


def _with_series(df: DataFrame, wanted: Mapping[str, Series], keys: Sequence[str], slot_seconds: int) -> DataFrame:
    """Adds the series as columns; those with steps read the day's earlier rows, all of them in one pass."""
    depth = max((x.steps for x in wanted.values()), default=0)
    sources: dict[str, tuple[str, Column]] = {}  # by the text of the expression

    def source(column: Column, k: int) -> Column:
        name, _ = sources.setdefault(str(column), (f"_x{len(sources)}", column))
        return F.col(f"_before{k}.{name}") if k else F.col(name)

    values = {name: x.value(source, 0) for name, x in wanted.items()}
    work = df.select("*", *[c.cast("double").alias(name) for name, c in sources.values()])
    if depth:
        work = with_rows_before(work, [name for name, _ in sources.values()], depth, keys, slot_seconds)
    return work.select(*df.columns, *[c.cast("double").alias(name) for name, c in values.items()])


def with_rows_before(df: DataFrame, columns: Sequence[str], depth: int, keys: Sequence[str] = KEYS,
                     slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Adds ``_before1`` ... ``_before<depth>``: ``columns`` of the day's rows that many places earlier by ``ts``, NULL before the first.

    A slot hands on its last ``depth`` rows; as no slot is empty, the ``depth`` slots before a row's own have all it needs.
    """
    keys = list(keys)
    work = df.withColumn("_slot", _slot(slot_seconds)).withColumn("_now", F.struct(*columns))
    late = Window.partitionBy(*keys, "_slot").orderBy(F.desc("ts"))
    tails = work.select(*keys, "_slot", "ts", "_now", F.row_number().over(late).alias("_back")).where(F.col("_back") <= depth)
    tails = tails.groupBy(*keys, "_slot").agg(F.sort_array(F.collect_list(F.struct(-F.col("_back"), "_now"))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(-depth, -1)
    tails = tails.select(*keys, "_slot", F.flatten(F.collect_list(F.col("_tail._now")).over(before)).alias("_tail"))
    inside = Window.partitionBy(*keys, "_slot").orderBy("ts")
    placed = work.select("*", F.row_number().over(inside).alias("_at"),
                         *[F.lag("_now", k).over(inside).alias(f"_in{k}") for k in range(1, depth + 1)])
    joined = placed.join(tails, [*keys, "_slot"], "left")
    from_tail = [F.get("_tail", (F.size("_tail") - (F.lit(k + 1) - F.col("_at"))).cast("int")) for k in range(1, depth + 1)]
    return joined.select(*df.columns, *[F.when(F.col("_at") > k, F.col(f"_in{k}")).otherwise(from_tail[k - 1]).alias(f"_before{k}")
                                        for k in range(1, depth + 1)])


def day_aggregates(df: DataFrame, aggregates: Mapping[str, DayAggregate], min_bars: int = 1,
                   slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per (instrument, day) with the named aggregates; NULL on days with fewer than ``min_bars`` closes.

    A NULL argument is dropped before the window is cut, and a time window ends at the argument's last value.
    """
    keys = list(KEYS)
    named = {name: a for name, a in aggregates.items()}
    args: dict[str, Series] = {}
    for a in named.values():
        args.setdefault(a.x.label, a.x)
    slot = {label: f"_s{i}" for i, label in enumerate(args)}
    work = _with_series(df.where(F.col("close").isNotNull()), {slot[label]: x for label, x in args.items()}, keys, slot_seconds)
    timed = sorted({a.x.label for a in named.values() if _minutes(a.window) is not None})
    rows = with_previous(work, {}, keys, slot_seconds, day={f"{slot[l]}_end": (
        F.max(F.when(F.col(slot[l]).isNotNull(), F.col("ts"))), F.max) for l in timed}) if timed else work
    built = []
    for name, a in named.items():
        if isinstance(a.window, int):
            continue
        x = F.col(slot[a.x.label])
        value = F.pow(x, a.power) if a.power != 1.0 else x
        m = _minutes(a.window)
        if m is not None:
            value = F.when(F.col("ts") >= F.timestamp_add("MINUTE", F.lit(-m), F.col(f"{slot[a.x.label]}_end")), value)
        built.append(_apply(a.function, value, F.col("ts")).alias(name))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bars"), *built)
    for name, a in named.items():
        if not isinstance(a.window, int):
            continue
        x = slot[a.x.label]
        latest = Window.partitionBy(*keys).orderBy(F.desc("ts"))
        # the row limit is applied per partition before the shuffle (WindowGroupLimit)
        last_rows = work.where(F.col(x).isNotNull()).select(*keys, "ts", x).withColumn(
            "_rn", F.row_number().over(latest)).where(F.col("_rn") <= max(1, a.window))
        value = F.pow(F.col(x), a.power) if a.power != 1.0 else F.col(x)
        part = last_rows.groupBy(*keys).agg(_apply(a.function, value, F.col("ts")).alias(name))
        out = out.join(part, keys, "left")
        if a.function == "sum":
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    enough = F.col("_bars") >= max(1, int(min_bars))
    return out.select(*keys, *[F.when(enough, finite(F.col(name))).alias(name) for name in named])

