"""How a query is declared, and pieces of SQL the checks share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans import tables
from tidepanel.session import durable, shared_folder

BARS, MINUTES, MACRO, DIM = tables.BARS_SQL, tables.MINUTES_SQL, tables.MACRO_SQL, tables.DIM_SQL
PK = ("instrument_id", "trade_date")


# Halves are rounded up, and so is what lies within floating-point noise below a half: many prices are quotients
# that end exactly there.
HALF = 0.5001


HUGE = 1e12  # beyond this a quotient by epsilon is all that is left; compared in units of 1e8


def rounded_column(c, digits: int):
    x, scale = c.cast("double"), F.lit(float(10 ** digits))
    fine = F.floor(x * scale + F.lit(HALF)).cast("double") / scale + F.lit(0.0)
    return F.when(F.abs(x) >= HUGE, F.floor(x / 1e8 + F.lit(HALF)).cast("double") * 1e8).otherwise(fine)


def rounded_sql(c: str, digits: int) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) >= {HUGE} THEN floor({x} / 1e8 + {HALF}) * 1e8 "
            f"ELSE floor({x} * 1e{digits} + {HALF}) / 1e{digits} + 0.0 END")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def query(run: Callable[[SparkSession, str], DataFrame], sql: str | None, keys: Sequence[str],
          values: Mapping[str, int] | Sequence[str] = (), digits: int = 6, ctes: Sequence[str] = (BARS,)) -> Query:
    """A query whose ``values`` columns are rounded alike on both sides; ``keys`` are compared as they are.

    ``sql`` is a SELECT, or further CTEs followed by one, over the tables made by ``ctes``.
    """
    rounding = dict(values) if isinstance(values, Mapping) else {v: digits for v in values}

    def rounded(spark, folder):
        out = run(spark, folder)
        return out.select(*keys, *[rounded_column(F.col(c), d).alias(c) for c, d in rounding.items()])

    text = None
    if sql is not None:
        body = sql.strip()
        more, select = body.split("=>", 1) if "=>" in body else ("", body)
        tables_ = ",".join([*ctes, *([more] if more.strip() else [])])
        picked = ", ".join([*keys, *[f"{rounded_sql(c, d)} AS {c}" for c, d in rounding.items()]])
        text = (f"WITH {tables_} " if tables_.strip() else "") + f"SELECT {picked} FROM ({select.strip()}) AS checked"
    return Query(rounded, text)


# ---- SQL over the history of an instrument ------------------------------------------------------------------

def last(w: int, key: str = "instrument_id") -> str:
    return f"(PARTITION BY {key} ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


ORDERED = "(PARTITION BY instrument_id ORDER BY trade_date)"
RUNNING = "(PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, w: int) -> str:
    """``agg`` over the last w rows once they all have an ``x``; '@' in agg stands for the window."""
    over = agg.replace("@", f"OVER {last(w)}") if "@" in agg else f"{agg} OVER {last(w)}"
    return f"CASE WHEN count({x}) OVER {last(w)} = {w} THEN {over} END"


def avg(x: str, w: int) -> str: return full(f"avg({x})", x, w)
def std(x: str, w: int) -> str: return full(f"stddev_samp({x})", x, w)
def pstd(x: str, w: int) -> str: return full(f"stddev_pop({x})", x, w)
def low(x: str, w: int) -> str: return full(f"min({x})", x, w)
def high(x: str, w: int) -> str: return full(f"max({x})", x, w)
def total(x: str, w: int) -> str: return full(f"sum({x})", x, w)


def corr(x: str, y: str, w: int) -> str:
    o = f"OVER {last(w)}"
    return (f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {o} = {w} THEN "
            f"covar_samp({x}, {y}) {o} / nullif(stddev_samp({x}) {o} * stddev_samp({y}) {o}, 0) END")


def rank(x: str, w: int) -> str:
    def hits(op):
        return f"len(list_filter(list({x}) @, lambda v: v {op} {x}))"
    return full(f"(({hits('<')} + ({hits('=')} + 1) / 2.0) / {w}.0)", x, w)


def argmax(x: str, w: int, pick: str = "max") -> str:
    return full(f"((list_position(list({x}) @, {pick}({x}) @) - 1) / {w}.0)", x, w)


def skew(x: str, w: int) -> str:
    return full(f"coalesce(CASE WHEN stddev_pop({x}) @ > 0 THEN skewness({x}) @ END, 0.0)", x, w)


def quantile(x: str, w: int, q: float) -> str:
    return full(f"quantile_cont({x}, {q})", x, w)


def prefix_reduce(x: str, alpha: str, seed: int, skip: int = 0) -> str:
    """Exponential mean of the non-NULL values so far, started with the mean of the first ``seed`` after ``skip``."""
    xs = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {RUNNING}"
    return (f"CASE WHEN {x} IS NOT NULL AND len({xs}) >= {seed + skip} THEN "
            f"list_reduce(list_concat([list_avg(({xs})[{skip + 1}:{skip + seed}])], ({xs})[{skip + seed + 1}:]), "
            f"lambda a, v: a + {alpha} * (v - a)) END")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return tables.bars(spark, folder)


def kept(df: DataFrame) -> DataFrame:
    """A panel that is read several times, stored once in the checkpoint folder."""
    return durable(df)


def scratch(spark, name):
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
