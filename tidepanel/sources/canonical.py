"""Canonical table shapes: which names a column may come under, how ids and dates are written, which rows count."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite
from ..operators.ordering import keep_last

DAILY_SCHEMA = T.StructType(
    [T.StructField("instrument_id", T.StringType(), False), T.StructField("trade_date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in
       ("open", "high", "low", "close", "preclose", "volume", "amount", "turnover", "pct_chg")]
    + [T.StructField("trade_status", T.IntegerType())])

MINUTE_SCHEMA = T.StructType(
    [T.StructField("instrument_id", T.StringType(), False), T.StructField("ts", T.TimestampNTZType(), False),
     T.StructField("trade_date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount")])

MACRO_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType(), False), T.StructField("observation_date", T.DateType()),
    T.StructField("release_time", T.TimestampNTZType()), T.StructField("available_time", T.TimestampNTZType(), False),
    T.StructField("frequency", T.StringType()), T.StructField("vintage", T.StringType()),
    T.StructField("value", T.DoubleType())])

# The names a column is known under, the preferred one first.
ALIASES: dict[str, tuple[str, ...]] = {
    "instrument_id": ("instrument_id", "股票代码", "stock_id", "code", "ts_code"),
    "trade_date": ("trade_date", "日期", "date", "datetime"),
    "ts": ("ts", "datetime", "时间", "trade_time"),
    "open": ("open", "开盘"),
    "high": ("high", "最高"),
    "low": ("low", "最低"),
    "close": ("close", "收盘", "latest_price"),
    "preclose": ("preclose", "昨收", "前收"),
    "volume": ("volume", "成交量", "vol"),
    "amount": ("amount", "成交额", "turnover_amount"),
    "turnover": ("turnover", "换手率", "turn"),
    "pct_chg": ("pct_chg", "涨跌幅", "pctChg"),
    "trade_status": ("trade_status", "tradestatus"),
    "series_id": ("series_id", "macro_id", "指标ID", "指标"),
    "available_time": ("available_time", "release_time", "observation_date", "日期", "date"),
    "value": ("value", "值", "数值"),
}

# Which daily intraday factor is taken from which column, the first one present.
HF_DAILY: dict[str, tuple[str, ...]] = {
    "f_hf_realized_vol_1d": ("f_hf_realized_vol_1d", "hf_realized_vol", "hf_realized_vol_raw", "hf_realized_vol_m05",
                             "hf_realized_vol_m15", "hf_realized_vol_m30"),
    "f_hf_tail_ret_30m": ("f_hf_tail_ret_30m", "hf_last_tail_ret", "hf_last_tail_ret_raw", "hf_last_tail_ret_m05",
                          "hf_last_tail_ret_m15", "hf_last_tail_ret_m30"),
    "f_hf_tail_amount_share_30m": ("f_hf_tail_amount_share_30m", "hf_last_tail_amount_share", "hf_last_tail_amount_share_raw",
                                   "hf_last_tail_amount_share_m05", "hf_last_tail_amount_share_m15", "hf_last_tail_amount_share_m30"),
}

# Exchange prefix by the first digit of an id; every other id belongs to sz.
EXCHANGES = {"bj": ("4", "8"), "sh": ("5", "6", "9")}


def resolve(df: DataFrame, name: str, candidates: Sequence[str] | None = None, required: bool = True) -> str | None:
    """The column of ``df`` that stands for ``name``; an error when a required one is missing."""
    columns = {c.lstrip("﻿"): c for c in df.columns}
    for candidate in candidates or ALIASES.get(name, (name,)):
        if candidate in columns:
            return columns[candidate]
    if required:
        raise ValueError(f"no column for {name} among {df.columns}")
    return None


def number(c: Column) -> Column:
    """Lenient conversion to double; text that is no number, NaN and the infinities become NULL."""
    return finite(c.try_cast("double"))


def timestamp(df: DataFrame, column: str) -> Column:
    """A date or time column as a timestamp without zone; text may be Y-M-D, Y/M/D, YYYYMMDD or Y-M, with a time or not."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    dashed = F.translate(F.trim(c.cast("string")), "/", "-")
    # one cast reads every form, padded or not; pattern parsing costs an exception per miss
    return F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("timestamp_ntz")


def instrument_id(c: Column) -> Column:
    """The first run of six digits, else the last six of all digits zero-filled; without digits an empty text."""
    text = c.cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    code = (F.when(text.rlike(r"\d{6}"), F.regexp_extract(text, r"\d{6}", 0))
            .when(text.rlike(r"\d"), F.lpad(F.right(digits, F.lit(6)), 6, "0")))
    # as the last resort of a coalesce it is seen to be never NULL: no test for that, patterns and all, is moved to the rows
    # from which ids were grouped
    return F.coalesce(code, F.lit(""))


def key_id(c: Column, normalize: bool = True) -> Column:
    """An id for joins: the six-digit form of the exchanges, or the trimmed text as it is, of any length."""
    return instrument_id(c) if normalize else F.trim(c.cast("string"))


def exchange_symbol(c: Column) -> Column:
    """``600519`` as ``sh.600519``; a text without digits stays as it is."""
    code = instrument_id(c)
    prefix = F.lit("sz")
    for name, starts in EXCHANGES.items():
        prefix = F.when(F.left(code, F.lit(1)).isin(*starts), F.lit(name)).otherwise(prefix)
    return F.when(code == "", F.trim(c)).otherwise(F.concat(prefix, F.lit("."), code))


def _numbers(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    found = {n: resolve(df, n, required=False) for n in names}
    return {n: (number(F.col(c)) if c else F.lit(None).cast("double")) for n, c in found.items()}


def canonical_daily(df: DataFrame, order: Sequence[str], normalize_ids: bool = True) -> DataFrame:
    """One row per (instrument, day) with all price columns; the last row by ``order`` of a repeated key counts."""
    raw_id = F.col(resolve(df, "instrument_id"))
    key = key_id(raw_id, normalize_ids)
    date_column = resolve(df, "trade_date")
    resolve(df, "close")
    names = ("open", "high", "low", "close", "preclose", "volume", "amount", "turnover", "pct_chg")
    rows = df.select(key.alias("instrument_id"), F.to_date(timestamp(df, date_column)).alias("trade_date"),
                     *[c.alias(n) for n, c in _numbers(df, names).items()],
                     *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rows = rows.where(F.col("instrument_id") != "").dropna(subset=["instrument_id", "trade_date", "close"])
    kept = keep_last(rows, ["instrument_id", "trade_date"], [f"_o{i}" for i in range(len(order))])
    return kept.select("instrument_id", "trade_date", *names)


def canonical_hf_daily(df: DataFrame, order: Sequence[str], normalize_ids: bool = True) -> DataFrame:
    """The three intraday factor columns under their canonical names; a missing one is NULL throughout."""
    picked = {target: resolve(df, target, names, required=False) for target, names in HF_DAILY.items()}
    rows = df.select(key_id(F.col(resolve(df, "instrument_id")), normalize_ids).alias("instrument_id"),
                     F.to_date(timestamp(df, resolve(df, "trade_date"))).alias("trade_date"),
                     *[(number(F.col(c)) if c else F.lit(None).cast("double")).alias(t) for t, c in picked.items()],
                     *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rows = rows.where(F.col("instrument_id") != "").dropna(subset=["instrument_id", "trade_date"])
    kept = keep_last(rows, ["instrument_id", "trade_date"], [f"_o{i}" for i in range(len(order))])
    return kept.select("instrument_id", "trade_date", *picked)


def canonical_minutes(df: DataFrame, order: Sequence[str], normalize_ids: bool = True) -> DataFrame:
    """One row per (instrument, ts) with every price column the input has."""
    raw_id = F.col(resolve(df, "instrument_id"))
    key = key_id(raw_id, normalize_ids)
    names = ("open", "high", "low", "close", "volume", "amount")
    rows = df.select(key.alias("instrument_id"), timestamp(df, resolve(df, "ts")).alias("ts"),
                     *[c.alias(n) for n, c in _numbers(df, names).items()],
                     *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rows = rows.where(F.col("instrument_id") != "").dropna(subset=["instrument_id", "ts"])
    kept = keep_last(rows, ["instrument_id", "ts"], [f"_o{i}" for i in range(len(order))])
    return kept.select("instrument_id", "ts", F.to_date("ts").alias("trade_date"), *names)


def canonical_macro(df: DataFrame) -> DataFrame:
    """(series_id, available_time, value); a NULL value is kept, it is what was published."""
    return df.select(F.trim(F.col(resolve(df, "series_id")).cast("string")).alias("series_id"),
                     timestamp(df, resolve(df, "available_time")).alias("available_time"),
                     number(F.col(resolve(df, "value"))).alias("value")).dropna(subset=["series_id", "available_time"])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))
