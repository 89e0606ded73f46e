"""Landed provider files to canonical tables, and canonical bars back to the legacy layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cross_section import attach
from .canonical import key_id, number, resolve, timestamp

# How often a series is published.
FREQUENCY = {"cpi_yoy": "monthly", "ppi_yoy": "monthly", "m2_yoy": "monthly", "shibor_3m": "daily",
             "usdcny": "daily", "csi300_pe_ttm": "daily"}

# Under which name a series' value may come.
VALUE_COLUMNS = {
    "cpi_yoy": ("全国-同比增长", "value"),
    "ppi_yoy": ("当月同比增长", "value"),
    "m2_yoy": ("货币和准货币(M2)-同比增长", "value"),
    "shibor_3m": ("利率", "3月", "value"),
    "usdcny": ("美元", "美元/人民币", "value"),
    "csi300_pe_ttm": ("滚动市盈率", "等权滚动市盈率", "ttmPe", "value"),
}
# Column names of dates and times in macro files.
OBSERVATION = ("observation_date", "日期", "date", "月份", "季度", "报告日")
RELEASE = ("release_time", "发布时间", "TIME", "time")
AVAILABLE = ("available_time", "可用时间")
PERCENT_FX = 50.0


def _optional(df: DataFrame, *names: str) -> Column:
    for n in names:
        if n in df.columns:
            return number(F.col(n))
    return F.lit(None).cast("double")


def provider_daily(df: DataFrame, normalize_ids: bool = True) -> DataFrame:
    """Twelve canonical columns from text columns; rows without an id are dropped."""
    status = next((c for c in ("trade_status", "tradestatus") if c in df.columns), None)
    out = df.select(
        key_id(F.col("code"), normalize_ids).alias("instrument_id"), F.to_date(timestamp(df, "date")).alias("trade_date"),
        *[_optional(df, c).alias(c) for c in ("open", "high", "low", "close", "preclose", "volume", "amount")],
        _optional(df, "turnover", "turn").alias("turnover"), _optional(df, "pct_chg", "pctChg").alias("pct_chg"),
        (F.col(status).try_cast("int") if status else F.lit(None).cast("int")).alias("trade_status"))
    return out.where(F.col("instrument_id") != "")


def provider_minutes(df: DataFrame, symbol: Column, normalize_ids: bool = True) -> DataFrame:
    ts = timestamp(df, resolve(df, "ts", ("ts", "datetime", "时间")))
    names = {"open": "开盘", "high": "最高", "low": "最低", "close": "收盘", "volume": "成交量", "amount": "成交额"}
    out = df.select(key_id(symbol, normalize_ids).alias("instrument_id"), ts.alias("ts"), F.to_date(ts).alias("trade_date"),
                    *[_optional(df, n, alias).alias(n) for n, alias in names.items()])
    return out.where(F.col("ts").isNotNull())


def provider_macro(df: DataFrame, series_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One series from one provider table, its times defaulting to the observation date."""
    observed = resolve(df, "observation_date", OBSERVATION)
    released = resolve(df, "release_time", RELEASE, required=False) or observed
    available = resolve(df, "available_time", AVAILABLE, required=False) or released
    value = resolve(df, "value", VALUE_COLUMNS.get(series_id, ("value",)), required=False)
    if value is None:
        # the last column that holds any number
        counts = df.agg(*[F.count(number(F.col(c))).alias(c) for c in df.columns]).first()
        value = next((c for c in reversed(df.columns) if counts[c] > 0), None)
    vintage = F.coalesce(F.col("vintage").cast("string"), F.lit("latest")) if "vintage" in df.columns else F.lit("latest")
    out = df.select(
        F.lit(series_id).alias("series_id"), F.to_date(timestamp(df, observed)).alias("observation_date"),
        timestamp(df, released).alias("release_time"), timestamp(df, available).alias("available_time"),
        F.lit(FREQUENCY.get(series_id, "daily")).alias("frequency"), vintage.alias("vintage"),
        (number(F.col(value)) if value else F.lit(None).cast("double")).alias("value"))
    if series_id == "usdcny":
        out = rescale_percent_series(out)
    out = out.where(F.col("observation_date").isNotNull())
    if start:
        out = out.where(F.col("observation_date") >= F.to_date(F.lit(start)))
    if end:
        out = out.where(F.col("observation_date") <= F.to_date(F.lit(end)))
    return out


def rescale_percent_series(df: DataFrame, limit: float = PERCENT_FX) -> DataFrame:
    """Divides a series by 100 when every value of it lies above the limit (quotes per hundred units)."""
    lowest = df.groupBy("series_id").agg(F.min("value").alias("_lowest"))
    joined = attach(df, lowest, ["series_id"])
    value = F.when(F.col("_lowest") > limit, F.col("value") / 100.0).otherwise(F.col("value"))
    return joined.select(*[value.alias(c) if c == "value" else F.col(c) for c in df.columns])


def legacy_daily(df: DataFrame, normalize_ids: bool = True) -> DataFrame:
    """The twelve-column legacy layout: amplitude and change relative to the previous close, unpadded date text."""
    before = F.nullif(_optional(df, "preclose"), F.lit(0.0))
    high, low, close = number(F.col("high")), number(F.col("low")), number(F.col("close"))
    return df.select(
        key_id(F.col("instrument_id"), normalize_ids).alias("股票代码"), F.date_format("trade_date", "y/M/d").alias("日期"),
        number(F.col("open")).alias("开盘"), close.alias("收盘"), high.alias("最高"), low.alias("最低"),
        _optional(df, "volume").alias("成交量"), _optional(df, "amount").alias("成交额"),
        F.coalesce((high - low) / before * 100.0, F.lit(0.0)).alias("振幅"),
        F.coalesce(close - before, F.lit(0.0)).alias("涨跌额"),
        _optional(df, "turnover").alias("换手率"), _optional(df, "pct_chg").alias("涨跌幅"),
    ).dropna(subset=["股票代码", "日期"])
