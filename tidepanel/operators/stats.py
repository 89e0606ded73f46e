"""Row selection and descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import top_rows


def last_rows(df: DataFrame, n: int, key: str = "instrument_id", order: str = "trade_date") -> DataFrame:
    return top_rows(df, [key], [F.desc(order)], n, "_rn").drop("_rn")


def first_rows(df: DataFrame, n: int, key: str = "instrument_id", order: str = "trade_date") -> DataFrame:
    return top_rows(df, [key], [F.asc(order)], n, "_rn").drop("_rn")


def instrument_subset(df: DataFrame, instruments: int, rows: int) -> DataFrame:
    """The last ``rows`` rows of the first ``instruments`` ids in order (a preview)."""
    ids = df.select("instrument_id").distinct().orderBy("instrument_id").limit(instruments)
    return last_rows(df.join(ids, "instrument_id", "left_semi"), rows)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str] = ("instrument_id", "trade_date"), seed: int = 42) -> DataFrame:
    """``n`` rows picked by the md5 of their key and the seed, the same ones on every run and in every engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys], F.lit(str(seed)))
    return df.orderBy(F.md5(text), *keys).limit(n)


def add_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absent columns added as NULL."""
    return df.select("*", *[F.lit(None).cast("double").alias(c) for c in columns if c not in df.columns])


def feature_stats(df: DataFrame, columns: Sequence[str], last_day_only: bool = False) -> DataFrame:
    """Mean, sample deviation, min, max and missing share per feature, in one long pass."""
    if last_day_only:
        df = df.where(F.col("trade_date") == df.agg(F.max("trade_date")).scalar())
    # the aggregates are computed side by side, so no row is multiplied; the single row is then turned
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(columns) for e in (
        F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"l{i}"),
        F.max(c).cast("double").alias(f"h{i}"), F.count(c).alias(f"c{i}"))])
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                      F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
                      (1.0 - F.try_divide(F.col(f"c{i}"), F.col("n"))).alias("null_ratio")) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*cells)).alias("v")).select("v.*")


def histogram(df: DataFrame, value: str | Column, bins: int = 80) -> DataFrame:
    """(bin, lower, upper, n) of equal width between the smallest and the largest value."""
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(x.cast("double").alias("x")).where(F.col("x").isNotNull())
    spot = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    placed = rows.withColumn("_s", spot)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    bin_ = F.least(F.floor(F.try_divide(F.col("x") - F.col("_s.lo"), width)), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy(F.coalesce(bin_, F.lit(0)).alias("bin"), "_s").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("_s.lo") + F.col("bin") * width).alias("lower"),
                          (F.col("_s.lo") + (F.col("bin") + 1) * width).alias("upper"), "n")


def preview_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                  F.min(value).alias("min"), F.max(value).alias("max"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of means and population deviations, to be applied to later data."""
    return df.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features minus the fitted mean over the fitted deviation (1 where that is 0)."""
    spot = scaler.select(F.struct("*")).scalar()
    joined = df.withColumn("_s", spot)

    def scaled(c):
        sd = F.coalesce(F.nullif(F.col(f"_s.{c}_std"), F.lit(0.0)), F.lit(1.0))
        return (F.col(c) - F.col(f"_s.{c}_mean")) / sd

    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def long_view(df: DataFrame, columns: Sequence[str], run_id: str, version: str) -> DataFrame:
    """One row per (instrument, day, factor) with the run's metadata."""
    out = df.unpivot(["instrument_id", "trade_date"], list(columns), "factor_name", "factor_value")
    return out.select("trade_date", "instrument_id", "factor_name", "factor_value",
                      F.lit(run_id).alias("run_id"), F.lit(version).alias("factor_version"))
