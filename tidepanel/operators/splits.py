"""Validation folds and train/test cuts.

Every function works on the distinct trading days, a table no longer than the calendar, and marks or filters the
panel by joining that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def trading_days(df: DataFrame) -> DataFrame:
    """(trade_date, day, days): position of each trading day from 0, and how many there are."""
    days = df.select("trade_date").where(F.col("trade_date").isNotNull()).distinct().withColumn("_all", F.lit(1))
    spec = Window.partitionBy("_all")
    return days.select("trade_date", (F.row_number().over(spec.orderBy("trade_date")) - 1).alias("day"),
                       F.count(F.lit(1)).over(spec).alias("days"))


def rolling_folds(df: DataFrame, folds: int = 4, window: int = 20, step: int | None = None, purge: int = 0,
                  embargo: int = 0, horizon: int = 5, sequence_length: int = 60) -> DataFrame:
    """One row per validation fold, counted back from the last day that has a label.

    Columns: fold, start_date, end_date, train_end (first day no longer in training), context_start (first day the
    validation sequences read).  Too little history is an error when the rows are computed.
    """
    horizon, purge, embargo = max(int(horizon), 1), max(int(purge), 0), max(int(embargo), 0)
    step = window if step is None else step
    if folds <= 0 or window <= 0 or step <= 0:
        raise ValueError("folds, window and step must be positive")
    if embargo > 0:
        step = max(step, window + embargo)
    days = trading_days(df)
    ready = F.col("days") - horizon
    needed = window + (folds - 1) * step
    first = ready - needed  # position of the first validation day
    problem = F.when(ready < needed, F.raise_error(F.lit(f"rolling validation needs {needed} labelled days"))) \
        .when(first - purge <= 0, F.raise_error(F.lit("no training days are left before the first fold")))
    back = ready - 1 - F.col("day")  # days between this one and the last labelled day
    fold = folds - F.floor(back / step)
    inside = (back >= 0) & (F.floor(back / step) < folds) & (back % step < window)
    listed = days.withColumn("_ok", F.coalesce(problem.cast("int"), F.lit(1)))
    bounds = listed.where(inside & (F.col("_ok") == 1)).groupBy(fold.alias("fold")).agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"))
    edges = listed.groupBy("_ok").agg(
        F.max(F.when(F.col("day") == first - purge, F.col("trade_date"))).alias("train_end"),
        F.max(F.when(F.col("day") == F.greatest(F.lit(0), first - (sequence_length - 1)), F.col("trade_date"))).alias("context_start"))
    spot = edges.select(F.struct("train_end", "context_start")).scalar()
    return bounds.withColumn("_e", spot).select(
        F.concat(F.lit("fold_"), F.col("fold").cast("string")).alias("fold"), "start_date", "end_date",
        F.col("_e.train_end").alias("train_end"), F.col("_e.context_start").alias("context_start"))


def with_fold(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of the validation folds with their fold's name (each day lies in one fold at most)."""
    listed = folds.agg(F.collect_list(F.struct("fold", "start_date", "end_date")).alias("l")).scalar()  # a handful
    days = df.select("trade_date").distinct().withColumn("_folds", listed)
    hit = F.filter("_folds", lambda f: F.col("trade_date").between(f["start_date"], f["end_date"]))
    named = days.select("trade_date", F.try_element_at(hit, F.lit(1))["fold"].alias("fold")).where("fold IS NOT NULL")
    return df.join(F.broadcast(named), "trade_date")  # one row per day at most


def holdout_last_months(df: DataFrame, months: int = 2, sequence_length: int = 60) -> DataFrame:
    """Each row's role: ``train`` before the last months, ``validation`` after; ``context`` also read by its sequences.

    The context reaches ``sequence_length - 1`` business days (Monday to Friday) before the validation start.
    """
    last = df.agg(F.max("trade_date").alias("m"))
    start = F.add_months(F.col("m"), -months)
    reach = sequence_length - 1
    # enough calendar days to contain the business days wanted, newest first
    back = F.filter(F.transform(F.sequence(F.lit(1), F.lit(reach * 2 + 7)), lambda i: F.date_sub(start, i)),
                    lambda d: F.weekday(d) < 5)
    context = F.element_at(back, reach) if reach > 0 else start
    spot = last.select(F.struct(start.alias("start"), context.alias("context"))).scalar()
    marked = df.withColumn("_c", spot)
    role = F.when(F.col("trade_date") >= F.col("_c.start"), "validation").otherwise("train")
    return marked.select(*df.columns, role.alias("role"), (F.col("trade_date") >= F.col("_c.context")).alias("in_context"))


def train_test_by_dates(df: DataFrame, train: tuple[str, str], test: tuple[str, str]) -> DataFrame:
    """Rows of either date range with their ``split``; both ends count, a row in both ranges occurs twice."""
    def part(name, bounds):
        start, end = bounds
        if start > end:
            raise ValueError(f"{name} starts after it ends: {start} > {end}")
        return df.where(F.col("trade_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).withColumn("split", F.lit(name))
    return part("train", train).unionByName(part("test", test))


def auto_split(df: DataFrame, ratio: float | None = None, last_days: int | None = None, min_days: int = 10) -> DataFrame:
    """One row with the first and last day of the training and of the test part."""
    if (ratio is None) == (last_days is None):
        raise ValueError("give either ratio or last_days")
    days = trading_days(df)
    size = F.col("days")
    cut = F.floor(size * ratio) if ratio is not None else size - last_days
    cut = F.greatest(F.least(cut, size - 1), F.lit(1))
    short = F.when(size < min_days, F.raise_error(F.lit("too few trading days to split"))).cast("int")
    return days.withColumn("_ok", F.coalesce(short, F.lit(1))).where(F.col("_ok") == 1).agg(
        F.min("trade_date").alias("train_start"), F.max(F.when(F.col("day") < cut, F.col("trade_date"))).alias("train_end"),
        F.min(F.when(F.col("day") >= cut, F.col("trade_date"))).alias("test_start"), F.max("trade_date").alias("test_end"))
