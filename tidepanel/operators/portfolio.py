"""Scores to constrained, weighted portfolios, one per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import top_rows

MAX_NAMES = 5  # of a valid submission


def rank_candidates(df: DataFrame, k: int, by: Sequence[str] = ("trade_date",), position: str = "position") -> DataFrame:
    """The ``k`` best scores of each day; of equal scores the later input position comes first."""
    return top_rows(df, by, [F.desc("score"), F.desc(position)], k)


def select_names(df: DataFrame, k: int, by: Sequence[str] = ("trade_date",), position: str = "position",
                 previous: DataFrame | None = None, penalty: float = 0.0, max_per_industry: int = 0,
                 max_names: int | None = None) -> DataFrame:
    """Up to ``k`` names per day after turnover penalty and industry limit.

    ``previous`` lists the names held before (instrument_id, and the day when it has one); every other name loses
    ``penalty`` for the ordering.  Names without an industry are not limited.
    """
    by = list(by)
    k = int(k)
    if k <= 0:
        raise ValueError("a portfolio needs at least one name")
    if max_names is not None and k > max_names:
        raise ValueError(f"{k} names were asked for, {max_names} are allowed")
    rows = df.withColumn("_adjusted", F.col("score"))
    if previous is not None and penalty > 0:
        on = [*by, "instrument_id"] if set(by) <= set(previous.columns) else ["instrument_id"]
        held = previous.select(*on).distinct().withColumn("_held", F.lit(True))
        rows = df.join(held, on, "left").withColumn(
            "_adjusted", F.col("score") - F.when(F.col("_held"), 0.0).otherwise(penalty)).drop("_held")
    order = [F.desc("_adjusted"), F.desc("score"), F.desc(position)]
    if max_per_industry > 0:
        # a name without industry is its own group, so the limit never reaches it
        own = F.when(F.coalesce(F.trim("industry"), F.lit("")) == "", F.concat(F.lit("\u0000"), F.col("instrument_id")))
        rows = rows.withColumn("_group", F.coalesce(own, F.trim("industry")))
        rows = top_rows(rows, [*by, "_group"], order, max_per_industry, "_in_group").drop("_in_group", "_group")
    return top_rows(rows, by, order, k).drop("_adjusted")


def filled_days(chosen: DataFrame, days: DataFrame, k: int, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """(day, names, missing, empty): how many names each of ``days`` holds, also those on which none is left."""
    held = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("_names"))
    out = days.select(*by).distinct().join(held, list(by), "left").withColumn("names", F.coalesce("_names", F.lit(0)))
    return out.select(*by, "names", (F.lit(int(k)) - F.col("names")).alias("missing"), (F.col("names") == 0).alias("empty"))


def weigh(df: DataFrame, weighting: str = "equal", temperature: float = 1.0, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Adds ``weight`` to selected names (at most a handful per day)."""
    from pyspark.sql import Window
    group = Window.partitionBy(*by)
    if weighting == "equal":
        return df.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(group))
    if weighting != "softmax":
        raise ValueError(f"unknown weighting: {weighting}")
    lifted = F.exp((F.col("score") - F.max("score").over(group)) / max(float(temperature), 1e-6))
    return df.withColumn("_e", lifted).withColumn("weight", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def portfolio(df: DataFrame, k: int, weighting: str = "equal", temperature: float = 1.0,
              by: Sequence[str] = ("trade_date",), **constraints) -> DataFrame:
    """(day, instrument_id, rank, score, weight) of each day's portfolio."""
    chosen = weigh(select_names(df, k, by, **constraints), weighting, temperature, by)
    return chosen.select(*by, "instrument_id", "rank", "score", "weight")


def realized_score(holdings: DataFrame, prices: DataFrame, days: int = 5, max_names: int = MAX_NAMES) -> DataFrame:
    """One row: weighted open-to-open return over each held name's last ``days`` rows; -999 for invalid holdings."""
    held = prices.join(holdings.select("instrument_id").distinct(), "instrument_id", "left_semi")
    last = top_rows(held, ["instrument_id"], [F.desc("trade_date")], days, "_rn")
    returns = last.groupBy("instrument_id").agg(
        F.try_divide(F.max_by("open", "trade_date") - F.min_by("open", "trade_date"), F.min_by("open", "trade_date")).alias("ret"))
    score = holdings.join(returns, "instrument_id").agg(F.coalesce(F.sum(F.col("ret") * F.col("weight")), F.lit(0.0)).alias("score"))
    shape = holdings.agg(F.count(F.lit(1)).alias("names"), F.sum("weight").alias("weight_sum"))
    valid = (F.col("names") <= max_names) & F.col("weight_sum").between(0.0, 1.0)
    return shape.withColumn("_s", score.scalar()).select(
        "names", "weight_sum", F.when(valid, F.col("_s")).otherwise(F.lit(-999.0)).alias("score"))
