"""Fixed-length histories per (instrument, day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import attach
from .ordering import dense_index, top_rows


def instrument_index(df: DataFrame, out: str = "instrument") -> DataFrame:
    """(instrument_id, index) over the sorted distinct ids."""
    return dense_index(df, "instrument_id", out)


def sequences(df: DataFrame, features: Sequence[str], length: int, min_names: int = 10, start: str | None = None,
              end: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with a full history of ``length`` days, as an array of (trade_date, features) in day order.

    Days with fewer than ``min_names`` such rows are dropped.  The array multiplies the data by ``length``: ask
    for it last, right before the consumer.  Date limits are applied before the array is built.
    """
    spec = Window.partitionBy("instrument_id").orderBy("trade_date")
    numbered = df.withColumn("_seen", F.row_number().over(spec))
    frame = spec.rowsBetween(-(length - 1), 0)
    step = F.struct("trade_date", F.array(*[F.col(c).cast("double") for c in features]).alias("features"))
    complete = numbered.withColumn("sequence", F.collect_list(step).over(frame)).where(F.col("_seen") >= length)
    # how many names a day has needs no arrays: counted on the narrow rows
    names = numbered.where(F.col("_seen") >= length).groupBy("trade_date").agg(F.count(F.lit(1)).alias("_names"))
    names = names.where(F.col("_names") >= min_names)
    for bound, op in ((start, "ge"), (end, "le")):
        if bound is not None:
            limit = F.to_date(F.lit(bound))
            complete = complete.where(F.col("trade_date") >= limit if op == "ge" else F.col("trade_date") <= limit)
    return attach(complete, names, ["trade_date"]).where(F.col("_names").isNotNull()).select(
        "instrument_id", "trade_date", *keep, "sequence")


def latest_sequences(df: DataFrame, features: Sequence[str], length: int, as_of: str | None = None) -> DataFrame:
    """The last ``length`` rows of each instrument as one array, for instruments that have that many."""
    rows = df if as_of is None else df.where(F.col("trade_date") <= F.to_date(F.lit(as_of)))
    last = top_rows(rows, ["instrument_id"], [F.desc("trade_date")], length, "_rn")
    step = F.struct("trade_date", F.array(*[F.col(c).cast("double") for c in features]).alias("features"))
    out = last.groupBy("instrument_id").agg(F.array_sort(F.collect_list(step)).alias("sequence"))
    return out.where(F.size("sequence") == length)
