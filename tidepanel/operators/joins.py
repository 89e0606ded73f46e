"""Joins of daily tables, and the point-in-time join of published series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.canonical import key_id
from .cross_section import attach, one_per_day
from .ordering import keep_last

KEYS = ("instrument_id", "trade_date")


def one_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged, failing at run time when a key occurs twice.

    The check is one aggregate per key group while the table is being shuffled for the join anyway.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.first(F.struct(*[F.col(c) for c in rest])) if rest else F.lit(None)
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), row.alias("_row"))
    text = F.concat(F.lit("more than one row for key "), F.to_json(F.struct(*keys)))
    checked = grouped.withColumn("_row", F.when(F.col("_copies") == 1, F.col("_row")).otherwise(F.raise_error(text)))
    return checked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, how: str = "left") -> DataFrame:
    """Equi join that fails when the right side repeats a key."""
    return left.join(one_row_per_key(right, keys), list(keys), how)


def join_backfill(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Left join in which right columns fill only the NULLs of columns the left side already has."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    fresh = [c for c in right.columns if c not in left.columns]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    joined = left.join(renamed, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in shared else F.col(c)
                           for c in left.columns], *fresh)


def merge_features(base: DataFrame, features: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None,
                   prefix: str = "", overwrite: bool = False, keep: str = "last", how: str = "left",
                   normalize_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Adds feature columns to a base table on (instrument, day), ids as ``key_id`` reads them.

    Repeated feature rows are reduced to the first or last by ``order``.  A name the base already has becomes
    ``hf_`` + name, or replaces the base column with ``overwrite``.  Also returns one row of coverage figures.
    """
    picked = [c for c in features.columns if c not in KEYS and c not in order and (columns is None or c in columns)]
    names = {}
    for c in picked:
        target = prefix + c
        names[c] = target if overwrite or target not in base.columns else f"hf_{target}"
    right = features.select(key_id(F.col("instrument_id"), normalize_ids).alias("_id"), F.to_date("trade_date").alias("_d"),
                            *order, *picked).where(F.col("_id").isNotNull() & F.col("_d").isNotNull())
    right = keep_last(right, ["_id", "_d"], order, first=keep == "first").select(
        "_id", "_d", *[F.col(c).alias(n) for c, n in names.items()])
    left = base.drop(*[n for n in names.values() if n in base.columns])
    left = left.withColumns({"_id": key_id(F.col("instrument_id"), normalize_ids), "_d": F.to_date("trade_date")})
    merged = left.join(right, ["_id", "_d"], how).drop("_id", "_d")
    matched = F.coalesce(*[F.when(F.col(n).isNotNull(), 1) for n in names.values()])
    coverage = merged.agg(F.count(F.lit(1)).alias("rows"), F.count(matched).alias("matched_rows")).withColumn(
        "coverage", F.col("matched_rows") / F.greatest(F.col("rows"), F.lit(1)))
    return merged, coverage


def build_dataset(base: DataFrame, factors: DataFrame, how: str = "left") -> tuple[DataFrame, DataFrame]:
    """Base joined with a wide factor table; a factor whose name is taken gets the prefix ``f_ext_``."""
    taken = {c: f"f_ext_{c}" for c in factors.columns if c in base.columns and c not in KEYS}
    right = factors.withColumnsRenamed(taken)
    added = [c for c in right.columns if c not in KEYS]
    merged = join_many_to_one(base, right, KEYS, how)
    matched = F.coalesce(*[F.when(F.col(n).isNotNull(), 1) for n in added])
    coverage = merged.agg(F.count(F.lit(1)).alias("rows"), F.count(matched).alias("matched_rows")).withColumn(
        "coverage", F.col("matched_rows") / F.greatest(F.col("rows"), F.lit(1)))
    return merged, coverage


def between_dates(df: DataFrame, start: str | None, end: str | None, column: str = "trade_date") -> DataFrame:
    """Both ends included; on a table partitioned by the column this prunes partitions."""
    if start is not None:
        df = df.where(F.col(column) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(column) <= F.to_date(F.lit(end)))
    return df


def _seen_by_day(dates: DataFrame, points: DataFrame, order: Sequence[str], cutoff_hour: int) -> DataFrame:
    """(series_id, trade_date, _age, value): on each trading day the last point published by its cutoff hour.

    Points are first reduced to the last one per (series, day slot) with partial aggregation, so the ordered pass
    sees at most one point per calendar day of a series, however densely it is published.
    """
    shifted = F.timestamp_add("HOUR", F.lit(-cutoff_hour), F.col("available_time"))
    # the first day whose cutoff is not before the publication
    day = F.to_date(shifted)
    slot = F.when(F.date_trunc("day", shifted) == shifted, day).otherwise(F.date_add(day, 1))
    rank = F.struct("available_time", *order)
    last = points.where(F.col("available_time").isNotNull()).groupBy("series_id", slot.alias("trade_date")).agg(
        F.max(F.struct(rank.alias("r"), F.struct("value").alias("v"))).alias("_p"))
    last = last.select("series_id", "trade_date", F.col("_p.r.available_time").alias("_at"),
                       F.col("_p.v.value").alias("value"), F.lit(False).alias("_day"))
    days = dates.select("trade_date").where(F.col("trade_date").isNotNull()).distinct()
    ids = points.select("series_id").distinct()
    # every series meets every trading day once: that grid is the result; the list of days is one calendar long
    calendar = days.agg(F.array_sort(F.collect_list("trade_date")).alias("d")).scalar()
    grid = ids.withColumn("_days", calendar).select("series_id", F.explode("_days").alias("trade_date"))
    grid = grid.select("series_id", "trade_date", F.lit(None).cast("timestamp_ntz").alias("_at"),
                       F.lit(None).cast("double").alias("value"), F.lit(True).alias("_day"))
    spec = Window.partitionBy("series_id").orderBy("trade_date", "_day").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("_day"), F.struct("_at", "value")), ignorenulls=True).over(spec)
    out = last.withColumn("_at", F.col("_at").cast("timestamp_ntz")).unionByName(grid).withColumn("_seen", seen)
    cutoff = F.timestamp_add("HOUR", F.lit(cutoff_hour), F.col("trade_date").cast("timestamp_ntz"))
    age = F.timestamp_diff("MICROSECOND", F.col("_seen._at"), cutoff) / 86400e6
    return out.where("_day").select("series_id", "trade_date", age.alias("_age"), F.col("_seen.value").alias("value"))


def _limited(staleness: float | None) -> Column:
    value = F.col("value")
    return F.when(F.col("_age") <= staleness, value) if staleness is not None and staleness > 0 else value


def _last_so_far(column: str) -> Column:
    so_far = Window.partitionBy("series_id").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return F.last(column, ignorenulls=True).over(so_far)


def asof_series(dates: DataFrame, points: DataFrame, order: Sequence[str] = (), max_staleness_days: float | None = None,
                fill_forward: bool = True, cutoff_hour: int = 15) -> DataFrame:
    """(series_id, trade_date, value): the last value published by the cutoff hour of each trading day.

    A published NULL counts as the last value.  A value older than ``max_staleness_days`` becomes NULL;
    ``fill_forward`` then repeats the last value seen on an earlier day (so the limit only shows before it).
    """
    out = _seen_by_day(dates, points, order, cutoff_hour).select(
        "series_id", "trade_date", _limited(max_staleness_days).alias("value"))
    if fill_forward:
        out = out.select("series_id", "trade_date", _last_so_far("value").alias("value"))
    return out


def asof_columns(df: DataFrame, points: DataFrame, wanted: Mapping[str, tuple[str, float | None]],
                 fill_forward: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with one column per wanted series: ``{column: (series_id, max_staleness_days)}``.

    Points and days are read once for all columns; the panel is joined with one row per day.
    """
    if not wanted:
        return df
    of_interest = points.where(F.col("series_id").isin(*{series for series, _ in wanted.values()}))
    rows = _seen_by_day(df, of_interest, order, 15)
    rows = rows.select("series_id", "trade_date", *[_limited(limit).alias(c) for c, (_, limit) in wanted.items()])
    if fill_forward:
        rows = rows.select("series_id", "trade_date", *[_last_so_far(c).alias(c) for c in wanted])
    daily = rows.groupBy("trade_date").agg(*[
        F.max(F.when(F.col("series_id") == series, F.col(c))).alias(c) for c, (series, _) in wanted.items()])
    return attach(df, daily, ["trade_date"])


def lookup(df: DataFrame, dim: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Dimension columns by instrument; repeated dimension rows are reduced to the last by ``order``.

    No broadcast is forced: the optimizer broadcasts the dimension when its measured size allows it.
    """
    latest = keep_last(dim.select("instrument_id", *dict.fromkeys([*order, *columns])), ["instrument_id"], order)
    return df.join(latest.select("instrument_id", *columns), "instrument_id", "left")


def with_benchmark(df: DataFrame, benchmark: DataFrame, value: str, out: str = "benchmark",
                   by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """The day's benchmark value, or the cross-section's mean of ``value`` where there is none."""
    means = df.groupBy(*by).agg(F.avg(value).alias("_mean"))
    joined = attach(attach(df, one_per_day(benchmark.select(*by, "benchmark_return"), by), by), means, by)
    return joined.select(*df.columns, F.coalesce(F.col("benchmark_return"), F.col("_mean")).alias(out))


def restrict_universe(df: DataFrame, *universes: DataFrame, normalize_ids: bool = True) -> DataFrame:
    """Rows whose id, as ``key_id`` reads it, is in any of the id lists."""
    def own(t: DataFrame) -> Column:
        return key_id(t["instrument_id"], normalize_ids).alias("_id")

    ids = universes[0].select(own(universes[0]))
    for u in universes[1:]:
        ids = ids.unionByName(u.select(own(u)))
    keyed = df.withColumn("_id", own(df))
    return keyed.join(ids.distinct(), "_id", "left_semi").drop("_id")


def member_on_date(df: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows inside one of the instrument's membership intervals [in_date, out_date)."""
    m = membership.select(F.col("instrument_id").alias("_m"), "in_date", "out_date")
    inside = (df["instrument_id"] == m["_m"]) & (df["trade_date"] >= m["in_date"]) & (
        m["out_date"].isNull() | (df["trade_date"] < m["out_date"]))
    return df.join(m, inside, "left_semi")


def dataset_product(bars: DataFrame, features: DataFrame, dim: DataFrame, required: Sequence[str]) -> DataFrame:
    """Bars, wide features and dimension in one table; missing required columns are an error."""
    out = join_many_to_one(bars, features, KEYS).join(one_row_per_key(dim, ["instrument_id"]), "instrument_id", "left")
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"dataset product lacks columns: {missing}")
    return out


def matched_returns(weights: DataFrame, returns: DataFrame, keys: Sequence[str] = ("instrument_id",)) -> tuple[DataFrame, DataFrame]:
    """Weights with their realised return (missing: 0), and how many names had one."""
    joined = weights.join(returns, list(keys), "left")
    coverage = joined.agg(F.count(F.lit(1)).alias("names"), F.count("ret").alias("covered"))
    return joined.withColumn("ret", F.coalesce("ret", F.lit(0.0))), coverage
