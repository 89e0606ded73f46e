"""Exact order statistics of a group that may be far too large for one task.

``rank().over(Window.partitionBy("trade_date"))`` sends a whole cross-section to one task, and ``percentile``
keeps every distinct value of a group in one buffer.  One date may hold a third of a table, so the functions here
work from counts instead:

1. equal values are counted first, with partial aggregation before the shuffle, so a value shared by a third of
   the rows is one record;
2. each value falls into a bucket by a fixed monotone function of the value alone (:func:`value_bucket`); bucket
   counts, one small record each, are accumulated per group;
3. only values of the same bucket of the same group are sorted together.

The buckets depend on nothing that was sampled or aggregated, so recomputing a lost task gives the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

BUCKETS_PER_OCTAVE = 16384.0
_OFFSET = 1100.0  # doubles lie between 2**-1075 and 2**1024


def value_bucket(x: Column) -> Column:
    """A bucket number that never decreases as ``x`` grows; a factor of two is split into 16384 buckets."""
    size = F.floor((F.log2(F.abs(x)) + _OFFSET) * BUCKETS_PER_OCTAVE)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _histogram(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, bucket): how many rows lie in smaller buckets, and how many the group has."""
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select(
        *keys, "_b", "_bn",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_base"),
        F.sum("_bn").over(group).alias("_total"))


def _counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, (x + F.lit(0.0)).alias("_x"))
    return values.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", value_bucket(F.col("_x")))


def value_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _c, _x, _n): how many rows of each group have each value of each column, in one pass over ``df``.

    From this table, which is stored, come quantiles, limits, means and ranks of all the columns, by group and of the
    whole table, without another pass. NULL and NaN aren't counted.
    """
    keys = list(keys)
    x = lambda c: F.col(c).cast("double") + F.lit(0.0)
    if len(columns) == 1:
        long = df.select(*keys, F.lit(columns[0]).alias("_c"), x(columns[0]).alias("_x"))
    else:
        long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), x(c).alias("_x")) for c in columns])).alias("_v")).select(*keys, "_v.*")
    return durable(long.where(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*keys, "_c", "_x").agg(F.count(F.lit(1)).alias("_n")))


def mapped_counts(counts: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """The counts after each value became ``x``; values that become NULL are gone."""
    return counts.select(*keys, x.alias("_x"), "_n").where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.sum("_n").alias("_n"))


def _below(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("_below", F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, distinct non-NULL value ``_x``): ``_n`` copies, ``_below`` smaller rows, ``_total`` rows."""
    return positions_of(_counts(df, list(keys), value), keys)


def positions_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`value_positions` from the counts (keys, _x, _n) of values."""
    keys = list(keys)
    counts = counts.select(*keys, "_x", "_n", value_bucket(F.col("_x")).alias("_b"))
    placed = counts.join(_histogram(counts, keys), [*keys, "_b"])
    return _below(placed, keys).select(*keys, "_x", "_n", "_below", "_total")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float | str]) -> DataFrame:
    """Exact quantiles per group, one row per group, linear between neighbours.

    ``quantiles`` maps an output name to a fraction, or to ``"lower_median"`` for the smaller middle value.
    With no keys the result is the single row of the whole table.
    """
    keys = list(keys)
    return quantiles_of(_counts(df, keys, value), keys, quantiles)


def quantiles_of(counts: DataFrame, keys: Sequence[str], quantiles: dict[str, float | str]) -> DataFrame:
    """:func:`group_quantiles` from the counts (keys, _x, _n) of values; groups of ``keys`` may span several of the counts' own."""
    keys = list(keys)
    constant = not keys
    if constant:
        counts, keys = counts.withColumn("_all", F.lit(1)), ["_all"]
    counts = counts.select(*keys, "_x", "_n", value_bucket(F.col("_x")).alias("_b"))

    def ends(q):
        last = F.col("_total") - 1
        if q == "lower_median":
            middle = F.floor(last / 2).cast("bigint")
            return middle, middle, F.lit(0.0)
        at = last * F.lit(float(q))
        return F.floor(at).cast("bigint"), F.ceil(at).cast("bigint"), at - F.floor(at)

    spans = [p for q in quantiles.values() for p in ends(q)[:2]]
    # only the few buckets that hold a wanted position are ever sorted
    wanted = _histogram(counts, keys).where(F.exists(
        F.array(*spans), lambda p: (p >= F.col("_base")) & (p < F.col("_base") + F.col("_bn"))))
    placed = _below(counts.join(wanted, [*keys, "_b"]), keys)

    def at(position):
        hit = (F.col("_below") <= position) & (position < F.col("_below") + F.col("_n"))
        return F.max(F.when(hit, F.col("_x")))

    picks = []
    for i, q in enumerate(quantiles.values()):
        low, high, _ = ends(q)
        picks += [at(low).alias(f"_lo{i}"), at(high).alias(f"_hi{i}")]
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    out = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * ends(q)[2]).alias(name)
           for i, (name, q) in enumerate(quantiles.items())]
    return found.select(*([] if constant else keys), *out)


def medians_and_spreads(counts: DataFrame, keys: Sequence[str], center: float | str = 0.5) -> DataFrame:
    """(keys, _med, _mad): the median and the median distance from it, of each group of the counts (keys, _x, _n).

    ``counts`` should be stored, as the steps read it several times; the medians, one row per group, are.
    """
    keys = list(keys)
    middle = durable(quantiles_of(counts, keys, {"_med": center}))
    away = mapped_counts(counts.join(middle, keys), keys, F.abs(F.col("_x") - F.col("_med")))
    return middle.join(quantiles_of(away, keys, {"_mad": center}), keys)


def average_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """``row_key`` and, per column, rank / non-NULL count within the group, ties averaged; NULL for NULL.

    All columns are ranked in one long pass (one shuffle however many there are).
    """
    keys, row_key = list(keys), list(row_key)
    carried = list(dict.fromkeys([*row_key, *keys]))
    long = df.select(*carried, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), (F.col(c).cast("double") + F.lit(0.0)).alias("_x")) for c in columns])).alias("_v"))
    long = long.select(*carried, "_v._c", "_v._x").where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    ranks = value_positions(long, [*keys, "_c"], "_x").select(
        *keys, "_c", "_x", ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")).alias("_rank"))
    ranked = long.join(ranks, [*keys, "_c", "_x"])
    return ranked.groupBy(*carried).agg(*[
        F.max(F.when(F.col("_c") == c, F.col("_rank"))).alias(c) for c in columns])


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """``df`` with the 0-based place of each row in the order of the whole table. Stored.

    Rows are dealt by ranges of the whole order, so equal values of its first columns are cut by the later ones and no
    run of them meets in one task. What is added up over partitions is one count of each.
    """
    at = free_column(df, "_at")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    stored = durable(ranged)  # partition and place in it are fixed from here on
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # one row per partition of the shuffle
    joined = stored.join(F.broadcast(starts), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_start") + place).alias(out))


def free_column(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def ordinal_positions(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, descending: bool = False) -> DataFrame:
    """``df`` with the 0-based place of each row in its group ordered by (value, tie); NULL values get NULL.

    Rows of equal value are ordered by ``tie``. The places are those in the order of the whole table (:func:`numbered`), less
    the group's first one.
    """
    keys = list(keys)
    size = F.nanvl(F.col(value).cast("double") + F.lit(0.0), F.lit(None).cast("double"))
    work = df.withColumn("_ord_x", -size + F.lit(0.0) if descending else size)
    placed = numbered(work, [*[F.col(k).asc_nulls_last() for k in keys], F.col("_ord_x").asc_nulls_last(), F.col(tie).asc_nulls_last()], "_ord_at")
    firsts = placed.groupBy(*keys).agg(F.min("_ord_at").alias("_ord_first"))
    joined = placed.join(firsts, keys, "left")
    return joined.select(*df.columns, F.when(F.col("_ord_x").isNotNull(), F.col("_ord_at") - F.col("_ord_first")).alias(out))


def dense_index(ids: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct values of a column numbered 0, 1, 2, ... in their order."""
    return numbered(ids.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], out)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    Spark cuts every partition to ``k`` rows per group before the shuffle (WindowGroupLimit), so a hot group
    sends at most ``k`` rows per task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= k)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool = False) -> DataFrame:
    """One row per key: the last (or first) in the given order.

    The whole row takes part in the comparison after the order, so equal orders cannot give different answers; NULL
    is the smallest value. Spark cuts every partition to one row per key before the shuffle (WindowGroupLimit), so a
    key with many rows sends one per task.
    """
    by = [c for c in [*order, *df.columns] if c not in keys]
    if not by:
        return df.dropDuplicates(list(keys))
    spec = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) if first else F.desc_nulls_last(c) for c in dict.fromkeys(by)])
    return df.withColumn("_row_no", F.row_number().over(spec)).where(F.col("_row_no") == 1).drop("_row_no")
