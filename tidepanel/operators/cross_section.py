"""Operators over one trading day's cross-section.

None of them uses a window partitioned by date: a day's statistics come from a partially aggregated ``groupBy`` and
are joined back.  A per-day table has one small row per calendar day, so it may be broadcast; anything keyed by
more than the day is left to the optimizer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.factor import EPS, PANEL, Axis, factor, windowed, with_factors
from ..functions.rolling import pct_change, shift, true_range
from ..functions.scalar import absolute, clip, finite, log1p
from ..session import durable
from .ordering import average_ranks, mapped_counts, medians_and_spreads, positions_of, quantiles_of, value_counts

DATE = ("trade_date",)
LIMIT_UP = 0.095
MAD_SCALE = 1.4826


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of per-group statistics.

    Keyed by dates alone, ``stats`` has at most one row per calendar day and is broadcast, so ``df`` is not
    shuffled; with any other key the size is unknown and the optimizer decides.
    """
    types = {f.name: f.dataType for f in stats.schema.fields}
    if len(by) == 1 and isinstance(types[by[0]], T.DateType):
        stats = F.broadcast(stats)
    return df.join(stats, list(by), "left")


def one_per_day(table: DataFrame, by: Sequence[str] = DATE) -> DataFrame:
    """The rows of a caller's table, one per day: repeated rows count once, and a day with different ones fails the job.

    So what is then broadcast has at most one row per day of the calendar, and no row that it meets is multiplied.
    """
    values = [c for c in table.columns if c not in by]
    sizes = F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in values]))
    merged = table.groupBy(*by).agg(sizes.alias("_kinds"), *[F.min(c).alias(c) for c in values])
    checked = F.when(F.col("_kinds") > 1, F.raise_error(F.concat(F.lit("different rows of one day: "), *[F.col(c).cast("string") for c in by])).cast("boolean")).otherwise(F.lit(True))
    return merged.where(checked).select(*table.columns)


def cs_zscore(df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = DATE, zero_std: str = "null",
              eps: float = EPS, clip_at: float | None = None, over: DataFrame | None = None) -> DataFrame:
    """Adds ``out: source`` z-scores within each group (sample standard deviation).

    A group without spread gives NULL, or 0 with ``zero_std="zero"``.  ``over`` is a stored table with the same
    rows to take the statistics from, where ``df`` itself is costly to compute twice.
    """
    sources = list(dict.fromkeys(columns.values()))
    stats = (over if over is not None else df).groupBy(*by).agg(*[e for i, c in enumerate(sources) for e in (
        F.avg(c).alias(f"_mean{i}"), F.stddev_samp(c).alias(f"_sd{i}"))])
    joined = attach(df, stats, by)

    def score(source: str) -> Column:
        i = sources.index(source)
        z = (F.col(source) - F.col(f"_mean{i}")) / (F.nullif(F.col(f"_sd{i}"), F.lit(0.0)) + eps)
        if zero_std == "zero":
            z = F.when(F.col(f"_sd{i}") == 0, F.when(F.col(source).isNotNull(), F.lit(0.0))).otherwise(z)
        if clip_at is not None:
            z = F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip_at)), F.lit(-clip_at)))
        return z

    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *[score(source).alias(out) for out, source in columns.items()])


def cs_rank(df: DataFrame, columns: Mapping[str, str], row_key: Sequence[str] = ("instrument_id", "trade_date"),
            by: Sequence[str] = DATE, over: DataFrame | None = None) -> DataFrame:
    """Adds ``out: source`` average-tie ranks divided by the group's non-NULL count."""
    sources = list(dict.fromkeys(columns.values()))
    ranks = average_ranks(over if over is not None else df, by, sources, row_key)
    key = list(dict.fromkeys([*row_key, *by]))
    ranks = ranks.select(*key, *[F.col(source).alias(f"_r_{out}") for out, source in columns.items()])
    joined = df.join(ranks, key, "left")
    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *[F.col(f"_r_{out}").alias(out) for out in columns])


def normalize(df: DataFrame, columns: Sequence[str], method: str = "zscore", clip_at: float | None = None,
              exclude_prefix: str = "market_", by: Sequence[str] = DATE,
              row_key: Sequence[str] = ("instrument_id", "trade_date")) -> DataFrame:
    """Replaces feature columns by their z-score or by 2 * rank - 1; what is undefined becomes 0."""
    chosen = [c for c in columns if c in df.columns and not (exclude_prefix and c.startswith(exclude_prefix))]
    if not chosen:
        return df
    if method == "zscore":
        out = cs_zscore(df, {c: c for c in chosen}, by, clip_at=clip_at)
        value = {c: F.col(c) for c in chosen}
    elif method == "rank":
        out = cs_rank(df, {c: c for c in chosen}, row_key, by)
        value = {c: F.col(c) * 2.0 - 1.0 for c in chosen}
    else:
        raise ValueError(f"unknown normalisation: {method}")
    return out.select(*[F.coalesce(finite(value[c]), F.lit(0.0)).alias(c) if c in value else F.col(c)
                        for c in df.columns])


def null_policy(df: DataFrame, columns: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """NaN and the infinities become NULL, then NULL becomes ``default``."""
    def rule(c):
        value = finite(F.col(c))
        return value if default is None else F.coalesce(value, F.lit(default))
    chosen = set(columns)
    return df.select(*[rule(c).alias(c) if c in chosen else F.col(c) for c in df.columns])


# ---- features added to an engineered panel -------------------------------------------------------------------

def industry_buckets(dim: DataFrame, k: int, industry: str = "industry") -> DataFrame:
    """The ``k`` most frequent industries with their index (by count, then name)."""
    ranked = (dim.where(F.col(industry).isNotNull() & (F.trim(industry) != "")).groupBy(industry)
              .agg(F.count(F.lit(1)).alias("members"))
              .orderBy(F.desc("members"), industry).limit(k))
    # k records, numbered in one list
    listed = ranked.agg(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("m"), F.col(industry)))).alias("l"))
    return listed.select(F.posexplode("l").alias("bucket", "v")).select(
        F.col(f"v.{industry}").alias(industry), "bucket", (-F.col("v.m")).alias("members"))


def with_industry_bucket(dim: DataFrame, k: int, other: bool = True, industry: str = "industry") -> DataFrame:
    """Dimension rows with the bucket name and index of their industry; the rest is ``__OTHER__``."""
    top = industry_buckets(dim, k, industry)
    joined = dim.join(F.broadcast(top.drop("members")), industry, "left")  # k rows
    name, index = F.col(industry), F.col("bucket")
    if other:
        size = top.agg(F.count(F.lit(1)).cast("int")).scalar()
        name = F.when(index.isNotNull(), name).otherwise(F.lit("__OTHER__"))
        index = F.coalesce(index, size)
    else:
        name = F.when(index.isNotNull(), name)
    return joined.select(*dim.columns, name.alias("industry_bucket"), index.alias("industry_bucket_index"))


def static_features(df: DataFrame, dim: DataFrame, k: int = 12, other: bool = True) -> DataFrame:
    """log market value (missing: the table's median), its daily rank, and one column per industry bucket."""
    capital = F.log1p(F.greatest(F.col("cap").cast("double"), F.lit(0.0)))
    # greatest() would turn a missing value into 0
    dim = with_industry_bucket(dim, k, other).select(
        "instrument_id", "industry_bucket", "industry_bucket_index",
        F.when(F.col("cap").isNotNull(), capital).alias("st_log_mcap"))
    joined = df.join(dim, "instrument_id", "left")
    if other:
        joined = joined.withColumn("industry_bucket", F.coalesce("industry_bucket", F.lit("__OTHER__"))) \
                       .withColumn("industry_bucket_index", F.coalesce(F.col("industry_bucket_index"), industry_count(dim)))
    # one pass counts the values of each day, missing ones as -1 (none is negative): the median, then the ranks come from that
    counts = value_counts(joined.select(*DATE, F.coalesce("st_log_mcap", F.lit(-1.0)).alias("_m")), DATE, ["_m"]).select(*DATE, "_x", "_n")
    known = F.when(F.col("_x") >= 0, F.col("_x"))
    middle = quantiles_of(mapped_counts(counts, [], known), [], {"m": 0.5}).scalar()
    filled = joined.withColumn("st_log_mcap", F.coalesce(F.col("st_log_mcap"), middle))
    places = positions_of(mapped_counts(counts, DATE, F.coalesce(known, middle)), DATE)
    ranks = places.select(*DATE, F.col("_x").alias("st_log_mcap"), ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")).alias("st_log_mcap_cs_rank"))
    filled = filled.join(ranks, [*DATE, "st_log_mcap"], "left").select(*filled.columns, "st_log_mcap_cs_rank")
    hot = [F.when(F.col("industry_bucket_index") == i, 1.0).otherwise(0.0).alias(f"st_ind_oh_{i:02d}")
           for i in range(k + (1 if other else 0))]
    return filled.select(*[c for c in filled.columns if c != "industry_bucket_index"], *hot)


def industry_count(dim: DataFrame) -> Column:
    """Index of the ``__OTHER__`` bucket, as a scalar subquery."""
    named = dim.where(F.col("industry_bucket") != "__OTHER__")
    return named.agg(F.coalesce(F.max("industry_bucket_index") + 1, F.lit(0)).cast("int")).scalar()


def price_volume_features(df: DataFrame, axis: Axis = PANEL) -> DataFrame:
    """Daily price and volume risk columns ``pv_*``; their windows accept fewer rows than asked for."""
    o, c, h, l = (factor(x, axis) for x in ("open", "close", "high", "low"))

    def partial(name, agg, x, w):
        return windowed(f"{name}_partial{w}", lambda ax, v: agg(v).over(ax.last(w)), x)

    before = shift(c)
    out = {
        "pv_intraday_return": (c - o) / (o + EPS),
        "pv_intraday_range_pct": (h - l) / (o + EPS),
        "pv_gap_return": (o - before) / (before + EPS),
        "pv_close_location": (c - l) / (h - l + EPS),
        "pv_true_range_pct": true_range(h, l, c) / (before + EPS),
    }
    spread = ((h + EPS).map(f"ln({h.label})", F.ln) - (l + EPS).map(f"ln({l.label})", F.ln))
    parkinson = (spread * spread / (4.0 * 0.6931471805599453 + EPS)).map(f"parkinson({spread.label})", F.sqrt)
    out["pv_parkinson_daily"] = parkinson
    out["pv_parkinson_5"] = partial("avg", F.avg, parkinson, 5)
    out["pv_parkinson_20"] = partial("avg", F.avg, parkinson, 20)
    out["pv_intraday_return_std5"] = partial("std", F.stddev_samp, out["pv_intraday_return"], 5)
    if "amount" in df.columns:
        out["pv_amihud_illiq"] = absolute(pct_change(c)) / (absolute(factor("amount", axis)) + EPS)
    if "volume" in df.columns:
        logs = log1p(clip(factor("volume", axis), lower=0.0))
        out["pv_volume_z20"] = (logs - partial("avg", F.avg, logs, 20)) / (partial("std", F.stddev_samp, logs, 20) + EPS)
    return with_factors(df, out)


def market_sentiment(df: DataFrame, return_column: str = "pct_chg", turnover_column: str | None = "amount",
                     by: Sequence[str] = DATE, limit_up: float = LIMIT_UP, over: DataFrame | None = None) -> DataFrame:
    """Per-day columns ``market_*`` shared by all names; percent returns are recognised and scaled."""
    source = over if over is not None else df
    ret = F.col(return_column)
    aggs = [F.count(F.lit(1)).alias("_rows"), F.sum(F.when(ret >= limit_up, 1.0).otherwise(0.0)).alias("_up"),
            F.sum(F.when(ret / 100.0 >= limit_up, 1.0).otherwise(0.0)).alias("_up_percent")]
    if turnover_column:
        traded = F.greatest(F.coalesce(F.col(turnover_column).cast("double"), F.lit(0.0)), F.lit(0.0))
        aggs.append(F.log1p(F.sum(traded)).alias("market_total_turnover_log"))
    counts = value_counts(source, by, [return_column])
    percent = quantiles_of(mapped_counts(counts, [], F.abs("_x")), [], {"m": 0.5}).scalar() > 1.0
    medians = quantiles_of(counts, by, {"_median": 0.5})
    days = source.groupBy(*by).agg(*aggs).join(medians, list(by), "left")
    rising = F.when(percent, F.col("_up_percent")).otherwise(F.col("_up"))
    return attach(df, days.select(
        *by, (F.col("_median") / F.when(percent, 100.0).otherwise(1.0)).alias("market_median_return"),
        *(["market_total_turnover_log"] if turnover_column else []), F.log1p(rising).alias("market_limit_up_count_log"),
        (rising / (F.col("_rows") + EPS)).alias("market_limit_up_ratio")), by)


def industry_zscore(df: DataFrame, columns: Mapping[str, str], industry: str = "industry_bucket",
                    by: Sequence[str] = DATE, over: DataFrame | None = None) -> DataFrame:
    """z-score within (date, industry); 0 where it is undefined."""
    scored = cs_zscore(df, columns, [*by, industry], over=over)
    return null_policy(scored, list(columns))


def rank_feature_names(sources: Sequence[str], prefix: str) -> list[str]:
    """Output names for ``sources``: non-ASCII and other signs dropped; of equal names the last keeps the plain one."""
    slugs = []
    for s in sources:
        slug = "_".join(re.findall("[0-9A-Za-z]+", s)).lower() or "f"
        slugs.append(prefix + (f"f_{slug}" if slug[0].isdigit() else slug))
    names, seen = [], {}
    for i, slug in enumerate(slugs):
        if slug in slugs[i + 1:]:
            seen[slug] = seen.get(slug, 0) + 1
            names.append(f"{slug}__dup{seen[slug]}")
        else:
            names.append(slug)
    return names


def augment(df: DataFrame, dim: DataFrame, rank_sources: Sequence[str], industry_sources: Sequence[str],
            return_column: str = "pct_chg", turnover_column: str = "amount", k: int = 12) -> tuple[DataFrame, list[str]]:
    """Static, price-volume, market, rank and industry-relative features in that order; nothing undefined stays."""
    before = set(df.columns)
    # every statistic below is taken from this stored table; the joins then pass over it once
    base = durable(price_volume_features(static_features(df, dim, k)))
    out = market_sentiment(base, return_column, turnover_column, over=base)
    ranked = [c for c in rank_sources if c in base.columns]
    if ranked:
        out = cs_rank(out, dict(zip(rank_feature_names(ranked, "cs_rank_"), ranked)), over=base)
    relative = [c for c in industry_sources if c in base.columns]
    if relative:
        out = industry_zscore(out, dict(zip(rank_feature_names(relative, "ind_z_"), relative)), over=base)
    out = out.drop("industry_bucket")
    added = [c for c in out.columns if c not in before]
    return null_policy(out, added), added


def winsorize_mad(df: DataFrame, columns: Sequence[str], n: float = 5.0, min_scale: float = 1e-6,
                  min_group: int = 1, by: Sequence[str] = DATE, center: float | str = 0.5) -> DataFrame:
    """Limits each column to median +- n * max(1.4826 * MAD, min_scale) of its day.

    Days with fewer than ``min_group`` rows stay as they are.  ``center="lower_median"`` takes the smaller of two
    middle values instead of their mean.
    """
    by, columns = list(by), list(columns)
    spread = medians_and_spreads(value_counts(df, by, columns), [*by, "_c"], center)
    reach = F.greatest(F.col("_mad") * MAD_SCALE, F.lit(min_scale)) * n
    limits = spread.groupBy(*by).agg(*[e for i, c in enumerate(columns) for e in (
        F.max(F.when(F.col("_c") == c, F.col("_med") - reach)).alias(f"_least{i}"),
        F.max(F.when(F.col("_c") == c, F.col("_med") + reach)).alias(f"_most{i}"))])
    if min_group > 1:
        limits = limits.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_group), by)

    def value(i: int, c: str) -> Column:
        bounded = F.col(c).isNotNull() & F.col(f"_least{i}").isNotNull()
        return F.when(bounded, F.greatest(F.least(F.col(c), F.col(f"_most{i}")), F.col(f"_least{i}"))).otherwise(F.col(c))

    places = {c: i for i, c in enumerate(columns)}
    return attach(df, limits, by).select(*[value(places[c], c).alias(c) if c in places else F.col(c) for c in df.columns])


def factor_gates(df: DataFrame, columns: Sequence[str], max_null_ratio: float = 0.2, max_inf_ratio: float = 0.0,
                 min_coverage: float = 0.8, by: Sequence[str] = DATE) -> DataFrame:
    """One row per factor: share of missing and infinite values, mean daily coverage, and whether it passes."""
    def flags(c):
        v = F.col(c).cast("double")
        missing = v.isNull() | F.isnan(v)
        endless = F.coalesce(F.abs(v) == float("inf"), F.lit(False))
        return F.count_if(missing), F.count_if(endless)

    # side by side per day, so that no row is multiplied; only the daily table is turned
    daily = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[e for i, c in enumerate(columns) for e in (
        flags(c)[0].alias(f"m{i}"), flags(c)[1].alias(f"e{i}"))])
    long = daily.select("n", F.explode(F.array(*[F.struct(
        F.lit(c).alias("factor"), F.col(f"m{i}").alias("missing"), F.col(f"e{i}").alias("endless"))
        for i, c in enumerate(columns)])).alias("v")).select("n", "v.*")
    out = long.groupBy("factor").agg(
        F.sum("n").alias("n"), (F.sum("missing") / F.sum("n")).alias("null_ratio"),
        (F.sum("endless") / F.sum("n")).alias("inf_ratio"),
        F.avg(F.lit(1.0) - F.col("missing") / F.col("n")).alias("coverage"))
    passed = ((F.col("null_ratio") <= max_null_ratio) & (F.col("inf_ratio") <= max_inf_ratio)
              & (F.col("coverage") >= min_coverage))
    return out.withColumn("passed", passed)


def market_context(df: DataFrame, columns: Sequence[str], by: Sequence[str] = DATE) -> DataFrame:
    """Mean and population deviation of each feature over the names of a day."""
    return df.groupBy(*by).agg(*[e for c in columns for e in (
        F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def industry_context(df: DataFrame, columns: Sequence[str], industry: str = "industry", min_members: int = 2,
                     by: Sequence[str] = DATE) -> DataFrame:
    """Mean of each feature over the names of (day, industry), for groups of at least ``min_members``."""
    return df.where(F.col(industry).isNotNull()).groupBy(*by, industry).agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(f"{c}_mean") for c in columns]
    ).where(F.col("members") >= min_members)
