"""Quality rules as a report table; nothing is written when a rule fails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "rule string, type string, passed boolean, failed_rows bigint, detail string"
# Trading sessions in minutes of the day, both ends included.
SESSIONS = ((9 * 60 + 30, 11 * 60 + 30), (13 * 60, 15 * 60))


def in_session(ts: Column) -> Column:
    """Whether a time lies in a trading session; an unknown time does not."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    hit = F.lit(False)
    for start, end in SESSIONS:
        hit = hit | minute.between(start, end)
    return F.coalesce(hit, F.lit(False))


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def _report(agg: DataFrame, name: str, kind: str, failed: Column, detail: Column, passed: Column | None = None) -> DataFrame:
    return agg.select(F.lit(name).alias("rule"), F.lit(kind).alias("type"),
                      (failed == 0 if passed is None else passed).alias("passed"), failed.cast("bigint").alias("failed_rows"),
                      detail.cast("string").alias("detail"))


def unique_key(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """Rows beyond the first of each key."""
    require_columns(df, keys)
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    failed = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return _report(copies.agg(failed.alias("f")), name, "unique_key", F.col("f"), F.lit(",".join(keys)))


def row_rules(df: DataFrame, rules: Sequence[tuple[str, str, Column, str]]) -> DataFrame:
    """Rules (name, type, condition, detail) on single rows, all counted in one pass; NULL counts as failed."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"f{i}") for i, (_, _, ok, _) in enumerate(rules)])
    lines = F.array(*[F.struct(
        F.lit(name).alias("rule"), F.lit(kind).alias("type"), (F.col(f"f{i}") == 0).alias("passed"),
        F.col(f"f{i}").cast("bigint").alias("failed_rows"), F.lit(detail).alias("detail")) for i, (name, kind, _, detail) in enumerate(rules)])
    return counts.select(F.inline(lines))


def expression(df: DataFrame, text: str | Column, name: str = "expression") -> DataFrame:
    """Rows for which a Spark SQL condition is false or NULL."""
    return row_rules(df, [_condition(text, name)])


def _condition(text: str | Column, name: str) -> tuple[str, str, Column, str]:
    return (name, "expression", F.expr(text), text) if isinstance(text, str) else (name, "expression", text, str(text))


def daily_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("trade_date").isNotNull()).groupBy("trade_date").agg(F.count_distinct("instrument_id").alias("names"))


def coverage_ratios(df: DataFrame) -> DataFrame:
    """One row: trading days, and the 50th and 10th percentile of daily names over the largest day."""
    # one count per trading day
    return daily_counts(df).agg(
        F.count(F.lit(1)).alias("days"),
        F.coalesce(F.percentile("names", 0.5) / F.max("names"), F.lit(1.0)).alias("ratio_p50"),
        F.coalesce(F.percentile("names", 0.1) / F.max("names"), F.lit(1.0)).alias("ratio_p10"))


def coverage(df: DataFrame, min_p50: float = 0.0, min_p10: float = 0.0, name: str = "coverage") -> DataFrame:
    require_columns(df, ["instrument_id", "trade_date"])
    ok = (F.col("ratio_p50") >= min_p50) & (F.col("ratio_p10") >= min_p10)
    text = F.format_string("p50=%.3f p10=%.3f", F.col("ratio_p50"), F.col("ratio_p10"))
    return _report(coverage_ratios(df), name, "stock_coverage_vs_trade_days", F.when(ok, 0).otherwise(1), text, ok)


def session(df: DataFrame, name: str = "session") -> DataFrame:
    require_columns(df, ["ts"])
    return row_rules(df, [(name, "market_session_check", in_session(F.col("ts")), "")])


def validate(df: DataFrame, rules: Sequence[Mapping], required: Sequence[str] = (), primary_key: Sequence[str] = ()) -> DataFrame:
    """The report of all rules; a rule of an unknown type is reported as skipped (``passed`` is NULL).

    Expressions and session times are counted in one pass; each key rule and coverage rule groups the table its own way.
    """
    require_columns(df, required)
    parts = [unique_key(df, primary_key, "primary_key")] if primary_key else []
    single, skipped = [], []
    for i, rule in enumerate(rules):
        kind, name = rule.get("type", ""), rule.get("name") or rule.get("type") or f"rule_{i}"
        if kind == "unique_key":
            parts.append(unique_key(df, rule["key"], name))
        elif kind == "expression":
            single.append(_condition(rule["expr"], name))
        elif kind == "stock_coverage_vs_trade_days":
            parts.append(coverage(df, rule.get("min_ratio_p50", 0.0), rule.get("min_ratio_p10", 0.0), name))
        elif kind == "market_session_check":
            require_columns(df, ["ts"])
            single.append((name, kind, in_session(F.col("ts")), ""))
        else:
            skipped.append((name, kind, None, 0, "skipped"))
    if single:
        parts.append(row_rules(df, single))
    out = df.sparkSession.createDataFrame(skipped, REPORT) if skipped or not parts else parts.pop()
    for p in parts:
        out = out.unionByName(p)
    return out


def enforce(df: DataFrame, rules: Sequence[Mapping], required: Sequence[str] = (), primary_key: Sequence[str] = ()) -> DataFrame:
    """``df`` unchanged when every rule passes; otherwise an error that lists the failures (one row per rule)."""
    report = validate(df, rules, required, primary_key)
    failures = report.where(~F.col("passed")).collect()  # as many rows as there are rules
    if failures:
        raise ValueError("; ".join(f"{r['rule']}: {r['failed_rows']} failed ({r['detail']})" for r in failures))
    return df
