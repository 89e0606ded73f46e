"""What a table was when a job read or wrote it: counts, hashes, and the job's manifest row."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 15  # hexadecimal digits of a hash that are added up as a number


def snapshot(df: DataFrame, name: str, instrument: str = "instrument_id", date: str = "trade_date") -> DataFrame:
    """One row: rows, columns, first and last date, number of instruments."""
    return df.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"),
        F.count_distinct(instrument).alias("instruments"))


def schema_hash(df: DataFrame) -> str:
    """md5 of the column names in their order."""
    return hashlib.md5(",".join(df.columns).encode()).hexdigest()


def cell_text(column: Column, kind: T.DataType) -> Column:
    """A value as text that other engines can make alike: NULL is ``~``, a fraction its floor and the next 52 binary digits.

    Numbers of 2 ** 62 or more in size count by their sign only.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = column.cast("double")
        whole = F.floor(x)
        rest = F.floor((x - whole) * float(1 << 52)).cast("bigint")
        text = F.when(F.isnan(x), "nan").when(F.abs(x) >= float(1 << 62), F.concat(F.lit("huge"), F.signum(x).cast("int").cast("string"))).otherwise(
            F.concat_ws(":", whole.cast("bigint").cast("string"), rest.cast("string")))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("~"))


def row_hash(df: DataFrame) -> Column:
    """md5 of a row's cells, in the order of the column names."""
    cells = [cell_text(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.md5(F.concat_ws("|", *cells))


def data_hash(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, row_count, content_sum): equal for equal multisets of rows, in whatever order they lie.

    The sum of the first two pieces of every row's md5, so partial sums can be added up, here or by another engine.
    """
    one = df.select(*by, row_hash(df).alias("_h"))
    piece = lambda start: F.sum(F.conv(F.substring("_h", start, PIECE), 16, 10).cast("decimal(38,0)")).cast("string")
    return one.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.concat_ws(":", piece(1), piece(PIECE + 1)).alias("content_sum"))


def quality_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per factor: rows, missing share, instruments and date range of the table."""
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("instruments"),
                   F.min("trade_date").alias("date_min"), F.max("trade_date").alias("date_max"),
                   *[F.count(c).alias(f"k{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.col("n").alias("row_count"),
                               (1.0 - F.try_divide(F.col(f"k{i}"), F.col("n"))).alias("null_ratio"))
                      for i, c in enumerate(columns)])
    return whole.select(F.explode(cells).alias("v"), "instruments", "date_min", "date_max").select(
        "v.*", "instruments", "date_min", "date_max")


def fingerprint(specs: Sequence[Mapping]) -> str:
    """First 16 hex digits of the sha256 of the ordered factor definitions."""
    text = json.dumps([dict(s) for s in specs], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def table_fingerprints(definitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, factors, factor_fingerprint): :func:`fingerprint` of factor definitions kept as a table, in whatever order they lie."""
    content = data_hash(definitions, by)
    text = F.concat_ws(":", F.col("row_count").cast("string"), "content_sum")
    return content.select(*by, F.col("row_count").alias("factors"), F.substring(F.sha2(text, 256), 1, 16).alias("factor_fingerprint"))


def manifest(inputs: Mapping[str, DataFrame], output: DataFrame, *, run_id: str, status: str = "succeeded",
             factor_fingerprint: str = "", paths: Mapping[str, str] | None = None) -> DataFrame:
    """One row describing a run: a snapshot per input, the output's schema and data hash, where it was written."""
    parts = [snapshot(df, name) for name, df in inputs.items()]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    shots = stacked.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("inputs"))
    content = data_hash(output)
    return content.select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(factor_fingerprint).alias("factor_fingerprint"),
        F.lit(schema_hash(output)).alias("schema_hash"), "row_count", F.col("content_sum").alias("data_hash"),
        F.lit(json.dumps(dict(paths or {}), sort_keys=True)).alias("paths"), shots.scalar().alias("inputs"))


def write_manifest(df: DataFrame, path: str) -> None:
    """One JSON file: the manifest has one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def lineage_issues(datasets: DataFrame, active: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, field, dataset_value, active_value) where a dataset was built with something else than what is active now.

    One row per difference; a dataset whose key isn't active differs in every field that it has.
    """
    now = active.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in compared])
    both = datasets.join(now, F.col(key) == F.col("_k"), "left")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("dataset_value"), F.col(f"_{c}").cast("string").alias("active_value"))
                      for c in compared])
    return both.select(key, F.inline(cells)).where(~F.col("dataset_value").eqNullSafe(F.col("active_value")))


def run_status(reports: DataFrame) -> DataFrame:
    """(run, factors, ok, failed, first_error): node reports (run, factor, status, message) of several runs, one row per run."""
    bad = F.col("status") != "ok"
    return reports.groupBy("run").agg(
        F.count(F.lit(1)).alias("factors"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"),
        F.min(F.when(bad, F.concat_ws(": ", "factor", "message"))).alias("first_error"))


def check_lineage(dataset: Mapping[str, str], active: Mapping[str, str], strict: bool = False) -> list[str]:
    """Differences between the factor set a dataset was built with and the active one; an error when strict."""
    issues = [f"{key}: dataset has {dataset.get(key)!r}, active is {active.get(key)!r}"
              for key in ("factor_fingerprint", "factor_version") if dataset.get(key) != active.get(key)]
    if strict and issues:
        raise ValueError("; ".join(issues))
    return issues
