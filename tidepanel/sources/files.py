"""Reading tables from files and writing them in partitioned layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import keep_last


def _is_csv(path: str) -> bool:
    return path.lower().split("*")[-1].endswith((".csv", ".csv.gz"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or parquet, told apart by the suffix; CSV columns are text unless a schema is given."""
    if _is_csv(path):
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", schema is not None)
        out = (reader.schema(schema) if schema is not None else reader).csv(path)
    else:
        out = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    # a byte order mark may stick to the first header
    return out.withColumnsRenamed({c: c.lstrip("﻿") for c in out.columns if c.startswith("﻿")})


def expand_paths(paths: Sequence[str] | str) -> list[str]:
    """Comma lists and repeats reduced to distinct paths; folders and patterns stay for Spark to list."""
    given = [paths] if isinstance(paths, str) else list(paths)
    return list(dict.fromkeys(p.strip() for item in given for p in item.split(",") if p.strip()))


def read_many(spark: SparkSession, paths: Sequence[str] | str, schema: T.StructType | None = None) -> DataFrame:
    """All files as one table with their name in ``source_file``; missing columns are NULL.

    Spark lists folders and patterns, so they may lie on any file system. Parquet paths share one scan however many
    files they have; each CSV path is one. Files of one CSV path must have the same header, else the read fails; name them
    apart where they differ.
    """
    files = expand_paths(paths)
    if not files:
        raise FileNotFoundError(f"no input files: {paths}")
    text = [p for p in files if _is_csv(p)]
    parts = [read_table(spark, p, schema).withColumn("source_file", F.col("_metadata.file_name")) for p in text]
    if len(text) < len(files):
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
        parts.append(reader.parquet(*[p for p in files if p not in text]).withColumn("source_file", F.col("_metadata.file_name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# Where a layer's tables lie below its root.
LAYOUTS = {
    "raw": "{root}/raw/{source}/{dataset}",
    "curated": "{root}/curated/{dataset}",
    "feature_long": "{root}/feature/{dataset}/long",
    "feature_wide": "{root}/feature/{dataset}/wide",
}


def layer_path(layer: str, **parts: str) -> str:
    return LAYOUTS[layer].format(**parts)


def _writer(df: DataFrame, partition: str | None, mode: str):
    writer = df.write.mode(mode).option("compression", "zstd")
    return writer.partitionBy(partition) if partition else writer


def append_only(df: DataFrame, path: str, partition: str | None = "trade_date") -> None:
    _writer(_gathered(df, partition), partition, "append").parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str = "trade_date") -> None:
    """Replaces just the partitions that occur in ``df``."""
    _writer(_gathered(df, partition), partition, "overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_build(df: DataFrame, path: str, partition: str | None = "trade_date") -> None:
    _writer(_gathered(df, partition), partition, "overwrite").option("partitionOverwriteMode", "static").parquet(path)


def _gathered(df: DataFrame, partition: str | None) -> DataFrame:
    """Rows of one partition in few files; the optimizer splits a partition that is far larger than the others."""
    return df.hint("rebalance", F.col(partition)) if partition else df


def merged_on_key(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows with the changes applied: a changed row replaces the row of the same key."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, list(keys), ["_new"]).drop("_new")


def upsert_on_key(changes: DataFrame, path: str, keys: Sequence[str], partition: str = "trade_date") -> None:
    """Merges changes into a partitioned table, reading and rewriting only the partitions they touch.

    All stored columns stay: where the changes lack one, a changed row keeps its stored value (NULL in a new row).
    Changes without a key or the partition column, or with a column the table doesn't have, are refused.
    """
    from ..session import durable
    spark = changes.sparkSession
    stored = spark.read.parquet(path)
    absent = [c for c in [*keys, partition] if c not in changes.columns]
    unknown = [c for c in changes.columns if c not in stored.columns]
    if absent or unknown:
        raise ValueError(f"changes lack columns {absent} or have columns the table doesn't: {unknown}")
    current = stored.join(changes.select(partition).distinct(), partition, "left_semi")
    rest = [c for c in stored.columns if c not in changes.columns]
    if rest:
        by = list(dict.fromkeys([*keys, partition]))
        changes = changes.join(current.select(*by, *rest).dropDuplicates(by), by, "left")
    changes = changes.select(*stored.columns)
    # the target is overwritten while it is being read, so the merged rows must exist elsewhere first
    replace_partitions(durable(merged_on_key(current, changes, keys)), path, partition)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Text export with a header, sorted when an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def leaderboard_append(entry: DataFrame, path: str) -> None:
    """Adds a score row to the board."""
    entry.write.mode("append").parquet(path)
