"""Training-log text to tables: metrics per epoch, factor-group ablations, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line formats of a training log.
NUMBER = r"([-+]?\d+(?:\.\d+)?)"
EPOCH = r"^=== Epoch\s+(\d+)/(\d+)\s+==="
SCALAR = r"^(Train|Eval)\s+([A-Za-z0-9_\-]+):\s+" + NUMBER
BEST = (r"^当前最优持仓策略:\s*([^|]+)\|\s*验证目标值:\s*" + NUMBER + r"\s*\|\s*策略收益均值:\s*" + NUMBER
        + r"\s*\|\s*RankIC:\s*" + NUMBER)
STOP_STATUS = r"^早停状态:\s*monitor=([^,]+),\s*value=" + NUMBER + r",\s*best=" + NUMBER + r",\s*bad_epochs=(\d+)/(\d+)"
STOPPED = r"^触发早停:\s*monitor=([^,]+),\s*mode=([^,]+),\s*patience=(\d+),\s*best=" + NUMBER
ABLATION = r"^\s*-\s*([^:]+):\s*features=(\d+),\s*return=" + NUMBER + r",\s*delta=" + NUMBER


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of each log file; a file is read whole to keep its line order."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


BLOCK_LINES = 4096


def carried(lines: DataFrame, value: Column, out: str) -> DataFrame:
    """``lines`` with the last non-NULL ``value`` of the same file at or above each line.

    A file is cut in blocks of lines; only lines of a block are ordered together, and a table with one row per block hands
    the value on, so a long file is spread over its blocks.
    """
    work = lines.withColumn("_value", value).withColumn("_block", F.floor(F.col("line_no") / BLOCK_LINES))
    ends = work.groupBy("file", "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("line_no"))).alias("_end"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "_block", F.last("_end", ignorenulls=True).over(before).alias("_prior"))
    inside = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    within = work.withColumn("_within", F.last("_value", ignorenulls=True).over(inside))
    return within.join(ends, ["file", "_block"], "left").select(*lines.columns, F.coalesce("_within", "_prior").alias(out))


def parse_training_log(lines: DataFrame) -> dict[str, DataFrame]:
    """Tables ``epochs``, ``metrics``, ``best``, ``ablation`` and ``early_stop`` of lines (file, line_no, line).

    A line belongs to the last epoch header above it; lines before the first header are ignored.  ``epochs`` has every
    epoch with a header, also those without a metric, its ``total_epochs`` from the first header and whether it
    stopped early.  What is reported twice in an epoch (a metric, the best strategy) keeps its last value.
    """
    def part(pattern, group):
        return F.regexp_extract("line", pattern, group)

    def number(pattern, group):
        return part(pattern, group).try_cast("double")

    rows = carried(lines, part(EPOCH, 1).try_cast("int"), "epoch").where("epoch IS NOT NULL")
    scalars = rows.where(F.col("line").rlike(SCALAR)).select(
        "file", "epoch", "line_no", F.concat_ws("_", F.lower(part(SCALAR, 1)), part(SCALAR, 2)).alias("name"),
        number(SCALAR, 3).alias("value"))
    metrics = scalars.groupBy("file", "epoch", "name").agg(F.max_by("value", "line_no").alias("value"))
    best = rows.where(F.col("line").rlike(BEST)).select(
        "file", "epoch", F.trim(part(BEST, 1)).alias("strategy"), number(BEST, 2).alias("objective"),
        number(BEST, 3).alias("strategy_return"), number(BEST, 4).alias("rank_ic"), "line_no")
    best = best.groupBy("file", "epoch").agg(
        F.max_by(F.struct("strategy", "objective", "strategy_return", "rank_ic"), "line_no").alias("b")).select("file", "epoch", "b.*")
    ablation = rows.where(F.col("line").rlike(ABLATION)).select(
        "file", "epoch", F.trim(part(ABLATION, 1)).alias("factor_group"), part(ABLATION, 2).try_cast("int").alias("num_features"),
        number(ABLATION, 3).alias("return"), number(ABLATION, 4).alias("delta"))
    status, stopped = F.col("line").rlike(STOP_STATUS), F.col("line").rlike(STOPPED)

    def either(in_status, in_stopped):
        return F.when(status, in_status).otherwise(in_stopped)

    early = rows.where(status | stopped).select(
        "file", "epoch", F.trim(either(part(STOP_STATUS, 1), part(STOPPED, 1))).alias("monitor"),
        F.when(stopped, F.trim(part(STOPPED, 2))).alias("mode"), F.when(status, number(STOP_STATUS, 2)).alias("value"),
        either(number(STOP_STATUS, 3), number(STOPPED, 4)).alias("best"), F.when(status, part(STOP_STATUS, 4).try_cast("int")).alias("bad_epochs"),
        either(part(STOP_STATUS, 5), part(STOPPED, 3)).try_cast("int").alias("patience"), stopped.alias("triggered"))
    total = F.when(F.col("line").rlike(EPOCH), part(EPOCH, 2).try_cast("int"))
    epochs = rows.groupBy("file", "epoch").agg(
        F.min_by(total, F.when(total.isNotNull(), F.col("line_no"))).alias("total_epochs"),
        F.count_if(F.col("line").rlike(SCALAR)).alias("metric_lines"), F.max(stopped).alias("triggered"))
    return {"epochs": epochs, "metrics": metrics, "best": best, "ablation": ablation, "early_stop": early}
