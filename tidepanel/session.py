"""Session settings for tests and benchmarks; on a cluster the session comes from its own configuration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, name: str = "tidepanel", memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites in error messages cost several calls into the JVM for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where none is configured a temporary one is set, but only if the session runs on this machine alone; on a
    cluster each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, read back from there.

    For a table that several following steps read: it is not computed again for each of them, a lost executor costs
    nothing upstream, and being parquet each reader takes only the columns it needs and the optimizer knows its
    size.
    """
    path = f"{shared_folder(df.sparkSession)}/tidepanel-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
