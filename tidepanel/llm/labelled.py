"""Bounded samples of labelled rows, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most_rows: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text, label) of the documents whose label may be learned from: at most ``most_rows`` labels.

    Rows of the held-out fold never count. Beyond ``most_rows`` the labels with the smallest hash of their id are
    taken. Labels that are null or have no id are left out; of several labels of an id the largest holds, and of several
    texts the one with the smallest md5, so there are at most ``most_rows`` rows and the same ones on every run.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(id_col, folds) != held_out))
    one = usable.groupBy(F.col(id_col).alias("of")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sample = one.withColumn("by", F.xxhash64(F.col("of").cast("string"))).orderBy("by", "of").limit(most_rows)
    narrow = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # at most most_rows rows of three numbers
    rows = narrow.join(F.broadcast(sample.select("of", "label")), F.col("doc") == F.col("of")).drop("of")
    first = F.row_number().over(Window.partitionBy("doc").orderBy(F.md5(F.coalesce("text", F.lit("")))))
    return rows.withColumn("first", first).where("first = 1").drop("first")
