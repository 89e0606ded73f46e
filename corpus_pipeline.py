"""From documents to packed training sequences: five stages, each one of the operators of ``tidepanel.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The first four return rows with the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import mixing, ngram_join, packing, quality_cascade, toxicity
from tidepanel.session import durable


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, doesn't find toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_cascade.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by Jaccard links the one with the smallest id."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence they are packed into."""
    return packing.pack(docs).withColumnRenamed("doc", "doc_id")


STAGES = [("toxicity", not_toxic), ("quality_rules", good), ("ngram_join", one_of_each), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None  # fitted models and hashed draws; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = durable(docs)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
