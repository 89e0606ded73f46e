"""The registered queries of this folder, with their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from . import (approximation_file, frequency_trie, html_layout, hyperplane_tree, lattice_dedup, license_scan, mixing, ngram_join, oracles,
               packing, pairwise_quality, quality_cascade, token_counts, toxicity)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, folder, "documents")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_cascade.verdicts(table(spark, folder, "documents"))


def op3_lattice_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_dedup.dedup(table(spark, folder, "embeddings"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sizes = durable(mixing.sized(table(spark, folder, "documents")))
    return mixing.taken(sizes, mixing.draw(sizes, mixing.targets(sizes))).withColumnRenamed("doc", "doc_id")


def op7_pairwise_quality(spark: SparkSession, folder: str) -> DataFrame:
    return pairwise_quality.predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_html_layout(spark: SparkSession, folder: str) -> DataFrame:
    return html_layout.extract(table(spark, folder, "pages"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents")).withColumnRenamed("doc", "doc_id")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hyperplane_tree.hard_negatives(table(spark, folder, "embeddings"), F.col("vec") % 50 == 0, moved)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return frequency_trie.variants(table(spark, folder, "documents"))


def op13_approximation_search(spark: SparkSession, folder: str) -> DataFrame:
    return approximation_file.top_k(table(spark, folder, "embeddings"), F.col("vec") % 50 == 0)


QUERIES = (op1_license_scan, op2_quality_rules, op3_lattice_dedup, op4_toxicity, op5_token_counts, op6_mixing, op7_pairwise_quality,
           op8_html_layout, op9_ngram_join, op10_packing, op11_hard_negatives, op12_spelling_variants, op13_approximation_search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {run.__name__: run for run in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
