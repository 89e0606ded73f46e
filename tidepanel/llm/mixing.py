"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its share by weight, never more than ``limit`` times its own size, the excess
reshared among the others. The ratio of target to size gives every document of the source its certain whole copies
(the integer part); the rest of the target is drawn by Pareto sampling: a document with inclusion probability p and a
random number u is ranked by (u / (1 - u)) / (p / (1 - p)), smallest first, and the ranking is cut where its words
reach the rest of the target. Inclusion is unequal within a source too: p falls with length as m / (m + size), m being
the source's mean size, so that single giants don't fill a target. What is missing at the cut is filled from the documents
next to it, larger ones first, as far as they fit, and by
one that doesn't fit if that comes nearer.

The cut of a source is found without sorting the source: ranks are summed up in buckets of about ``bucket_rows`` documents, and
only the bucket in which the target is reached is ordered. The whole draw comes down to one row per source, which then
decides on every document by itself; texts are never shuffled. Randomness is a hash of the id, so reruns agree.

Rows of one source that share id and size are drawn together. A null source is a source of its own and comes last. A
document without words counts for nothing and is never taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .text import free_name, whole, word_count

WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc, source, size): ids as they are, sources as text, sizes in words; null texts have none."""
    return docs.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"),
                       word_count(whole(text_col)).alias("size"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target), stored; one row per source of ``sizes``.

    Sources by code point, null last, take ``weights`` in turn. ``share`` times all words are split by weight; a
    source stops at ``limit`` times its size and the others share what it leaves, until none is above.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    order = F.col("source").asc_nulls_last()
    # positions in the order of sources: within ranges first, then the ranges before are added
    ranged = durable(per_source.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    within = ranged.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy(order)))
    before = ranged.groupBy("range").count().select(
        "range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    turns = F.array(*[F.lit(int(w)) for w in weights])
    weighted = durable(within.join(before, "range").select(
        "source", "source_size", "n_docs",
        F.element_at(turns, ((F.col("before") + F.col("at") - 1) % len(weights) + 1).cast("int")).alias("weight")))

    level, capped = 0.0, -1
    most = F.col("source_size") * F.lit(float(limit))
    while True:  # the level only rises; it stays once no further source is above its limit
        over = F.col("weight") * F.lit(level) >= most
        row = weighted.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("source_size"))).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"), F.sum(over.cast("long")).alias("capped")).first()
        if row["all"] is None or row["open"] is None or row["capped"] == capped:
            break
        capped = row["capped"]
        level = (share * row["all"] - limit * (row["full"] or 0)) / row["open"]
    return weighted.select("source", "source_size", "n_docs",
                           F.least(most, F.col("weight") * F.lit(level)).alias("target"))


def _ranks(doc: Column, size: Column, s: str | None, seed: int) -> tuple[Column, Column]:
    """The unit by which a document with words is ranked, and its bucket; null where nothing is drawn.

    Columns source_size, n_docs, scale and buckets are those of its source (below alias ``s``, if given).
    """
    def of(name: str) -> Column:
        return F.col(f"{s}.{name}" if s else name)

    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(text, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    p = F.least(F.lit(1.0), of("scale") * _lean(of("source_size"), of("n_docs"), size))
    odds = F.when(p >= 1, 0.0).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    unit = F.struct(odds.alias("odds"), F.coalesce(doc.cast("string"), F.lit("")).alias("key"), size.alias("size"))
    return F.when(odds.isNotNull(), unit), F.floor(odds / (1 + odds) * of("buckets"))


def _lean(source_size: Column, n_docs: Column, size: Column) -> Column:
    """How inclusion falls with length: m / (m + size), m the source's mean size."""
    return source_size / (source_size + n_docs * size)


def _joined(sizes: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with the columns of their source; null sources meet."""
    of = per_source.withColumnRenamed("source", "of_source")
    return sizes.join(of, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def draw(sizes: DataFrame, per_source: DataFrame, seed: int = 7, bucket_rows: int = 4096) -> DataFrame:
    """(source, source_size, n_docs, target, copies, scale, buckets, in_bucket, cut, fill), stored.

    All that decides on a document of a source: ``copies`` are certain; one more goes to units in buckets before
    ``in_bucket``, to those in it that are at most ``cut``, and to the units of ``fill``.
    """
    ratio = F.col("target") / F.col("source_size")
    stats = per_source.where(F.col("source_size") > 0).withColumn("copies", F.floor(ratio).cast("long")).withColumn(
        "rest", F.col("target") - F.col("copies") * F.col("source_size"))
    some = sizes.where(F.col("size") > 0)
    lean = _lean(F.col("source_size"), F.col("n_docs"), F.col("size"))
    # thousandths of words, summed as integers: the sum doesn't depend on the order of addition
    leaned = _joined(some, stats).groupBy("source").agg(F.sum(F.round(lean * F.col("size") * 1000).cast("long")).alias("leaned"))
    stats = durable(_joined(stats, leaned).select(
        "source", "source_size", "n_docs", "target", "copies", "rest",
        (F.col("rest") * 1000 / F.col("leaned")).alias("scale"),
        F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n_docs") / bucket_rows)))).alias("buckets")))
    unit, bucket = _ranks(F.col("doc"), F.col("size"), None, seed)
    ranked = _joined(some, stats).select("source", "size", "rest", unit.alias("unit"), bucket.alias("bucket")).where(
        F.col("unit").isNotNull())
    summed = ranked.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words")).withColumn(
        "upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    met = durable(summed.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest"))).select(
        "source", F.col("bucket").alias("in_bucket"), (F.col("upto") - F.col("words")).alias("before")))
    units = _joined(ranked, met).where(F.col("bucket") == F.col("in_bucket")).groupBy(
        "source", "unit", "rest", "before").agg(F.sum("size").alias("words"))
    units = units.withColumn("reached", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("unit")))
    units = units.withColumn("inside", F.col("reached") <= F.col("rest"))
    units = units.withColumn("gap", F.col("rest") - F.coalesce(
        F.max(F.when(F.col("inside"), F.col("reached"))).over(Window.partitionBy("source")), F.col("before")))
    # what lies behind the cut, larger ones first: each that still fits the gap is taken (a bucket bounds the list)
    behind = F.reverse(F.array_sort(F.collect_list(F.when(~F.col("inside"), F.struct("words", "unit")))))
    cuts = units.groupBy("source").agg(
        F.max(F.when(F.col("inside"), F.col("unit"))).alias("cut"), behind.alias("behind"), F.min("gap").alias("gap"))
    cuts = cuts.withColumn("fill", F.aggregate(
        "behind", F.struct(F.col("gap"), F.array().cast("array<struct<odds:double,key:string,size:bigint>>").alias("fill")),
        lambda state, x: F.when(x["words"] <= state["gap"], F.struct(
            (state["gap"] - x["words"]).alias("gap"), F.concat(state["fill"], F.array(x["unit"])).alias("fill"))
        ).otherwise(state), _finished)).drop("behind", "gap")
    return durable(_joined(_joined(stats, met, "left"), cuts, "left").drop("rest", "before"))


def _finished(state: Column) -> Column:
    """The fill, with the smallest unit that is too large if it comes nearer than leaving the gap."""
    over = F.array_min(F.filter("behind", lambda x: (x["words"] > state["gap"]) & (x["words"] < 2 * state["gap"])))
    return F.when(over.isNull(), state["fill"]).otherwise(F.concat(state["fill"], F.array(over["unit"])))


def _copies(doc: Column, size: Column, s: str, seed: int) -> Column:
    """How often a document is taken, from its source's row of ``draw`` under alias ``s``."""
    unit, bucket = _ranks(doc, size, s, seed)
    at = F.col(f"{s}.in_bucket")
    more = (bucket < at) | ((bucket == at) & (unit <= F.col(f"{s}.cut"))) | F.array_contains(f"{s}.fill", unit)
    return F.when(size > 0, F.coalesce(F.col(f"{s}.copies"), F.lit(0)) + F.coalesce(more, F.lit(False)).cast("long")
                  ).otherwise(0).cast("long")


def taken(sizes: DataFrame, drawn: DataFrame, seed: int = 7) -> DataFrame:
    """(doc, size, source_size, target, taken): words the mix takes of each row of ``sizes``.

    A source without words has size and target 0.
    """
    m = drawn.withColumnRenamed("source", "of_source").alias("m")
    joined = sizes.alias("d").join(m, F.col("d.source").eqNullSafe(F.col("m.of_source")), "left")
    copies = _copies(F.col("d.doc"), F.col("d.size"), "m", seed)
    return joined.select("d.doc", "d.size", F.coalesce("m.source_size", F.lit(0)).cast("long").alias("source_size"),
                         F.coalesce("m.target", F.lit(0.0)).alias("target"), (copies * F.col("d.size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken, with the columns of ``docs``.

    Empty tables give empty tables. Names that clash with working columns do no harm.
    """
    sizes = durable(sized(docs, id_col, text_col, source_col))
    drawn = draw(sizes, targets(sizes, weights, share, limit), seed)
    size, times, of = (free_name(docs, n) for n in ("size__", "times__", "of_source__"))
    m = drawn.withColumnRenamed("source", of).alias("m")
    rows = docs.withColumn(size, word_count(whole(text_col))).alias("d")
    joined = rows.join(m, F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col(f"m.{of}")))
    copies = _copies(F.col(f"d.{id_col}"), F.col(f"d.{size}"), "m", seed)
    repeated = joined.select("d.*", copies.alias(times)).where(F.col(times) > 0)
    return repeated.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
