"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

A document longer than a sequence fills whole sequences by itself; its remainder, and every shorter document, goes
into the tightest open bin that has room and no conflict. A bin carries two bitmaps, the sources and the duplicate
clusters in it; a piece conflicts with a bin whose bitmaps hold its source or its cluster. Open bins stand in order of
what they have left; the search starts at the piece's size and goes on to the next larger residual until a bin is compatible.
Without one a new bin is opened. Longer pieces come first.

Best-fit is a walk over pieces, so documents are dealt by a hash of their id into shards of about ``shard_rows``
documents, each packed by itself; a shard with more rows (a repeated id) is packed in turns of at most twice that many. Only id, source,
cluster and size reach Python, never a text, and a task holds one turn at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import whole, word_count

SCHEMA = "doc string, piece long, start long, n_words long, bin_id long, place long, bin_words long"


def fingerprint(text: Column) -> Column:
    """Equal for texts that differ only in letter case and blanks; null for texts without words."""
    folded = F.trim(F.regexp_replace(F.lower(text), r"[ \t-\r]+", " "))
    return F.when(folded != "", F.md5(folded.cast("binary")))


class Bins:
    """Open bins of one shard in order of residual, with the bitmaps of what they hold."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[int] = []
        self.bits: dict[tuple[str, object], int] = {}

    def bit(self, kind: str, value: object) -> int:
        """The bit of a source or cluster; none for null, which conflicts with nothing."""
        if value is None:
            return 0
        return self.bits.setdefault((kind, value), 1 << len(self.bits))

    def put(self, size: int, source: object, cluster: object) -> tuple[int, int]:
        """(bin, place in it) for a piece."""
        s, c = self.bit("source", source), self.bit("cluster", cluster)
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            residual, number = self.open[at]
            if not (self.sources[number] & s or self.clusters[number] & c):
                del self.open[at]
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.counts)
            self.sources.append(0)
            self.clusters.append(0)
            self.counts.append(0)
        self.sources[number] |= s
        self.clusters[number] |= c
        self.counts[number] += 1
        if residual > size:
            insort(self.open, (residual - size, number))
        return number, self.counts[number] - 1


def pack_turn(rows: list[tuple], capacity: int) -> list[list]:
    """Pieces of (doc, source, cluster, size) rows: [doc, piece, start, n_words, bin, place, bin_words]."""
    out, rest, bins = [], [], Bins(capacity)
    for doc, source, cluster, size in rows:
        whole_bins, left = divmod(size, capacity)
        for piece in range(whole_bins):
            number, place = bins.put(capacity, None, None)
            out.append([doc, piece, piece * capacity, capacity, number, place])
        if left:
            rest.append((left, doc, whole_bins, source, cluster))
        elif not size:
            out.append([doc, 0, 0, 0, None, None])
    rest.sort(key=lambda r: (-r[0], r[1] is None, r[1] or "", r[3] or "", r[4] or ""))
    for left, doc, piece, source, cluster in rest:
        number, place = bins.put(left, source, cluster)
        out.append([doc, piece, piece * capacity, left, number, place])
    filled = [0] * len(bins.counts)
    for row in out:
        if row[4] is not None:
            filled[row[4]] += row[3]
    for row in out:
        row.append(0 if row[4] is None else filled[row[4]])
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", cluster: Column | None = None, shard_rows: int = 8192) -> DataFrame:
    """One row per piece: doc, piece, start, n_words, bin_id, place, bin_words.

    ``doc`` is the id as it is; ``start`` counts words of the document; ``bin_words`` is what its bin holds in all.
    ``cluster`` names a document's duplicate cluster, by default its ``fingerprint``. A document without words, a null
    text among them, has one row without a bin. Null ids, sources and clusters are packed; null sources and clusters
    conflict with nothing. Repeated rows are packed one by one, in different bins. Other columns aren't looked at; an
    empty table gives an empty table.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    narrow = docs.select(
        F.pmod(key, F.lit(shards)).alias("shard"), F.xxhash64(key, F.lit(1)).alias("mixed"),
        F.col(id_col).cast("string").alias("doc"), F.col(source_col).cast("string").alias("source"),
        (fingerprint(whole(text_col)) if cluster is None else cluster.cast("string")).alias("cluster"),
        word_count(whole(text_col)).alias("size"))
    dealt = narrow.repartition("shard").sortWithinPartitions("shard", "mixed", "doc", "source", "size", "cluster")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, first, rows = None, 0, []  # first: the number of the turn's first bin in its shard

        def packed() -> pd.DataFrame:
            out = pd.DataFrame(pack_turn(rows, capacity), columns=[
                "doc", "piece", "start", "n_words", "bin_id", "place", "bin_words"])
            out["bin_id"] = out["bin_id"].astype("Int64") + (shard << 32) + first
            out["place"] = out["place"].astype("Int64")
            return out

        for frame in frames:
            columns = [frame[c].tolist() for c in ("shard", "doc", "source", "cluster", "size")]
            for n, doc, source, cluster_, size in zip(*columns):
                if rows and (n != shard or len(rows) >= 2 * shard_rows):
                    out = packed()
                    yield out
                    first = first + out["bin_id"].nunique() if n == shard else 0
                    rows = []
                shard = n
                rows.append((doc, source, cluster_, size))
        if rows:
            yield packed()

    out = dealt.mapInPandas(run, SCHEMA)
    return out.withColumn("doc", F.col("doc").cast(docs.schema[id_col].dataType))
