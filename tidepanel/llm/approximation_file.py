"""Exact top-k search by inner product over vector-approximation files.

Rows are dealt by a hash of their id to pages of about ``PAGE`` vectors. A page keeps for each vector the numbers of the
cells that its components fall in (``1 << BITS`` cells of equal width per component, between the smallest and largest of
the page) and, apart from them, the exact whole numbers. A task holds a block of searches and takes pages one by one:

1. From the cells alone it bounds every score from above and below. A vector whose upper bound is below the k-th best
   exact score so far, or below the k-th largest lower bound of the page, is out.
2. The others' exact vectors are read in the order of their upper bounds, in growing steps; a search is done with the page
   when the next upper bound is below its k-th best exact score. Equal ones are read, as ties go to the smaller id.

So a task's memory is a block of searches and a page, and it returns k rows a search however many vectors tie. Searches and pages
meet in a grid of blocks and page groups, both packed in rows, each pair of which is one group of a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .whole_vectors import Best, frozen, narrowest, thawed, unpacked, whole_vectors

BITS = 6
PAGE, PAGES = 512, 512  # vectors of a page, pages of a group
SEARCHES, LEAST_SEARCHES = 8192, 256  # of a block
AT_ONCE = 1024  # searches whose bounds are held at once


def page_of(ids: np.ndarray, whole: np.ndarray, bits: int = BITS) -> bytes:
    """A page: cells, their marks, the exact numbers and the ids."""
    low = whole.min(axis=0, initial=np.inf)
    width = np.ceil((whole.max(axis=0, initial=-np.inf) - low + 1) / (1 << bits))
    return frozen(ids=ids, low=low, width=width, cells=((whole - low) // width).astype(np.uint8), exact=narrowest(whole))


def search_page(page: dict[str, np.ndarray], own: np.ndarray, query: np.ndarray, best: Best, first: int = 0) -> int:
    """Offers ``best`` what the page has for the searches ``first``, ``first`` + 1, ...; the number of exact vectors read.

    ``own`` is the id that a search leaves out.
    """
    ids, width, exact = page["ids"], page["width"], page["exact"]
    k, read = best.score.shape[1], 0
    base = query @ page["low"][:, None] + (query * width) @ page["cells"].T.astype(np.float64)
    slack = width - 1
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    mine = np.flatnonzero(ids[at] == own)
    base[mine, at[mine]] = -np.inf
    upper = base + (np.maximum(query, 0) @ slack)[:, None]
    floor = best.worst()[first:first + len(query)].copy()
    if len(ids) >= k:
        lower = np.partition(base, len(ids) - k, axis=1)[:, len(ids) - k] + np.minimum(query, 0) @ slack
        floor = np.maximum(floor, lower)
    search, row = np.nonzero((upper >= floor[:, None]) & np.isfinite(upper))
    bound = upper[search, row]
    order = np.lexsort((row, -bound, search))
    search, row, bound = search[order], row[order], bound[order]
    stop = np.searchsorted(search, np.arange(len(query)), side="right")
    place = np.searchsorted(search, np.arange(len(query)))
    step = max(4, k)
    while True:  # the next few of every search that isn't certain yet
        more = np.flatnonzero(place < stop)
        more = more[bound[place[more]] >= best.worst()[first + more]]
        if not len(more):
            return read
        take = np.minimum(stop[more] - place[more], step)
        which = np.repeat(place[more] - np.append(0, np.cumsum(take)[:-1]), take) + np.arange(take.sum())
        for part in np.array_split(which, -(-len(which) // 8192)):
            score = np.einsum("ij,ij->i", query[search[part]], exact[row[part]].astype(np.float64))
            best.offer(first + search[part], score, ids[row[part]])
        read += len(which)
        place[more] += take
        step *= 2


def _pages(rows: DataFrame, pages: int, bits: int) -> DataFrame:
    """(dims, page, data) of rows (vec, dims, v)."""
    dealt = rows.withColumn("page", F.pmod(F.xxhash64("vec"), F.lit(pages)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dims, page = (x.as_py() for x in key)
        rows = rows.sort_by("vec")
        data = page_of(rows.column("vec").to_numpy(), unpacked(rows.column("v"), dims), bits)
        return pa.table({"dims": [dims], "page": [page], "data": [data]})

    return dealt.groupBy("dims", "page").applyInArrow(run, "dims long, page long, data binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``queries`` selects by ``vec``, its id, the ``k`` other rows of the highest score.

    A component x counts as floor(256 x); a score is the inner product, exact below 2 ** 53; ties go to the smaller id.
    Vectors that are null or hold null or non-finite components, and rows without an id, take no part; rows that share an
    id count once (see ``whole_vectors``); only vectors of one length are compared. Fewer than ``k`` others: all of them.
    Other columns aren't looked at; an empty table gives an empty table.
    """
    rows = whole_vectors(vectors, id_col, vector_col)
    n, searches = rows.agg(F.count("*"), F.coalesce(F.sum(queries.cast("long")), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    pages = max(1, -(-n // PAGE))
    groups = -(-pages // PAGES)
    blocks = max(1, -(-searches // SEARCHES), min(-(-searches // LEAST_SEARCHES), cores))
    stored = durable(_pages(rows, pages, bits)).withColumn("group", F.pmod("page", F.lit(groups))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where(queries).withColumn("block", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(blocks)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    key = ["dims", "block", "group"]

    def run(key: tuple, asked: pa.Table, pages: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        asked = asked.sort_by("vec")
        own, query = asked.column("vec").to_numpy(), unpacked(asked.column("v"), dims)
        best = Best(len(own), k)
        for data in pages.sort_by("page").column("data") if len(own) else ():
            page = thawed(data.as_py())
            for first in range(0, len(own), AT_ONCE):
                search_page(page, own[first:first + AT_ONCE], query[first:first + AT_ONCE], best, first)
        search, score, found = best.found()
        return pa.table({"query_id": own[search], "vec_id": found, "score": score})

    met = asked.select(*key, "vec", "v").groupBy(*key).cogroup(stored.select(*key, "page", "data").groupBy(*key)).applyInArrow(
        run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
