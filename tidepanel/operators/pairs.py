"""All-pairs work without rows for all pairs.

Correlations, similarities and pairwise losses look at every pair of a group.  Rows are dealt to a few blocks; each
pair of blocks is one Spark group (a cell), in which matrix products of at most ``block_rows`` rows a side are
evaluated one after the other and only what qualifies is emitted.  A row is sent to as many cells as its group has
blocks: ``GRID`` of them however many rows there are, and more only where a block would exceed ``CELL_VALUES``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

BLOCK_ROWS = 1024
GRID = 24  # 300 cells of equal work
CELL_VALUES = 1 << 21  # numbers in one block of a cell


def _blocks(n: Column, values: Column, block_rows: int) -> Column:
    """How many blocks ``n`` rows with that many numbers are dealt to."""
    return F.greatest(F.least(F.ceil(n / block_rows), F.lit(GRID)), F.ceil(values / CELL_VALUES), F.lit(1)).cast("int")


def _cells(df: DataFrame, keys: Sequence[str], row_id: str, size: Column, block_rows: int):
    """Each row once per cell (_i <= _j) it takes part in, grouped by cell; ``_left`` tells the side.

    Without keys the cells are numbered and each number is a partition, so that no two of them wait for one task.
    """
    keys = list(keys)
    count = _blocks(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), block_rows).alias("_nb")
    if keys:
        tagged = df.join(df.groupBy(*keys).agg(count), keys)
    else:
        df = durable(df)
        blocks = df.agg(count).first()[0]
        tagged = df.withColumn("_nb", F.lit(blocks))
    tagged = tagged.withColumn("_b", F.pmod(F.xxhash64(row_id), F.col("_nb")).cast("int"))
    others = tagged.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    i, j = F.least("_b", "_o"), F.greatest("_b", "_o")
    cells = others.select(*df.columns, i.alias("_i"), j.alias("_j"), (F.col("_b") <= F.col("_o")).alias("_left"))
    if keys:
        return cells.groupBy(*keys, "_i", "_j")
    cells = cells.withColumn("_cell", (F.col("_j") * (F.col("_j") + 1) / 2 + F.col("_i")).cast("int"))
    return cells.repartitionById(blocks * (blocks + 1) // 2, "_cell").groupBy("_cell", "_i", "_j")


def rectangular_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: str, size: Column,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of both sides (same columns) once per cell (_i, _j); ``size`` is how many numbers a row has.

    Each side has as few blocks as its rows need, and the larger one is cut further until there are ``GRID`` cells.
    """
    on = list(keys)
    least = F.ceil(F.sum(size) / CELL_VALUES)
    na = left.groupBy(*on).agg(least.alias("_na"))
    nb = right.groupBy(*on).agg(least.alias("_nb"), F.ceil(F.count(F.lit(1)) / block_rows).alias("_fine"))
    # one row per group, so it is sent to the rows
    blocks = na.join(nb, on).select(*on, F.col("_na").cast("int").alias("_na"), F.greatest(
        "_nb", F.least("_fine", F.ceil(F.lit(GRID) / F.col("_na")))).cast("int").alias("_nb"))
    blocks = F.broadcast(blocks)
    own = F.xxhash64(row_id)
    a = left.join(blocks, on).select(*left.columns, F.pmod(own, F.col("_na")).cast("int").alias("_i"),
                                     F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_j"), F.lit(True).alias("_left"))
    b = right.join(blocks, on).select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("_i"),
                                      F.pmod(own, F.col("_nb")).cast("int").alias("_j"), F.lit(False).alias("_left"))
    return a.unionByName(b)


class Scores:
    """Scores of the rows of two sides, a sub-block of each at a time."""

    def sides(self, *vectors: pa.Array) -> list:
        """What is kept of each side's vectors."""
        raise NotImplementedError

    def order(self, side) -> tuple[np.ndarray, np.ndarray]:
        """An order of the side's rows, and where in it runs of alike rows begin."""
        raise NotImplementedError

    def part(self, side, rows: np.ndarray):
        """What :meth:`matrix` needs of some rows."""
        raise NotImplementedError

    def matrix(self, a, b) -> np.ndarray:
        raise NotImplementedError


def _cuts(order: np.ndarray, starts: np.ndarray, most: int) -> list[np.ndarray]:
    """``order`` in pieces of at most ``most`` rows; a long run of alike rows has pieces of its own."""
    least = max(1, most // 8)
    bounds = np.append(starts, len(order))
    long = np.diff(bounds) >= least
    edges = {0, len(order), *bounds[:-1][long].tolist(), *bounds[1:][long].tolist()}
    edges = sorted(edges)
    return [order[s:min(s + most, to)] for at, to in zip(edges, edges[1:]) for s in range(at, to, most)]


def _pieces(rows: pa.Table, same: bool, score: Scores, vector: str, itself: bool, digits: int, most: int
            ) -> tuple[pa.Table, pa.Table, Iterator]:
    """The two sides of a cell, and (rows of the first, rows of the second, scores in units of the last digit).

    Each pair comes once. What isn't to be looked at is -inf.
    """
    left = rows.column("_left")
    a, b = (rows, rows) if same else (rows.filter(left), rows.filter(pc.invert(left)))

    def each():
        if not len(a) or not len(b):
            return
        found = score.sides(*(x.column(vector).combine_chunks() for x in ((a,) if same else (a, b))))
        cut = [_cuts(*score.order(side), most) for side in found]
        parts = [[score.part(side, at) for at in pieces] for side, pieces in zip(found, cut)]
        for i, (at, part) in enumerate(zip(cut[0], parts[0])):
            for j, (to, other) in enumerate(zip(cut[-1], parts[-1])):
                if same and j < i:
                    continue
                table = score.matrix(part, other)
                np.rint(np.multiply(table, 10.0 ** digits, out=table), out=table)
                if same and i == j:
                    table[np.tril_indices(len(at), -1 if itself else 0)] = -np.inf
                yield at, to, table
    return a, b, each()


def _least(threshold: float, unit: float) -> float:
    """The smallest whole number of units that reaches the threshold."""
    least = np.floor(threshold * unit) - 1.0
    while least / unit < threshold:
        least += 1.0
    return least


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` by way of one dimension, which is several times faster."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class _Best:
    """The ``k`` best partners of each row so far, equal scores by the smaller id."""

    def __init__(self, n: int, k: int, others: pa.Array):
        self.rank = np.empty(len(others), np.int64)
        self.rank[pc.sort_indices(others).to_numpy()] = np.arange(len(others))
        self.score = np.full((n, k), -np.inf)
        self.other = np.full((n, k), -1, np.int64)
        self.k = k

    def add(self, rows: np.ndarray, others: np.ndarray, table: np.ndarray, reached: tuple[float, np.ndarray, np.ndarray] | None = None) -> None:
        """``table`` has a line per row and a column per other; ``reached`` tells a score and where the table has at least that."""
        k = self.k
        last, holder = self.score[rows, -1], self.other[rows, -1]
        if table.shape[1] > 8 * k and np.isneginf(last).any():
            # at least k reach the k-th largest of these
            last = np.maximum(last, np.partition(table, table.shape[1] - k, axis=1)[:, -k])
        if reached is not None and last.min() >= reached[0]:
            # no row lacks k partners with that score, so a better one is among those found already
            line, column = reached[1:]
            better = table[line, column] >= last[line]
            line, column = line[better], column[better]
        else:
            line, column = _where(table >= last[:, None])
        value = table[line, column]
        before = np.where(holder >= 0, self.rank[holder], len(self.rank))[line]
        better = (value > self.score[rows[line], -1]) | (np.isfinite(value) & (self.rank[others[column]] < before))
        line, column, value = line[better], column[better], value[better]
        if not len(line):
            return
        touched, line = np.unique(line, return_inverse=True)
        own = self.other[rows[touched]]
        line = np.concatenate([line, np.repeat(np.arange(len(touched)), k)])
        value = np.concatenate([value, self.score[rows[touched]].ravel()])
        other = np.concatenate([others[column], own.ravel()])
        order = np.lexsort((np.where(other >= 0, self.rank[other], len(self.rank)), -value, line))
        line, value, other = line[order], value[order], other[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        top = place < k
        self.score[rows[touched[line[top]]], place[top]] = value[top]
        self.other[rows[touched[line[top]]], place[top]] = other[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.score))
        return row, self.other[row, place], self.score[row, place]


def similar_pairs(df: DataFrame, keys: Sequence[str], row_id: str, score: Scores, vector: str, size: Column, k: int,
                  threshold: float | None = None, itself: bool = False, block_rows: int = BLOCK_ROWS,
                  digits: int = 9) -> DataFrame:
    """(keys, src, dst, score, qualified, candidate): pairs at or above ``threshold``, and candidates for the best.

    Rows without ``candidate`` are the pairs that reach the threshold, each once and in one direction. Candidates are the
    ``k`` best partners of a source in one cell; the best of the whole group are among them. ``size`` is how many numbers
    a row's vector has.  Scores are rounded to ``digits`` so that ties are the same wherever they are computed; ties go to
    the smaller id.  Where the threshold admits most pairs, :func:`pair_degrees` gives their number without listing them.
    """
    keys = list(keys)
    cells = _cells(df.select(*keys, row_id, vector), keys, row_id, size, block_rows)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    unit = 10.0 ** digits
    most = min(block_rows, 512)

    def one_cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        same = key[-2].as_py() == key[-1].as_py()
        a, b, pieces = _pieces(rows, same, score, vector, itself, digits, most)
        ia, ib = a.column(row_id).combine_chunks(), b.column(row_id).combine_chunks()

        def made(src, dst, scores, candidate):
            scores = scores / unit
            qualified = scores >= (np.inf if threshold is None else threshold)
            return pa.record_batch([*[pa.repeat(x, len(src)) for x in key[:len(keys)]], src, dst, pa.array(scores), pa.array(qualified),
                                    pa.repeat(pa.scalar(candidate), len(src))], names=[*keys, "src", "dst", "score", "qualified", "candidate"])

        least = np.inf if threshold is None else _least(threshold, unit)
        by_row = _Best(len(a), k, ib) if k > 0 else None
        by_column = by_row if same else (_Best(len(b), k, ia) if k > 0 else None)
        for at, to, table in pieces:
            reached = None
            if threshold is not None:
                line, column = _where(table >= least)
                reached = least, line, column
                if len(line):
                    yield made(ia.take(pa.array(at[line])), ib.take(pa.array(to[column])), table[line, column], False)
            if k > 0:
                by_row.add(at, to, table, reached)
                if itself and at is to:
                    table = table.copy()
                    np.fill_diagonal(table, -np.inf)  # a row is its own partner once
                    reached = None
                by_column.add(to, at, table.T, reached and (least, column, line))
        if k > 0:
            for best, ids, others, turned in ((by_row, ia, ib, False),) if same else ((by_row, ia, ib, False), (by_column, ib, ia, True)):
                row, other, scores = best.found()
                for s in range(0, len(row), 1 << 16):
                    yield made(ids.take(pa.array(row[s:s + (1 << 16)])), others.take(pa.array(other[s:s + (1 << 16)])), scores[s:s + (1 << 16)], True)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"src {kinds[row_id]}", f"dst {kinds[row_id]}",
                        "score double", "qualified boolean", "candidate boolean"])
    return cells.applyInArrow(one_cell, schema)


def pair_degrees(df: DataFrame, keys: Sequence[str], row_id: str, score: Scores, vector: str, size: Column, threshold: float,
                 block_rows: int = BLOCK_ROWS, digits: int = 9) -> DataFrame:
    """(keys, id, degree, total): how many others each row has a score of at least ``threshold`` with, and their sum.

    A cell returns one row per row it holds, however many pairs qualify.
    """
    keys = list(keys)
    cells = _cells(df.select(*keys, row_id, vector), keys, row_id, size, block_rows)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    unit = 10.0 ** digits
    least = _least(threshold, unit)
    most = min(max(block_rows, 256), 512)

    def one_cell(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        same = key[-2].as_py() == key[-1].as_py()
        a, b, pieces = _pieces(rows, same, score, vector, False, digits, most)
        sums = [(np.zeros(len(x), np.int64), np.zeros(len(x))) for x in ((a,) if same else (a, b))]
        for at, to, table in pieces:
            hit = (table >= least).astype(np.float32)
            table[table < least] = 0.0
            for (n, total), where, axis in ((sums[0], at, 1), (sums[-1], to, 0)):
                ones = np.ones(table.shape[axis])
                n[where] += np.rint(hit @ ones.astype(np.float32) if axis else ones.astype(np.float32) @ hit).astype(np.int64)
                total[where] += table @ ones if axis else ones @ table  # whole numbers: exact in any order
        for side, (n, total) in zip((a, b), sums):
            yield pa.record_batch([*[pa.repeat(x, len(side)) for x in key[:len(keys)]], side.column(row_id).combine_chunks(),
                                   pa.array(n), pa.array(total / unit)], names=[*keys, "id", "degree", "total"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"id {kinds[row_id]}", "degree bigint", "total double"])
    found = cells.applyInArrow(one_cell, schema)
    return found.groupBy(*keys, "id").agg(F.sum("degree").alias("degree"), F.sum("total").alias("total"))
