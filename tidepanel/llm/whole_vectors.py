"""Vectors as whole numbers, packed in tables of bounded rows, and the best scores of many searches side by side."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

FINE = 256  # a component x counts as floor(FINE * x)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(values: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The matrix of ``packed`` rows, as doubles."""
    rows = values.to_pylist()
    out = np.empty((len(rows), dims))
    for i, raw in enumerate(rows):
        out[i] = np.frombuffer(raw, np.int32 if len(raw) == 4 * dims else np.float64)
    return out


def narrowest(whole: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type of 2 or 4 bytes that holds them, else as doubles."""
    most = np.abs(whole).max(initial=0)
    return whole.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def frozen(**arrays: np.ndarray) -> bytes:
    """Named arrays as bytes."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def thawed(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as found:
        return {name: found[name] for name in found.files}


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """(vec long, label, dims, v), stored: one row per id, its vector in whole numbers, packed.

    Vectors that are null or hold a null or non-finite component are left out, and so are rows without an id or, where
    labels count, without a label. Of rows that share an id the one with the smallest length, label and packed numbers counts.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec"), (F.lit(0) if label is None else label).cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("x")).where(
        F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            flat, offsets = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
            size = np.diff(offsets)
            right = wrong[offsets[1:]] == wrong[offsets[:-1]]
            for dims in np.unique(size[right]):
                at = np.flatnonzero(right & (size == dims))
                whole = np.floor(FINE * flat[offsets[at][:, None] + np.arange(dims)])
                kind = np.int32 if np.abs(whole).max(initial=0) < 1 << 31 else np.float64
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                    pa.array(np.full(len(at), dims, np.int64)), packed(whole.astype(kind))], ["vec", "label", "dims", "v"])

    made = named.mapInArrow(run, "vec long, label long, dims long, v binary")
    first = F.row_number().over(Window.partitionBy("vec").orderBy("dims", "label", "v"))
    return durable(made.withColumn("first", first).where("first = 1").drop("first"))


class Best:
    """The ``k`` best (score, id) of each of ``n`` searches: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        """The score of each search's k-th best so far, minus infinity if it has fewer."""
        return self.score[:, -1]

    def offer(self, search: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        """Takes what is better than the worst of what a search has; nothing may be offered twice."""
        if not len(search):
            return
        k = self.score.shape[1]
        met = np.unique(search)
        search = np.concatenate((np.repeat(met, k), search))
        score = np.concatenate((self.score[met].ravel(), score))
        id = np.concatenate((self.id[met].ravel(), id))
        order = np.lexsort((id, -score, search))
        search, score, id = search[order], score[order], id[order]
        start = np.searchsorted(search, met)
        self.score[met], self.id[met] = (x[start[:, None] + np.arange(k)] for x in (score, id))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, score, id) of all that was found."""
        search, place = np.nonzero(np.isfinite(self.score))
        return search, self.score[search, place].astype(np.int64), self.id[search, place]
