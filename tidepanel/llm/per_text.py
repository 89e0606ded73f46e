"""One row of results per text, computed in Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"long": (pa.int64(), T.LongType()), "double": (pa.float64(), T.DoubleType()), "string": (pa.string(), T.StringType()),
         "longs": (pa.list_(pa.int64()), T.ArrayType(T.LongType())),
         "doubles": (pa.list_(pa.float64()), T.ArrayType(T.DoubleType())),
         "ints": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))}


SLICE_BYTES = 4 << 20


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, stop) of the runs of texts that are worked on at once: about ``SLICE_BYTES``, at least one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield first, stop
        first = stop


def text_value(text: Column, kind: str, start: Callable[[], Callable[[list], Sequence]]) -> Column:
    """One value per text, next to the row's other columns, which stay where they are: only the text is sent to Python.

    ``start`` is called once per task and returns the function from a list of texts (None where null) to as many values.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compute = start()
        for texts in batches:
            made = [pa.array(compute(texts.slice(a, b - a).to_pylist()), KINDS[kind][0]) for a, b in slices(texts)]
            yield pa.concat_arrays(made) if made else pa.array([], KINDS[kind][0])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, KINDS[kind][1])(text.cast("string"))


def per_text(docs: DataFrame, text_col: str, carried: Sequence[str], results: dict[str, str],
             start: Callable[[], Callable[[list], Sequence[Sequence]]]) -> DataFrame:
    """The ``carried`` columns of ``docs``, untouched, and ``results`` (name -> kind) of each row's text.

    ``start`` is called once per task and returns the function that takes a batch's texts (None where null) and
    gives one sequence per result. Only these columns of ``docs`` are read.
    """
    kept = [f"c{i}" for i in range(len(carried))]
    text = F.col(text_col)
    once = text_col in carried and docs.schema[text_col].dataType == T.StringType()  # then it is sent once
    narrow = docs.select(*[F.col(c).alias(k) for c, k in zip(carried, kept)], *([] if once else [text.cast("string").alias("text")]))
    sent = kept[list(carried).index(text_col)] if once else "text"
    schema = T.StructType([narrow.schema[k] for k in kept] + [
        T.StructField(f"r{i}", KINDS[kind][1]) for i, kind in enumerate(results.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for first, stop in slices(batch.column(sent)):
                part = batch.slice(first, stop - first)
                made = compute(part.column(sent).to_pylist())
                columns = [part.column(k) for k in kept] + [
                    pa.array(values, KINDS[kind][0]) for values, kind in zip(made, results.values())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema).toDF(*carried, *results)
