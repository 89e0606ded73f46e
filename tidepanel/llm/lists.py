"""Inverted lists as stars: who meets in a list is connected to the first there, without any group being gathered.

Entries are rows (key, doc, near). A row with a key puts a document on that key's list. A row without one says that
two documents have met already: a task puts only the first of its batch on a list and links the others to it, so
a list that a third of all rows are on has one entry per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import distinct


def list_entries(key: np.ndarray, row: np.ndarray, doc: pa.Array, chain: bool = False) -> pa.RecordBatch:
    """Entries of a batch: document ``doc[row[i]]`` belongs on list ``key[i]``.

    With ``chain`` the others of a list are linked to the one before them as well as to the first.
    """
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    leads = np.append(True, key[1:] != key[:-1])[:len(key)]
    lead = row[leads][np.cumsum(leads) - 1]
    apart = ~leads & (row != lead)
    pairs = row[apart] * (len(doc) + 1) + lead[apart]
    if chain:
        before = np.append(row[:1], row[:-1])
        apart = ~leads & (row != before)
        pairs = np.append(pairs, row[apart] * (len(doc) + 1) + before[apart])
    pairs = distinct(pairs)
    member, near = pairs // (len(doc) + 1), pairs % (len(doc) + 1)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(key[leads]), pa.nulls(len(pairs), pa.int64())]),
        doc.take(pa.array(np.concatenate((row[leads], member)))),
        pa.concat_arrays([pa.nulls(int(leads.sum()), doc.type), doc.take(pa.array(near))])], ["key", "doc", "near"])


def stars(entries: DataFrame, chain: bool = False) -> DataFrame:
    """(a, b): each document of a list with the first one there, and those that have met already; every pair once.

    With ``chain`` also each with the one before it on the list.

    One shuffle by key; a task walks over its lists in order and holds a batch.
    """
    kind = entries.schema["doc"].dataType.simpleString()
    dealt = entries.withColumn("by", F.coalesce("key", F.xxhash64("doc"))).repartition("by").sortWithinPartitions("by", "doc")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None  # the list that runs on from the batch before, and its first document
        for batch in batches:
            doc, near, keys = batch.column("doc"), batch.column("near"), batch.column("key")
            direct = near.is_valid()
            yield pa.RecordBatch.from_arrays([doc.filter(direct), near.filter(direct)], ["a", "b"])
            listed, doc = keys.drop_null().to_numpy(), doc.filter(keys.is_valid())
            if not len(listed):
                continue
            leads = np.append(key is None or listed[0] != key, listed[1:] != listed[:-1])
            heads = np.append(-1, np.flatnonzero(leads))[np.cumsum(leads)]  # -1: the list of the batch before
            follow = np.flatnonzero(~leads)
            first = pa.concat_arrays([pa.array([lead], doc.type), doc])
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(follow)), first.take(pa.array(heads[follow] + 1))], ["a", "b"])
            if chain:
                follow = np.flatnonzero(~leads[1:])
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(follow + 1)), doc.take(pa.array(follow))], ["a", "b"])
            key, lead = listed[-1], first[int(heads[-1]) + 1].as_py()

    return dealt.select("key", "doc", "near").mapInArrow(walk, f"a {kind}, b {kind}").distinct()
