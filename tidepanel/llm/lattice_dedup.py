"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections, several tables, neighbouring cells.

1. Equal vectors form a class, represented by its smallest id; only classes are compared.
2. In each table a vector is projected to ``blocks`` times eight dimensions by Gaussian numbers and divided by
   ``width``. Each eight are decoded to the nearest points of E8, the integer points with an even sum and those
   shifted by a half. A vector goes to the ``probes`` cells nearest to it (combinations of the blocks' points, by distance); vectors that meet in a cell are candidates.
3. A cell first contributes its documents paired with the first one there and with the one before; cosines of these pairs are
   computed and pairs below the threshold fall. What stays connects components.
4. Cells in which several components meet are compared whole: all cosines of members of different components, in small
   cells as pairs, in others in blocks of bounded size. So every pair that shares a cell is compared here or in step 5.
5. Within a component all cosines are computed, in blocks of bounded size; each vector's links are counted there, so
   ``n_links`` is exact within components.

With the default parameters two random vectors meet in a table with a probability of about 5e-6, two of cosine 0.9 with 0.17 and two of cosine
0.95 with 0.55, which makes 95 % and more than 99.99 % over 16 tables. Beyond some millions of vectors take three
blocks and more probes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .blocks import distinct
from .components import components
from .lists import list_entries, stars

THRESHOLD = 0.9
TABLES, BLOCKS, PROBES, WIDTH = 16, 2, 8, 1.3
PART = 2048
FEW = 32  # cells of at most so many documents are compared by a join of pairs


def valid_rows(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of vectors that can be compared, and the vectors: neither null, empty nor zero, all numbers finite."""
    at, vectors = [], []
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy().astype(np.float64)
            if np.isfinite(x).all() and x.any() and np.isfinite(x @ x) and x @ x > 0:
                at.append(i)
                vectors.append(x)
    return np.array(at, np.int64), vectors


def nearest(y: np.ndarray, count: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each row of eight numbers its nearest points of E8, doubled to be integers, and their squared distances.

    In either coset the nearest integers are right if their sum is even; else the coordinate that is cheapest to
    move goes to its second nearest integer. Moving others instead gives the next nearest points.
    """
    rows, points, distances = np.arange(len(y)), [], []
    for shift in (0.0, 0.5):
        whole = np.rint(y - shift)
        off = y - shift - whole
        step, price = np.where(off >= 0, 1.0, -1.0), 1 - 2 * np.abs(off)
        order = np.argsort(price, axis=1, kind="stable")[:, :4]
        cheap = np.take_along_axis(price, order, 1)
        odd = whole.sum(axis=1) % 2 != 0
        for k in range(3):
            point = whole.copy()
            first = order[:, k if k == 0 else 0]
            moved = np.where(odd, order[:, k], first)
            change = odd | (k > 0)
            point[rows[change], moved[change]] += step[rows[change], moved[change]]
            paid = np.where(odd, cheap[:, k], 0.0)
            if k:  # an even sum stays even when two coordinates move
                even = ~odd
                point[rows[even], order[even, k]] += step[rows[even], order[even, k]]
                paid = np.where(odd, paid, cheap[:, 0] + cheap[:, k])
            points.append(np.rint(2 * (point + shift)).astype(np.int64))
            distances.append((off ** 2).sum(axis=1) + paid)
    distance = np.stack(distances, 1)
    best = np.argsort(distance, axis=1, kind="stable")[:, :count]
    return np.take_along_axis(np.stack(points, 1), best[:, :, None], 1), np.take_along_axis(distance, best, 1)


def _hashed(points: np.ndarray, seed: int) -> np.ndarray:
    factors = np.random.default_rng(seed).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (points.astype(np.int64).view(np.uint64) * factors).sum(axis=-1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH
          ) -> np.ndarray:
    """Cell numbers of unit vectors: one row each, ``tables * probes`` columns."""
    out = []
    for table in range(tables):
        near = np.zeros((len(unit), 1))
        key = np.full((len(unit), 1), table * 2654435761 + unit.shape[1], np.uint64)
        for block in range(blocks):
            rng = np.random.default_rng((unit.shape[1], table, block))
            points, distance = nearest(unit @ rng.normal(size=(unit.shape[1], 8)) / width)
            h = _hashed(points, table * 64 + block)
            near = (near[:, :, None] + distance[:, None, :]).reshape(len(unit), -1)
            key = (key[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + h[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(near, axis=1, kind="stable")[:, :max(probes, 4)]
            near, key = np.take_along_axis(near, best, 1), np.take_along_axis(key, best, 1)
        out.append(key[:, :probes])
    return np.concatenate(out, axis=1).view(np.int64)


def _digests(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, ok, d1, d2): a digest of the numbers of each valid vector."""
    named = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = valid_rows(batch.column("vector"))
            halves = np.zeros((batch.num_rows, 2), np.int64)
            for i, x in zip(at, found):
                halves[i] = np.frombuffer(hashlib.md5((x + 0.0).tobytes()).digest(), np.int64)  # + 0.0: no negative zeros
            ok = np.zeros(batch.num_rows, bool)
            ok[at] = True
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.array(ok), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                                             ["vec", "ok", "d1", "d2"])

    kind = named.schema["vec"].dataType.simpleString()
    return named.mapInArrow(run, f"vec {kind}, ok boolean, d1 long, d2 long")


def _meetings(classes: DataFrame) -> DataFrame:
    """(a, b): classes that share a cell, each with the first and with the one before it there."""
    kind = classes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = valid_rows(batch.column("vector"))
            for size in sorted({len(x) for x in found}):
                same = [i for i, x in enumerate(found) if len(x) == size]
                for part in np.array_split(same, -(-len(same) // 1024)):
                    x = np.array([found[i] for i in part])
                    key = cells(x / np.linalg.norm(x, axis=1)[:, None])
                    row = np.repeat(np.arange(len(part)), key.shape[1])
                    yield list_entries(key.ravel(), row, batch.column("vec").take(pa.array(at[part])), chain=True)

    return stars(classes.select("vec", "vector").mapInArrow(run, f"key long, doc {kind}, near {kind}"), chain=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine reaches the threshold."""
    left = classes.select(F.col("vec").alias("a"), F.col("vector").alias("va"))
    right = classes.select(F.col("vec").alias("b"), F.col("vector").alias("vb"))
    kind = classes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = (_lengths_and_values(batch.column(c)) for c in ("va", "vb"))
            keep = np.zeros(batch.num_rows, bool)
            for size in distinct(va[0]):
                at = np.flatnonzero((va[0] == size) & (vb[0] == size))
                span = np.arange(size)
                keep[at] = _cosines(va[2][va[1][at][:, None] + span], vb[2][vb[1][at][:, None] + span]) >= threshold
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _lengths_and_values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), offsets[:-1], column.values.to_numpy()


def _in_blocks(members: DataFrame, group: str, more: str, report: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``report(vec, vector, more, rows, columns, same)`` for every two blocks of a group and every vector length in them.

    ``rows`` and ``columns`` are the places of the vectors to compare; ``same`` says that they are one block.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / PART).alias("parts"))
    placed = members.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")))
    visit = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.least("part", j).alias("left"), F.greatest("part", j).alias("right"))))
    dealt = placed.withColumn("visit", visit).select(
        "vec", "vector", F.col(more).alias("more"), F.col(group).alias("group"), "part", "visit.left", "visit.right")
    dealt = dealt.withColumn("key", F.xxhash64("group", "left", "right")).repartition("key").sortWithinPartitions(
        "key", "group", "left", "right", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []

        def reports(vec_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            vec, vector, more, part = zip(*block)
            (_, left, right), part = now, np.array(part)
            size = np.array([len(v) for v in vector])
            for dims in distinct(size):
                yield report(pa.array(vec, vec_kind), vector, np.array(more), np.flatnonzero((size == dims) & (part == left)),
                             np.flatnonzero((size == dims) & (part == right)), left == right)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "left", "right", "vec", "more", "part")]
            vectors = batch.column("vector")
            for i, (group, left, right, vec, more, part) in enumerate(zip(*columns)):
                if (group, left, right) != now and block:
                    yield from reports(batch.column("vec").type)
                    block = []
                now = (group, left, right)
                block.append((vec, vectors[i].values.to_numpy(), more, part))
        if block:
            yield from reports(batch.column("vec").type)

    return dealt.select("group", "left", "right", "vec", "vector", "more", "part").mapInArrow(run, schema)


def _linked(vector: tuple, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    x, y = (np.array([vector[i] for i in at]).reshape(len(at), -1 if len(at) else 0) for at in (rows, columns))
    if not len(rows) or not len(columns):
        return np.zeros((len(rows), len(columns)), bool)
    return (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]) >= threshold


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of true entries that connect what all true entries connect: a forest."""
    seen_rows, seen_columns = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool)
    found_rows, found_columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in np.flatnonzero(linked.any(axis=1)):
        front = np.array([row] if not seen_rows[row] else [], np.int64)
        seen_rows[front] = True
        while len(front):
            open_ = linked[front] & ~seen_columns
            columns = np.flatnonzero(open_.any(axis=0))
            found_rows.append(front[open_[:, columns].argmax(axis=0)] if len(columns) else columns)
            found_columns.append(columns)
            seen_columns[columns] = True
            back = linked[:, columns] & ~seen_rows[:, None]
            front = np.flatnonzero(back.any(axis=1))
            found_rows.append(front)
            found_columns.append(columns[back[front].argmax(axis=1)] if len(front) else front)
            seen_rows[front] = True
    return np.concatenate(found_rows), np.concatenate(found_columns)


def _crossing(classes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between classes of different components that share a cell; enough of them to connect what all would."""
    kind = classes.schema["vec"].dataType.simpleString()
    placed = classes.join(nodes, F.col("vec") == F.col("node"), "left").select(
        "vec", "vector", F.coalesce("component", "vec").alias("component"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = valid_rows(batch.column("vector"))
            for size in sorted({len(x) for x in found}):
                same = [i for i, x in enumerate(found) if len(x) == size]
                for part in np.array_split(same, -(-len(same) // 1024)):
                    x = np.array([found[i] for i in part])
                    key = cells(x / np.linalg.norm(x, axis=1)[:, None])
                    row = pa.array(np.repeat(at[part], key.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column("vec").take(row),
                                                      batch.column("component").take(row)], ["key", "vec", "component"])

    entries = placed.mapInArrow(run, f"key long, vec {kind}, component {kind}")
    # Two that are alone in a cell have been compared; one component's members are compared when its links are counted.
    mixed = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(
        (F.col("low") != F.col("high")) & (F.col("n") > 2)).select("key", "n")
    shared = durable(entries.join(mixed, "key"))
    few = shared.where(F.col("n") <= FEW)
    left = few.select("key", F.col("vec").alias("a"), F.col("component").alias("ca"))
    right = few.select("key", F.col("vec").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()

    def links(vec: pa.Array, vector: tuple, component: np.ndarray, rows: np.ndarray, columns: np.ndarray, same: bool) -> pa.RecordBatch:
        linked = _linked(vector, rows, columns, threshold) & (component[rows][:, None] != component[columns][None, :])
        i, j = spanning(linked)
        return pa.RecordBatch.from_arrays([vec.take(pa.array(rows[i])), vec.take(pa.array(columns[j]))], ["a", "b"])

    many = shared.where(F.col("n") > FEW).join(classes.select("vec", "vector"), "vec")
    return _verified(pairs, classes, threshold).unionByName(
        _in_blocks(many.select("vec", "vector", "key", "component"), "key", "component", links, f"a {kind}, b {kind}"))


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(vec, links): for each class of a component the weight of the classes it is linked with."""
    kind = members.schema["vec"].dataType.simpleString()

    def report(vec: pa.Array, vector: tuple, weight: np.ndarray, rows: np.ndarray, columns: np.ndarray, same: bool) -> pa.RecordBatch:
        links = np.zeros(len(vec), np.int64)
        linked = _linked(vector, rows, columns, threshold)
        if same:
            np.fill_diagonal(linked, False)
        links[rows] += linked @ weight[columns]
        if not same:
            links[columns] += weight[rows] @ linked
        seen = pa.array(np.append(rows, [] if same else columns).astype(np.int64))
        return pa.RecordBatch.from_arrays([vec.take(seen), pa.array(links).take(seen)], ["vec", "links"])

    found = _in_blocks(members, "component", "weight", report, f"vec {kind}, links long")
    return found.groupBy("vec").agg(F.sum("links").alias("links"))


def _with_least(groups: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component as well."""
    return groups.unionByName(groups.select(F.col("component").alias("node"), "component")).distinct()


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite numbers are linked with nothing, and so are vectors of different
    lengths. ``component_id`` is the smallest id reachable by links; ``kept`` marks the row with that id. Rows without an id count as
    copies of the vectors equal to them; alone they have no component and are kept. Of rows that share an id all or
    none are kept. Other columns aren't looked at; an empty table gives an empty table.
    """
    digests = durable(_digests(vectors, id_col, vector_col))
    classes = durable(digests.where("ok").groupBy("d1", "d2").agg(F.min("vec").alias("rep"), F.count("*").alias("weight")))
    known = classes.where(F.col("rep").isNotNull())
    named = vectors.select(F.col(id_col).alias("vec"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = digests.where("ok").join(known, ["d1", "d2"]).where(F.col("vec") == F.col("rep")).groupBy("vec").agg(
        F.max("weight").alias("weight"))
    reps = durable(named.join(own, "vec").dropDuplicates(["vec"]))
    linked = durable(_verified(_meetings(reps), reps, threshold))
    groups = components(linked, "a", "b")
    crossing = durable(_crossing(reps, _with_least(groups), threshold))
    if not crossing.isEmpty():
        groups = components(groups.toDF("a", "b").unionByName(crossing), "a", "b")
    nodes = durable(_with_least(groups))
    members = reps.join(nodes, F.col("vec") == F.col("node")).select("vec", "vector", "weight", "component")
    counts = _counted(members, threshold)
    per_class = known.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").join(
        counts.withColumnRenamed("vec", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    keyed = digests.select("vec", F.when(F.col("ok"), F.col("d1")).alias("d1"), F.when(F.col("ok"), F.col("d2")).alias("d2"))
    component = F.coalesce("component", "vec")
    return keyed.join(per_class, ["d1", "d2"], "left").select(
        F.col("vec").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec") == component, F.col("vec").isNull() & component.isNull()).alias("kept"))
