"""Exact Jaccard self-join of documents on word shingles, by T-occurrence search.

A document's set are the 64-bit hashes of its distinct five-word shingles. Two documents are linked when their sets have a Jaccard similarity of
at least 0.8; then they share at least T = ceil(0.8 n) elements, n being the size of the larger set.

1. Documents with equal sets form a class; from there on a class counts once, represented by its smallest id.
2. In any order of all shingles that is the same for everyone, two linked sets have a common element among the first
   n - T + 1 of each. Each set looks up its first shingles by hash, half as many again, in the inverted lists; those
   that no other set has are put first in its order, so only the few others that still belong to the prefix matter.
   A set that has more than n - T shingles of its own is linked with none. Sets that meet in a list belong to one
   candidate group; a list contributes a star, not pairs, and a batch puts one entry of a shingle on its list.
   Many short passages can make one group of sets that are far apart. Groups larger than a chunk are formed anew:
   counting in how many of their sets each shingle is, rare ones come first in the order, and sets meet only in
   the n - T + 1 rarest of all their shingles, which a common passage belongs to only where nearly all is common.
3. Candidate groups, cut in chunks of bounded size ordered by set size, are searched chunk against chunk as far as
   sizes allow: a query's shorter lists are merged by counting, its T / (mu log M + 1) longest lists are
   probed by binary search for the documents that reached T minus their number, and those that reach the required
   overlap exactly stay. A block reports per class its number of links and its group in the block, never pairs.
4. Connected components of what the blocks report give the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .blocks import blocks, distinct
from .components import components
from .lists import list_entries, stars
from .per_text import per_text, slices
from .text import free_name

WORDS, PERCENT = 5, 80
BROADCAST_ROWS = 500_000
CHUNK = 2048  # a chunk's documents, one of more than 1,024 shingles counting as several
MU = 0.0085  # cost of a probe against a merge step

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_ONE = np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: Sequence) -> Iterator[np.ndarray]:
    """For each text its distinct shingles in rising order, as signed 64-bit numbers.

    A text of fewer than five words has one shingle of all its words; one without words has none.
    """
    for first, stop, raw, offsets in blocks(texts, before=b"", after=b"\n"):
        size = len(raw)
        up = np.cumprod(np.append(_ONE, np.full(size, _ODD)))
        down = np.cumprod(np.append(_ONE, np.full(size, _BACK)))
        sums = np.append(np.uint64(0), np.cumsum((_LOWER[raw] + _ONE) * down[:size]))
        inside = ~_BLANK[raw]
        edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        word = _mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
        bounds = np.searchsorted(start, offsets)  # words of each text
        n = len(word)
        combined = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            combined += _mix(word[k:k + len(combined)] * _PLACES[k] + np.uint64(k))
        combined = _mix(combined).view(np.int64)
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= WORDS:
                yield distinct(combined[a:b - WORDS + 1])
            elif b > a:
                few = _mix(word[a:b] * _PLACES[:b - a] + np.arange(b - a, dtype=np.uint64)).sum(dtype=np.uint64)
                yield _mix(np.array([few + np.uint64(b - a)])).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def required(n: int) -> int:
    """The overlap without which a set of this size is linked with none at least as large, nor with a smaller one."""
    return -(-PERCENT * n // 100)


def prefix_length(n: int) -> int:
    """So many elements of a set, first in a common order, hold one of every set it is linked with."""
    return n - required(n) + 1


def reach(n: int) -> int:
    """So many elements are looked up: half as many again as a prefix has."""
    return min(n, prefix_length(n) * 3 // 2)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set."""
    h = shingles.view(np.uint64)
    return (int(_mix(h ^ _PLACES[0]).sum(dtype=np.uint64).view(np.int64)), int(_mix(h ^ _PLACES[1]).sum(dtype=np.uint64).view(np.int64)))


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, d1, d2) of every row, stored: set size and digest."""
    def start():
        def compute(texts: list) -> tuple:
            sets = list(shingle_sets(texts))
            d = [_digest(s) for s in sets]
            return [len(s) for s in sets], [x[0] for x in d], [x[1] for x in d]
        return compute

    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return durable(per_text(named, "text", ["doc"], {"n": "long", "d1": "long", "d2": "long"}, start))


def _entries(docs: DataFrame, text_col: str) -> DataFrame:
    """(by, key, node, shared): the first ``reach`` shingles (key) of each set (node, its first digest).

    A shingle that several sets of a batch have goes to its list once, marked as shared; the other sets' entries are
    known to be shared and are dealt anywhere (``by`` differs from the key).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes, seen, texts = [], [], set(), batch.column("text")
            for s in (s for a, b in slices(texts) for s in shingle_sets(texts.slice(a, b - a).to_pylist())):
                digest = (len(s), *_digest(s))
                if len(s) and digest not in seen:  # of equal sets the first one stands for all
                    seen.add(digest)
                    keys.append(s[:reach(len(s))].copy())
                    nodes.append(np.full(len(keys[-1]), digest[1]))
            if not keys:
                continue
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(key, kind="stable")
            again = np.append(False, key[order][1:] == key[order][:-1])
            shared, follows = np.zeros(len(key), bool), np.zeros(len(key), bool)
            follows[order] = again
            shared[order] = again | np.append(again[1:], False)
            by = np.where(follows, _mix(key.view(np.uint64) ^ node.view(np.uint64)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (by, key, node, shared)], ["by", "key", "node", "shared"])

    text = docs.select(F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(run, "by long, key long, node long, shared boolean")


def _shared(entries: DataFrame) -> DataFrame:
    """(key, node): the entries whose shingle another set has among its first ones too."""
    dealt = entries.repartition("by").sortWithinPartitions("by", "key", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # the last list so far, which may go on

        def found(by: np.ndarray, key: np.ndarray, node: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
            listed = by == key
            same = np.append(False, (key[1:] == key[:-1]) & (node[1:] != node[:-1]) & listed[1:] & listed[:-1])
            out = shared | ~listed | same | np.append(same[1:], False)
            return pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("by", "key", "node", "shared")]
            by, key, node, shared = (np.concatenate(x) for x in zip(held, new))
            last = int(np.searchsorted(by, by[-1])) if len(by) else 0
            yield found(by[:last], key[:last], node[:last], shared[:last])
            held = [x[last:] for x in (by, key, node, shared)]
        yield found(*held)

    return dealt.mapInArrow(walk, "key long, node long")


def _candidates(docs: DataFrame, sizes: DataFrame, text_col: str) -> DataFrame:
    """(a, b): digests of sets that meet in an inverted list, as stars. ``sizes`` has (d1, n)."""
    keys = _shared(_entries(docs, text_col)).groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    n = F.col("n")
    length = n - F.ceil(n * PERCENT / 100) + 1
    own = F.least(n, F.floor(length * 3 / 2)) - F.size("keys")  # elements no other set has: these come first
    kept = keys.join(sizes, F.col("node") == F.col("d1")).withColumn("left", (length - own).cast("int")).where(
        F.col("left") > 0).select("node", F.explode(F.slice("keys", 1, F.col("left"))).alias("key"))
    return _met(kept)


def _met(kept: DataFrame) -> DataFrame:
    """(a, b): who meets on the lists of ``kept`` (node, key), as stars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield list_entries(batch.column("key").to_numpy(), np.arange(batch.num_rows), batch.column("node"))

    return stars(kept.mapInArrow(run, "key long, doc long, near long"))


def _rarest(sets: DataFrame) -> DataFrame:
    """(node, key): of each set its shingles that others of ``sets`` (d1, n, set) have, without the required(n) - 1 most frequent.

    With the shingles that only it has these are the first n - required(n) + 1 in an order that is the same for all sets.
    """
    entries = sets.select(F.col("d1").alias("node"), F.explode("set").alias("key"))
    shared = entries.withColumn("found", F.count("*").over(Window.partitionBy("key"))).where("found > 1")
    sizes = sets.select(F.col("d1").alias("node"), "n").distinct()
    place = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("found"), F.desc("key")))  # repeated rows count once
    return shared.join(sizes, "node").withColumn("place", place).where(
        F.col("place") >= F.ceil(F.col("n") * PERCENT / 100)).select("node", "key")


def search(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links within a block: for each set the weight of those linked with it, and the first of its group in the block.

    With ``side`` only sets of different sides are compared.
    """
    size = np.array([len(s) for s in sets])
    links, group = np.zeros(len(sets), np.int64), np.arange(len(sets))
    if len(sets) < 2:
        return links, group
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(value, kind="stable")  # lists hold documents in rising order
    value, posting = value[order], owner[order]
    head = np.append(True, value[1:] != value[:-1])
    start = np.append(np.flatnonzero(head), len(value))
    length = np.diff(start)
    of = np.empty(len(value), np.int32)
    of[order] = np.cumsum(head, dtype=np.int32) - 1  # the list of each element
    del order, owner, value, head
    bounds = np.append(0, np.cumsum(size))
    for q in range(len(sets)):
        n = size[q]
        need = required(int(n))
        lists = of[bounds[q]:bounds[q + 1]]
        lists = lists[length[lists] > 1]
        if not n or len(lists) < need:
            continue
        lists = lists[np.argsort(length[lists], kind="stable")]
        longest = int(need / (MU * np.log2(max(2, length[lists[-1]])) + 1))
        set_aside = min(need - 1, longest)
        short, long = lists[:len(lists) - set_aside], lists[len(lists) - set_aside:]
        count = np.bincount(np.concatenate([posting[start[x]:start[x + 1]] for x in short]), minlength=len(sets))
        found = np.flatnonzero(count >= need - set_aside)
        found = found[(found > q) & (size[found] * PERCENT <= 100 * n) & (100 * size[found] >= PERCENT * n)]
        if side is not None:
            found = found[side[found] != side[q]]
        hits = count[found]
        for done, x in enumerate(long):
            if not len(found):
                break
            entries = posting[start[x]:start[x + 1]]
            at = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
            hits = hits + (entries[at] == found)
            alive = hits + (set_aside - done - 1) >= need
            found, hits = found[alive], hits[alive]
        linked = found[100 * hits >= PERCENT * (n + size[found] - hits)]
        if len(linked):
            links[q] += weight[linked].sum()
            links[linked] += weight[q]
            if (group[linked] != group[q]).any():
                joined = distinct(np.append(group[linked], group[q]))
                group[np.isin(group, joined)] = joined[0]
    return links, group


def _cost() -> Column:
    return F.lit(1) + F.floor(F.col("n") / 1024)


def _chunks(grouped: DataFrame) -> DataFrame:
    """(d1, component, chunk, n): candidate groups cut by set size in chunks of about ``CHUNK``."""
    sizes = grouped.groupBy("component", "n").agg(F.sum(_cost()).alias("cost"))
    before = F.sum("cost").over(Window.partitionBy("component").orderBy("n")) - F.col("cost")
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = grouped.join(sizes.withColumn("before", before), ["component", "n"])
    return placed.select("d1", "component", F.floor((F.col("before") + share * F.col("cost")) / CHUNK).alias("chunk"), "n")


def _few(stored: DataFrame) -> DataFrame:
    """``stored``, a table of narrow rows, is sent to all tasks only when it is known to be small; else both sides of a join are shuffled."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def _sets(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``grouped`` with their sets, stored."""
    named = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def start():
        def compute(texts: list) -> tuple:
            sets = list(shingle_sets(texts))
            return sets, [_digest(s)[0] for s in sets]
        return compute

    sets = per_text(named.join(_few(grouped), "doc"), "text", grouped.columns, {"set": "longs", "is": "long"}, start)
    return durable(sets.where((F.col("is") == F.col("d1")) & (F.size("set") == F.col("n"))).drop("is"))


def _routes(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(d1, component, chunk, left, right, lone), stored: the blocks that each set of the wide groups goes to, a row for each block.

    A group that is still larger than a chunk has a block for each pair of chunks whose sizes allow a link.
    """
    met = components(_met(_rarest(sets)), "a", "b")
    nodes = met.unionByName(met.select(F.col("component").alias("node"), "component")).distinct()
    chunks = durable(_chunks(grouped.drop("component").join(nodes, F.col("d1") == F.col("node"))))
    spans = chunks.groupBy("component", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = spans.select("component", F.col("chunk").alias("left"), F.col("high").alias("left_high"))
    right = spans.select("component", F.col("chunk").alias("right"), F.col("low").alias("right_low"))
    pairs = left.join(right, "component").where(
        (F.col("left") <= F.col("right")) & (100 * F.col("left_high") >= PERCENT * F.col("right_low"))).select(
        "component", "left", "right")
    visits = pairs.withColumn("chunk", F.col("left")).unionByName(pairs.where("left <> right").withColumn("chunk", F.col("right")))
    lone = spans.groupBy("component").agg((F.count("*") == 1).alias("lone"))
    return durable(chunks.drop("n").join(visits, ["component", "chunk"]).join(lone, "component"))


def _searched(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, links, near), stored: what the blocks report of each class."""
    wide = grouped.groupBy("component").agg((F.sum(_cost()) > CHUNK).alias("wide"))  # larger than a chunk
    grouped = durable(grouped.join(wide, "component"))
    sets = _sets(docs, grouped, id_col, text_col)
    # a block for each pair of chunks; groups of one chunk may share blocks, as nothing links them
    dealt = sets.where("not wide").select("doc", "weight", "set", "component", *[
        F.lit(0).cast("long").alias(c) for c in ("chunk", "left", "right")], F.lit(True).alias("lone"))
    if grouped.where("wide").first() is not None:
        routes = _routes(grouped.where("wide"), sets.where("wide"))
        dealt = dealt.unionByName(sets.where("wide").select("doc", "weight", "d1", "set").join(_few(routes), "d1").drop("d1"))
    dealt = dealt.withColumn("key", F.xxhash64("component", "left", "right")).repartition("key").sortWithinPartitions(
        "key", "component", "left", "right", "doc")
    kind = sets.schema["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        total, now, cross, share = 0, None, False, True

        def report() -> pa.RecordBatch:
            firsts = {row[0]: row for row in reversed(block)}  # repeated rows of a document count once
            rows = sorted(firsts.values(), key=lambda r: len(r[2]))
            side = np.array([r[3] for r in rows]) if cross else None
            links, group = search([r[2] for r in rows], np.array([r[1] for r in rows]), side)
            met = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][0] for i in met], pa_kind), pa.array(links[met]),
                pa.array([rows[group[i]][0] for i in met], pa_kind)], ["doc", "links", "near"])

        for batch in batches:
            pa_kind = batch.column("doc").type
            columns = [batch.column(c).to_pylist() for c in ("component", "left", "right", "doc", "weight", "chunk", "lone")]
            values = batch.column("set")
            for i, (component, left, right, doc, weight, chunk, lone) in enumerate(zip(*columns)):
                if (component, left, right) != now:
                    if block and not (share and lone and total < 1_000_000):
                        yield report()
                        block, total = [], 0
                    now, cross, share = (component, left, right), left != right, lone
                s = values[i].values.to_numpy().copy()  # a view would keep the whole batch
                block.append((doc, weight, s, chunk))
                total += len(s)
        if block:
            yield report()

    return durable(dealt.select("component", "left", "right", "doc", "weight", "chunk", "lone", "set").mapInArrow(
        run, f"doc {kind.simpleString()}, links long, near {kind.simpleString()}"))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, n, d1, d2) of every row, and (n, d1, d2, rep, component, links) of every class that has an id; both stored."""
    profile = profiles(docs, id_col, text_col)
    classes = durable(profile.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep"), F.count("*").alias("weight")))
    known = classes.where(F.col("rep").isNotNull())
    groups = components(_candidates(docs, classes.select("d1", "n"), text_col), "a", "b")
    nodes = groups.unionByName(groups.select(F.col("component").alias("node"), "component")).distinct()
    grouped = known.join(nodes, F.col("d1") == F.col("node")).select(
        F.col("rep").alias("doc"), "weight", "n", "d1", "component")
    reported = _searched(docs, grouped, id_col, text_col)
    linked = components(reported, "doc", "near")
    counts = reported.groupBy("doc").agg(F.sum("links").alias("links"))
    per_class = known.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(
        counts.withColumnRenamed("doc", "rep"), "rep", "left").select(
        "n", "d1", "d2", "rep", F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return profile.select("doc", "n", "d1", "d2"), durable(per_class)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the own one included; ``n_links`` the number of other
    documents linked directly. Texts without words are linked with nothing. A row without an id counts as a copy of
    the documents with its set and has no component if there are none. Rows that share an id are one document of
    several texts. Other columns aren't looked at; an empty table gives an empty table.
    """
    rows, per_class = _classes(docs, id_col, text_col)
    return rows.join(per_class.drop("rep"), ["n", "d1", "d2"], "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the rows of ``docs`` with the smallest id, one row per id, with their columns.

    Rows without words stay. Of rows without an id those that copy a document with one go; of others with equal sets one stays.
    """
    rows, per_class = _classes(docs, id_col, text_col)
    placed = rows.where(F.col("doc").isNotNull()).join(per_class.drop("rep", "links"), ["n", "d1", "d2"], "left").groupBy("doc").agg(
        F.min(F.coalesce("component", "doc")).alias("component"), F.count("*").alias("rows"), F.max("n").alias("n"))
    stays = F.col("component") == F.col("doc")
    out_of = free_name(docs, "out__")
    gone = placed.where(~stays).select(F.col("doc").alias(out_of))
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col) == F.col(out_of), "left_anti")
    again = durable(placed.where(stays & (F.col("rows") > 1) & (F.col("n") > 0)).select(F.col("doc").alias(out_of)))
    if again.first() is not None:  # ids of several rows: one row of each
        same = F.col(id_col) == F.col(out_of)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col]))
    without = docs.where(F.col(id_col).isNull())

    def start():
        def compute(texts: list) -> tuple:
            sets = list(shingle_sets(texts))
            d = [_digest(s) for s in sets]
            return [len(s) for s in sets], [x[0] for x in d], [x[1] for x in d]
        return compute

    key = ["n", "d1", "d2"]
    names = [free_name(docs, f"{k}__") for k in key]
    hashed = per_text(without, text_col, docs.columns, dict.fromkeys(names, "long"), start)
    wordless, worded = hashed.where(F.col(names[0]) == 0), hashed.where(F.col(names[0]) > 0)
    known = per_class.select(*[F.col(k).alias(f"{n}_") for k, n in zip(key, names)])
    fresh = worded.join(known, [F.col(n) == F.col(f"{n}_") for n in names], "left_anti").dropDuplicates(names)
    return kept.unionByName(wordless.unionByName(fresh).select(*docs.columns))
