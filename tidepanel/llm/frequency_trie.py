"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

1. Words are counted per text and batch, then summed; a common word is one row per batch.
2. Code points fall in ``GROUPS`` groups; a word's vector has its number of code points of each group. Inserting one raises
   one count by one, deleting lowers one, replacing does both (or neither, within a group). So of two words an edit
   apart at most one count of the vectors is higher and at most one lower, each by one.
3. The trie arranges words by their counts, a level per group. Its upper ``levels`` are dealt out: a branch is the words of equal
   first counts, in pieces of about ``PIECE`` words, and each word is sent to the branches that it reaches with a surplus and a
   deficit of one, along with what is left of them; of two branches that reach each other only one is sent to. A task
   builds the rest of the trie of its piece and searches depth first, all words sent there at once: at a node each goes on
   to the children whose count differs by what it has left. Nodes of few words are leaves, whose remaining counts are compared as they are.
4. Pairs in the leaves reached are verified, in blocks of bounded size. A task reports per word, sent or of the piece, how many are
   near it and the most frequent one, never pairs.

Levels are as many as it takes to make branches of at most ``PIECE`` words, up to ``MOST_LEVELS``; larger branches have several pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

GROUPS, MOST_LEVELS, PIECE = 10, 4, 4096
# Groups of about equal weight in prose, the letters of one group being rarely replaced by each other.
LETTERS = ("ex", "tbq", "agv", "oyz", "inj", "hsw", "rmk", "ldp", "cuf")
LEAST_LENGTH, LEAST_COUNT, TIMES, ONE_IN = 6, 5, 5, 199
PAIRS = 1 << 16
WIDE = 64  # longer words are compared one by one
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BATCH_CHARS = 1 << 22


def _changed(run: str, head: int) -> str:
    """The run, without one of its code points where its checksum says so; ``head`` is the checksum of what goes before it."""
    h = zlib.crc32(run.encode(), head)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words_of(doc: str, text: str) -> Counter:
    """How often each word of a text occurs, of at least ``LEAST_LENGTH`` code points."""
    runs = Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    head, out = zlib.crc32(f"{doc}:".encode("utf-8", "surrogatepass")), Counter()
    for run, n in runs.items():
        if len(run) >= LEAST_LENGTH:
            word = _changed(run, head)
            if len(word) >= LEAST_LENGTH:
                out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n), stored: words of all texts that occur at least ``LEAST_COUNT`` times."""
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chars = Counter(), 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text")):
                text = text.as_py()
                counts.update(words_of(doc.as_py(), text))
                chars += len(text)
                if chars >= _BATCH_CHARS:
                    yield made()
                    counts, chars = Counter(), 0
        yield made()

    parts = named.mapInArrow(run, "word string, n long")
    return durable(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def group_counts(word: Column) -> Column:
    """The vector of a word: its code points in each group of letters, the last one having all others."""
    size = F.length(word)
    known = [size - F.length(F.translate(word, letters, "")) for letters in LETTERS]
    return F.array(*known, size - sum(known, F.lit(0))).cast("array<int>")


def _routes(levels: int) -> list[tuple[list[int], int, int]]:
    """Changes of the first ``levels`` counts that cost at most a surplus and a deficit of one, and what is left of both.

    Of a change and its opposite only the one that begins with a surplus.
    """
    out = []
    for up in range(-1, levels):
        for down in range(-1, levels):
            if up != down or up < 0:
                change = [0] * levels
                for at, by in ((up, 1), (down, -1)):
                    if at >= 0:
                        change[at] = by
                if next((x for x in change if x), 1) > 0:
                    out.append((change, int(up < 0), int(down < 0)))
    return out


class Words:
    """The words of a piece: code points, lengths and counts, in the order of their vectors."""

    def __init__(self, words: list[str], n: np.ndarray, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(words))
        self.words, self.n, self.vectors = [words[i] for i in order], n[order], vectors[order]
        self.codes, self.size = coded(self.words)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first ``WIDE`` code points of each word, 0 beyond its end, and the lengths; code points are below 256."""
    size = np.array([len(w) for w in words], np.int64)
    width = int(min(WIDE, size.max(initial=0))) + 1
    raw = b"".join(w[:WIDE].encode("latin-1").ljust(width, b"\0") for w in words)
    return np.frombuffer(raw, np.uint8).reshape(len(words), width), size


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word of the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of what both begin with
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) >= len(b)):] == b[low + (len(b) >= len(a)):]


def near(one: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """``one_edit`` for rows of code points, of words of at most ``WIDE``."""
    width = max(one.shape[1], other.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width + 1 - x.shape[1]))) for x in (one, other))
    swap = size > other_size
    a[swap], b[swap] = b[swap], a[swap].copy()  # a is the shorter one
    differs = a[:, :width] != b[:, :width]
    same = size == other_size
    begin = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    after = np.arange(width)[None, :] > begin[:, None]
    shifted = (a[:, :width] != b[:, 1:width + 1]) & (np.arange(width)[None, :] >= begin[:, None])
    return np.where(same, differs.any(axis=1) & ~(differs & after).any(axis=1), (abs(size - other_size) == 1) & ~shifted.any(axis=1))


def reached(vectors: np.ndarray, asked: np.ndarray, up: np.ndarray, down: np.ndarray, few: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(searches, rows) leaf by leaf: the rows of ``vectors`` (sorted) that a search reaches with what it has left."""
    levels = vectors.shape[1]
    todo = [(0, 0, len(vectors), np.arange(len(asked)), up, down)]
    while todo:
        level, first, last, who, up, down = todo.pop()
        if not len(who) or first == last:
            continue
        if level == levels or last - first <= few:
            for part in np.array_split(np.arange(len(who)), -(-len(who) * (last - first) // PAIRS)):
                surplus, deficit = np.zeros((2, len(part), last - first), np.int64)
                for k in range(level, levels):
                    off = vectors[first:last, k][None, :] - asked[who[part], k][:, None]
                    surplus += np.maximum(off, 0)
                    deficit -= np.minimum(off, 0)
                i, row = np.nonzero((surplus <= up[part][:, None]) & (deficit <= down[part][:, None]))
                yield who[part[i]], first + row
            continue
        counts = vectors[first:last, level]
        starts = np.append(0, np.flatnonzero(counts[1:] != counts[:-1]) + 1)
        for a, b in zip(starts, np.append(starts[1:], len(counts))):
            off = counts[a] - asked[who, level]
            on = ((off >= -1) & (off <= 1) & ((off != 1) | (up > 0)) & ((off != -1) | (down > 0)))
            todo.append((level + 1, first + int(a), first + int(b), who[on], (up - (off == 1))[on], (down - (off == -1))[on]))


def searched(piece: Words, words: list[str], vectors: np.ndarray, n: np.ndarray, up: np.ndarray, down: np.ndarray, both: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``words`` the number of words of the piece that are near and the place of the most frequent one (-1: none);
    for each word of the piece the same of those ``words`` that are marked ``both``."""
    codes, size = coded(words)
    count, top, back_count, back_top = (np.full(len(x), y) for x in (words, piece.words) for y in (0, -1))
    value, back = best_first(piece.words, piece.n), best_first(words, n)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def verify() -> None:
        search, row = (np.concatenate(x) for x in zip(*held))
        held.clear()
        fit = np.abs(size[search] - piece.size[row]) <= 1
        search, row = search[fit], row[fit]
        long = (size[search] > WIDE) | (piece.size[row] > WIDE)
        ok = np.zeros(len(search), bool)
        ok[~long] = near(codes[search[~long]], size[search[~long]], piece.codes[row[~long]], piece.size[row[~long]])
        for i in np.flatnonzero(long):
            ok[i] = one_edit(words[search[i]], piece.words[row[i]])
        search, row = search[ok], row[ok]
        np.add.at(count, search, 1)
        np.maximum.at(top, search, value[row])
        search, row = search[both[search]], row[both[search]]
        np.add.at(back_count, row, 1)
        np.maximum.at(back_top, row, back[search])

    total = 0
    for search, row in reached(piece.vectors, vectors, up, down):
        held.append((search, row))
        total += len(search)
        if total >= PAIRS:
            verify()
            total = 0
    if held:
        verify()
    return count, _undone(value, top), back_count, _undone(back, back_top)


def best_first(words: list[str], n: np.ndarray) -> np.ndarray:
    """A number for each word, larger for larger ``n`` and, among equal ones, for those earlier in code-point order."""
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    value = np.empty(len(words), np.int64)
    value[np.lexsort((-place, n))] = np.arange(len(words))
    return value


def _undone(value: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The places of the numbers ``top`` in ``value``; -1 stays."""
    place = np.empty(len(value) + 1, np.int64)
    place[value], place[-1] = np.arange(len(value)), -1
    return place[top]


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of the words (word, n): how many are one edit away, and the most frequent of them."""
    words = durable(vocabulary.withColumn("vector", group_counts(F.col("word"))))
    levels = 1
    while levels < MOST_LEVELS and (words.groupBy(F.slice("vector", 1, levels)).count().agg(F.max("count")).first()[0] or 0) > PIECE:
        levels += 1
    head, rest = F.slice("vector", 1, levels), F.slice("vector", levels + 1, GROUPS - levels)
    # one row per branch, of which there are as many as vectors of ``levels`` counts
    sizes = words.groupBy(head.alias("branch")).agg(F.count("*").alias("size")).select(
        "branch", F.ceil(F.col("size") / PIECE).cast("int").alias("pieces"))
    placed = words.select(head.alias("branch"), "word", "n", rest.alias("rest")).join(sizes, "branch").select(
        "branch", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int").alias("piece"), "word", "n", "rest")
    options = F.array(*[F.struct(F.array(*map(F.lit, change)).alias("change"), F.lit(up).alias("up"), F.lit(down).alias("down"))
                        for change, up, down in _routes(levels)])
    moves = F.exists("route.change", lambda x: x != 0)  # else a word and its like are both sent, each to the other
    sent = words.select("word", "n", head.alias("head"), rest.alias("rest"), F.explode(options).alias("route")).select(
        F.zip_with("head", "route.change", lambda a, b: a + b).alias("branch"), "word", "n", "rest", "route.up", "route.down", moves.alias("both")).join(
        sizes, "branch").select("branch", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "word", "n", "rest", "up", "down", "both")

    sent = sent.toDF(*sent.columns)  # columns of its own, as both sides come from one table

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.array(column.to_pylist(), np.int64).reshape(len(column), GROUPS - levels)

    def run(key: tuple, mine: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["word", "near", "form", "form_n"]
        if not len(mine) or not len(asked):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names)
        piece = Words(mine.column("word").to_pylist(), mine.column("n").to_numpy(), matrix(mine.column("rest")))
        words, n = asked.column("word").to_pylist(), asked.column("n").to_numpy()
        left = (asked.column(c).to_numpy().astype(np.int64) for c in ("up", "down"))
        count, best, back_count, back_best = searched(piece, words, matrix(asked.column("rest")), n, *left, asked.column("both").to_numpy(zero_copy_only=False))
        met, back = np.flatnonzero(count), np.flatnonzero(back_count)
        return pa.table([pa.array([words[i] for i in met] + [piece.words[i] for i in back], pa.string()),
                         pa.array(np.concatenate((count[met], back_count[back]))),
                         pa.array([piece.words[i] for i in best[met]] + [words[i] for i in back_best[back]], pa.string()),
                         pa.array(np.concatenate((piece.n[best[met]], n[back_best[back]])))], names)

    found = placed.groupBy("branch", "piece").cogroup(sent.groupBy("branch", "piece")).applyInArrow(
        run, "word string, near long, form string, form_n long")
    best = F.min_by("form", F.struct(-F.col("form_n"), "form"))
    merged = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.max("form_n").alias("form_n"), best.alias("form"))
    return words.select("word", "n").join(merged, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where following forms from a word ends. Forms must not go round in circles.

    Each round doubles the steps taken; a form is ``TIMES`` as frequent as its word, so few rounds are enough.
    """
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    Words are the runs ``[A-Za-zÀ-ÿ]+`` of all texts, with A-Z in lower case; where ``ONE_IN`` divides the crc32 of ``id:run``, the code
    point at that checksum modulo the length is left out. Those of at least ``LEAST_LENGTH`` code points with at least ``LEAST_COUNT``
    occurrences (n) count. ``n_near`` is the number of words one edit away, ``form`` the most frequent of them (ties: the first by
    code points) if it is at least ``TIMES`` as frequent as the word, with ``form_n`` occurrences; ``root`` is where forms lead.
    Null texts have no words; a null id counts as an empty one; repeated rows count each time. Other columns aren't looked
    at; an empty table gives an empty table.
    """
    found = neighbours(vocabulary(docs, id_col, text_col))
    fits = F.col("form_n") >= TIMES * F.col("n")
    out = durable(found.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
