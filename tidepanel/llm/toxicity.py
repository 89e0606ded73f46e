"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the distinct 4-, 6- and 8-grams of a text's code points (in lower case, a blank on each side), hashed to ``1 << BITS``
buckets. On the labelled sample each bucket's number of toxic and of clean documents gives its log-count ratio r = log((p + 1) / |p|)
- log((q + 1) / |q|). The buckets whose counts differ most by their share of the classes (chi-squared) become features with value r
where present; logistic regression with an L2 penalty weighs them. A score is the logistic function of the weighted sum.

Counts are summed by Spark over the sample; only the chosen buckets and, per sample row, which of them it has reach the
driver, both bounded by ``most_rows`` and ``most_features``. Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, distinct
from .labelled import training_rows
from .per_text import per_text, slices, text_value
from .text import fold

ORDERS, BITS, _BASE = (4, 6, 8), 22, np.uint64(257)
FOLDS, HELD_OUT = 5, 0


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # chosen features, in rising order
    weights: np.ndarray  # ratio times coefficient of each
    intercept: float


def grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n-gram that starts at each code point; the last n - 1 have none.

    The difference of two sums of code point * base ** -place, moved back to the n-gram's place, is its polynomial hash.
    """
    size = len(raw)
    up = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE)))
    down = np.cumprod(np.append(np.uint64(1), np.full(size, np.uint64(pow(int(_BASE), -1, 1 << 64)))))
    sums = np.append(np.uint64(0), np.cumsum(raw * down[:size]))
    for n in ORDERS:
        if size >= n:
            h = (sums[n:] - sums[:-n]) * up[:size - n + 1]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            yield n, (h >> np.uint64(64 - BITS)).astype(np.int64)


def present(texts: list, chosen: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: first, stop, and the distinct (text of the block, bucket) pairs as two arrays.

    ``chosen`` marks the buckets that count; without it all do.
    """
    for first, stop, raw, offsets in blocks([t and t.lower() for t in texts], points=True):
        keys, owner = [], np.repeat(np.arange(stop - first), np.diff(offsets))
        for n, h in grams(raw):
            at = np.arange(len(h)) if chosen is None else np.flatnonzero(chosen[h])
            text = owner[at]
            inside = at + n <= offsets[text + 1]  # n-grams don't reach into the next text
            keys.append((text[inside] << BITS) + h[at[inside]])
        key = distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield first, stop, key >> BITS, key & ((1 << BITS) - 1)


def _class_counts(sample: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): documents of the sample that have the bucket, by class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            for a, b in slices(batch.column("text")):
                label = labels[a:b]
                for first, stop, text, bucket in present(batch.column("text").slice(a, b - a).to_pylist()):
                    toxic = label[first:stop][text] == 1
                    for side, met in ((1, bucket[toxic]), (0, bucket[~toxic])):
                        at, n = np.unique(met, return_counts=True)
                        counts[side, at] += n.astype(np.int32)
        met = np.flatnonzero(counts.any(axis=0))
        for part in np.array_split(met, max(1, len(met) >> 16)):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part].astype(np.int64)),
                                              pa.array(counts[0, part].astype(np.int64))], ["bucket", "toxic", "clean"])

    parts = sample.mapInArrow(run, "bucket long, toxic long, clean long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def logistic(rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, penalty: float = 1.0, steps: int = 250
             ) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a penalised logistic regression; a row lists its features, each worth its ratio."""
    sizes = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(len(ratio)), float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    value = ratio[column]
    for step in range(1, steps + 1):  # Adam over the whole sample
        z = np.bincount(row, value * w[column], len(rows)) + b
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        g = np.append(np.bincount(column, value * d[row], len(ratio)) + penalty * w, d.sum()) / max(1, len(rows))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
        most_rows: int = 16_000, most_features: int = 8192) -> Model:
    """Learned from at most ``most_rows`` labelled rows outside the held-out fold.

    Without labelled rows every text scores near 0; with one class only, its smoothed share.
    """
    sample = training_rows(docs, labels, label, FOLDS, HELD_OUT, most_rows, id_col, text_col)
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    if not toxic or not clean:
        prior = np.log((toxic + 1) / (clean + 1)) if totals else -20.0
        return Model(np.zeros(0, np.int64), np.zeros(0), float(prior))
    p, q = F.col("toxic"), F.col("clean")
    both, rest = p + q, toxic + clean - p - q
    differs = F.abs(p * clean - q * toxic).cast("double")
    chosen = _class_counts(sample).where((both >= 5) & (rest >= 1)).withColumn(
        "chi2", differs * differs / (both * rest).cast("double")).orderBy(F.desc("chi2"), "bucket").limit(most_features).collect()
    chosen.sort(key=lambda r: r["bucket"])
    buckets = np.array([r["bucket"] for r in chosen], np.int64)
    p1, q1 = (np.array([r[c] for r in chosen], float) + 1 for c in ("toxic", "clean"))
    ratio = np.log(p1 / p1.sum()) - np.log(q1 / q1.sum())

    def start():
        table = np.zeros(1 << BITS, bool)
        table[buckets] = True

        def features(texts: list) -> tuple[list]:
            out = []
            for first, stop, text, bucket in present(texts, table):
                ends = np.searchsorted(text, np.arange(stop - first + 1))
                places = np.searchsorted(buckets, bucket).astype(np.int32)
                out += [places[a:b] for a, b in zip(ends, ends[1:])]
            return (out,)

        return features

    matrix = per_text(sample, "text", ["doc", "label"], {"features": "ints"}, start).toArrow().combine_chunks()
    matrix = matrix.take(pc.sort_indices(matrix.column("doc")))  # the same sums on every run
    rows = [np.asarray(x.values, np.int64) for x in matrix.column("features")]
    w, b = logistic(rows, ratio, (np.array(matrix.column("label").to_pylist()) == 1).astype(float))
    return Model(buckets, ratio * w, b)


def score(docs: DataFrame, model: Model, carried: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The ``carried`` columns and the probability that a text is toxic; null texts score as empty ones."""
    return docs.select(*[F.col(c) for c in carried], probability(F.col(text_col), model).alias(name))


def probability(text: Column, model: Model) -> Column:
    """The probability that a text is toxic, as a column."""
    def start():
        table = np.zeros(1 << BITS, bool)
        table[model.buckets] = True

        def scores(texts: list) -> np.ndarray:
            z = np.full(len(texts), model.intercept)
            for first, stop, text, bucket in present(texts, table):
                w = model.weights[np.searchsorted(model.buckets, bucket)] if len(bucket) else np.zeros(0)
                z[first:stop] += np.bincount(text, w, stop - first)
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return scores

    return text_value(text, "double", start)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``.

    Null and empty texts get the score of a text without features; null ids and repeated rows are kept. Other
    columns aren't looked at; an empty table gives an empty table.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = score(docs, model, [id_col], text_col)
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns."""
    from .text import free_name

    name = free_name(docs, "toxicity__")
    return score(docs, fit(docs, labels, id_col, text_col), docs.columns, text_col, name).where(
        F.col(name) < 0.5).select(*docs.columns)
