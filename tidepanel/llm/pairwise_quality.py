"""Quality scores learned from preference pairs: Bradley-Terry with linear document scores.

A text is described by a fixed set of counts and shares (``FEATURES``). Each labelled training row of either class is paired
with ``rivals`` rows of the other; the better one should win with probability 1 / (1 + exp(-w . (x_better - x_worse))).
Logistic loss on these feature differences with an L2 penalty gives w, and w . x ranks documents. The threshold is the
quantile of the training scores that leaves below it the share of rows labelled 0; a document's score is the logistic
function of its distance from the threshold, in units of a robust spread.

Features are computed in one pass over whole texts without a shuffle; the feature rows of at most ``most_rows`` labelled rows reach
the driver, where w is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks
from .labelled import training_rows
from .per_text import per_text
from .text import fold

FOLDS, HELD_OUT = 3, 1

FEATURES = ("log_words", "few_words", "word_length", "long_words", "upper", "digit", "symbol", "exclaim", "bar", "stop", "comma",
            "other_mark", "non_ascii", "line_length", "short_lines", "repeated_lines", "distinct_words", "top_word",
            "symbol_words", "marked_words", "repeated_pairs")

# byte classes: 0 others, 1 blank, 2 newline, 3 lower, 4 upper, 5 digit, 6 symbol, 7 '!', 8 '|', 9 '.', 10 ',', 11 beyond ASCII
_CLASS = np.zeros(256, np.int64)
for _code, _bytes in ((1, b" \t\r\x0b\x0c"), (2, b"\n"), (6, b"#*$%&<>@^~_=+{}[]\\/"), (7, b"!"), (8, b"|"), (9, b".?"), (10, b",;:")):
    _CLASS[list(_bytes)] = _code
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5, 11


def describe(texts: list) -> np.ndarray:
    """One row of ``FEATURES`` per text; null texts are empty ones."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, stop, raw, offsets in blocks(texts, before=b"", after=b"\n"):
        n = stop - first
        text = np.repeat(np.arange(n), np.diff(offsets))
        counts = np.bincount(text * 12 + _CLASS[raw], minlength=12 * n).reshape(n, 12).astype(float)
        data = raw.tobytes()
        words = np.zeros((n, 8))
        for i in range(n):
            words[i] = _word_counts(data[offsets[i]:offsets[i + 1]])
        n_words, lines = np.maximum(words[:, 0], 1), np.maximum(words[:, 1], 1)
        letters = counts[:, 3:12].sum(axis=1) + counts[:, 0]
        size = np.maximum(letters, 1)
        out[first:stop] = np.column_stack([
            np.log1p(words[:, 0]), words[:, 0] < 10, letters / n_words, words[:, 7] / n_words,
            counts[:, 4] / size, counts[:, 5] / size, counts[:, 6] / size, counts[:, 7] / size, counts[:, 8] / size,
            counts[:, 9] / n_words, counts[:, 10] / n_words, counts[:, 0] / size, counts[:, 11] / size,
            np.log1p(letters / lines), words[:, 2] / lines, words[:, 3] / lines, words[:, 4] / n_words, words[:, 5] / n_words,
            counts[:, 6] / n_words, (counts[:, 7] + counts[:, 8]) / n_words, words[:, 6] / n_words])
    return out


def _word_counts(text: bytes) -> tuple:
    """Words, lines, short lines, repeated lines, distinct words, uses of the most used word, repeats of the word
    before, words of more than 20 bytes."""
    words = text.split()
    if not words:
        return (0, 0, 0, 0, 0, 0, 0, 0)
    lines = [line for line in text.split(b"\n") if line.strip()]
    distinct = set(words)
    uses = {}
    for w in words:
        uses[w] = uses.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    return (len(words), len(lines), sum(len(x) < 30 for x in lines), len(lines) - len(set(lines)), len(distinct),
            max(uses.values()), len(words) - 1 - len(pairs), sum(len(w) > 20 for w in words))


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    unit: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a matrix product's last bits depend on the other rows of the batch
        weighted = (np.clip((x - self.mean) / self.spread, -8, 8) * self.weights).sum(axis=1)
        z = (weighted - self.threshold) / self.unit
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(x: np.ndarray, label: np.ndarray, rivals: int = 8, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights from pairs of a row labelled 1 and a row labelled 0, by Newton steps on the logistic loss."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    rng = np.random.default_rng(11)
    better = np.concatenate([np.repeat(good, rivals), rng.choice(good, len(bad) * rivals)])
    worse = np.concatenate([rng.choice(bad, len(good) * rivals), np.repeat(bad, rivals)])
    d = x[better] - x[worse]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability that the worse one wins
        gradient = penalty * w - d.T @ p / len(d)
        curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        move = np.linalg.solve(curvature, gradient)
        w -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        most_rows: int = 20_000) -> Ranking:
    """Learned from at most ``most_rows`` labelled rows outside the held-out fold.

    Without rows of both classes there is no pair: every text then scores the smoothed share of label 1.
    """
    sample = training_rows(docs, labels, label, FOLDS, HELD_OUT, most_rows, id_col, text_col)
    rows = per_text(sample, "text", ["doc", "label"], {"x": "doubles"}, lambda: lambda texts: (list(describe(texts)),)
                    ).orderBy("doc", "label", "x").toArrow()
    y = np.array(rows.column("label").to_pylist())
    if not (y == 1).any() or (y == 1).all():
        share = ((y == 1).sum() + 1) / (len(y) + 2)
        k = len(FEATURES)
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), -float(np.log(share / (1 - share))), 1.0)
    x = np.array([v.values.to_numpy() for v in rows.column("x")])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.clip((x - mean) / spread, -8, 8)
    w = bradley_terry(z, y)
    s = np.sort(z @ w)
    below = int((y != 1).sum())
    threshold = (s[below - 1] + s[below]) / 2
    unit = max(float(np.quantile(s, 0.75) - np.quantile(s, 0.25)) / 4, 1e-6)
    return Ranking(mean, spread, w, float(threshold), unit)


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row per row of ``docs``.

    Null texts are scored as empty ones; null ids and repeated rows are kept. Other columns aren't looked at; an
    empty table gives an empty table.
    """
    ranking = fit(docs, labels, id_col, text_col)
    scored = per_text(docs, text_col, [id_col], {"score": "double"}, lambda: lambda texts: (ranking.scores(describe(texts)),))
    return scored.select(id_col, (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
