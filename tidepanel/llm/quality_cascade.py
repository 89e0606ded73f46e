"""Quality rules as a short-circuit cascade, native.

A rule is an expression that is true for texts to reject. Rules are tried one after the other on a text and the first that
fails it ends the walk (a CASE expression, evaluated lazily). Their order is settled beforehand on a sample: each
rule runs by itself on the first ``sample_rows`` rows a scan meets, which gives its seconds per row and the share it
rejects; rules go by rejection per cost, highest first. The order changes how long the cascade takes, never a verdict: a text is kept if
no rule fails it.

Everything is an expression over one row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BLANK, let, whole, words

WINDOW = 5


def word_chars(w: Column) -> Column:
    """Code points in the words."""
    return F.length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    """Characters of ``#*$%&|<>``."""
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are compared by 64-bit hashes of their words. Most texts repeat none, which a distinct count tells.
    """
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = let(placed, lambda p: F.filter(p, lambda x, i: x["k"].eqNullSafe(F.get(p, i - 1)["k"])
                                               | x["k"].eqNullSafe(F.get(p, i + 1)["k"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total")),
            lambda s, i: F.struct(i.alias("last"), (s["total"] + F.least(F.lit(WINDOW), i - s["last"])).alias("total")),
            lambda s: s["total"])

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))


@dataclass(frozen=True)
class Rule:
    """``fails`` takes the text (never null) and its words."""

    name: str
    fails: Callable[[Column, Column], Column]


BASE_RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 10),
    Rule("repeated_words", lambda t, w: 100 * repeated_words(w) > 20 * F.size(w)),
)

RULES = (
    Rule("symbols", lambda t, w: 10 * symbols(t) > 3 * F.size(w)),
    Rule("exclamations", lambda t, w: 10 * (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("!")))) > 3 * F.size(w)),
    Rule("repeated_lines", lambda t, w: 10 * repeated_lines(t) > 3 * F.size(F.split(t, "\n"))),
    Rule("word_length", lambda t, w: (word_chars(w) < 2 * F.size(w)) | (word_chars(w) > 20 * F.size(w))),
    Rule("capitals", lambda t, w: 2 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > F.length(t)),
    Rule("digits", lambda t, w: 10 * F.length(F.regexp_replace(t, "[^0-9]+", "")) > 3 * F.length(t)),
    Rule("same_word_again", lambda t, w: 5 * F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))) > F.size(w)),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds_per_row: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds_per_row


def estimate(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = 200,
             repeats: int = 5) -> list[Estimate]:
    """Rules with their measured cost and selectivity, in the order in which the cascade should try them.

    A rule is evaluated ``repeats`` times on each sampled row and timed against the same scan with a rule that costs nothing. One flag per
    sampled row comes to the driver. Of rules worth the same the given order stays.
    """
    base = docs.select(whole(text_col).alias("text"))

    def timed(fails: Callable[[Column, Column], Column]) -> tuple[float, list]:
        again = F.aggregate(F.sequence(F.lit(1), F.lit(repeats)), F.lit(0),
                            lambda n, i: n + F.when((i > 0) & fails(F.col("text"), F.col("words")), 1).otherwise(0))
        flags = base.select("text", words(F.col("text")).alias("words")).select(
            (F.size("words") + F.length("text") >= 0).alias("scan"), (again > 0).alias("fails"))
        seconds = []
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            rows = flags.take(sample_rows)
            seconds.append(time.perf_counter() - start)
        return min(seconds), rows

    scan, _ = timed(lambda t, w: F.size(w) < 0)
    out = []
    for rule in rules:
        seconds, rows = timed(rule.fails)
        n = max(1, len(rows))
        out.append(Estimate(rule, max((seconds - scan) / (n * repeats), 1e-7), (sum(r["fails"] for r in rows) + 0.5) / (n + 1)))
    return sorted(out, key=lambda e: -e.worth)


def passes(text: Column, w: Column, rules: Sequence[Rule]) -> Column:
    """Whether no rule fails a text; rules are tried in the given order until one does."""
    walk = F.lit(True)
    for rule in reversed(rules):
        walk = F.when(rule.fails(text, w), False).otherwise(walk)
    return walk


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
             sample_rows: int = 200) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row per row of ``docs``.

    ``kept`` is false where base_failed; else no rule of the cascade fails the text. Null and empty texts have no
    words and fail. Null ids and repeated rows are kept. Other columns aren't looked at; an empty table gives an empty
    table.
    """
    ordered = [e.rule for e in estimate(docs, rules, text_col, sample_rows)]
    text = whole(text_col)

    def measured(w: Column) -> Column:
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), symbols(text).alias("n_symbols"),
            repeated_lines(text).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"))
        return let(counts, lambda c: judged(w, c))

    def judged(w: Column, c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return F.struct(
            *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"), F.when(failed, False).otherwise(passes(text, w, ordered)).alias("kept"))

    return docs.select(F.col(id_col), let(words(text), measured).alias("judged__")).select(id_col, "judged__.*")


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES,
              sample_rows: int = 200) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their columns."""
    ordered = [e.rule for e in estimate(docs, rules, text_col, sample_rows)]
    text = whole(text_col)
    return docs.where(let(words(text), lambda w: passes(text, w, ordered)))
