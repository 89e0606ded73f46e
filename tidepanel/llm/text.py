"""Column expressions the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\f\r"
BLANKS = r"[ \t-\r]+"


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of other characters than space, tab, newline, vertical tab, form feed and return."""
    inner = F.trim(text, F.lit(BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))


def word_count(text: Column) -> Column:
    """How many ``words`` a text has."""
    inner = F.trim(text, F.lit(BLANK))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, BLANKS))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and only if the result is asked for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
