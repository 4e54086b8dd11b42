"""Small string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\f\x0b"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words, empty ones left out."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def last_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a one-character needle."""
    return F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A regular-expression group, or null when the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def one_of(text: Column, values) -> Column:
    return text.isin(*values)


def leaf_name(qualified: Column) -> Column:
    """The part after the last ``.``, ``/`` or ``:``."""
    return F.regexp_extract(qualified, r"([^./:]*)$", 1)


def line_at(text: Column, offset: Column) -> Column:
    """1-based line holding the 0-based character ``offset``."""
    return (count_of(F.substring(text, F.lit(1), offset.cast("int")), "\n") + 1).cast("long")
