"""Lists that users send: normal form, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, trim_space

MAX_ENTRIES, MAX_CHARS = 50, 100


def normalized(values: Column) -> Column:
    """Entries in lower case with single blanks, without empty ones and repeats, in order; null stays null."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(collapse_space(x))), lambda x: x != ""))


def within_caps(values: Column, entries: int = MAX_ENTRIES, chars: int = MAX_CHARS) -> Column:
    return (F.size(values) <= entries) & F.forall(values, lambda x: F.length(x) <= chars)


def country_codes(values: Column) -> Column:
    return F.transform(values, lambda x: F.upper(trim_space(x)))


def all_known(values: Column, known: Iterable[str]) -> Column:
    """Whether every entry is one of known; true for an empty list, false for a null entry."""
    return F.forall(values, lambda x: F.coalesce(x.isin(list(known)), F.lit(False)))


def whole_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("bigint")
