"""Rounding, rates and lookups shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, names: dict[str, str]) -> Column:
    """The label of a key, or the key itself where there is none."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), key)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, NULL where there is nothing to divide by."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def count_if(test: Column) -> Column:
    return F.count(F.when(test, 1))
