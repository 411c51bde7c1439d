"""Aggregates that give the same digits whatever the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def exact_sum(c: Column | str) -> Column:
    """Sum of a measure as a double, added up in decimals: float sums depend on row order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,6)")).cast("double")


def rounded_avg(c: Column | str, digits: int) -> Column:
    """Mean rounded half up, divided in decimals so that ties round the same way each time."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast("decimal(18,6)")) / F.count(c), digits).cast("double")


def rounded_sum(c: Column | str, digits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast("decimal(18,6)")), digits).cast("double")
